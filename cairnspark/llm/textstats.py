"""Per-text counts that the quality operators share, vectorised over byte buffers.

Null and empty texts have zero in every count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from . import textbytes as tb

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_lower", "n_digits", "n_bang", "n_pipe", "n_punct", "n_wide", "n_ended_lines"]


def counts_of(buf, offs) -> dict:
    """Arrays of :data:`COUNTS` for texts that lie one after the other in ``buf`` (offsets from 0)."""
    import numpy as np

    n = len(offs) - 1
    h, start, end, bounds = tb.words(buf, offs)
    line_h, line_start, line_end, line_bounds = tb.words(buf, offs, _LINES())
    doc_of = np.repeat(np.arange(n), np.diff(bounds))

    def total(mask):
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offs])

    def kind(chars: bytes):
        t = np.zeros(256, bool)
        t[list(chars)] = True
        return total(t[buf])

    out = {"n_words": np.diff(bounds)}
    out["word_chars"] = total(tb.SPACE_WORDS[buf] & ((buf & 0xC0) != 0x80))
    out["n_symbols"] = kind(b"#*$%&|<>")
    # lines that have a word; equal ones by hash within a text
    worded = np.searchsorted(start, line_end, "left") > np.searchsorted(start, line_start, "left")
    line_doc = np.repeat(np.arange(n), np.diff(line_bounds))[worded]
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(_distinct(line_h[worded], line_doc), minlength=n)
    closing = np.zeros(256, bool)
    closing[list(b'.!?:;"')] = True
    out["n_ended_lines"] = np.bincount(line_doc[closing[buf[line_end[worded] - 1]]], minlength=n)
    out["n_distinct_words"] = np.bincount(_distinct(h, doc_of), minlength=n)
    out["n_repeat_words"] = np.zeros(n, np.int64)
    if len(h) >= 3:
        w = tb.windows(h, 3)
        inside = doc_of[2:] == doc_of[:-2]
        at = np.flatnonzero(inside)
        key = w[at] ^ tb.mix(doc_of[at].astype(np.uint64) + np.uint64(1))
        _, inverse, seen = np.unique(key, return_inverse=True, return_counts=True)
        again = at[seen[inverse] > 1]
        hit = np.zeros(len(h), bool)
        for k in range(3):
            hit[again + k] = True
        out["n_repeat_words"] = np.bincount(doc_of[hit], minlength=n)
    out["n_upper"] = kind(bytes(range(65, 91)))
    out["n_lower"] = kind(bytes(range(97, 123)))
    out["n_digits"] = kind(bytes(range(48, 58)))
    out["n_bang"], out["n_pipe"] = kind(b"!"), kind(b"|")
    out["n_punct"] = kind(b".,;:?'\"()-")
    # upper-case letters of the Latin-1 and Latin Extended-A blocks follow 0xC3
    lead = np.zeros(len(buf), bool)
    lead[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    out["n_upper"] = out["n_upper"] + total(lead)
    out["n_wide"] = total((buf & 0xC0) == 0xC0)
    return out


def _LINES():
    return tb.separators([(0x0A, 0x0A)])


def _distinct(h, doc):
    """The text of each distinct (text, hash)."""
    import numpy as np

    _, first = np.unique(h ^ tb.mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)
    return doc[first]


def text_counts(docs: DataFrame, text: Column | tuple[str, str], keep: dict[str, Column]) -> DataFrame:
    """The columns ``keep`` (name to column) and :data:`COUNTS` (long) of every whole text.

    ``text`` is a column, or a struct of ``keep`` and the field in it: then the text travels once.
    """
    names, inside = [*keep, *COUNTS], text if isinstance(text, tuple) else None
    skip = inside is None

    def run(batches):
        import pyarrow as pa

        for b in batches:
            buf, offs = tb.buffers(b.column(0) if skip else b.column(names.index(inside[0])).field(inside[1]))
            for i, j in tb.groups(offs):
                part = counts_of(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([*[b.column(k + skip).slice(i, j - i) for k in range(len(names) - len(COUNTS))], *[pa.array(part[c], pa.int64()) for c in COUNTS]], names=names)

    texts = docs.select(*([text.alias("text")] if skip else []), *[c.alias(k) for k, c in keep.items()])
    schema = T.StructType([*[T.StructField(k, f.dataType) for k, f in zip(keep, texts.schema.fields[skip:])], *[T.StructField(c, T.LongType()) for c in COUNTS]])
    return texts.mapInArrow(tb.tidied(run), schema)
