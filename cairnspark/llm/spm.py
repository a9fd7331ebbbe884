"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model protobuf is parsed (:mod:`spm_model`), and normaliser, metaspace
marker, piece scores (unigram) or merges (BPE) and byte fallback are rebuilt as
a tokenizers pipeline.  Batches are encoded by the library's thread pool
(``threads``) and their ids are compared with those of the sentencepiece library.

A BPE model whose pieces never hold the marker after another character cannot
merge across a word start, and ties are broken from the left, so the ids of a
text are those of its words one after the other.  For such a model the pipeline
encodes each distinct word once a process and keeps its ids in a memo bounded in
bytes; other models have whole texts encoded.  ``verify`` says what `parity`
compares: "words" (each word that is encoded, by both libraries; a text has
parity if all of its words have), "texts" (the whole text, encoded by
sentencepiece as it stands) or None.  For other models both mean whole texts.
Pieces decode to their bytes; ids that are no valid UTF-8 go to the library.

Defined results: null and empty texts have no ids; a text that holds the marker
itself decodes to a space there, as in sentencepiece, and `round_trip` is false
for it; a very long text is encoded whole, alone in its call; words of over
:data:`LONG` characters (texts without spaces) are encoded whole, never kept;
equal scores are joined from the left, as both libraries do; repeated rows
repeat; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from array import array

from pyspark.sql import DataFrame

from .common import named
from .spm_model import BPE, BYTE, CONTROL, MARK, UNIGRAM, UNKNOWN, USER_DEFINED, Model, parse_model
from .textbytes import tidied

#: Texts a call of encode_batch gets: about this many characters.
CALL_CHARS = 1 << 20
#: Bytes of a process's memo of words, about; it restarts when larger.  Longer words than LONG are not kept.
MEMO_BYTES, LONG = 64 << 20, 64
#: What a kept word costs beside its characters and ids: two objects and a place in a table.
MEMO_ROW = 180


def merges_of(model: Model) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Vocabulary and merges, best score first, of a BPE model.

    sentencepiece joins the neighbours whose join is the best-scored piece, so
    each way to cut a piece into two pieces is a merge of that piece's rank.
    """
    vocab = {p.text: i for i, p in enumerate(model.pieces)}
    usable = {p.text: i for i, p in enumerate(model.pieces) if p.kind not in (UNKNOWN, CONTROL, BYTE)}
    ranked = []
    for text, i in usable.items():
        for cut in range(1, len(text)):
            a, b = text[:cut], text[cut:]
            if a in usable and b in usable:
                ranked.append((-model.pieces[i].score, usable[a], usable[b], a, b))
    ranked.sort()
    return vocab, [(a, b) for *_, a, b in ranked]


def build_tokenizer(model: Model, by_word: bool = False):
    """A tokenizers.Tokenizer that encodes and decodes as the model does; ``by_word``: the caller remembers words itself."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unk = model.pieces[model.unk_id].text
    if model.model_type == UNIGRAM:
        t = Tokenizer(models.Unigram([(p.text, p.score) for p in model.pieces], model.unk_id, model.byte_fallback))
    elif model.model_type == BPE:
        vocab, merges = merges_of(model)
        t = Tokenizer(models.BPE(vocab, merges, unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0 if by_word else 100_000))
        if not by_word and not any(MARK in p.text.lstrip(MARK) for p in model.pieces):
            t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    else:
        raise ValueError("only unigram and BPE models are supported")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    chain = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence(chain + [decoders.Strip(" ", 1, 0)] * model.add_dummy_prefix)
    t.add_tokens([AddedToken(p.text, normalized=False) for p in model.pieces if p.kind == USER_DEFINED])
    return t


class Coder:
    """Encodes and decodes batches of texts for one model."""

    def __init__(self, data: bytes, threads: int, verify: str | None):
        import sentencepiece

        model = parse_model(data)
        self.threads, self.verify = threads, verify
        self.exact = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.by_word = model.model_type == BPE and model.add_dummy_prefix and model.escape_whitespaces and not (model.charsmap or model.remove_extra_whitespaces) and MARK in model.names and not any(MARK in p.text.lstrip(MARK) or p.kind == USER_DEFINED for p in model.pieces)
        self.library = build_tokenizer(model, self.by_word)
        self.alone = {"": _packed([model.names[MARK]])} if self.by_word else {}
        self.memo: dict[str, bytes] = dict(self.alone)
        self.held = 0
        self.odd: set[str] = set()
        self.bytes_of = [bytes([int(p.text[3:5], 16)]) if p.kind == BYTE else p.text.replace(MARK, " ").encode() for p in model.pieces] if self.by_word else []

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids if t else [] for e, t in zip(self.library.encode_batch_fast(texts, add_special_tokens=False), texts)]

    def _reference(self, texts: list[str]) -> list[list[int]]:
        return self.exact.encode(texts, num_threads=self.threads)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool | None]]:
        """Ids (packed int32) of each text, and whether the sentencepiece library has the same (None: not verified)."""
        if not self.by_word:
            ids = self._whole(texts)
            return list(map(_packed, ids)), [a == b for a, b in zip(ids, self._reference(texts))] if self.verify else [None] * len(texts)
        memo = self.memo
        if self.held > MEMO_BYTES:
            memo.clear()
            memo.update(self.alone)
            self.odd.clear()
            self.held = 0
        cut = [_words(t) for t in texts]
        new = list({w for words in cut for w in words if w not in memo})
        got = self._whole(new)
        for w, ids in zip(new, got):
            memo[w] = _packed(ids)
        if self.verify == "words":
            self.odd.update(w for w, a, b in zip(new, got, self._reference(new)) if a != b)
        look = memo.__getitem__
        out = [b"".join(map(look, words)) for words in cut]
        if self.verify == "texts":
            same = [a == _packed(b) for a, b in zip(out, self._reference(texts))]
        else:
            same = [None if not self.verify else not self.odd or self.odd.isdisjoint(words) for words in cut]
        for w in new:
            if len(w) > LONG:
                del memo[w]
            else:
                self.held += MEMO_ROW + len(w) + len(memo[w])
        return out, same

    def decode(self, packed: list[bytes]) -> list[str]:
        ids = [memoryview(x).cast("i").tolist() for x in packed]
        if not self.by_word:
            return self.library.decode_batch(ids, skip_special_tokens=False)
        look, out = self.bytes_of.__getitem__, []
        for x in ids:
            try:
                out.append(b"".join(map(look, x)).decode()[1:])
            except UnicodeDecodeError:
                out.append(self.library.decode(x, skip_special_tokens=False))
        return out


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def _words(text: str) -> list[str]:
    """The text's words, each with the spaces before it but the first."""
    text = text.replace(MARK, " ")
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return [w[1:] for w in re.findall(" +[^ ]+| +", " " + text)] if text else []
    return text.split(" ") if text else []


def encode_decode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", threads: int = 2, verify: str | None = "words") -> DataFrame:
    """Per text: doc_id, n_tokens, ids, round_trip (decoding gives the text) and parity ("words", "texts", or None: null).

    ``threads``: of the library's pool in each Python worker, which is idle while Spark reads and writes.
    """
    if verify not in ("words", "texts", None):
        raise ValueError('verify is "words", "texts" or None')
    model = docs.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())  # under 1 MB; fixed by the tokenizer

    def run(batches):
        import os

        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        import pyarrow as pa
        import pyspark

        held = pyspark.__dict__.setdefault("_cairn_coders", {})
        key = hash(model.value), threads, verify
        if key not in held:
            held[key] = Coder(model.value, threads, verify)
        coder = held[key]
        for b in batches:
            i = 0
            while i < b.num_rows:
                # texts become Python strings a call at a time
                part, chars = [], 0
                while i + len(part) < b.num_rows and chars < CALL_CHARS:
                    part.append(b.column(1)[i + len(part)].as_py() or "")
                    chars += len(part[-1])
                j = i + len(part)
                ids, same = coder.encode(part)
                trip = [x == y for x, y in zip(coder.decode(ids), part)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(size := [len(x) // 4 for x in ids], pa.int64()), pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(size)], pa.int32()), pa.Array.from_buffers(pa.int32(), sum(size), [None, pa.py_buffer(b"".join(ids))])), pa.array(trip, pa.bool_()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids", "round_trip", "parity"])
                i = j

    texts = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    return texts.mapInArrow(tidied(run), f"doc_id {dict(texts.dtypes)['doc_id']}, n_tokens long, ids array<int>, round_trip boolean, parity boolean")
