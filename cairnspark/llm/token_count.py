"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces in a word; dynamic
programming carries the best score and its piece count, never the pieces.  Tie
rules follow the tokenizers library's unigram model: starts in ascending order,
a later path wins only with a strictly larger score, an unknown character has
the least score of the vocabulary less 10 and exists only where no piece is
exactly that character, and unknown characters fall back to one piece a byte.

A text becomes words as the library's metaspace rule makes them (each space
turns into the marker and opens a word; a marker is put in front of a text that
has none), so words repeat and their counts are memoised per executor process.

The box has no unigram model file, so the query reads the public BPE model's
pieces and scores as unigram pieces and log-scores; parity is tested against the
tokenizers library with the same vocabulary.

Defined results: null and empty texts have no tokens; rows repeat as they come;
a very long text is counted whole, word by word, and a word of any length is one
programme of its own length (words over 64 characters are not memoised); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named
from .spm_model import MARK, Model, parse_model
from .textbytes import tidied

#: Distinct words kept in a process's memo; it restarts when full.
MEMO_WORDS = 400_000


def unigram_vocab(model: Model) -> tuple[list[tuple[str, float]], int, bool]:
    """(piece, score) by id, the unknown id, and whether bytes are a fallback."""
    return [(p.text, p.score) for p in model.pieces], model.unk_id, model.byte_fallback


class Counter:
    """Counts tokens of texts under a unigram vocabulary."""

    def __init__(self, vocab: list[tuple[str, float]], unk_id: int, byte_fallback: bool):
        import ahocorasick

        self.least = min(s for _, s in vocab) - 10.0
        names = {p for p, _ in vocab}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.chars = {p for p in names if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, s in dict(vocab).items():
            if p:
                self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.memo: dict[str, int] = {}

    def word(self, w: str) -> int:
        """Tokens of one word (it already has its marker)."""
        n = len(w)
        least, chars = self.least, self.chars
        score = [0.0] * (n + 1)
        # count of pieces; a run of unknown characters counts its bytes, or one
        count = [0] * (n + 1)
        open_unk = [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(w):
            ends[end].append(piece)
        for end in range(n):
            best, size = None, 0
            for length, s in sorted(ends[end], reverse=True):
                c = score[end + 1 - length] + s
                if best is None or c > best:
                    best, size = c, length
            if w[end] not in chars:
                c = score[end] + least
                if best is None or c > best:
                    best, size = c, 0
            score[end + 1] = best
            if size:
                count[end + 1] = count[end + 1 - size] + 1
            else:
                open_unk[end + 1] = True
                count[end + 1] = count[end] + (len(w[end].encode("utf-8", "surrogatepass")) if self.bytes else not open_unk[end])
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        if text[0] != MARK:
            text = MARK + text
        memo, total = self.memo, 0
        for w in text[1:].split(MARK):
            c = memo.get(w)
            if c is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                c = self.word(MARK + w)
                if len(w) <= 64:
                    memo[w] = c
            total += c
        return total


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and n_tokens of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())  # under 1 MB; fixed by the tokenizer

    def count(batches):
        import pyarrow as pa
        import pyspark

        held = pyspark.__dict__.setdefault("_cairn_counters", {})
        key = hash(model.value)
        if key not in held:
            held[key] = Counter(*unigram_vocab(parse_model(model.value)))
        c = held[key]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([c.text(t.as_py()) for t in b.column(1)], pa.int64())], names=["doc_id", "n_chars", "n_tokens"])

    texts = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"), F.coalesce(F.length(named(text_col)), F.lit(0)).cast("long").alias("n_chars"))
    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(tidied(count), f"doc_id {kind}, n_chars long, n_tokens long")
