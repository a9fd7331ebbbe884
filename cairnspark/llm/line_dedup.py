r"""Fuzzy line deduplication over the whole corpus.

Texts are split at ``\n``.  Lines of at least ``min_chars`` characters, and one
at least, without surrounding white space take part (0 is legal: any line with a
word); lines shorter than a shingle are compared for equality only.  Their character shingles of :data:`SHINGLE`
code points get MinHash signatures, bands of these give candidates, candidates
are confirmed by exact Jaccard similarity of the shingle sets, and a distributed
union-find joins confirmed links.  Of each component the first line (by doc_id,
then content, then position) is kept in its place and all others are removed.

Equal lines are one node and are collapsed inside each task before anything is
shuffled.  Lines are equal if 128 bits of hash are; 64 of them name a node.  Of
unlike lines that share these (a chance of 3e-8 for a line among 1e12) one is
compared with near lines, the others with equal ones only.  Lines of similarity
0.8 share none of the 12 bands of 3 with probability 2e-4, of 0.9 with 2e-7.

Defined results: null texts stay null and have no lines; an empty text is one
short line; a very long text is one row, its lines are taken one by one, and a
very long line is one set; short lines are always kept; rows equal in id and text are one
document and get the same result; a null id sorts first; a text whose every line
goes becomes empty; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from . import common
from .common import discard, fresh, maybe_broadcast, named, release, row_of, spread_join, written
from .simjoin import classes

SHINGLE = 9
BANDS, BAND = 12, 3
SEED = 17
#: Line hashes a task remembers so as to sign a repeated line once.
SEEN = 250_000


def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, BANDS * BAND, np.uint32, endpoint=False) | np.uint32(1), rng.integers(0, 1 << 32, BANDS * BAND, np.uint32, endpoint=False)


def windows(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of SHINGLE code points of the joined lines, and each line's first and past-the-last run."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(x) for x in lines], np.int64)
    start = np.cumsum(size) - size
    power, inverse = tb._powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * power[:-1], out=sums[1:])
    h = tb.mix((sums[SHINGLE:] - sums[:-SHINGLE]) * inverse[: len(points) - SHINGLE + 1])
    return h, start, start + size - SHINGLE + 1


def minima(h: np.ndarray, start: np.ndarray, stop: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of each line."""
    x = np.append((h >> np.uint64(32)).astype(np.uint32), np.uint32(0xFFFFFFFF))
    at = np.stack([start, stop], 1).ravel()
    out = np.empty((len(start), len(a)), np.uint32)
    y = np.empty_like(x)
    for r in range(len(a)):
        np.bitwise_xor(x, b[r], out=y)
        np.multiply(y, a[r], out=y)
        out[:, r] = np.minimum.reduceat(y, at)[::2]
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    m = m.reshape(len(m), BANDS, BAND).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(BAND):
        key = tb.mix(key ^ (m[:, :, i] + (np.uint64(i) << np.uint64(33))))
    return key.view(np.int64)


def shingle_sets(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (52 bits) of all lines, one line after the other, and their counts."""
    out, counts = [], []
    for i, j in _blocks(lines):
        for k in range(i, j, 4096):
            h, start, stop = windows([x.decode() for x in lines[k : min(k + 4096, j)]])
            size = stop - start
            number = np.repeat(np.arange(len(size), dtype=np.uint64), size)
            h = h[np.arange(len(number)) + np.repeat(start - np.cumsum(size) + size, size)]
            h = np.sort((number << np.uint64(52)) | (h >> np.uint64(12)))
            h = h[np.append(True, h[1:] != h[:-1])]
            out.append(h & np.uint64((1 << 52) - 1))
            counts.append(np.bincount((h >> np.uint64(52)).astype(np.int64), minlength=len(size)))
    return np.concatenate([*out, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0, np.int64)])


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    return (x == y).mean(1)


def _blocks(lines: list[str], chars: int = 1 << 16):
    """Runs of lines whose arrays stay in a core's cache."""
    i = 0
    while i < len(lines):
        j, n = i, 0
        while j < len(lines) and (j == i or n + len(lines[j]) <= chars):
            n += len(lines[j])
            j += 1
        yield i, j
        i = j


def _signed(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """rid, doc_id, pos, id and check of each line that takes part; its text and band keys where the task meets it for the first time."""
    source = docs.select(_rid(id_col, text_col).alias("rid"), named(id_col).alias("doc_id"), named(text_col).alias("text")).where("text is not null")
    longs = [T.StructField(x, T.LongType()) for x in ("id", "check")]
    schema = T.StructType([*source.schema.fields[:2], T.StructField("pos", T.IntegerType()), *longs, T.StructField("line", T.StringType()), T.StructField("keys", T.BinaryType())])
    least = max(min_chars, 1)

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_intdigest

        a, b = _family()
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > SEEN:
                seen.clear()
            row, pos, ids, new = [], [], [], []
            for n, text in enumerate(batch.column(2)):
                for p, line in enumerate(text.as_py().split("\n")):
                    if len(line) >= least and len(line.strip()) >= least:
                        i = xxh3_128_intdigest(line.encode())
                        row.append(n)
                        pos.append(p)
                        ids.append(i.to_bytes(16, "little"))
                        new.append(None if i in seen or len(line) < SHINGLE else line)
                        seen.add(i)
            texts = [x for x in new if x is not None]
            keys = [band_keys(minima(*windows(texts[i:j]), a, b)) for i, j in _blocks(texts)]
            packed = np.concatenate(keys) if keys else np.zeros((0, BANDS), np.int64)
            have = iter(packed.view(f"V{8 * BANDS}").ravel().tolist())
            held = pa.array([None if x is None else next(have) for x in new], pa.binary())
            at = pa.array(row, pa.int32())
            halves = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int32()), *[pa.array(np.ascontiguousarray(halves[:, k])) for k in (0, 1)], pa.array(new, pa.string()), held], names=["rid", "doc_id", "pos", "id", "check", "line", "keys"])

    return source.mapInArrow(tb.tidied(run), schema)


def _facts(lines: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        a, b = _family()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in _blocks(texts):
                sigs = (minima(*windows(texts[i:j]), a, b) & np.uint32(0xFFFF)).astype("<u2")
                lines = [x.encode() for x in texts[i:j]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(shingle_sets(lines)[1], pa.int64()), pa.array([x.tobytes() for x in sigs], pa.binary()), pa.array(lines, pa.binary())], names=["id", "n", "sig", "items"])

    return lines.mapInArrow(tb.tidied(run), "id long, n long, sig binary, items binary")


def _rid(id_col: str, text_col: str) -> Column:
    return F.xxhash64(named(id_col), F.lit(0), named(text_col))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """Every row of ``docs`` with its text rebuilt from the kept lines, and ``lines``: n_lines and n_dropped."""
    if min_chars < 0:
        raise ValueError("min_chars is 0 or more")
    lines = written(_signed(docs, id_col, text_col, min_chars), "lines")
    places, texts = lines.select("rid", "doc_id", "pos", "id", "check"), lines.where("line is not null")

    def facts_of(ids: DataFrame) -> DataFrame:
        one = texts.select("id", "check", "line").join(maybe_broadcast(ids, ids.count(), wide=True), "id", "left_semi").groupBy("id").agg(F.min_by("line", "check").alias("line"))
        return written(_facts(one), "line-facts")

    comps = classes(texts.select("id", "keys"), facts_of, estimate, threshold=threshold, margin=0.3, decode=shingle_sets)
    place = F.struct("doc_id", "rid", "pos")
    firsts = written(places.groupBy("id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.min("check").alias("check"), F.max("check").alias("other")), "line-firsts")
    known = firsts.join(comps, "id", "left").where("(n > 1 or comp is not null) and check = other").select("id", "check", F.coalesce("comp", "id").alias("comp"), "first", "n")
    # unlike lines of one id: only that of the least check is in a class of near lines
    clash = firsts.where("check <> other").select("id", F.col("check").alias("least"))
    apart = places.join(maybe_broadcast(clash, clash.count()), "id").groupBy("id", "check", "least").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).join(comps, "id", "left")
    apart = apart.withColumn("comp", F.when(F.col("check") == F.col("least"), F.coalesce("comp", "id")).otherwise(F.xxhash64("id", "check")))
    known = written(known.unionByName(apart.select(*known.columns)), "line-classes")
    keeper = written(known.groupBy("comp").agg(F.min("first").alias("keeper"), F.count(F.lit(1)).alias("size")), "line-heads")
    # a component of very many lines is spread over all tasks too
    headed = spread_join(known.select("id", "check", "comp", "n"), keeper, ["comp"], [F.col("id"), F.col("check")], rows=3 * keeper.count(), n="size")
    keepers = written(headed.select("id", "check", "n", "keeper"), "line-keepers")
    # a line in very many texts is spread over all tasks
    found = spread_join(places, keepers, ["id", "check"], [F.col("rid"), F.col("pos")], rows=4 * keepers.count(), n="n")
    gone = written(found.where(~place.eqNullSafe(F.col("keeper"))).groupBy("rid").agg(F.collect_set("pos").alias("gone")), "lines-gone")
    discard(lines, firsts, known, keeper, keepers, comps)
    weight = gone.agg(F.coalesce(F.sum(1 + F.size("gone") / 2), F.lit(0.0)).alias("w")).first()["w"]
    rows = docs.select(row_of(docs).alias("r"), _rid(id_col, text_col).alias("rid"))
    release(docs.sparkSession)
    # rows of one rid are equal in id and text; beyond a broadcast the texts are not sorted
    rows = rows.join(F.broadcast(gone) if weight <= common.BROADCAST_ROWS else gone.hint("shuffle_hash"), "rid", "left")
    text = F.col("r").getField(text_col)
    parts = F.split(text, "\n", -1)
    # the split text is bound once as the lambda's argument, not split anew for each line
    stay = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("gone"))
    rebuilt = F.transform(F.array(parts), lambda p: F.array_join(F.transform(stay(p), lambda i: F.get(p, i)), "\n"))[0]
    kept = F.when(F.col("gone").isNull(), text).otherwise(rebuilt)
    stats = F.struct(F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    return rows.select(*[(kept if c == text_col else F.col("r").getField(c)).alias(c) for c in docs.columns], stats.alias(fresh(docs.columns, "lines")))
