r"""Near-duplicate documents by SetSketch.

Texts are lower-cased (A-Z), cut into words ``[^\x20\x09-\x0D]+`` and taken as
sets of distinct word shingles (a shorter text as one shingle).  A SetSketch
register is the least of exponentially distributed element values, truncated to
powers of a base near 1; registers of a union are the maxima of both sketches'
registers.  Bands of registers give candidates; similarity is estimated from the
register order by maximum likelihood given both set sizes; links are confirmed
on the full sets (64-bit hashes of the shingles).

Sets are collapsed first, so copies cost one row each.  A link of similarity
0.8 shares none of the 32 bands of 4 registers with probability 5e-8.

Defined results: null, empty and wordless texts have no shingles and are linked
with nothing (component of their own id); texts with equal sets are linked;
rows that share a ``doc_id`` are one node, so what either links to is linked;
rows with a null ``doc_id`` belong to the class of the rows whose set equals
theirs but cannot name one: their component is the class's least id, or null if
it has none, and they are kept only then; a very long text is one set, sketched
in chunks; of equally central nodes the least id is the centre; other columns are ignored by :func:`components` and kept by :func:`dedup`; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import discard, fresh, maybe_broadcast, named as column, spread_join, written
from .simjoin import classes

REGISTERS, BAND = 128, 4
BASE, RATE, TOP = 1.001, 20.0, 65534
SEED = 5
#: Shingle hashes multiplied at once.
CHUNK = 2048


def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 64, (REGISTERS, 1), np.uint64, endpoint=False) | np.uint64(1), rng.integers(0, 1 << 64, (REGISTERS, 1), np.uint64, endpoint=False)


def minima(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least uniform value of the set under each register's hash function."""
    out = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), CHUNK):
        np.minimum(out, ((items[None, i : i + CHUNK] ^ b) * a).min(1), out=out)
    return out


def registers(least: np.ndarray) -> np.ndarray:
    """SetSketch registers from uniform minima: floor(1 - log_base(x)) of the exponential value x, truncated."""
    u = (least >> np.uint64(11)).astype(float) * 2.0**-53
    with np.errstate(divide="ignore"):
        x = -np.log1p(-u) / RATE
        return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of registers, by row."""
    packed = np.ascontiguousarray(regs).view("<u8").reshape(len(regs), -1)
    return tb.mix(packed ^ tb.mix(np.arange(1, packed.shape[1] + 1, dtype=np.uint64))).view(np.int64)


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity given registers and set sizes, on a grid of 1/64."""
    more, less = (x > y).sum(1)[:, None], (x < y).sum(1)[:, None]
    same = x.shape[1] - more - less
    u = (nx / (nx + ny))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 65)[None, :] * np.minimum(u / v, v / u)
    p = lambda z: -np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    like = more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.clip(1 - up - down, tiny, 1))
    return j[np.arange(len(j)), like.argmax(1)]


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int):
    """Sorted distinct shingle hashes of each text."""
    h, _, _, bounds = tb.words(buf, offs, tb.SPACE_WORDS, tb.LOWER)
    runs = tb.windows(h, k)
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if e - s >= k:
            yield np.unique(runs[s : e - k + 1])
        elif e > s:
            yield np.array([tb.sequence(h[s:e])])
        else:
            yield np.zeros(0, np.uint64)


def _signed(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        a, b = _family()
        for batch in batches:
            buf, offs = tb.buffers(batch.column(1))
            for i, j in tb.groups(offs):
                size, least, f1, f2 = [], [], [], []
                for s in shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle):
                    size.append(len(s))
                    least.append(minima(s, a, b))
                    f1.append(tb.mix(s).sum(dtype=np.uint64))
                    f2.append(tb.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                keys = band_keys(registers(np.stack(least)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(np.array(f1).view(np.int64)), pa.array(np.array(f2).view(np.int64)), pa.array([x.tobytes() for x in keys], pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "keys"])

    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")).mapInArrow(tb.tidied(run), "doc_id long, n_shingles long, f1 long, f2 long, keys binary")


def _facts(texts: DataFrame, shingle: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        a, b = _family()
        for batch in batches:
            buf, offs = tb.buffers(batch.column(1))
            for i, j in tb.groups(offs):
                sets = list(shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle))
                sigs = registers(np.stack([minima(s, a, b) for s in sets]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([x.tobytes() for x in sigs], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "sig", "items"])

    return texts.mapInArrow(tb.tidied(run), "id long, n long, sig binary, items binary")


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    rows = written(_signed(docs, id_col, text_col, shingle), "sketches")
    full = rows.where("n_shingles > 0")
    nodes = written(full.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys")), "sets")

    def facts_of(ids: DataFrame) -> DataFrame:
        n = ids.count()
        texts = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
        facts = written(_facts(texts.join(maybe_broadcast(ids, n, wide=True), "id", "left_semi"), shingle), "facts")
        return facts if facts.count() == n else written(facts.dropDuplicates(["id", "n", "sig", "items"]), "facts")

    comps = classes(nodes.where("id is not null").select("id", "keys"), facts_of, estimate, threshold=threshold)
    # only sets with copies and linked sets differ from their own documents
    named = nodes.select("f1", "f2", "id", "copies").join(comps, "id", "left").where("copies > 1 or comp is not null").select("f1", "f2", "copies", F.coalesce("comp", "id").alias("component"))
    named = written(named, "set-classes")
    discard(nodes, comps)
    out = spread_join(full.select("doc_id", "n_shingles", "f1", "f2"), named, ["f1", "f2"], [F.col("doc_id")], rows=3 * named.count(), n="copies", how="left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, one document of each class (rows that repeat its id stay with it)."""
    name = fresh(docs.columns, "gone")
    gone = written(components(docs, id_col=id_col, **options).where("not kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct(), "near-copies")
    return docs.join(maybe_broadcast(gone, gone.count(), wide=True), column(id_col).cast("long") == F.col(name), "left_anti")
