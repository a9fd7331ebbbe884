"""Stored postings: an inverted index of texts that is updated by segments.

A store is a folder of segments and a manifest per version.  A segment has
``terms`` (bucket of the term, term, id, weight, document length; sorted by term,
a frequent term spread over files), ``docs`` (id, length) and ``gone`` (ids whose
older postings it replaces or removes).  A query reads the buckets of its terms
in each segment, without the ids that later segments name; document frequencies
come from those rows and corpus statistics from the manifest, so no text is
read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.table import Collection, Files
from . import lexical

#: Postings of a bucket, about; a store keeps the number of buckets it began with.
BUCKET_ROWS, MAX_BUCKETS = 1 << 20, 4096
#: Ids of later segments are broadcast up to this many.
GONE_IDS = 1_000_000
#: Segments beyond which :meth:`Postings.merge` is due.
MAX_SEGMENTS = 8


@dataclass(frozen=True)
class State:
    version: int
    source: int
    buckets: int
    n_docs: int
    total: float
    segments: tuple[str, ...]
    gone: tuple[int, ...]


class Postings:
    """``stem`` and ``stop`` are how texts are analysed; they stay with the store."""

    def __init__(self, spark: SparkSession, root: str, *, stem: bool = True, stop: bool = True):
        self.spark, self.root, self.options = spark, root, {"stem": stem, "stop": stop}
        self.files = Files(spark, root)

    def state(self) -> State | None:
        names = self.files.names("manifest") if self.files.exists() else []
        if not names:
            return None
        d = json.loads(self.files.read(f"manifest/{names[-1]}"))
        return State(**{**d, "segments": tuple(d["segments"]), "gone": tuple(d["gone"])})

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(F.col("term").cast("string")), F.lit(n)).cast("int")

    def _add(self, weights: DataFrame | None, gone: DataFrame | None, source: int, fresh: bool = False) -> State:
        """Publish a segment of (id, term, weight) rows, with the ids' lengths ``dl`` if these are known, that replaces the postings of ``gone``."""
        now = None if fresh else self.state()
        before = self.state()
        name = f"segments/{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        lost, lost_docs, lost_total = 0, 0, 0.0
        if gone is not None:
            gone.select("id").distinct().write.parquet(f"{path}/gone")
            held = self.spark.read.parquet(f"{path}/gone")
            lost = held.count()
            if now is not None:
                r = self.docs(now).join(F.broadcast(held) if lost <= GONE_IDS else held, "id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0.0)).alias("t")).first()
                lost_docs, lost_total = r["n"], r["t"]
        n_docs, total, buckets = 0, 0.0, now.buckets if now else 1
        if weights is not None:
            # rows of an id are together here, so its length needs no join of all postings
            rows = weights if "dl" in weights.columns else weights.withColumn("dl", F.sum("weight").over(Window.partitionBy("id")))
            rows.select("id", "term", "weight", "dl").write.parquet(f"{path}/raw")
            raw = self.spark.read.parquet(f"{path}/raw")
            raw.groupBy("id").agg(F.max("dl").alias("dl")).write.parquet(f"{path}/docs")
            docs = self.spark.read.parquet(f"{path}/docs")
            r = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0.0)).alias("t")).first()
            n_docs, total = r["n"], r["t"]
            if now is None:
                buckets = max(1, min(MAX_BUCKETS, raw.count() // BUCKET_ROWS))
            # ranges of (bucket, term, id), so a term of very many texts is cut over several tasks
            rows = raw.withColumn("bucket", self._bucket(buckets)).repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")
            rows.write.partitionBy("bucket").parquet(f"{path}/terms")
            self.files.delete(f"{name}/raw")
        old = (now.n_docs, now.total, now.segments, now.gone) if now else (0, 0.0, (), ())
        done = State(before.version + 1 if before else 1, source, buckets, old[0] - lost_docs + n_docs, old[1] - lost_total + total, (*old[2], name), (*old[3], lost))
        self.files.create(f"manifest/{done.version:012d}.json", json.dumps(asdict(done)))
        return done

    def build(self, docs: DataFrame, *, id_col: str = "id", text_col: str = "text", source: int = 0) -> Postings:
        """Index all texts anew."""
        self._add(lexical.postings_from_text(docs, id_col=id_col, text_col=text_col, **self.options), None, source, fresh=True)
        return self

    def build_weights(self, weights: DataFrame, source: int = 0) -> Postings:
        """Store explicit (id, term, weight) rows."""
        self._add(weights, None, source, fresh=True)
        return self

    def upsert(self, docs: DataFrame, *, removed: DataFrame | None = None, id_col: str = "id", text_col: str = "text", source: int = 0) -> State:
        """Replace the postings of these texts, and drop those of the ids of ``removed``."""
        ids = docs.select(F.col(id_col).alias("id"))
        gone = ids if removed is None else ids.unionByName(removed.select("id"))
        done = self._add(lexical.postings_from_text(docs, id_col=id_col, text_col=text_col, **self.options), gone, source)
        return self.merge() if len(done.segments) > MAX_SEGMENTS else done

    def remove(self, ids: DataFrame, source: int = 0) -> State:
        return self._add(None, ids, source)

    def merge(self) -> State:
        """Rewrite the live postings as one segment."""
        now = self.state()
        return self._add(self.read(now), None, now.source, fresh=True)

    def _parts(self, now: State, folder: str) -> list[DataFrame]:
        """A table of each segment, without the ids that later ones name."""
        out = []
        for i, name in enumerate(now.segments):
            if not self.files.exists(f"{name}/{folder}"):
                continue
            rows = self.spark.read.parquet(f"{self.root}/{name}/{folder}")
            later = [f"{self.root}/{n}/gone" for n, k in zip(now.segments[i + 1 :], now.gone[i + 1 :]) if k]
            if later:
                ids = self.spark.read.parquet(*later)
                rows = rows.join(F.broadcast(ids) if sum(now.gone[i + 1 :]) <= GONE_IDS else ids, "id", "left_anti")
            out.append(rows)
        return out

    def docs(self, now: State | None = None) -> DataFrame:
        """(id, dl) of every text with terms."""
        return reduce(DataFrame.unionByName, self._parts(now or self.state(), "docs"))

    def read(self, now: State | None = None, terms: Sequence | None = None) -> DataFrame:
        """(id, term, weight, dl), of the given terms or all."""
        now = now or self.state()
        out = []
        for rows in self._parts(now, "terms"):
            if terms is not None:
                kind = dict(rows.dtypes)["term"]
                wanted = [F.lit(t).cast(kind) for t in terms]
                places = F.array(*[F.pmod(F.xxhash64(w.cast("string")), F.lit(now.buckets)).cast("int") for w in wanted]) if wanted else F.array().cast("array<int>")
                held = self.spark.range(1).select(F.array_distinct(places).alias("b")).first()["b"]  # the query's buckets
                rows = rows.where(F.col("bucket").isin(held) & F.col("term").isin(list(terms)))
            out.append(rows.select("id", "term", "weight", "dl"))
        return reduce(DataFrame.unionByName, out)

    def bm25(self, terms: Sequence, *, k1: float = lexical.K1, b: float = lexical.B) -> DataFrame:
        """(id, score) of the texts with a query term; each query term counts once."""
        now, terms = self.state(), list(dict.fromkeys(terms))
        rows = self.read(now, terms)
        df = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each query term
        if not df:
            return rows.select("id", F.lit(0.0).alias("score")).limit(0)
        avgdl = now.total / max(now.n_docs, 1)
        n = F.element_at(F.create_map(*[F.lit(x) for t, c in df.items() for x in (t, float(c))]), F.col("term"))
        idf = F.log(1 + (F.lit(float(now.n_docs)) - n + 0.5) / (n + 0.5))
        tf = F.col("weight") * (k1 + 1) / (F.col("weight") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
        return rows.groupBy("id").agg(F.sum(idf * tf).alias("score")).where("score > 0")

    def sparse(self, query: Mapping) -> DataFrame:
        """(id, score): dot products above zero with weights by term."""
        return lexical.sparse_scores(self.read(terms=list(query)), query)


def _store(c: Collection) -> Postings:
    return Postings(c.spark, f"{c.root}/postings", stem=True)


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.get_json_object("payload", "$.text").alias("text"))


def of(c: Collection) -> Postings | None:
    """The stored postings of a collection, if they are of its newest version."""
    store = _store(c)
    now = store.state()
    return store if now is not None and now.source == c.manifest().version else None


def refresh(c: Collection) -> State:
    """Bring the stored postings of the payloads' ``text`` to the newest version: the changed ids only, where the segments allow."""
    store, m = _store(c), c.manifest()
    now = store.state()
    if now is not None:
        if now.source == m.version:
            return now
        old = c.manifest(now.source).segments if f"{now.source:012d}.json" in c.files.names("manifest") else None
        if old is not None and m.segments[: len(old)] == old and len(m.segments) > len(old):
            changed = c._segments(m.segments[len(old) :]).select("id").distinct()
            live = c.snapshot(m.version).join(changed, "id", "left_semi")
            return store.upsert(_texts(live), removed=changed, source=m.version)
    store.build(_texts(c.snapshot(m.version)), source=m.version)
    return store.state()
