"""Collections as segments of operations and a manifest per version.

A collection folder holds ``segments/<name>`` (Parquet: id, op, lsn, vector,
payload and promoted columns) and ``manifest/<version>.json``.  A commit writes
its segment first and then creates the next manifest file, which fails if
another writer made it meanwhile; so a version is visible whole or not at all,
and a retried job leaves at most an unreferenced segment.

A segment has one operation for each id, and a later segment's operation wins.
The live view is the union of the segments' upserts, each without the ids of
later segments: an anti-join with the small set of newer ids, through which
filters reach every scan, and no vector is shuffled.  Promoted columns narrow a
scan; the payload decides.

Files are reached through Hadoop's file system API, so a collection may lie on
any store Spark writes to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import InVariant, columns_of, compile_filter, narrowing
from ..schema import LIMITS, CollectionSpec, SpecError, check_limit, check_name, promoted

#: Compaction is due at this many segments, or when half of the rows are dead.
MAX_SEGMENTS, DEAD_SHARE = 8, 0.5
#: Ids of newer segments are broadcast up to this many (the manifest counts them); beyond it the anti-join shuffles.
NEWER_IDS = 1_000_000


class ConflictError(RuntimeError):
    """Another writer committed the same version."""


class Files:
    """A few file operations through Hadoop."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.fs.exists(self.path(folder)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a new file; an existing one is a conflict."""
        try:
            stream = self.fs.create(self.path(name), False)
        except Exception as e:
            if self.fs.exists(self.path(name)):
                raise ConflictError(name) from e
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def delete(self, name: str = "") -> bool:
        return self.fs.delete(self.path(name), True)

    def bytes(self, name: str = "") -> int:
        return self.fs.getContentSummary(self.path(name)).getLength()


@dataclass(frozen=True)
class Manifest:
    """One version: its segments with their rows, the largest lsn in them, and what made it."""

    version: int
    lsn: int
    segments: tuple[str, ...]
    rows: tuple[int, ...] = ()
    action: str = "create"

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "lsn": self.lsn, "segments": list(self.segments), "rows": list(self.rows), "action": self.action})


def latest(ops: DataFrame, id_col: str = "id") -> DataFrame:
    """Live rows of an operation log: the last operation of each id, if it is no delete.

    ``max_by`` aggregates map-side, so an id with many versions shuffles one row per task.
    """
    cols = [c for c in ops.columns if c not in (id_col, "lsn")]
    last = ops.groupBy(id_col).agg(F.max("lsn").alias("lsn"), F.max_by(F.struct(*cols), "lsn").alias("row"))
    return last.where("row.op <> 'delete'").select(id_col, "lsn", *[F.col(f"row.{c}").alias(c) for c in cols if c != "op"])


class Collection:
    """``observers`` are called with each manifest this object commits; ``auto_compact``: compact when a commit makes it due."""

    def __init__(self, spark: SparkSession, root: str, spec: CollectionSpec, *, observers: Sequence[Callable[[Manifest], None]] = (), auto_compact: bool = False):
        self.spark, self.root, self.spec = spark, root, spec
        self.observers, self.auto_compact = list(observers), auto_compact
        self.files = Files(spark, root)

    @staticmethod
    def create(spark: SparkSession, root: str, spec: CollectionSpec) -> Collection:
        c = Collection(spark, root, spec.check())
        c.files.create("spec.json", spec.to_json())
        c.files.create(c._manifest(0), Manifest(0, 0, ()).to_json())
        return c

    @staticmethod
    def open(spark: SparkSession, root: str) -> Collection:
        return Collection(spark, root, CollectionSpec.from_json(Files(spark, root).read("spec.json")))

    @staticmethod
    def _manifest(version: int) -> str:
        return f"manifest/{version:012d}.json"

    def manifest(self, version: int | None = None) -> Manifest:
        names = self.files.names("manifest")
        name = f"{version:012d}.json" if version is not None else [n for n in names if n.endswith(".json")][-1]
        d = json.loads(self.files.read(f"manifest/{name}"))
        return Manifest(d["version"], d["lsn"], tuple(d["segments"]), tuple(d["rows"]), d["action"])

    def log(self) -> DataFrame:
        """The commits that have not been vacuumed: version, lsn, action, segments and rows of the newest segment."""
        kept = [self.manifest(int(n[:12])) for n in self.files.names("manifest") if n.endswith(".json")]
        rows = [(m.version, m.lsn, m.action, len(m.segments), m.rows[-1] if m.rows else 0) for m in kept]
        return self.spark.createDataFrame(rows, "version long, lsn long, action string, segments int, rows long")

    def ops_schema(self) -> T.StructType:
        extra = [f for f in self.spec.struct().fields if f.name not in ("id", "vector", "payload")]
        return T.StructType([T.StructField("id", T.StringType()), T.StructField("op", T.StringType()), T.StructField("lsn", T.LongType()), *self.spec.struct().fields[1:3], *extra])

    def _shape(self, rows: DataFrame) -> DataFrame:
        """Upserts in segment form: dimension checked, declared payload fields promoted to typed columns."""
        payload = F.col("payload").cast("string") if "payload" in rows.columns else F.lit(None).cast("string")
        n = F.size("vector")
        vector = F.when(n == self.spec.dim, F.col("vector").cast("array<float>")).otherwise(F.raise_error(F.format_string(f"vector has %d components, not {self.spec.dim}", n)).cast("array<float>"))
        if self.spec.vector_encryption == "client_side":
            vector = F.col("vector").cast("array<float>")
        fields = {}
        for path, kind in self.spec.filterable.items():
            x = InVariant(F.parse_json(payload), path)
            fields[promoted(path)] = F.when(x.is_string, x._as("string")) if kind == "keyword" else F.when(x.is_number, x._as("double"))
        return rows.select(F.col("id").cast("string").alias("id"), vector.alias("vector"), payload.alias("payload"), *([F.col("ord")] if "ord" in rows.columns else [])).withColumns(fields)

    def _write(self, ops: DataFrame, base: Manifest, suffix: str = "") -> tuple[str, int]:
        """A segment of the next version and its rows (as its footers count them)."""
        name = f"segments/{base.version + 1:012d}-{uuid.uuid4().hex}{suffix}"
        ops.select(self.ops_schema().fieldNames()).write.parquet(f"{self.root}/{name}")
        return name, self._segments([name]).count()

    def _publish(self, done: Manifest) -> Manifest:
        self.files.create(self._manifest(done.version), done.to_json())
        for tell in self.observers:
            tell(done)
        if self.auto_compact and done.action != "compact" and len(done.segments) > 1 and self.needs_compaction():
            return self.compact()
        return done

    def _commit(self, ops: DataFrame, base: Manifest, action: str, lsn: int | None = None) -> Manifest:
        """Publish operations, one for each id, as the next version; ``lsn``: the largest among them."""
        name, rows = self._write(ops.sortWithinPartitions("id"), base)
        return self._publish(Manifest(base.version + 1, max(base.lsn, base.lsn + 1 if lsn is None else lsn), (*base.segments, name), (*base.rows, rows), action))

    def _one_each(self, rows: DataFrame) -> DataFrame:
        """Upserts in segment form with one row for each id."""
        shaped = self._shape(rows)
        if "ord" in shaped.columns:
            cols = [c for c in shaped.columns if c not in ("id", "ord")]
            return shaped.groupBy("id").agg(F.max_by(F.struct(*cols), "ord").alias("r")).select("id", "r.*")
        # a look at the ids only: vectors are not shuffled
        if not shaped.select("id").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            raise SpecError("ids repeat in the batch: give ord, by which the last of them wins")
        return shaped

    def upsert(self, rows: DataFrame, *, bulk: bool = False) -> Manifest:
        """Insert or replace whole rows (id, vector, payload).

        A batch is one version; of equal ids in it the row with the largest ``ord``
        wins.  A DataFrame has no order of its own, so repeated ids without ``ord`` are an error.
        """
        limit = "bulk" if bulk else "batch"
        if limit == "batch":
            check_limit(limit, rows.select("id").limit(LIMITS[limit] + 1).count())
        return self.apply(upserts=rows, action="upsert")

    def apply(self, *, upserts: DataFrame | None = None, deletes: DataFrame | None = None, action: str = "apply") -> Manifest:
        """Upserts and deletes (by id) as one version; an id in both is upserted."""
        base = self.manifest()
        parts = []
        if upserts is not None:
            parts.append(self._one_each(upserts).withColumns({"op": F.lit("upsert"), "lsn": F.lit(base.lsn + 1).cast("long")}).select(self.ops_schema().fieldNames()))
        if deletes is not None:
            gone = deletes.select(F.col("id").cast("string").alias("id")).distinct()
            parts.append(self._gone(gone.join(parts[0].select("id"), "id", "left_anti") if parts else gone, base.lsn + 1))
        return self._commit(reduce(DataFrame.unionByName, parts), base, action)

    def _gone(self, ids: DataFrame, lsn: int) -> DataFrame:
        nulls = {f.name: F.lit(None).cast(f.dataType) for f in self.ops_schema().fields if f.name not in ("id", "op", "lsn")}
        return ids.select(F.col("id").cast("string").alias("id")).withColumns({"op": F.lit("delete"), "lsn": F.lit(lsn).cast("long"), **nulls}).select(self.ops_schema().fieldNames())

    def prepare_upsert(self, rows: DataFrame) -> DataFrame:
        """The checked operations an upsert would commit, for a log of one's own; nothing is written."""
        return self._shape(rows).withColumns({"op": F.lit("upsert"), "lsn": F.lit(self.manifest().lsn + 1).cast("long")}).select(self.ops_schema().fieldNames())

    def prepare_delete(self, ids: DataFrame) -> DataFrame:
        return self._gone(ids, self.manifest().lsn + 1)

    def delete(self, ids: DataFrame) -> int:
        """Tombstone the given ids; the number of them that existed."""
        hit = self.snapshot().select("id").join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
        return self._tombstones(hit)

    def delete_where(self, tree) -> int:
        return self._tombstones(self.where(tree).select("id"))

    def _tombstones(self, hit: DataFrame) -> int:
        base = self.manifest()
        done = self._commit(self._gone(hit, base.lsn + 1), base, "delete")
        return done.rows[-1] if done.action == "delete" else self.manifest(base.version + 1).rows[-1]

    def _segments(self, names) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.ops_schema())
        return self.spark.read.schema(self.ops_schema()).parquet(*[f"{self.root}/{n}" for n in names])

    def ops(self, version: int | None = None) -> DataFrame:
        return self._segments(self.manifest(version).segments)

    def snapshot(self, version: int | None = None) -> DataFrame:
        """Live rows as of a version (the newest by default)."""
        m = self.manifest(version)
        parts = []
        for i, name in enumerate(m.segments):
            rows = self._segments([name]).where("op <> 'delete'").drop("op")
            if newer := m.segments[i + 1 :]:
                ids = self._segments(newer).select("id")
                rows = rows.join(F.broadcast(ids) if sum(m.rows[i + 1 :]) <= NEWER_IDS else ids, "id", "left_anti")
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts) if parts else self._segments(()).drop("op")

    def where(self, tree, version: int | None = None) -> DataFrame:
        """Live rows that satisfy a JSON filter.

        Declared fields narrow the scans by their typed columns; every row left is held against its payload, so declaring a
        field never changes what is found.
        """
        rows = self.snapshot(version)
        typed = {p: columns_of(rows.dtypes)[promoted(p)] for p in self.spec.filterable}
        exact = compile_filter(tree, {}, F.parse_json("payload"))
        few = narrowing(tree, typed) if tree is not None else None
        return rows.where(exact) if few is None else rows.where(few).where(exact)

    def count(self) -> int:
        return self.snapshot().count()

    def tail(self, lsn: int) -> DataFrame:
        """Operations after a log position."""
        return self.ops().where(F.col("lsn") > lsn)

    def needs_compaction(self) -> bool:
        """Whether segments or dead rows are many; the log's rows are counted by the manifest."""
        m = self.manifest()
        total = sum(m.rows)
        return len(m.segments) >= MAX_SEGMENTS or total > 0 and (total - self.count()) >= DEAD_SHARE * total

    def checkpoint(self) -> Manifest:
        """Mark the present state in the log: a version with nothing new, from which a tail is read."""
        base = self.manifest()
        return self._publish(Manifest(base.version + 1, base.lsn, base.segments, base.rows, "checkpoint"))

    def compact(self, tries: int = 3) -> Manifest:
        """Rewrite the live rows as one segment; older versions stay readable until :meth:`vacuum`.

        Writers go on meanwhile: segments they have added are kept behind the compacted one, and only the short
        publication is tried again.
        """
        base = self.manifest()
        rows = self.snapshot(base.version).withColumn("op", F.lit("upsert"))
        name, n = self._write(rows.repartitionByRange("id").sortWithinPartitions("id"), base, "-compact")
        for attempt in range(tries):
            now = self.manifest()
            if now.segments[: len(base.segments)] != base.segments:
                raise ConflictError("the segments were compacted meanwhile")
            k = len(base.segments)
            try:
                return self._publish(Manifest(now.version + 1, now.lsn, (name, *now.segments[k:]), (n, *now.rows[k:]), "compact"))
            except ConflictError:
                if attempt == tries - 1:
                    raise
        raise ConflictError(name)

    def vacuum(self) -> int:
        """Delete segments that the newest version does not name, and older manifests."""
        m = self.manifest()
        keep = {s.split("/")[1] for s in m.segments}
        gone = [n for n in self.files.names("segments") if n not in keep]
        for n in gone:
            self.files.delete(f"segments/{n}")
        for n in self.files.names("manifest"):
            if n != f"{m.version:012d}.json":
                self.files.delete(f"manifest/{n}")
        return len(gone)

    def backup(self, dest: str) -> dict:
        """Write the live state to a folder that must not exist."""
        if Files(self.spark, dest).exists():
            raise FileExistsError(dest)
        m = self.manifest()
        out = Collection.create(self.spark, dest, self.spec)
        name, rows = out._write(self.snapshot(m.version).withColumn("op", F.lit("upsert")), Manifest(0, 0, ()), "-compact")
        out.files.create(self._manifest(1), Manifest(1, m.lsn, (name,), (rows,), "restore").to_json())
        return {"version": m.version, "files": len(out.files.names(name)), "bytes": out.files.bytes()}

    @staticmethod
    def restore(spark: SparkSession, source: str, dest: str) -> Collection:
        if not Files(spark, source).exists("spec.json"):
            raise FileNotFoundError(f"{source} is no backup")
        Collection.open(spark, source).backup(dest)
        return Collection.open(spark, dest)


class Catalog:
    """Named collections under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark, root)

    def create(self, name: str, spec: CollectionSpec) -> Collection:
        if self.files.exists(check_name(name)):
            raise FileExistsError(f"collection {name} exists")
        return Collection.create(self.spark, f"{self.root}/{name}", spec)

    def open(self, name: str) -> Collection:
        if not self.files.exists(check_name(name)):
            raise KeyError(name)
        return Collection.open(self.spark, f"{self.root}/{name}")

    def drop(self, name: str) -> bool:
        """Delete a collection (its key file with it); whether it existed."""
        found = self.files.exists(check_name(name))
        if found:
            self.files.delete(name)
        return found

    def names(self) -> list[str]:
        return self.files.names("")

    def stats(self) -> DataFrame:
        """Per collection: points, dim, metric, bytes; and a total."""
        rows = []
        for n in self.names():
            c = self.open(n)
            rows.append((n, c.count(), c.spec.dim, c.spec.metric, self.files.bytes(n)))
        total = (None, sum(r[1] for r in rows), None, None, sum(r[4] for r in rows))
        return self.spark.createDataFrame([*rows, total], "collection string, points long, dim int, metric string, disk_bytes long")
