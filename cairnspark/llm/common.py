"""Shared helpers: durable intermediate tables and table loading."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many rows of two longs (half a MB) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 32_768
#: The same (32 MB) where the other way would move whole texts, or a row for each word of them.
WIDE_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where that is unset (local mode)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(sc, "_cairn_dir", None)
        if base is None:
            base = sc._cairn_dir = "file://" + tempfile.mkdtemp(prefix="cairnspark-")
    return base.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; on local disks it goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/cairnspark-{spark.sparkContext.applicationId}"
    if path not in _HELD:
        _HELD.add(path)
        if path.startswith(("/", "file:")):
            atexit.register(shutil.rmtree, "/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
    return path


_HELD: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`written` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_cairn_path", None)
        if path:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def maybe_broadcast(df: DataFrame, rows: int, wide: bool = False) -> DataFrame:
    """Broadcast ``df`` only if its counted ``rows`` are within :data:`BROADCAST_ROWS`; else the join shuffles.

    ``wide``: the other side holds whole texts; the bound is :data:`WIDE_ROWS`, and beyond it texts are not sorted, a
    partition of ``df`` is hashed instead.
    """
    if wide:
        return F.broadcast(df) if rows <= WIDE_ROWS else df.hint("shuffle_hash")
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: A key is hot if it has more than one row in HOT of the large side, so there are fewer than HOT of them.
HOT = 1024


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[Column], *, rows: int, n: str | None = None, counts: DataFrame | None = None, how: str = "inner", wide: bool = False, bound: int | None = None) -> DataFrame:
    """``left`` joined with a ``right`` of fewer rows, so that no key fills a task.

    A ``right`` of counted ``rows`` within ``bound`` (by default :data:`BROADCAST_ROWS`) is broadcast.  Beyond it both sides shuffle; the rows of a
    hot key are spread over all partitions by a hash of ``by`` and its ``right`` rows are repeated in each.  A key's rows in
    ``left`` are told by the column ``n`` of ``right`` (if its keys are distinct and every key of several rows is there), by ``counts`` (keys and n), or counted.  ``wide``: rows of ``left`` hold whole texts and are not sorted; a
    partition of ``right`` is hashed instead.
    """
    if rows <= (BROADCAST_ROWS if bound is None else bound):
        return left.join(F.broadcast(right), keys, how)
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flag, salt = (fresh([*left.columns, *right.columns], x) for x in ("hot", "salt"))
    if counts is None:
        counts = right.select(*keys, F.col(n).alias("n")) if n else written(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "join-counts")
    seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    right = right.hint("shuffle_hash") if wide else right
    if seen["most"] * HOT <= seen["total"]:
        return left.join(right, keys, how)
    hot = F.broadcast(counts.where(F.col("n") * HOT > seen["total"]).select(*keys, F.lit(True).alias(flag)))  # fewer than HOT rows
    some = left.join(hot, keys, "left").withColumn(salt, F.when(F.col(flag), F.pmod(F.xxhash64(F.lit(parts), *by), F.lit(parts))).otherwise(0).cast("int")).drop(flag)
    every = F.when(F.col(flag), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    many = right.join(hot, keys, "left").withColumn(salt, F.explode(every)).drop(flag)
    return some.join(many.hint("shuffle_hash") if wide else many, [*keys, salt], how).drop(salt)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with as many underscores as set it apart from ``columns`` (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(name: str) -> Column:
    """A top-level column of any name."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_of(docs: DataFrame) -> Column:
    """All columns as one struct: what travels with a record under any names."""
    return F.struct(*map(named, docs.columns))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
