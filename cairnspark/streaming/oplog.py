"""Operation logs as Structured Streaming sources and sinks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.table import Collection, latest


def read_log(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Backfill and live tail of an append-only Parquet log are the same stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def replication_snapshot(ops: DataFrame, id_col: str = "id") -> DataFrame:
    """Operations that recreate the live state: one upsert per id."""
    return latest(ops, id_col).withColumn("op", F.lit("upsert"))


def recovery_tail(ops: DataFrame, checkpoint_lsn) -> DataFrame:
    return ops.where(F.col("lsn") > checkpoint_lsn)


def last_operations(stream: DataFrame, id_col: str = "id") -> DataFrame:
    """Last operation per id as a streaming aggregation (complete mode); deletes stay as tombstones."""
    cols = [c for c in stream.columns if c not in (id_col, "lsn")]
    return stream.groupBy(id_col).agg(F.max("lsn").alias("lsn"), F.max_by(F.struct(*cols), "lsn").alias("row"))


def live(last: DataFrame, id_col: str = "id") -> DataFrame:
    rows = last.where("row.op <> 'delete'")
    return rows.select(id_col, "lsn", "row.*").drop("op")


def apply_stateful(stream: DataFrame, value_type: str, id_col: str = "id", value_col: str = "value") -> DataFrame:
    """(id, lsn, op, value) updates with keyed state: late and repeated operations change nothing.

    The state keeps the last lsn of deleted ids too, so an older upsert cannot revive one.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = dict(stream.dtypes)[id_col]

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        before = best
        for f in frames:
            r = f.loc[f["lsn"].idxmax()]
            if best is None or int(r["lsn"]) > best[0]:
                best = (int(r["lsn"]), str(r["op"]), None if pd.isna(r[value_col]) else r[value_col])
        if best is not None and best != before:
            state.update(best)
            yield pd.DataFrame({id_col: [key[0]], "lsn": [best[0]], "op": [best[1]], "value": [best[2]]})

    return stream.groupBy(id_col).applyInPandasWithState(step, f"{id_col} {kind}, lsn long, op string, value {value_type}", f"lsn long, op string, value {value_type}", "update", GroupStateTimeout.NoTimeout)


def follow(stream: DataFrame, target: Collection, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Apply a stream of (id, op, lsn, vector, payload) to a collection, one version per micro-batch.

    The target remembers the source position in its rows' lsn and the largest of them in
    its manifest, so a write of its own comes after them; operations that are not newer
    are skipped, so a replayed batch is harmless.
    """

    def apply(batch: DataFrame, _: int) -> None:
        cols = [c for c in batch.columns if c not in ("id", "lsn")]
        last = batch.groupBy("id").agg(F.max("lsn").alias("lsn"), F.max_by(F.struct(*cols), "lsn").alias("row")).select("id", "lsn", "row.*")
        base = target.manifest()
        known = target.ops().groupBy("id").agg(F.max("lsn").alias("_seen"))
        new = last.join(known, "id", "left").where("_seen is null or lsn > _seen").drop("_seen").persist()
        top = new.agg(F.max("lsn").alias("lsn")).first()["lsn"]
        if top is not None:
            shaped = target._shape(new.where("op = 'upsert'").select("id", "vector", "payload")).join(new.select("id", "lsn", "op"), "id")
            names = target.ops_schema().fieldNames()
            gone = new.where("op = 'delete'").select(*[F.col(c) if c in ("id", "op", "lsn") else F.lit(None).cast(target.ops_schema()[c].dataType).alias(c) for c in names])
            target._commit(shaped.select(names).unionByName(gone), base, "follow", max(top, base.lsn))
        new.unpersist()

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def upsert_stream(stream: DataFrame, target: Collection, checkpoint: str) -> StreamingQuery:
    """Bulk-load each micro-batch of (id, vector, payload)."""
    return stream.writeStream.foreachBatch(lambda batch, _: target.upsert(batch, bulk=True) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def consolidation_due(base_rows: int, overlay_rows: int) -> bool:
    """Whether an overlay should be merged into its base."""
    return overlay_rows >= max(base_rows // 5, 1024)
