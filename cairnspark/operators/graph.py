"""Stored neighbour graphs: blocks of rows with their links, searched by beam.

A block is one row of a Parquet table: the ids, vectors and links of at most
``GRAPH_ROWS`` points and where a search begins, so a task that reads a block
has its whole graph.  Inserts append blocks, removals hide the older rows of an
id (soft deletes) and are counted, and a rebuild is due at a share of them.  A
search walks every block's graph and merges the best of all; hidden rows are
walked through but never returned, and the beam widens by their share.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.table import Files
from .cells import GRAPH_ROWS, _beam, _links
from .search import exact_keys, final_ranks, matrix

#: Removed rows, as a share of all, at which the graph is to be built anew.
REBUILD_SHARE = 0.2


@dataclass
class GraphIndex:
    path: str
    metric: str = "l2"
    degree: int = 16
    alpha: float = 1.2
    seed: int = 1

    def _blocks(self, points: DataFrame, born: int) -> DataFrame:
        kind = dict(points.dtypes)["id"]
        metric, degree, alpha, seed = self.metric, self.degree, self.alpha, self.seed

        def run(batches):
            import pyarrow as pa

            for b in batches:
                x = matrix(b.column(1)) if b.num_rows else np.zeros((0, 1))
                y = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x
                for at in np.array_split(np.arange(len(x)), -(-len(x) // GRAPH_ROWS)) if len(x) else []:
                    z = y[at]
                    links = _links(z, degree, seed, alpha)
                    start = int(((z - z.mean(0)) ** 2).sum(1).argmin())
                    ids = b.column(0).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([x[at].tobytes()], pa.binary()), pa.array([links], pa.list_(pa.list_(pa.int32()))), pa.array([start], pa.int32()), pa.array([born], pa.int32())], names=["ids", "vectors", "links", "start", "born"])

        rows = points.where("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))
        return rows.mapInArrow(run, f"ids array<{kind}>, vectors binary, links array<array<int>>, start int, born int")

    @staticmethod
    def build(points: DataFrame, path: str, metric: str = "l2", **options) -> GraphIndex:
        """Graphs over all (id, vector) rows."""
        index = GraphIndex(path, metric, **options)
        index._blocks(points, 0).write.parquet(path)
        return index

    def _removals(self, spark: SparkSession) -> list[str]:
        return Files(spark, self.path + "_gone").names("")

    def remove(self, ids: DataFrame) -> None:
        """Hide the rows that these ids have so far."""
        number = len(self._removals(ids.sparkSession)) + 1
        ids.select("id", F.lit(number).alias("died")).distinct().write.parquet(f"{self.path}_gone/{number:09d}")

    def insert(self, points: DataFrame) -> None:
        """Insert or replace rows by id: they get blocks of their own."""
        spark = points.sparkSession
        self.remove(points.select("id"))
        self._blocks(points, len(self._removals(spark))).write.mode("append").parquet(self.path)

    def _dead(self, spark: SparkSession) -> DataFrame | None:
        gone = self._removals(spark)
        return spark.read.parquet(*[f"{self.path}_gone/{n}" for n in gone]).groupBy("id").agg(F.max("died").alias("died")) if gone else None

    def members(self, spark: SparkSession, live: bool = True) -> DataFrame:
        """(id, born) of the rows in the blocks."""
        rows = spark.read.parquet(self.path).select(F.explode("ids").alias("id"), "born")
        dead = self._dead(spark)
        return rows if dead is None or not live else rows.join(dead, "id", "left").where("died is null or died <= born").drop("died")

    def deleted_share(self, spark: SparkSession) -> float:
        total = self.members(spark, live=False).count()
        return 1 - self.members(spark).count() / total if total else 0.0

    def rebuild_due(self, spark: SparkSession) -> bool:
        return self.deleted_share(spark) >= REBUILD_SHARE

    def join(self, queries: DataFrame, k: int = 10, *, beam: int = 64, query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
        """(query_id, id, score, rank): the k best of each query over all blocks; queries are a request's, broadcast."""
        spark, metric = queries.sparkSession, self.metric
        held = queries.select(query_id, F.col(query_vector).cast("array<double>")).collect()  # the request
        share = spark.sparkContext.broadcast(([r[0] for r in held], [np.array(r[1], float) for r in held]))
        dead = self._dead(spark)
        # a block finds enough rows for k to be left when hidden ones have gone
        hidden = self.deleted_share(spark) if dead is not None else 0.0
        width = math.ceil(max(beam, k) / max(1 - hidden, 0.05))
        blocks = spark.read.parquet(self.path)
        kind, asked = blocks.schema["ids"].dataType.elementType.simpleString(), to_arrow_type(queries.schema[query_id].dataType)

        def run(batches):
            import pyarrow as pa

            names, vectors = share.value
            for b in batches:
                for ids, data, links, start, born in zip(*[c.to_pylist() for c in b.columns]):
                    x = np.frombuffer(data, float).reshape(len(ids), -1)
                    y = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x
                    out: tuple[list, list, list] = ([], [], [])
                    for name, v in zip(names, vectors):
                        z = v / max(np.linalg.norm(v), 1e-300) if metric == "cosine" else v
                        at = np.array(_beam(y, links, z, start, width, metric == "dot"))
                        keys = exact_keys(metric, v, x[at])
                        for side, values in zip(out, ([name] * len(at), [ids[i] for i in at], keys.tolist())):
                            side += values
                    field = b.schema.field(0).type.value_type
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], asked), pa.array(out[1], field), pa.array(out[2], pa.float64()), pa.array([born] * len(out[0]), pa.int32())], names=["query_id", "id", "key", "born"])

        found = blocks.mapInArrow(run, f"query_id {dict(queries.dtypes)[query_id]}, id {kind}, key double, born int")
        if dead is not None:
            found = found.join(dead, "id", "left").where("died is null or died <= born").drop("died")
        return final_ranks(found.drop("born"), k, metric)
