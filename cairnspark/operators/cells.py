"""Inverted-file layouts: k-means cells as partition folders, probed by partition pruning."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.table import Files
from .quantize import ProductQuantizer, kmeans, kmeans_tree, nearest
from .search import distances, exact_keys, final_ranks, matrix, top_k_by_task

#: Rows that centroids are trained on at most, and their bytes on the driver.
TRAIN_ROWS, TRAIN_BYTES = 262_144, 256 << 20
#: A cell is split beyond this many rows and merged below that many.
SPLIT_ROWS, MERGE_ROWS = 256, 16
#: Rows of a neighbour graph at most: all of them are looked at as neighbours of each.
GRAPH_ROWS = 1024


def cell_count(n: int) -> int:
    return max(1, min(n, max(64, min(65_536, math.ceil(math.sqrt(n))))))


def _sample(points: DataFrame, vector_col: str) -> np.ndarray:
    """A sample bounded in rows and bytes, the same at each run."""
    first = points.select(F.size(vector_col).alias("n")).first()
    rows = max(1, min(TRAIN_ROWS, TRAIN_BYTES // (8 * max(first["n"], 1)))) if first else 0
    held = points.select(F.col(vector_col).cast("array<double>").alias("v")).orderBy(F.xxhash64("v")).limit(rows).toPandas()["v"]
    return np.array(held.tolist(), float)


def assign(v: Column, centroids: np.ndarray) -> Column:
    """Nearest cell of each vector, by Arrow batch and blocks of a distance matrix."""
    import pandas as pd

    def run(batch):
        return pd.Series(nearest(np.array(batch.tolist(), float), centroids) if len(batch) else [], dtype="int32")

    return F.pandas_udf(run, "int")(v)


def _laid_out(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write rows as cell folders; ranges of (cell, vector), so a crowded cell is cut over several tasks and files."""
    rows.repartitionByRange("cell", F.xxhash64("vector")).sortWithinPartitions("cell").write.mode(mode).partitionBy("cell").parquet(path)


@dataclass
class CellIndex:
    """Centroids (at most 65 536) and the table that is laid out by cell.

    Rows carry ``born``, the number of removals before them; a removal stores ids with its own number and hides older rows of them.
    """

    path: str
    centroids: np.ndarray
    metric: str
    pq: ProductQuantizer | None = None

    @staticmethod
    def build(points: DataFrame, path: str, *, metric: str = "l2", cells: int | None = None, pq: int | None = None, iterations: int = 20, seed: int = 1, vector_col: str = "vector") -> CellIndex:
        """Train on a bounded sample, then assign and write every row in one distributed pass."""
        if metric == "dot":
            raise ValueError("cells need l2 or cosine")
        unit = metric == "cosine"
        points = points.withColumn("_v", V.normalize(F.col(vector_col)) if unit else F.col(vector_col).cast("array<double>"))
        x = _sample(points, "_v")
        centroids = kmeans_tree(x, min(cells or cell_count(points.count()), len(x)), iterations, seed)
        coder = ProductQuantizer.train(points, pq, vector_col="_v", seed=seed) if pq else None
        rows = points.withColumn("cell", assign(F.col("_v"), centroids)).withColumn("born", F.lit(0))
        if coder:
            rows = rows.withColumn("code", coder.encode(F.col("_v")))
        _laid_out(rows.drop("_v") if vector_col == "vector" else rows.drop("_v").withColumn("vector", F.col(vector_col)), path)
        return CellIndex(path, centroids, metric, coder)._described(points.sparkSession)

    def _described(self, spark: SparkSession) -> CellIndex:
        meta = {"metric": self.metric, "centroids": self.centroids.tolist(), "books": self.pq.books.tolist() if self.pq else None}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(self.path + "_centroids")
        return self

    def _removals(self, spark: SparkSession) -> list[str]:
        return Files(spark, self.path + "_gone").names("")

    def rows(self, spark: SparkSession, cells: Sequence[int] | None = None, id_col: str = "id") -> DataFrame:
        """Live rows, of the given cells or all."""
        rows = spark.read.parquet(self.path)
        if cells is not None:
            rows = rows.where(F.col("cell").isin(list(cells)))
        if gone := self._removals(spark):
            dead = spark.read.parquet(*[f"{self.path}_gone/{n}" for n in gone]).groupBy(F.col("id").alias("_id")).agg(F.max("died").alias("_died"))
            rows = rows.join(dead, (F.col(id_col) == F.col("_id")) & (F.col("_died") > F.col("born")), "left_anti")
        return rows.drop("born")

    @staticmethod
    def open(spark: SparkSession, path: str) -> CellIndex:
        meta = json.loads(spark.read.text(path + "_centroids").first()["value"])
        return CellIndex(path, np.array(meta["centroids"]), meta["metric"], ProductQuantizer(np.array(meta["books"])) if meta["books"] else None)

    def probe(self, query: Sequence[float], nprobe: int) -> list[int]:
        q = np.asarray(query, float)
        if self.metric == "cosine" and np.linalg.norm(q):
            q = q / np.linalg.norm(q)
        return np.argsort(((self.centroids - q) ** 2).sum(1), kind="stable")[:nprobe].tolist()

    def search(self, spark: SparkSession, query: Sequence[float], k: int = 10, *, nprobe: int = 64, rerank: bool = True, factor: int = 4, id_col: str = "id", vector_col: str = "vector", where: Column | None = None, without: DataFrame | None = None) -> DataFrame:
        """Top-k in the nprobe nearest cells (a partition filter); codes rank first if there are any, then exact scores. ``without``: ids to leave out."""
        rows = self.rows(spark, self.probe(query, nprobe), id_col)
        if where is not None:
            rows = rows.where(where)
        if without is not None:
            rows = rows.join(without, id_col, "left_anti")
        if self.pq is not None:
            approx = self.pq.score(F.col("code"), query, "cosine" if self.metric == "cosine" else "l2")
            rows = rows.withColumn("score", approx).orderBy(V.sort_key(self.metric, F.col("score")), id_col).limit(k * factor if rerank else k)
            if not rerank:
                return rows
        return rows.withColumn("score", V.score(self.metric, F.col(vector_col), query)).orderBy(V.sort_key(self.metric, F.col("score")), id_col).limit(k)

    def _nearest(self, nprobe: int):
        """Function from a matrix of vectors to their nprobe nearest cells."""
        centroids, metric = self.centroids, self.metric
        nprobe = min(nprobe, len(centroids))

        def run(q):
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) if metric == "cosine" else q
            return np.argsort(distances("l2", q, centroids), axis=1, kind="stable")[:, :nprobe]

        return run

    def nearest_cells(self, v: Column, nprobe: int) -> Column:
        """Array of the nprobe nearest cells of a vector column, by Arrow batch."""
        import pandas as pd

        cells = self._nearest(nprobe)

        def run(batch):
            return pd.Series(list(cells(np.array(batch.tolist(), float)).astype("int32")) if len(batch) else [], dtype=object)

        return F.pandas_udf(run, "array<int>")(v)

    def join(self, queries: DataFrame, k: int = 10, *, nprobe: int = 64, id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
        """(query_id, id, score, rank): the k nearest of each query's nprobe nearest cells, with exact scores.

        Only cells that some query probes are read; a batch scores all queries at
        once and leaves out rows of cells that a query doesn't probe.
        """
        spark, metric, centroids = queries.sparkSession, self.metric, self.centroids
        nprobe = min(nprobe, len(centroids))
        nearest_cells = self._nearest(nprobe)
        probed = queries.select(F.explode(self.nearest_cells(F.col(query_vector), nprobe)).alias("c")).distinct().collect()  # at most one row for each cell
        rows = self.rows(spark, [r["c"] for r in probed], id_col)

        def keys(_, q, data):
            x, cell = data
            key = distances(metric, q, x)
            near = np.zeros((len(q), len(centroids)), bool)
            np.put_along_axis(near, nearest_cells(q), True, 1)
            key[~near[:, cell]] = np.inf
            return key

        found = top_k_by_task(rows, queries, k, lambda c: (matrix(c[0]), c[1].to_numpy()), keys, lambda q, d, at: exact_keys(metric, q, d[0][at]), data_cols=[vector_col, "cell"], id_col=id_col, query_id=query_id, query_vector=query_vector)
        return final_ranks(found, k, metric)

    def append(self, points: DataFrame, vector_col: str = "vector") -> None:
        """Add rows to the cells nearest to them."""
        v = V.normalize(F.col(vector_col)) if self.metric == "cosine" else F.col(vector_col).cast("array<double>")
        rows = points.withColumn("cell", assign(v, self.centroids)).withColumn("born", F.lit(len(self._removals(points.sparkSession))))
        if self.pq is not None:
            rows = rows.withColumn("code", self.pq.encode(v))
        _laid_out(rows, self.path, "append")

    def remove(self, ids: DataFrame, id_col: str = "id") -> None:
        """Hide the rows that these ids have so far; :meth:`rebalanced` drops them."""
        spark = ids.sparkSession
        number = len(self._removals(spark)) + 1
        ids.select(F.col(id_col).alias("id"), F.lit(number).alias("died")).distinct().write.parquet(f"{self.path}_gone/{number:09d}")

    def insert(self, points: DataFrame) -> None:
        """Insert or replace rows by id."""
        self.remove(points.select("id"))
        self.append(points)

    def sizes(self, spark: SparkSession) -> DataFrame:
        return self.rows(spark).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))

    def rebalance_due(self, spark: SparkSession, *, split: int = SPLIT_ROWS, merge: int = MERGE_ROWS) -> bool:
        return not self.sizes(spark).where((F.col("n") > split) | (F.col("n") < merge)).isEmpty()

    def rebalanced(self, spark: SparkSession, path: str, *, split: int = SPLIT_ROWS, merge: int = MERGE_ROWS, seed: int = 1, vector_col: str = "vector") -> CellIndex:
        """A new layout without removed rows: crowded cells are cut by 2-means and more, sparse cells lose their centroid.

        All crowded cells are cut in one job, each on a bounded sample of its rows.  Rows of cells that stay keep
        their cell unless a new centroid is nearer.
        """
        size = {r["cell"]: r["n"] for r in self.sizes(spark).collect()}  # a row per cell
        rows = self.rows(spark).drop("cell", "code")
        v = V.normalize(F.col(vector_col)) if self.metric == "cosine" else F.col(vector_col).cast("array<double>")
        crowded = {c: n for c, n in size.items() if n > split}
        out = [centre for c, centre in enumerate(self.centroids) if merge <= size.get(c, 0) <= split]
        if crowded:
            # a pseudo-random share of each crowded cell: about 8 x split rows
            share = F.element_at(F.create_map(*[F.lit(x) for c, n in crowded.items() for x in (c, min(1.0, 8 * split / n))]), F.col("cell"))
            some = self.rows(spark, list(crowded)).select("cell", v.alias("v")).where(F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(1 << 20)) < share * (1 << 20))
            parts = {c: min(64, -(-n // split)) for c, n in crowded.items()}

            def cut(pdf):
                import pandas as pd

                x = np.array(pdf["v"].tolist(), float)
                return pd.DataFrame({"c": list(kmeans(x, min(parts[int(pdf["cell"].iloc[0])], len(x)), 10, seed))})

            out += [np.array(r["c"]) for r in some.groupBy("cell").applyInPandas(cut, "c array<double>").collect()]  # centroids only
        centroids = np.array(out or [self.centroids.mean(0)])
        rows = rows.withColumn("cell", assign(v, centroids)).withColumn("born", F.lit(0))
        if self.pq is not None:
            rows = rows.withColumn("code", self.pq.encode(v))
        _laid_out(rows, path)
        return CellIndex(path, centroids, self.metric, self.pq)._described(spark)


def token_candidates(index: CellIndex, spark: SparkSession, query: Sequence[Sequence[float]], nprobe: int, doc_col: str = "doc_id") -> DataFrame:
    """Documents with a token in a cell near some query token (late interaction's candidate step)."""
    cells = sorted({c for q in query for c in index.probe(q, nprobe)})
    return index.rows(spark, cells, doc_col).select(doc_col).distinct()


def token_candidates_of(index: CellIndex, queries: DataFrame, nprobe: int, *, doc_col: str = "doc_id", query_id: str = "query_id", vector_col: str = "vector") -> DataFrame:
    """(doc_id, queries): for each document the queries that have a token whose nearest cells hold one of its tokens."""
    asked = queries.select(query_id, F.explode(index.nearest_cells(F.col(vector_col), nprobe)).alias("cell")).distinct()
    held = index.rows(queries.sparkSession, None, doc_col).select("cell", doc_col).distinct()
    # queries of a cell are one array, so a cell of many documents is not multiplied by its queries before the last step
    by_cell = asked.groupBy("cell").agg(F.collect_set(query_id).alias("asked"))
    return held.join(by_cell, "cell").groupBy(doc_col).agg(F.array_distinct(F.flatten(F.collect_list("asked"))).alias("queries"))


def _links(y: np.ndarray, degree: int, seed: int, alpha: float = 1.0) -> list[list[int]]:
    """A navigable graph: neighbours that no nearer neighbour shadows (is ``alpha`` times nearer to them), and a few random ones."""
    n, rng, links = len(y), np.random.default_rng(seed), []
    between = np.stack([((y - v) ** 2).sum(1) for v in y])
    for i, d in enumerate(between):
        order = np.argsort(d, kind="stable")
        kept: list[int] = []
        clear = np.arange(n) != i
        while len(kept) < degree and clear.any():
            j = int(order[clear[order].argmax()])
            kept.append(j)
            clear &= alpha * alpha * between[j] >= d
            clear[j] = False
        links.append(list(dict.fromkeys(kept + rng.integers(0, n, 4).tolist())))
    return links


def _beam(y: np.ndarray, links: list[list[int]], z: np.ndarray, start: int, width: int, dot: bool) -> list[int]:
    """Best-first search from ``start`` that keeps the ``width`` nearest rows."""
    import heapq

    far = (lambda at: -(y[at] @ z)) if dot else (lambda at: ((y[at] - z) ** 2).sum(1))
    first = float(far(np.array([start]))[0])
    seen, best, todo = {start}, [(-first, start)], [(first, start)]
    while todo:
        d, i = heapq.heappop(todo)
        if len(best) == width and d > -best[0][0]:
            break
        new = [j for j in links[i] if j not in seen]
        if not new:
            continue
        seen.update(new)
        for j, e in zip(new, far(np.array(new)).tolist()):
            if len(best) < width or e < -best[0][0]:
                heapq.heappush(todo, (e, j))
                heapq.heappush(best, (-e, j))
                if len(best) > width:
                    heapq.heappop(best)
    return [j for _, j in best]


def graph_join(points: DataFrame, queries: DataFrame, k: int = 10, *, beam: int = 64, degree: int = 16, metric: str = "l2", id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", seed: int = 1) -> DataFrame:
    """(query_id, id, score, rank) by beam search over pruned neighbour graphs of each Arrow batch.

    The optional graph strategy: a batch is cut evenly into blocks of at most
    :data:`GRAPH_ROWS` rows, each block has a graph and is searched, and found rows
    get exact scores; the default strategy stays the exact scan.
    """

    def prepare(columns):
        x = matrix(columns[0])
        y = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x
        blocks = []
        for at in np.array_split(np.arange(len(x)), -(-len(x) // GRAPH_ROWS)):
            z = y[at]
            blocks.append((at[0], z, _links(z, degree, seed), int(((z - z.mean(0)) ** 2).sum(1).argmin())))
        return x, blocks

    def keys(_, q, data):
        x, blocks = data
        out = np.full((len(q), len(x)), np.inf)
        for row, v in zip(out, q):
            z = v / max(np.linalg.norm(v), 1e-300) if metric == "cosine" else v
            for first, y, links, start in blocks:
                at = first + np.array(_beam(y, links, z, start, max(beam, k), metric == "dot"))
                row[at] = exact_keys(metric, v, x[at])
        return out

    return final_ranks(top_k_by_task(points, queries, k, prepare, keys, data_cols=[vector_col], id_col=id_col, query_id=query_id, query_vector=query_vector), k, metric)
