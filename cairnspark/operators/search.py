"""Exact retrieval: listing, lookup, k-NN with filters, range search, k-NN joins.

Filters apply before ranking, so k rows come back whenever k rows match.  Order
is by (distance key, id).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.crypto import open_vector
from ..functions.predicates import columns_of, compile_filter
from ..schema import check_limit


def where(points: DataFrame, tree: Mapping | str | None, payload: str | None = None) -> DataFrame:
    """Rows that satisfy a JSON filter; scalar columns are fields of their names, ``payload`` names a variant for all others."""
    return points if tree is None else points.where(compile_filter(tree, columns_of(points.dtypes), F.col(payload) if payload else None))


def get(points: DataFrame, ident, id_col: str = "id") -> DataFrame:
    return points.where(F.col(id_col) == F.lit(ident))


def multi_get(points: DataFrame, idents: Sequence, id_col: str = "id") -> DataFrame:
    """Points in the order asked for; unknown ids are skipped."""
    spark = points.sparkSession
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(idents)], f"ord long, want {dict(points.dtypes)[id_col]}")
    check_limit("fetch", len(idents))
    return points.join(F.broadcast(asked), F.col(id_col) == F.col("want")).orderBy("ord").drop("want", "ord")


def fetch(points: DataFrame, tree=None, *, offset: int = 0, limit: int = 100, id_col: str = "id", payload: str | None = None) -> DataFrame:
    """Unranked page in id order; the offset counts matches."""
    return where(points, tree, payload).orderBy(id_col).offset(offset).limit(check_limit("fetch", limit))


def scroll(points: DataFrame, tree=None, *, id_col: str = "id", payload: str | None = None) -> DataFrame:
    return where(points, tree, payload).orderBy(id_col)


def scored(points: DataFrame, query: V.Vector, metric: str, vector_col: str = "vector") -> DataFrame:
    return points.withColumn("score", V.score(metric, F.col(vector_col), query))


def knn(points: DataFrame, query: V.Vector, k: int = 10, *, metric: str = "l2", tree=None, payload: str | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The k nearest points with their score: filter, score, take ordered."""
    rows = scored(where(points, tree, payload), query, metric, vector_col)
    return rows.orderBy(V.sort_key(metric, F.col("score")), id_col).limit(check_limit("k", k))


def range_search(points: DataFrame, query: V.Vector, threshold: float, *, metric: str = "l2", tree=None, payload: str | None = None, vector_col: str = "vector") -> DataFrame:
    """All points at a squared distance of at most, or a similarity of at least, ``threshold``."""
    rows = scored(where(points, tree, payload), query, metric, vector_col)
    return rows.where(F.col("score") <= threshold if metric == "l2" else F.col("score") >= threshold)


def ranked(rows: DataFrame, depth: int, *order: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """Rows with ``rank`` (from 1) of at most depth, per group of ``by``.

    Ungrouped ranks are cut to ``depth`` rows by a distributed top-k first, so
    the window behind them sees only those.
    """
    if by:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= depth)
    return rows.orderBy(*order).limit(depth).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


#: Queries are broadcast in blocks of at most QUERY_ROWS and scored SCORED at a time.
QUERY_ROWS, SCORED = 10_000, 256


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column (one length, no nulls) as a matrix of doubles."""
    n = len(column)
    flat = column.flatten()
    if column.null_count or flat.null_count:
        raise ValueError("vectors have no nulls")
    flat = flat.to_numpy(zero_copy_only=False).astype(float)
    if n and len(flat) % n or (n and (np.diff(column.offsets.to_numpy()) != len(flat) // n).any()):
        raise ValueError("vectors have one length")
    return flat.reshape(n, -1)


def distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sort keys of all rows of x for all queries by one matrix product (rounding differs from :func:`exact_keys`)."""
    product = q @ x.T
    if metric == "dot":
        return -product
    if metric == "l2":
        return (q * q).sum(1)[:, None] - 2 * product + (x * x).sum(1)[None, :]
    size = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
    return -np.divide(product, size, out=np.zeros_like(product), where=size > 0)


def exact_keys(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sort keys of the rows of x for one query, summed in component order as the column expressions do."""
    total = lambda v: np.add.accumulate(v, axis=1)[:, -1] if v.shape[1] else np.zeros(len(v))
    if metric == "l2":
        return total((x - q) ** 2)
    product = total(x * q)
    if metric == "dot":
        return -product
    size = np.sqrt(total(x * x)) * np.sqrt(total((q * q)[None, :]))
    return -np.divide(product, size, out=np.zeros_like(product), where=size > 0)


class Best:
    """The k least (key, id) of each query over all batches of a task: at most queries x k rows leave it."""

    def __init__(self, n: int, k: int):
        self.k, self.keys, self.ids = k, [np.zeros(0)] * n, [np.zeros(0, object)] * n

    def bound(self, i: int) -> float:
        return self.keys[i][-1] if len(self.keys[i]) == self.k else np.inf

    def add(self, i: int, keys: np.ndarray, ids: np.ndarray) -> None:
        keys, ids = np.append(self.keys[i], keys), np.append(self.ids[i], ids)
        at = np.lexsort((ids, keys))[: self.k]
        self.keys[i], self.ids[i] = keys[at], ids[at]

    def rows(self):
        return np.repeat(np.arange(len(self.ids)), [len(x) for x in self.ids]), np.concatenate(self.ids or [[]]), np.concatenate(self.keys or [[]])


def top_k_by_task(points: DataFrame, queries: DataFrame, k: int, prepare, keys_of, refine=None, *, data_cols: Sequence[str], id_col: str = "id", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_id, id, key): candidates for the k least keys of each query, k for every task at most.

    ``prepare(columns)`` reads a batch's ``data_cols`` (rows without the first are
    left out); ``keys_of(numbers, queries, data)`` gives the batch's keys for a
    block of queries (infinite: not a candidate); ``refine(query, data, rows)``
    gives final ones for rows within rounding of the k-th.
    """
    spark = points.sparkSession
    total = queries.count()
    kinds, qkind = dict(points.dtypes), dict(queries.dtypes)[query_id]
    parts = max(1, -(-total // QUERY_ROWS))
    schema = f"query_id {qkind}, id {kinds[id_col]}, key double"
    out = None
    for part in range(parts):
        block = queries if parts == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(parts)) == part)
        held = block.select(query_id, F.col(query_vector).cast("array<double>")).collect()  # a bounded block of queries
        if not held:
            continue
        share = spark.sparkContext.broadcast(([r[0] for r in held], np.array([r[1] for r in held], float)))

        def run(batches, share=share):
            import pyarrow as pa

            names, q = share.value
            best, schema = Best(len(q), k), None
            for b in batches:
                schema = b.schema
                if not b.num_rows:
                    continue
                ids = b.column(0).to_numpy(zero_copy_only=False)
                data = prepare(b.columns[1:])
                for s in range(0, len(q), SCORED):
                    n = np.arange(s, min(s + SCORED, len(q)))
                    keys = keys_of(n, q[n], data)
                    cut = np.partition(keys, k - 1, axis=1)[:, k - 1] if keys.shape[1] > k else np.full(len(n), np.inf)
                    for i, row, edge in zip(n.tolist(), keys, cut):
                        edge = min(edge, best.bound(i))
                        near = np.flatnonzero((row <= edge + 1e-9 * (1 + abs(edge))) & (row < np.inf)) if edge < np.inf else np.flatnonzero(row < np.inf)
                        if len(near):
                            best.add(i, refine(q[i], data, near) if refine else row[near], ids[near])
            if schema is not None:
                at, ids, keys = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at.tolist()]), pa.array(ids.tolist(), schema.field(0).type), pa.array(keys, pa.float64())], names=["query_id", "id", "key"])

        near = points.where(F.col(data_cols[0]).isNotNull()).select(F.col(id_col).alias("id"), *data_cols).mapInArrow(run, schema)
        out = near if out is None else out.unionByName(near)
    return spark.createDataFrame([], schema) if out is None else out


def knn_join(points: DataFrame, queries: DataFrame, k: int = 10, *, metric: str = "l2", id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_id, id, score, rank): the k nearest points of each query, exactly.

    Each Arrow batch of points is scored against a block of queries by one matrix
    product; rows within rounding of the k-th get exact scores, and a task sends
    its k best of each query, without vectors, to the final ranking.
    """
    near = top_k_by_task(points, queries, check_limit("k", k), lambda c: matrix(c[0]), lambda _, q, x: distances(metric, q, x), lambda q, x, at: exact_keys(metric, q, x[at]), data_cols=[vector_col], id_col=id_col, query_id=query_id, query_vector=query_vector)
    return final_ranks(near, k, metric)


def final_ranks(near: DataFrame, k: int, metric: str) -> DataFrame:
    return ranked(near, k, F.col("key"), F.col("id"), by=["query_id"]).select("query_id", "id", V.report(metric, F.col("key")).alias("score"), "rank")


def merge_top_k(shards: Sequence[DataFrame], k: int, *, metric: str = "l2", id_col: str = "id") -> DataFrame:
    """Global top-k of per-shard results; an id found on several shards counts once, at its best."""
    rows = shards[0]
    for s in shards[1:]:
        rows = rows.unionByName(s)
    key = V.sort_key(metric, F.col("score"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy(key))).where("_n = 1").drop("_n")
    return rows.orderBy(key, id_col).limit(k)


def overlay(base: DataFrame, delta: DataFrame, deleted: DataFrame, id_col: str = "id") -> DataFrame:
    """Snapshot of a base with upserts and tombstones over it: newer rows win, deleted ids go."""
    changed = delta.select(id_col).unionByName(deleted.select(id_col)).distinct()
    return base.join(changed, id_col, "left_anti").unionByName(delta)


def sealed_knn(points: DataFrame, key: bytes, query: Sequence[float], k: int = 10, *, metric: str = "l2", tree=None, aad: str = "", id_col: str = "id", sealed_col: str = "sealed") -> DataFrame:
    """k-NN over vectors only the caller can open: filter first, open what is left, rank."""
    rows = where(points, tree)
    return knn(rows.withColumn("vector", open_vector(F.col(sealed_col), key, len(query), aad)), query, k, metric=metric, id_col=id_col)
