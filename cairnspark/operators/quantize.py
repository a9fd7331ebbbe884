"""Scalar, product and binary quantizers: training, codes, scores, exact re-ranking."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .search import distances, exact_keys, final_ranks, matrix, top_k_by_task

#: Rows a codebook is trained on at most (drawn by hash of the vector).
TRAIN_ROWS = 262_144


def per_dimension(points: DataFrame, vector_col: str = "vector") -> DataFrame:
    """(pos, lo, hi, mean) of each dimension; partial aggregates, one row per dimension leaves a task."""
    rows = points.select(F.posexplode(F.col(vector_col).cast("array<double>")).alias("pos", "x"))
    return rows.groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"))


@dataclass(frozen=True)
class ScalarQuantizer:
    """One byte per dimension: round((x - lo) / step), clamped."""

    lo: tuple[float, ...]
    step: tuple[float, ...]

    @staticmethod
    def train(points: DataFrame, vector_col: str = "vector") -> ScalarQuantizer:
        rows = per_dimension(points, vector_col).orderBy("pos").collect()  # dim rows
        return ScalarQuantizer(tuple(r["lo"] for r in rows), tuple((r["hi"] - r["lo"]) / 255 for r in rows))

    def encode(self, v: Column) -> Column:
        parts = F.arrays_zip(V.vec(v).alias("x"), V.vec(self.lo).alias("lo"), V.vec(self.step).alias("step"))
        code = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((p["x"] - p["lo"]) / p["step"] + 0.5).cast("double")))
        return F.transform(parts, lambda p: F.when(p["step"] > 0, code(p)).otherwise(0.0).cast("smallint"))

    def decode(self, code: Column) -> Column:
        parts = F.arrays_zip(code.alias("c"), V.vec(self.lo).alias("lo"), V.vec(self.step).alias("step"))
        return F.transform(parts, lambda p: p["lo"] + p["c"] * p["step"])

    def score(self, code: Column, query: V.Vector, metric: str = "l2") -> Column:
        """Full-precision query against the decoded vector."""
        return V.score(metric, self.decode(code), query)

    def values(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.lo) + codes * np.array(self.step)

    def keys(self, q: np.ndarray, codes: np.ndarray, metric: str) -> np.ndarray:
        return distances(metric, q, self.values(codes))


@dataclass(frozen=True)
class BinaryQuantizer:
    """One bit per dimension: above the dimension's mean; 64 bits to a long, lowest first."""

    mean: tuple[float, ...]

    @staticmethod
    def train(points: DataFrame, vector_col: str = "vector") -> BinaryQuantizer:
        return BinaryQuantizer(tuple(r["mean"] for r in per_dimension(points, vector_col).orderBy("pos").collect()))  # dim rows

    def encode(self, v: Column) -> Column:
        bits = F.zip_with(V.vec(v), V.vec(self.mean), lambda x, m: (x > m).cast("long"))
        words = -(-len(self.mean) // 64)
        word = lambda w: F.aggregate(F.transform(F.slice(bits, w * 64 + 1, 64), lambda b, i: F.shiftleft(b, 0) * F.when(i < 63, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(-(1 << 63)).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
        return F.array(*[word(w) for w in range(words)])

    def score(self, code: Column, query_code: Column) -> Column:
        return V.hamming(code, query_code)

    def join(self, points: DataFrame, queries: DataFrame, k: int, *, code_col: str = "code", id_col: str = "id", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
        """(query_id, id, distance, rank): the k codes with the fewest bits unlike those of each query."""
        mean = np.array(self.mean)

        def bits(columns):
            words = columns[0].flatten().to_numpy().astype(np.int64).reshape(len(columns[0]), -1)
            return np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, : len(mean)].astype(float)

        def keys(_, q, x):
            y = (q > mean).astype(float)
            return y @ (1 - x).T + (1 - y) @ x.T

        near = top_k_by_task(points, queries, k, bits, keys, data_cols=[code_col], id_col=id_col, query_id=query_id, query_vector=query_vector)
        return final_ranks(near, k, "l2").select("query_id", "id", F.col("score").cast("int").alias("distance"), "rank")


@dataclass(frozen=True)
class ProductQuantizer:
    """m subspaces with a codebook each (shape m x centroids x dim / m)."""

    books: np.ndarray

    @staticmethod
    def train(points: DataFrame, m: int, *, centroids: int = 256, iterations: int = 25, seed: int = 1, vector_col: str = "vector", unit: bool = False) -> ProductQuantizer:
        """Codebooks by k-means on each slice of at most :data:`TRAIN_ROWS` rows."""
        v = F.col(vector_col).cast("array<double>")
        sample = points.select((V.normalize(v) if unit else v).alias("v")).orderBy(F.xxhash64("v")).limit(TRAIN_ROWS).toPandas()["v"]
        x = np.array(sample.tolist(), float)
        if not len(x) or x.shape[1] % m:
            raise ValueError("m divides the dimension, and there is something to train on")
        d = x.shape[1] // m
        return ProductQuantizer(np.stack([kmeans(x[:, j * d : (j + 1) * d], min(centroids, len(x)), iterations, seed + j) for j in range(m)]))

    def encode(self, v: Column) -> Column:
        """Codes by Arrow batch: one distance matrix per subspace."""
        import pandas as pd

        def run(batch):
            if not len(batch):
                return pd.Series([], dtype=object)
            x = np.array(batch.tolist(), float)
            d = self.books.shape[2]
            return pd.Series(list(np.stack([nearest(x[:, j * d : (j + 1) * d], b) for j, b in enumerate(self.books)], 1).astype("int16")))

        return F.pandas_udf(run, "array<smallint>")(v)

    def _literal(self, j: int) -> Column:
        return F.array(*[F.array(*map(F.lit, map(float, c))) for c in self.books[j]])

    def reconstruct(self, code: Column) -> Column:
        return F.flatten(F.array(*[F.get(self._literal(j), F.get(code, j)) for j in range(len(self.books))]))

    def lookup(self, query: Sequence[float], metric: str = "l2") -> np.ndarray:
        """Per-subspace contribution of each centroid to the squared distance or the dot product."""
        q = np.asarray(query, float).reshape(len(self.books), -1)
        if metric == "l2":
            return ((self.books - q[:, None, :]) ** 2).sum(2)
        return (self.books * q[:, None, :]).sum(2)

    def values(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, j].astype(int)] for j, b in enumerate(self.books)], axis=1)

    def keys(self, q: np.ndarray, codes: np.ndarray, metric: str) -> np.ndarray:
        """Sums of the queries' lookup tables; for cosine as :meth:`score` says."""
        m, _, d = self.books.shape
        if metric == "cosine":
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        part = q.reshape(len(q), m, d)
        total = np.zeros((len(q), len(codes)))
        for j in range(m):
            table = distances("l2" if metric == "l2" else "dot", part[:, j], self.books[j])
            total += table[:, codes[:, j].astype(int)]
        return total

    def score(self, code: Column, query: Sequence[float], metric: str = "l2") -> Column:
        """Asymmetric score from the query's lookup table: a literal array and m array reads per row.

        For cosine, train and encode unit vectors: then it is the dot product with the unit query.
        """
        q = np.asarray(query, float)
        if metric == "cosine" and np.linalg.norm(q):
            q = q / np.linalg.norm(q)
        table = self.lookup(q, metric)
        parts = [F.get(F.array(*map(F.lit, map(float, row))), F.get(code, j)) for j, row in enumerate(table)]
        return sum(parts[1:], parts[0])


#: Cells of a distance matrix held at once (32 MB).
MATRIX = 4 << 20


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid, the lowest on ties; the distance matrix is made a block of rows at a time."""
    size = (centroids**2).sum(1)[None, :]
    step = max(1, MATRIX // max(len(centroids), 1))
    parts = [(size - 2 * x[s : s + step] @ centroids.T).argmin(1) for s in range(0, len(x), step)]
    return np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)


#: Centroids trained at once; more are trained in two levels.
FLAT = 512


def kmeans_tree(x: np.ndarray, k: int, iterations: int, seed: int) -> np.ndarray:
    """k centroids: by :func:`kmeans` up to :data:`FLAT`, else coarse ones first and each coarse part on its own, by its share of the rows."""
    if k <= FLAT:
        return kmeans(x, k, iterations, seed)
    top = kmeans(x, int(np.ceil(np.sqrt(k))), iterations, seed)
    at = nearest(x, top)
    count = np.bincount(at, minlength=len(top))
    share = np.minimum(np.maximum(1, np.floor(k * count / len(x))).astype(int), count)
    # what rounding left over goes to the fullest parts
    for c in np.argsort(-(count / np.maximum(share, 1)), kind="stable")[: max(0, k - share.sum())]:
        share[c] += share[c] < count[c]
    return np.concatenate([kmeans(x[at == c], n, iterations, seed + 1 + c) for c, n in enumerate(share.tolist()) if n])


def kmeans(x: np.ndarray, k: int, iterations: int, seed: int) -> np.ndarray:
    """Seeded k-means++ and Lloyd steps until stable; an empty cluster takes the worst-served row. For bounded samples."""
    rng = np.random.default_rng(seed)
    c = x[[rng.integers(len(x))]]
    far = ((x - c[0]) ** 2).sum(1)
    while len(c) < k:
        i = rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))
        c = np.vstack([c, x[i]])
        far = np.minimum(far, ((x - x[i]) ** 2).sum(1))
    before = None
    for _ in range(iterations):
        at = nearest(x, c)
        if before is not None and (at == before).all():
            break
        before = at
        count = np.bincount(at, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        for e in np.flatnonzero(count == 0):
            c[e] = x[((x - c[at]) ** 2).sum(1).argmax()]
    return c


def join(points: DataFrame, queries: DataFrame, k: int, quantizer, *, code_col: str = "code", factor: int = 4, metric: str = "l2", id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_id, id, score, rank): the k nearest of each query, exactly, with rows left out by their codes.

    In each Arrow batch the k x factor best rows by code get exact keys.  A row's
    code error bounds its exact key from below, and every other row whose bound is
    within the k-th key found so gets an exact key too.
    """
    depth = k * factor
    size = lambda x: np.linalg.norm(x, axis=-1, keepdims=True)
    unit = lambda x: x / np.maximum(size(x), 1e-300)

    def prepare(columns):
        codes, x = matrix(columns[0]), matrix(columns[1])
        y = quantizer.values(codes)
        if metric == "cosine":
            # product codes hold unit vectors; scalar keys are of the decoded vector's direction
            return codes, x, size(unit(x) - (y if isinstance(quantizer, ProductQuantizer) else unit(y)))[:, 0]
        return codes, x, size(x - y)[:, 0]

    def keys(_, q, data):
        codes, x, error = data
        near = quantizer.keys(q, codes, metric)
        if metric == "l2":
            low = np.maximum(np.sqrt(np.maximum(near, 0)) - error, 0) ** 2
        else:
            low = near - error * (size(q) if metric == "dot" else 1)
        out = np.full(near.shape, np.inf)
        for row, v, code, least in zip(out, q, near, low):
            at = np.argpartition(code, depth - 1)[:depth] if len(code) > depth else np.arange(len(code))
            row[at] = exact_keys(metric, v, x[at])
            edge = np.partition(row[at], k - 1)[k - 1] if len(at) >= k else np.inf
            at = np.flatnonzero((least <= edge + 1e-9 * (1 + abs(edge))) & (row == np.inf)) if edge < np.inf else np.flatnonzero(row == np.inf)
            row[at] = exact_keys(metric, v, x[at])
        return out

    near = top_k_by_task(points, queries, k, prepare, keys, data_cols=[code_col, vector_col], id_col=id_col, query_id=query_id, query_vector=query_vector)
    return final_ranks(near, k, metric)


def two_phase(points: DataFrame, approximate: Column, query: V.Vector, k: int, *, factor: int = 4, metric: str = "l2", id_col: str = "id", vector_col: str = "vector", ascending: bool = True) -> DataFrame:
    """k x factor rows by the approximate score, then exact scores and the top k."""
    pool = points.withColumn("approx", approximate).orderBy(F.asc("approx") if ascending else F.desc("approx"), id_col).limit(k * factor)
    return pool.withColumn("score", V.score(metric, F.col(vector_col), query)).orderBy(V.sort_key(metric, F.col("score")), id_col).limit(k)
