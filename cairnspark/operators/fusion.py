"""Reciprocal-rank fusion, hybrid search and reranking."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import lexical
from .search import knn, ranked, where

RRF_K = 60.0


def ranked_list(scores: DataFrame, depth: int, *, descending: bool = True) -> DataFrame:
    """(id, rank) of the best ``depth``, ties by id."""
    key = F.desc("score") if descending else F.asc("score")
    return ranked(scores.select("id", "score"), depth, key, F.col("id")).select("id", "rank")


def rrf(lists: Sequence[DataFrame], k: int = 10, k0: float = RRF_K) -> DataFrame:
    """(id, score): sum of 1 / (k0 + rank) over lists of (id, rank); k0 is 0 at least."""
    rows = lists[0].select("id", "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select("id", "rank"))
    return lexical.top(rows.groupBy("id").agg(F.sum(F.lit(1.0) / (max(float(k0), 0.0) + F.col("rank"))).alias("score")), k)


def hybrid(points: DataFrame, k: int = 10, *, dense=None, sparse: Mapping | None = None, text: str | None = None, metric: str = "cosine", tree=None, k0: float = RRF_K, postings: DataFrame | None = None, stem: bool = True, stop: bool = True) -> DataFrame:
    """Fuse dense, sparse and text rankings of one collection; at least one is asked for.

    Each list goes to depth max(10 k, 100), after the filter; corpus statistics ignore it.
    """
    if dense is None and sparse is None and text is None:
        raise ValueError("give a vector, a sparse vector or a text")
    depth, lists = max(10 * k, 100), []
    allowed = where(points, tree).select("id") if tree is not None else None
    keep = lambda s: s if allowed is None else s.join(allowed, "id", "left_semi")
    if dense is not None:
        lists.append(ranked_list(knn(points, dense, depth, metric=metric, tree=tree), depth, descending=metric != "l2"))
    if sparse is not None:
        lists.append(ranked_list(keep(lexical.sparse_scores(postings if postings is not None else lexical.postings_from_sparse(points), sparse)), depth))
    if text is not None:
        p = lexical.postings_from_text(points, stem=stem, stop=stop)
        lists.append(ranked_list(keep(lexical.bm25_scores(p, lexical.analyse(points.sparkSession, text, stem=stem, stop=stop))), depth))
    return rrf(lists, k, k0)


def rerank(rows: DataFrame, score: Column, k: int) -> DataFrame:
    """Order a pool (with its ``rank``) anew by a score column; ties keep the pool's order."""
    return rows.withColumn("rerank_score", score).orderBy(F.desc("rerank_score"), "rank").limit(k)


def rerank_with(rows: DataFrame, query: str, scorer: Callable[[str, list[str]], list[float]], k: int, text_col: str = "text") -> DataFrame:
    """Rerank a bounded pool by a Python scorer called with whole Arrow batches of documents."""
    import pandas as pd

    udf = F.pandas_udf(lambda docs: pd.Series(scorer(query, docs.fillna("").tolist()), dtype="float64"), "double")
    return rerank(rows, udf(F.col(text_col)), k)


def rerank_text(text: Column, payload: Column) -> Column:
    """What a reranker reads: the text, else the payload's JSON, else nothing."""
    return F.coalesce(text, payload, F.lit(""))


def text_search(points: DataFrame, query: str, embed: Callable[[list[str]], list[list[float]]], k: int = 10, *, metric: str = "cosine", tree=None, reranker: Callable | None = None, pool: int = 50) -> DataFrame:
    """Embed the query, fuse dense and BM25 rankings, and rerank a pool of max(k, pool) if asked."""
    vector = embed([query])[0]
    found = hybrid(points, max(k, pool) if reranker else k, dense=vector, text=query, metric=metric, tree=tree)
    if reranker is None:
        return found
    rows = ranked(found, max(k, pool), F.desc("score"), F.col("id")).join(points.select("id", "text"), "id")
    return rerank_with(rows, query, reranker, k)


def embed_column(text: Column, embed: Callable[[list[str]], list[list[float]]], dim: int) -> Column:
    """Vectors of a text column from a Python embedder, by Arrow batch; count and dimension are checked."""
    import pandas as pd

    def run(batch):
        out = embed(batch.fillna("").tolist())
        if len(out) != len(batch) or any(len(v) != dim for v in out):
            raise ValueError("the embedder returned another count or dimension")
        return pd.Series([[float(x) for x in v] for v in out])

    return F.pandas_udf(run, "array<float>")(text)


def _fnv1a_64(texts: list[bytes]) -> np.ndarray:
    """FNV-1a 64 of many texts, all a byte further at a time; the last few long ones are finished one by one."""
    data, length = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-length, kind="stable")
    begin, h, p = (np.cumsum(length) - length)[order], np.full(len(texts), 0xCBF29CE484222325, np.uint64), 0
    ends = -length[order]
    while (k := int(np.searchsorted(ends, -p, "left"))) > 32:
        h[:k] = (h[:k] ^ data[begin[:k] + p]) * np.uint64(0x100000001B3)
        p += 1
    for i in range(k):
        one = int(h[i])
        for x in texts[order[i]][p:]:
            one = (one ^ x) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        h[i] = one
    out = np.empty_like(h)
    out[order] = h
    return out


def hash_embedder(dim: int) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in: components in [-1, 1) from FNV-1a 64 of "text:i"; the text's part of the hash is made once."""

    def embed(texts: list[str]) -> list[list[float]]:
        head, out = _fnv1a_64([f"{t}:".encode() for t in texts]), np.empty((len(texts), dim))
        for i in range(dim):
            h = head.copy()
            for x in str(i).encode():
                h = (h ^ np.uint64(x)) * np.uint64(0x100000001B3)
            out[:, i] = (h >> np.uint64(40)).astype(float) / 2**23 - 1
        return out.tolist()

    return embed


PROVIDERS: dict[str, dict[str, Callable]] = {}


def register_provider(collection: str, *, embedder: Callable | None = None, reranker: Callable | None = None) -> None:
    """Name the callables a collection's text verbs use."""
    PROVIDERS.setdefault(collection, {}).update({k: v for k, v in (("embedder", embedder), ("reranker", reranker)) if v})


def normalise_scores(scores: DataFrame) -> DataFrame:
    """Scores scaled to [0, 1] (0.5 if flat)."""
    s = F.broadcast(scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi")))
    return scores.crossJoin(s).select("id", F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5).alias("score"))  # s has one row


def random_axes(dim: int, seed: int = 0) -> tuple[list[float], list[float]]:
    """Two seeded unit vectors with normal components."""
    rng = np.random.default_rng(seed)
    x, y = (v / np.linalg.norm(v) for v in rng.normal(size=(2, dim)))
    return x.tolist(), y.tolist()


def project_2d(points: DataFrame, x_axis: Sequence[float], y_axis: Sequence[float], *, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, x, y): dot products with two axes, each scaled to [0, 1] (0.5 if flat)."""
    p = points.select(F.col(id_col).alias("id"), V.dot(F.col(vector_col), x_axis).alias("x"), V.dot(F.col(vector_col), y_axis).alias("y"))
    s = F.broadcast(p.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))
    scale = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), (F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(0.5)
    return p.crossJoin(s).select("id", scale("x", "x0", "x1").alias("x"), scale("y", "y0", "y1").alias("y"))  # s has one row


def constellation(points: DataFrame, ident, x_axis: Sequence[float], y_axis: Sequence[float], *, n: int = 256, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, score, x, y): the n points nearest to a stored one, itself included, on two axes; none if it is not there."""
    at = points.where(F.col(id_col) == F.lit(ident)).select(vector_col).first()
    near = knn(points, at[0], n, metric=metric, id_col=id_col, vector_col=vector_col) if at else points.withColumn("score", F.lit(0.0)).limit(0)
    return near.select(F.col(id_col).alias("id"), "score").join(project_2d(near, x_axis, y_axis, id_col=id_col, vector_col=vector_col), "id")
