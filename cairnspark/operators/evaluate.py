"""Recall, percentiles, selectivity masks and sweeps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import knn_join


def recall_at_k(found: DataFrame, truth: DataFrame, k: int, query_id: str = "query_id") -> DataFrame:
    """(query_id, recall): share of the true top k among the found top k; both have id and rank."""
    t = truth.where(F.col("rank") <= k).select(query_id, "id")
    f = found.where(F.col("rank") <= k).select(query_id, "id").withColumn("hit", F.lit(1))
    return t.join(f, [query_id, "id"], "left").groupBy(query_id).agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.count(F.lit(1))).alias("recall"))


def mean_recall(recalls: DataFrame) -> DataFrame:
    return recalls.agg(F.coalesce(F.avg("recall"), F.lit(0.0)).alias("mean_recall"))


#: Distinct values a percentile sorts in one place at most; more are narrowed down first.
SORTED = 1_000_000
ACCURACY = 10_000


def percentile_nearest(values: DataFrame, column: str, p: float) -> DataFrame:
    """Order statistic at round(p / 100 * (n - 1)), halves to even, without gathering the values.

    A quantile sketch gives bounds around the place, exact counts make them sure,
    and only the values between them are sorted, with equal ones counted once;
    while these are many, a sketch of them narrows further.
    """
    x = values.select(F.col(column).cast("double").alias("value")).where("value is not null")
    n = x.count()
    if not n:
        return values.sparkSession.createDataFrame([(None,)], "value double")
    at, size = round(p / 100 * (n - 1)), n
    while size > SORTED:
        shares = [min(max(at / size + d, 0.0), 1.0) for d in (-2 / ACCURACY, 2 / ACCURACY)]
        lo, hi = x.agg(F.percentile_approx("value", shares, ACCURACY).alias("b")).first()["b"]
        below, inside = x.agg(F.count_if(F.col("value") < lo), F.count_if(F.col("value").between(lo, hi))).first()
        if not below <= at < below + inside or inside == size:
            break  # the sketch was off, or one value fills the range: equal values are counted once below
        x, at, size = x.where(F.col("value").between(lo, hi)), at - below, inside
    counts = x.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("value")))
    return upto.where(F.col("upto") > at).orderBy("value").limit(1).select("value")


def selectivity_mask(ident: Column, percent: int) -> Column:
    return (ident % 100) < percent


def filtered_truth(points: DataFrame, queries: DataFrame, percent: int, k: int, **options) -> DataFrame:
    """Exact top-k inside a selectivity mask."""
    return knn_join(points.where(selectivity_mask(F.col(options.get("id_col", "id")), percent)), queries, k, **options)


def sweep(points: DataFrame, queries: DataFrame, strategies: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]], ks: Sequence[int] = (1, 10, 100), **options) -> DataFrame:
    """(strategy, k, mean_recall): each strategy's joins held against exact ones."""
    truth = knn_join(points, queries, max(ks), **options)
    out = None
    for name, run in strategies.items():
        found = run(points, queries, max(ks))
        for k in ks:
            row = mean_recall(recall_at_k(found, truth, k)).select(F.lit(name).alias("strategy"), F.lit(k).alias("k"), "mean_recall")
            out = row if out is None else out.unionByName(row)
    return out
