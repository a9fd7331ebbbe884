"""Sparse and BM25 ranking over postings (id, term, weight)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .search import where

K1, B = 1.2, 0.75


def postings_from_text(docs: DataFrame, *, id_col: str = "id", text_col: str = "text", stem: bool = False, stop: bool = True) -> DataFrame:
    """(id, term, weight): term frequencies of analysed texts."""
    # dealt by id as texts, the words' counts and the lengths need no other shuffle
    docs = docs.select(id_col, text_col).repartition(id_col)
    words = docs.select(F.col(id_col).alias("id"), F.explode(F.split(F.lower(F.col(text_col)), X.SPLIT)).alias("term")).where("term <> ''")
    keep = ~F.col("term").isin(*X.STOP_WORDS)
    out = (words.where(keep) if stop else words).groupBy("id", "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    if not stem:
        return out
    # the stemmer sees a text's distinct words; words of one stem are added up
    out = out.withColumn("term", X.stem_column(F.col("term"))).repartition("id")
    return (out.where(keep) if stop else out).groupBy("id", "term").agg(F.sum("weight").alias("weight"))


def postings_from_sparse(docs: DataFrame, *, id_col: str = "id", indices: str = "indices", values: str = "values") -> DataFrame:
    """(id, term, weight) of explicit sparse vectors; malformed ones are not indexed."""
    ok = docs.where(X.valid_sparse(F.col(indices), F.col(values)))
    return ok.select(F.col(id_col).alias("id"), F.explode(F.arrays_zip(F.col(indices).alias("term"), F.col(values).alias("weight"))).alias("p")).select("id", F.col("p.term").alias("term"), F.col("p.weight").cast("double").alias("weight"))


def extract_postings(docs: DataFrame, *, id_col: str = "id", indices: str = "indices", values: str = "values", text_col: str = "text", **options) -> DataFrame:
    """Explicit sparse vectors where given (malformed ones index nothing), else the text's term ids."""
    explicit = docs.where(F.col(indices).isNotNull() | F.col(values).isNotNull())
    implied = docs.where(F.col(indices).isNull() & F.col(values).isNull())
    terms = implied.select(F.col(id_col).alias("id"), F.explode(F.transform(X.tokens(F.col(text_col), **options), X.term_id)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    given = postings_from_sparse(explicit, id_col=id_col, indices=indices, values=values)
    return given.select("id", F.col("term").cast("long").alias("term"), "weight").unionByName(terms.select("id", F.col("term").cast("long").alias("term"), "weight"))


def _query_terms(postings: DataFrame, weights: Mapping) -> DataFrame:
    kind = dict(postings.dtypes)["term"]
    return F.broadcast(postings.sparkSession.createDataFrame([(t, float(w)) for t, w in weights.items()], f"term {kind}, qw double"))  # one request's terms


def sparse_scores(postings: DataFrame, query: Mapping) -> DataFrame:
    """(id, score): dot products above zero. ``query``: weight by term."""
    hit = postings.join(_query_terms(postings, query), "term")
    return hit.groupBy("id").agg(F.sum(F.col("weight") * F.col("qw")).alias("score")).where("score > 0")


def _origins(docs: DataFrame, id_words: Column, targets: Sequence[str]) -> dict[str, str]:
    """Stem by word for the words of all texts whose stem is one of a few targets.

    A stem keeps its word's first two letters, or is the first one alone, but for
    :data:`X.IRREGULAR` words; so only such distinct words go to the stemmer.
    """
    starts = sorted({t[:2] for t in targets})
    words = docs.select(F.explode(F.filter(id_words, lambda w: F.substring(w, 1, 2).isin(*starts) | F.substring(w, 1, 1).isin(*starts) | w.isin(*X.IRREGULAR))).alias("term")).distinct()
    words = words.repartition(docs.sparkSession.sparkContext.defaultParallelism, "term")  # small, but the stemmer is slow
    found = words.withColumn("stem", X.stem_column(F.col("term"))).where(F.col("stem").isin(*targets))
    return dict(found.collect())  # forms of the request's terms and of stop words


def term_counts(docs: DataFrame, terms: Sequence[str], *, id_col: str = "id", text_col: str = "text", stem: bool = False, stop: bool = True) -> DataFrame:
    """(id, dl, counts): length of every text with terms and how often it holds each of ``terms``.

    A text is counted where it is read; one row of each goes on, and rows of one id are added up.
    """
    words = F.filter(F.split(F.lower(F.col(text_col)), X.SPLIT), lambda w: (w != "") & ~w.isin(*X.STOP_WORDS) if stop else w != "")
    terms = list(terms)
    forms = {t: [t] for t in terms}
    if stem:
        origins = _origins(docs, words, [*terms, *(X.STOP_WORDS if stop else ())])
        forms = {t: [w for w, s in origins.items() if s == t] for t in terms}
        lost = [w for w, s in origins.items() if stop and s in X.STOP_WORDS]
        if lost:
            words = F.filter(words, lambda w: ~w.isin(*lost))
    rows = docs.select(F.col(id_col).alias("id"), words.alias("w"))
    asked = [w for t in terms for w in forms[t]]
    rows = rows.select("id", F.greatest(F.size("w"), F.lit(0)).alias("dl"), (F.filter("w", lambda w: w.isin(*asked)) if asked else F.array().cast("array<string>")).alias("w"))
    held = lambda t: F.greatest(F.size(F.filter("w", lambda w: w.isin(*forms[t]))), F.lit(0)) if forms[t] else F.lit(0)
    counts = [F.sum(held(t)).cast("double") for t in terms]
    # the length is asked for last, or each text would be cut into words twice
    return rows.groupBy("id").agg(F.sum("dl").cast("double").alias("dl"), F.array(*counts).cast("array<double>").alias("counts")).where("dl > 0")


def counted_sparse(counted: DataFrame, terms: Sequence[str], query: Mapping) -> DataFrame:
    """(id, score) over :func:`term_counts` of ``terms``: dot products above zero."""
    if missing := set(query) - set(terms):
        raise ValueError(f"terms that were not counted: {sorted(missing)}")
    parts = [F.get("counts", F.lit(i)) * F.lit(float(query[t])) for i, t in enumerate(terms) if t in query]
    return counted.select("id", sum(parts, F.lit(0.0)).alias("score")).where("score > 0")


def counted_bm25(counted: DataFrame, terms: Sequence[str], *, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) over :func:`term_counts` of ``terms``; read twice, for the corpus and for the scores."""
    held = [F.get("counts", F.lit(i)) for i in range(len(terms))]
    st = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("a"), *[F.count_if(c > 0).alias(f"df{i}") for i, c in enumerate(held)]).first()  # one row
    score = F.lit(0.0)
    for i, c in enumerate(held):
        idf = math.log(1 + (st["n"] - st[f"df{i}"] + 0.5) / (st[f"df{i}"] + 0.5))
        score += F.lit(idf) * c * (k1 + 1) / (c + k1 * (1 - b + b * F.col("dl") / F.lit(st["a"])))
    return counted.select("id", score.alias("score")).where("score > 0")


def corpus_stats(postings: DataFrame) -> DataFrame:
    """One row: documents with terms, and their mean length."""
    return postings.groupBy("id").agg(F.sum("weight").alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def bm25_scores(postings: DataFrame, terms: Sequence, *, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of documents with a query term; each query term counts once.

    Lengths are summed for candidates only; the corpus row is broadcast.
    """
    q = _query_terms(postings, dict.fromkeys(terms, 1.0))
    hit = postings.join(q, "term").select("id", "term", "weight")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    length = postings.groupBy("id").agg(F.sum("weight").alias("dl"))
    stats = F.broadcast(length.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")))
    rows = hit.join(F.broadcast(df), "term").join(length, "id").crossJoin(stats)  # df and stats: a row per query term, one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("weight") * (k1 + 1) / (F.col("weight") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("id").agg(F.sum(idf * tf).alias("score")).where("score > 0")


def analyse(spark, query: str, **options) -> list[str]:
    """Distinct analysed terms of a query text."""
    return spark.range(1).select(F.array_distinct(X.tokens(F.lit(query), **options)).alias("t")).first()["t"]


def top(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "id").limit(k)


def bm25_search(docs: DataFrame, query: str, k: int = 10, *, tree=None, id_col: str = "id", text_col: str = "text", stem: bool = True, stop: bool = True) -> DataFrame:
    """Top-k by BM25; the filter applies after corpus statistics are taken."""
    scores = bm25_scores(postings_from_text(docs, id_col=id_col, text_col=text_col, stem=stem, stop=stop), analyse(docs.sparkSession, query, stem=stem, stop=stop))
    if tree is not None:
        scores = scores.join(where(docs, tree).select(F.col(id_col).alias("id")), "id", "left_semi")
    return top(scores, k)


def sparse_search(postings: DataFrame, query: Mapping, k: int = 10) -> DataFrame:
    return top(sparse_scores(postings, query), k)


def overlap_score(query: str, doc: Column) -> Column:
    """Words of a document (white-space separated, with repeats) that are in the query."""
    asked = F.array_distinct(F.split(F.lower(F.trim(F.lit(query))), r"\s+"))
    return F.size(F.filter(F.split(F.lower(F.coalesce(doc, F.lit(""))), r"\s+"), lambda w: (w != "") & F.array_contains(asked, w))).cast("double")
