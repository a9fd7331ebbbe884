"""Documents of several token vectors: storage forms, MaxSim search, CRUD.

A token table has (doc_id, ordinal, vector) and the payload on ordinal 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .search import Best, matrix, ranked, where

SEPARATOR = "\x1f"


def token_id(doc: Column, ordinal: Column) -> Column:
    """Row id of a token; the document id must not hold the separator."""
    clean = F.when(F.instr(doc, SEPARATOR) == 0, doc).otherwise(F.raise_error(F.lit("a document id cannot hold U+001F")))
    return F.concat_ws(SEPARATOR, clean, ordinal.cast("string"))


def parse_token_id(ident: Column) -> Column:
    """struct(doc_id, ordinal), split at the last separator; null for other ids."""
    pattern = f"(?s)^(.*){SEPARATOR}(\\d+)$"
    ok = ident.rlike(pattern)
    return F.when(ok, F.struct(F.regexp_extract(ident, pattern, 1).alias("doc_id"), F.regexp_extract(ident, pattern, 2).cast("long").alias("ordinal")))


def to_tokens(docs: DataFrame, *, id_col: str = "doc_id", vectors: str = "vectors", payload: str | None = "payload") -> DataFrame:
    """Token table of documents with an array of vectors; the payload stays on ordinal 0."""
    out = docs.select(F.col(id_col).alias("doc_id"), *([payload] if payload else []), F.posexplode(vectors).alias("ordinal", "vector"))
    return out.withColumn(payload, F.when(F.col("ordinal") == 0, F.col(payload))) if payload else out


def gather(tokens: DataFrame, doc_id=None) -> DataFrame:
    """(doc_id, vectors) with vectors in ordinal order; one document's tokens are one request's size."""
    rows = tokens if doc_id is None else tokens.where(F.col("doc_id") == F.lit(doc_id))
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "vector"))), lambda t: t["vector"]).alias("vectors"))


def document_count(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.count_distinct("doc_id").alias("documents"))


def upsert_documents(tokens: DataFrame, new: DataFrame) -> DataFrame:
    """Replace whole documents: a shorter new version leaves no old tokens."""
    return tokens.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def delete_documents(tokens: DataFrame, ids: DataFrame) -> DataFrame:
    return tokens.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def max_sim_scores(tokens: DataFrame, query: Sequence[Sequence[float]], metric: str = "cosine") -> DataFrame:
    """(doc_id, score): each query token's best similarity in a document, summed.

    The query's tokens are literals, so each token row computes all of its
    similarities in place and a partial max per document goes to the shuffle.
    """
    if not query:
        return tokens.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    best = tokens.groupBy("doc_id").agg(*[F.max(V.score(metric, F.col("vector"), q)).alias(f"q{i}") for i, q in enumerate(query)])
    return best.select("doc_id", sum((F.col(f"q{i}") for i in range(1, len(query))), F.col("q0")).alias("score"))


#: Query tokens scored in one pass over the documents' tokens.
TOKENS = 1024


def join(tokens: DataFrame, queries: DataFrame, k: int = 10, *, metric: str = "cosine", query_id: str = "query_id", allowed: str | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) by MaxSim for a set of queries (query_id, ordinal, vector).

    Tokens are dealt by document and stream through a task in document order; a
    batch is scored against a block of query tokens by one matrix product, a
    document's best similarities are carried from batch to batch, and a task sends
    its k best documents of each query to the final ranking.  Queries come to the
    workers in blocks of about :data:`TOKENS` tokens, each a pass.  ``allowed``: a
    column of ``tokens`` with the array of query ids that a document is a candidate of.
    """
    spark, kinds, qkind = tokens.sparkSession, dict(tokens.dtypes), dict(queries.dtypes)[query_id]
    schema = f"query_id {qkind}, doc_id {kinds['doc_id']}, key double"
    dealt = tokens.where("vector is not null").select("doc_id", F.col("vector").cast("array<double>").alias("vector"), *([F.col(allowed).alias("allowed")] if allowed else []))
    dealt = dealt.repartition("doc_id").sortWithinPartitions("doc_id")
    if allowed:  # a document's first row alone has the array
        dealt = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id")))
    parts, out = max(1, -(-queries.count() // TOKENS)), None
    for part in range(parts):
        block = queries if parts == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(parts)) == part)
        held = block.orderBy(query_id, "ordinal").select(query_id, F.col("vector").cast("array<double>")).collect()  # about TOKENS rows, whole queries
        if not held:
            continue
        names = list(dict.fromkeys(r[0] for r in held))
        place = {x: i for i, x in enumerate(names)}
        starts = [i for i, r in enumerate(held) if i == 0 or held[i - 1][0] != r[0]]
        share = spark.sparkContext.broadcast((names, place, np.array(starts), np.array([r[1] for r in held], float)))

        def run(batches, share=share):
            import pyarrow as pa

            names, place, starts, q = share.value
            unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            if metric == "cosine":
                q = unit(q)
            best, schema = Best(len(names), k), None
            last: tuple | None = None

            def done(docs, top, asked):
                """Finished documents with their best similarities (query tokens x documents)."""
                key = -np.add.reduceat(top, starts, axis=0)
                if allowed:
                    mask = np.ones(key.shape, bool)
                    for j, ids in enumerate(asked):
                        mask[[place[x] for x in ids or [] if x in place], j] = False
                    key[mask] = np.inf
                ids = np.array(docs, object)
                for i, row in enumerate(key):
                    at = np.flatnonzero((row <= best.bound(i)) & (row < np.inf))
                    if len(at) > k:
                        at = at[row[at] <= np.partition(row[at], k - 1)[k - 1]]
                    if len(at):
                        best.add(i, row[at], ids[at])

            for b in batches:
                schema = b.schema
                if not b.num_rows:
                    continue
                x = matrix(b.column(1))
                s = q @ (unit(x) if metric == "cosine" else x).T
                docs = b.column(0).to_pylist()
                cuts = [i for i, d in enumerate(docs) if i == 0 or docs[i - 1] != d]
                top = np.maximum.reduceat(s, cuts, axis=1)
                names_here = [docs[i] for i in cuts]
                asked = b.column(2).take(pa.array(cuts)).to_pylist() if allowed else [None] * len(cuts)
                if last is not None and last[0] == names_here[0]:
                    top[:, 0] = np.maximum(top[:, 0], last[1])
                    asked[0] = last[2]
                elif last is not None:
                    done([last[0]], last[1][:, None], [last[2]])
                if len(cuts) > 1:
                    done(names_here[:-1], top[:, :-1], asked[:-1])
                last = (names_here[-1], top[:, -1].copy(), asked[-1])
            if last is not None:
                done([last[0]], last[1][:, None], [last[2]])
            if schema is not None:
                at, ids, keys = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at.tolist()]), pa.array(ids.tolist(), schema.field(0).type), pa.array(keys, pa.float64())], names=["query_id", "doc_id", "key"])

        part_of = dealt
        if allowed:
            # and of the array, the queries of this pass
            asked = F.col("allowed") if parts == 1 else F.filter("allowed", lambda x: F.pmod(F.xxhash64(x), F.lit(parts)) == F.lit(part))  # noqa: B023: called at once
            part_of = dealt.select("doc_id", "vector", F.when(F.col("_n") == 1, asked).alias("allowed"))
        rows = part_of.mapInArrow(run, schema)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], schema)
    return ranked(out, k, F.col("key"), F.col("doc_id"), by=["query_id"]).select("query_id", "doc_id", (-F.col("key")).alias("score"), "rank")


def search(tokens: DataFrame, query: Sequence[Sequence[float]], k: int = 10, *, metric: str = "cosine", tree=None) -> DataFrame:
    """Top-k documents by MaxSim; the filter reads the anchor token's columns; an empty query finds nothing."""
    if tree is not None:
        tokens = tokens.join(where(tokens.where("ordinal = 0"), tree).select("doc_id"), "doc_id", "left_semi")
    return max_sim_scores(tokens, query, metric).orderBy(F.desc("score"), "doc_id").limit(k)
