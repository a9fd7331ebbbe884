import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairnspark.llm import queries, rule_ensemble
from cairnspark.llm.textstats import text_counts

from .test_weak_rules import base, more


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.01"
    return queries.op9_quality_classifier(spark, sf).toPandas(), spark.read.parquet(f"{sf}/labels.parquet").toPandas(), spark.read.parquet(f"{sf}/documents.parquet").count()


def test_query(scored):
    rows, labels, n = scored
    assert len(rows) == n and rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows.itertuples())


def test_held_out_accuracy(scored):
    rows, labels, _ = scored
    both = rows[rows.held_out].merge(labels, on="doc_id")
    assert len(both) > 80 and (both.predicted == both.quality).mean() > 0.97


def test_labels_of_held_out_rows_are_not_read(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(rule_ensemble.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda y: {r.doc_id: r.score for r in rule_ensemble.classify(docs, y).collect()}
    assert score(labels) == score(flipped)


def test_only_the_text_counts(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    other = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x")).withColumn("n_chars", F.lit(0))
    score = lambda d: {r.doc_id: r.score for r in rule_ensemble.classify(d, labels).collect()}
    assert score(docs) == score(other)


def test_compiled_rules_are_the_model(spark, sf):
    """The column expression against the same rules in numpy."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = rule_ensemble.train(docs, labels)
    inputs = rule_ensemble.statistics()
    rows = text_counts(docs, F.col("text"), {"doc_id": F.col("doc_id")}).select(*[c.alias(k) for k, c in inputs.items()], model.column(inputs).alias("score")).toPandas()
    z = model.intercept + rule_ensemble.covers([r for r, _ in model.rules], rows[model.names].to_numpy(float)) @ np.array([w for _, w in model.rules])
    assert rows.score.to_numpy() == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)
    assert 0 < len(model.rules) < 200 and all(len(r) <= 3 for r, _ in model.rules)


def test_query_end_to_end(spark, sf):
    """Statistics of each text in plain Python, and the model fitted on them: the query's scores."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}

    def inputs(text):
        (n, chars, symbols, dup, repeat), m = base(text), more(text)
        w, lines = max(n, 1), max(m["n_lines"], 1)
        letters = max(m["n_upper"] + m["n_lower"] + m["n_wide"], 1)
        return [math.log1p(n), chars / w, symbols / w, m["n_bang"] / w, m["n_pipe"] / w, m["n_upper"] / letters, m["n_digits"] / max(chars, 1), m["n_punct"] / w, repeat / w, dup / lines, m["n_distinct_words"] / math.sqrt(w), n / lines, m["n_ended_lines"] / lines]

    def order(i):
        h = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest((11).to_bytes(4, "little"), 42))
        return h - (1 << 64) if h >> 63 else h

    fitted = sorted((i for i in labels if i in docs and zlib.crc32(str(i).encode()) % 3 != 1), key=order)
    model = rule_ensemble.fit(list(rule_ensemble.statistics()), np.array([inputs(docs[i]) for i in fitted]), np.array([float(labels[i]) for i in fitted]))
    for r in queries.op9_quality_classifier(spark, sf).collect():
        x = inputs(docs[r.doc_id])
        z = model.intercept + sum(w for rule, w in model.rules if all((x[i] > at) if above else (x[i] <= at) for i, above, at in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and r.predicted == (r.score >= 0.5)


def test_lasso_drops_rules_that_say_nothing():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 6))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.4)).astype(float)
    m = rule_ensemble.fit(list("abcdef"), x, y)
    p = m.intercept + rule_ensemble.covers([r for r, _ in m.rules], x) @ np.array([w for _, w in m.rules])
    assert ((p > 0) == (y == 1)).mean() > 0.98
    grown = rule_ensemble.grow(x, y)
    assert len(m.rules) < len(grown) / 2


def test_null_and_empty(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (4, 0, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = rule_ensemble.classify(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(not r.held_out for r in rows if r.doc_id is None)
    same = [r.score for r in rows if r.doc_id in (1, 2)]
    assert len(set(same)) == 1 and len(same) == 3
    kept = rule_ensemble.keep_good(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() == sum(r.predicted for r in rows)
    assert rule_ensemble.classify(empty, labels).count() == 0 and rule_ensemble.keep_good(empty, labels).count() == 0
    none = rule_ensemble.classify(awkward, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
