"""The pipeline against a brute-force version, stage by stage and as a whole."""

import os
import shutil

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from cairnspark.llm import queries, rule_ensemble
from tests.llm import test_decontaminate, test_line_dedup, test_near_dedup

STAGES = dict(corpus_pipeline.STAGES)


def quality(spark, docs, sf):
    table = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string")
    scores = rule_ensemble.classify(table, spark.read.parquet(f"{sf}/labels.parquet")).where("score >= 0.5")
    keep = {r.doc_id for r in scores.collect()}
    return [(i, t) for i, t in docs if i in keep]


def lines(docs):
    out = test_line_dedup.brute(docs)
    return [(i, out[i]) for i, t in docs if out[i] == t or out[i].strip()]


def near(docs):
    found = test_near_dedup.brute(docs, 5)
    return [(i, t) for i, t in docs if found[i][1] == i]


def clean(docs, items):
    return [(i, t) for i, t in docs if not test_decontaminate.brute(t, items)[4]]


def test_run(spark, sf):
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_dups", "benchmark", "tokens"]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    steps = [docs, quality(spark, docs, sf)]
    steps.append(lines(steps[-1]))
    steps.append(near(steps[-1]))
    steps.append(clean(steps[-1], items))
    assert len({len(x) for x in steps}) >= 4  # most stages find something here
    exact = sentencepiece.SentencePieceProcessor(model_file=queries.SPM_MODEL)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in rows) == sorted((i, exact.encode(t or "")) for i, t in steps[-1])
    assert all(r.round_trip and r.parity for r in rows)


@pytest.fixture(scope="module")
def folder(sf, tmp_path_factory):
    """Labels and benchmark as they are; the stages get their documents handed."""
    d = str(tmp_path_factory.mktemp("tables"))
    for t in ("labels", "benchmark"):
        shutil.copy(f"{sf}/{t}.parquet", os.path.join(d, f"{t}.parquet"))
    return d


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_any_rows(spark, awkward, empty, folder, name):
    out = STAGES[name](spark, awkward, folder)
    assert STAGES[name](spark, empty, folder).count() == 0
    if name != "tokens":
        assert out.schema.simpleString() == awkward.schema.simpleString()
        assert out.count() <= awkward.count()
    else:
        assert out.count() == awkward.count()


def test_lines_stage_counts_characters_anew(spark, folder):
    line = "a line of some length that comes again and again"
    docs = spark.createDataFrame([(1, line + "\nfirst", "en", "s", 7), (2, "second\n" + line, "en", "s", 55), (3, line + "\n\n", "en", "s", 50)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = {r.doc_id: (r.text, r.n_chars) for r in STAGES["lines"](spark, docs, folder).collect()}
    assert rows == {1: (line + "\nfirst", 7), 2: ("second", 6)}


def test_one_document_of_each_group_stays(spark, folder):
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join([*words[: 199 - i % 3], "end"]), "en", "s", 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in STAGES["near_dups"](spark, docs, folder).collect()] == [0]


def test_contaminated_documents_go(spark, folder):
    item = spark.read.parquet(f"{folder}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    docs = spark.createDataFrame([(1, "before " + item.upper() + " after", "en", "s", 1), (2, "nothing of the kind", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in STAGES["benchmark"](spark, docs, folder).collect()] == [2]
