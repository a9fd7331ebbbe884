"""Id and text columns of any name, in every operator."""

import pytest

from cairnspark.llm import decontaminate, line_dedup, near_dedup, queries, rule_ensemble, secret_scan, sharding, spm, token_count, warc, weak_rules


@pytest.fixture(scope="module")
def odd(spark):
    some = "Some plain words stand here, and they go on for a while. " * 3
    return spark.createDataFrame([(1, some), (2, some), (3, None), (4, "")], "`doc.id` long, `the text` string")


ID, TEXT = {"id_col": "doc.id"}, {"text_col": "the text"}


def test_names(spark, odd):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "plain words stand here and they go on for a")], "item_id long, text string")
    both = {**ID, **TEXT}
    assert secret_scan.scan(odd, **both).count() == 4
    assert spm.encode_decode(odd, queries.SPM_MODEL, **both).count() == token_count.token_counts(odd, queries.SPM_MODEL, **both).count() == 4
    assert sharding.assign(odd, 3, **both).count() == weak_rules.assess(odd, **both).count() == 4
    assert sorted(r.component_id for r in near_dedup.components(odd, **both).collect()) == [1, 1, 3, 4]
    assert near_dedup.dedup(odd, **both).columns == line_dedup.dedup_lines(odd, **both).columns[:-1] == odd.columns
    assert rule_ensemble.classify(odd, labels, **both).count() == 4
    assert sum(r.hit.contaminated for r in decontaminate.decontaminate(odd, items, **TEXT).select("hit").collect()) == 2
    pages = odd.selectExpr("`doc.id` as `page.id`", "'u' as `the.url`", "`the text` as `h.t`")
    assert warc.round_trip(pages, id_col="page.id", url_col="the.url", payload_col="h.t").count() == 4


def test_secret_scan_without_source_or_language(spark):
    docs = spark.createDataFrame([(1, "password=abcdefghijkl"), (2, "password=abcdefghijkl")], "doc_id long, text string")
    assert [(r.n_assign, r.n_live) for r in secret_scan.scan(docs).collect()] == [(1, 1)] * 2
