import hashlib
import random
import re

import pytest

from cairnspark.llm import common, decontaminate, queries


def words(text):
    t = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(text, items, window=10):
    """n_words, n_hit, item ids by looking for every window at every place."""
    w = words(text)
    hit, ids = set(), set()
    for i, t in items:
        v = words(t)
        n = min(window, len(v))
        wins = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if v else set()
        for s in range(len(w) - n + 1):
            if n and tuple(w[s : s + n]) in wins:
                hit.update(range(s, s + n))
                ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def held(rows, texts, items):
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(texts[r.doc_id], items), r.doc_id


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = queries.op7_decontamination(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and any(r.contaminated for r in rows)
    held(rows, texts, items)


def test_overlaps_short_items_and_repeats(spark):
    r = random.Random(4)
    pick = lambda n: " ".join(r.choice("ab") + r.choice("xy") for _ in range(n))
    items = [(i, pick(n)) for i, n in enumerate([1, 2, 3, 4, 9, 10, 11, 12, 30, 10])] + [(20, ""), (21, None), (22, "…!"), (23, "Ünï-çødé word's"), (5, pick(10)), (24, "zz " * 12), (24, "zz " * 12)]
    docs = [(i, pick(r.choice([0, 1, 5, 60, 200]))) for i in range(60)] + [(100, "zz " * 9), (101, "ZZ, zz;" * 40), (102, "ünï çødé WORD s"), (103, "Ünï çødé word s" + "\x00" + "zz " * 10)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    held(decontaminate.decontaminate(d, b).select("doc_id", "hit.*").collect(), dict(docs), items)


@pytest.mark.parametrize("hot", [1024, 8])
def test_shuffled_joins_give_the_same(spark, monkeypatch, hot):
    """No broadcast at all, a passage in every text and one text in a third of all rows."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "WIDE_ROWS", 0)
    monkeypatch.setattr(common, "HOT", hot)
    r = random.Random(8)
    pick = lambda n: " ".join(r.choice("abcd") + r.choice("xyz") for _ in range(n))
    common_one, template = pick(15), pick(12)
    items = [(1, common_one), (2, "one two"), (3, "q")] + [(i, template + " " + pick(4)) for i in range(10, 40)]
    docs = [(i, f"{pick(20)} {common_one} {pick(9)}") for i in range(40)] + [(i, template) for i in range(100, 130)] + [(i, r.choice([None, "", "one two three", "q q q"])) for i in range(200, 220)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(d, b).select("doc_id", "hit.*").collect()
    assert len(out) == len(docs)
    held(out, dict(docs), items)


def test_other_window(spark):
    docs, items = [(1, "a b c d e f"), (2, "x b c")], [("i", "a b c d"), ("j", "c x")]
    rows = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), window=2).select("doc_id", "hit.*").collect()
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(dict(docs)[r.doc_id], items, 2)


def test_null_and_empty(spark, awkward, empty):
    items = spark.createDataFrame([(1, "go on for a while some plain words stand here and they"), (None, "plain words stand here and they go on for a while"), (2, "É▁ß".lower())], "item_id long, text string")
    out = decontaminate.decontaminate(awkward, items)
    assert out.columns[:-1] == awkward.columns and out.columns[-1] == "hit_"
    rows = {r.doc_id: r.hit_ for r in out.collect() if r.doc_id}
    assert out.count() == awkward.count() and rows[8].n_items == 1
    assert (rows[1].n_items, rows[1].items_sha256) == (2, hashlib.sha256(b",1").hexdigest())
    assert [rows[i].n_words for i in (3, 4, 7)] == [0, 0, 0] and not rows[5].contaminated
    assert decontaminate.decontaminate(empty, items).count() == 0
    none = decontaminate.decontaminate(awkward, items.limit(0)).collect()
    assert len(none) == awkward.count() and not any(r.hit_.contaminated for r in none)


def test_main_path_is_native(spark, sf):
    plan = queries.op7_decontamination(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Cartesian" not in plan and "NestedLoop" not in plan
