import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark import schema
from cairnspark.functions import crypto, dialects, placement, text
from cairnspark.functions import vectors as V
from cairnspark.functions.predicates import FilterError, columns_of, compile_filter, constrained_fields

BIG = 9007199254740993  # 2**53 + 1


def hits(spark, payloads, tree):
    rows = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "i int, p string")
    return [r.i for r in rows.where(compile_filter(tree, payload=F.parse_json("p"))).orderBy("i").collect()]


PAYLOADS = [{"a": 30}, {"a": 30.0}, {"a": "30"}, {"a": None}, {}, {"a": True}, {"a": [1, 2]}, {"u": {"v": True}}, {"a": BIG}, {"a": 4.5}, {"a": {"y": 1, "x": 2}}]


@pytest.mark.parametrize("tree, want", [
    ({"eq": {"field": "a", "value": 30}}, [0, 1]),
    ({"eq": {"field": "a", "value": 30.0}}, [0, 1]),
    ({"eq": {"field": "a", "value": "30"}}, [2]),
    ({"eq": {"field": "a", "value": None}}, [3]),
    ({"eq": {"field": "a", "value": True}}, [5]),
    ({"eq": {"field": "a", "value": [1, 2]}}, [6]),
    ({"eq": {"field": "a", "value": {"x": 2, "y": 1}}}, [10]),
    ({"eq": {"field": "u.v", "value": True}}, [7]),
    ({"eq": {"field": "a", "value": BIG}}, [8]),
    ({"gt": {"field": "a", "value": BIG - 1}}, [8]),
    ({"eq": {"field": "a", "value": 5}}, []),
    ({"ne": {"field": "a", "value": 30}}, [2, 3, 4, 5, 6, 7, 8, 9, 10]),
    ({"in": {"field": "a", "values": ["30", 4.5]}}, [2, 9]),
    ({"in": {"field": "a", "values": []}}, []),
    ({"lt": {"field": "a", "value": 31}}, [0, 1, 9]),
    ({"gte": {"field": "a", "value": "3"}}, [2]),
    ({"lte": {"field": "a", "value": True}}, []),
    ({"exists": {"field": "a"}}, [0, 1, 2, 3, 5, 6, 8, 9, 10]),
    ({"not": {"lt": {"field": "a", "value": 31}}}, [2, 3, 4, 5, 6, 7, 8, 10]),
    ({"and": []}, list(range(11))),
    ({"or": []}, []),
])
def test_predicates(spark, tree, want):
    assert hits(spark, PAYLOADS, tree) == want


@pytest.mark.parametrize("bad", ["{", {"eq": {}}, {"xx": {"field": "a"}}, {"and": {}}, {"eq": {"field": "a"}}, {"in": {"field": "a", "values": 3}}, [], {"eq": {"field": 3, "value": 1}}])
def test_malformed_filters(bad):
    with pytest.raises(FilterError):
        compile_filter(bad)


def test_typed_columns_are_pushed_down(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    plan = d.where(compile_filter({"and": [{"eq": {"field": "lang", "value": "en"}}, {"gt": {"field": "n_chars", "value": 5}}]}, columns_of(d.dtypes)))._jdf.queryExecution().toString()
    assert "EqualTo(lang,en)" in plan and "GreaterThan(n_chars,5)" in plan
    assert not d.where(compile_filter({"eq": {"field": "lang", "value": 5}}, columns_of(d.dtypes))).count()


def test_candidate_narrowing():
    eq = lambda f: {"eq": {"field": f, "value": 1}}
    assert constrained_fields({"and": [eq("a"), {"not": eq("b")}]}) == {"a"}
    assert constrained_fields({"or": [eq("a"), {"exists": {"field": "b"}}]}) is None


def test_dialects():
    assert dialects.from_conditions({"operator": "AND", "conditions": [{"field": "meta.a", "operator": "==", "value": 1}, {"operator": "NOT", "conditions": [{"field": "b", "operator": "not in", "value": [1]}]}]}) == {"and": [{"eq": {"field": "a", "value": 1}}, {"not": {"and": [{"not": {"in": {"field": "b", "values": [1]}}}]}}]}
    assert dialects.from_metadata_filters({"condition": "or", "filters": [{"key": "a", "value": 1}, {"key": "b", "operator": "<=", "value": 2}]}) == {"or": [{"eq": {"field": "a", "value": 1}}, {"lte": {"field": "b", "value": 2}}]}
    with pytest.raises(FilterError):
        dialects.from_conditions({"field": "a", "operator": "~", "value": 1})


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_vector_metrics(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(2.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.dot(a, b)) == 8 and one(spark, V.l2_squared(a, b)) == 13 and one(spark, V.cosine(a, b)) == pytest.approx(0.8)
    assert one(spark, V.cosine(a, zero)) == 0 and one(spark, V.normalize(zero)) == [0, 0]
    assert one(spark, V.hamming(F.array(F.lit(-1)), F.array(F.lit(0)))) in (32, 64)
    tokens = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))
    assert one(spark, V.max_sim("cosine", F.array(a, b), tokens)) == pytest.approx(1.8)
    assert one(spark, V.max_sim("dot", F.array(a), F.array().cast("array<array<double>>"))) == 0


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"), ("running", "run"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("conditional", "condit"), ("happy", "happi"), ("generously", "generous"), ("knightly", "knight"), ("consistency", "consist"), ("skies", "sky"), ("by", "by"), ("national", "nation"), ("controlling", "control"), ("communism", "communism"), ("adoption", "adopt")])
def test_stems(word, want):
    assert text.stem(word) == want


def test_tokens_and_terms(spark):
    assert one(spark, text.tokens(F.lit("The Café, 42 dogs & the DOGS!"))) == ["café", "42", "dogs", "dogs"]
    assert one(spark, text.tokens(F.lit("The runners were running"), stem=True)) == ["runner", "were", "run"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []
    for w in ("hello", "ñ", "a"):
        assert one(spark, text.term_id(F.lit(w))) == text.fnv1a(w.encode())
    v = one(spark, text.term_frequencies(F.lit("dog cat dog")))
    assert sorted(v["values"]) == [1.0, 2.0]
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, text.sparse_dot(arr(1, 5), arr(2.0, 3.0), arr(5, 9), arr(4.0, 1.0))) == 12
    assert not one(spark, text.valid_sparse(arr(1, 1), arr(2.0, 3.0))) and one(spark, text.valid_sparse(arr(1, 2), arr(2.0, 3.0)))


def test_sealing(spark):
    key = b"k" * 16
    env = crypto.seal(F.lit('{"a":1}'), key, "c")
    assert one(spark, crypto.open_sealed(env, key, "c")) == '{"a":1}' and one(spark, crypto.is_sealed(env))
    with pytest.raises(Exception):
        one(spark, crypto.open_sealed(env, key, "other"))
    v = F.array(F.lit(1.5), F.lit(-2.0)).cast("array<float>")
    assert one(spark, crypto.open_vector(crypto.seal_vector(v, key), key, 2)) == [1.5, -2.0]


def test_distance_preserving():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 16))
    exact = crypto.DistancePreserving(b"key", 16, scale=3.0)
    y = np.array([exact.encrypt(v, b"%d" % i)[0] for i, v in enumerate(x)])
    assert np.allclose(((y - y[0]) ** 2).sum(1), 9 * ((x - x[0]) ** 2).sum(1))
    noisy = crypto.DistancePreserving(b"key", 16, scale=2.0, beta=0.5)
    out, tag = noisy.encrypt(x[0], b"n")
    assert np.allclose(noisy.decrypt(out, b"n", tag), x[0])
    assert np.linalg.norm(out - 2 * x[0][noisy.order]) <= 2 * 0.5 / 4 + 1e-9
    with pytest.raises(crypto.TagError):
        noisy.decrypt(out + 1, b"n", tag)


def test_placement(spark):
    ids = [str(i) for i in range(2000)]
    before, after = ([placement.owner(i, list(range(n))) for i in ids] for n in (4, 5))
    assert all(a == b or b == 4 for a, b in zip(before, after)) and 250 < after.count(4) < 550
    rows = spark.createDataFrame([(i,) for i in ids[:50]], "id string").select("id", placement.owner_column(F.col("id"), [0, 1, 2]).alias("s"))
    assert all(r.s == placement.owner(r.id, [0, 1, 2]) for r in rows.collect())
    m = placement.ShardMap().add(0).add(1).join(2)
    assert m.active() == [0, 1] and m.owners() == [0, 1, 2] and m.version == 3
    moved = [i for i in ids if m.owner(i) == 2]
    assert moved and all(m.donor(i) in (0, 1) for i in moved)
    assert m.promote(2).leave(0).owners() == [1, 2]


def test_specs():
    S = schema.CollectionSpec
    assert S.from_json(S(8, "l2", filterable={"a.b": "numeric"}).to_json()) == S(8, "l2", filterable={"a.b": "numeric"})
    for bad in (S(0), S(8, "l1"), S(8, "l2", multivector=True), S(8, "dot", schema.IndexSpec("ivf")), S(8, "cosine", vector_encryption="dcpe"), S(8, "cosine", schema.IndexSpec("colbert")), S(8, "cosine", multivector=True, vector_encryption="client_side")):
        with pytest.raises(schema.SpecError):
            bad.check()
    for name in ("", "a/b", "x" * 256, ".."):
        with pytest.raises(schema.SpecError):
            schema.check_name(name)
    assert schema.default_subspaces(64) == 8 and schema.default_subspaces(7) == 1


def test_vectorised_owners_and_migration(spark):
    names = ["", "a", "é漢", "x" * 40, *map(str, range(300))]
    assert placement.owners(names, [4, 0, 7]).tolist() == [placement.owner(n, [4, 0, 7]) for n in names]
    p = spark.createDataFrame([(n,) for n in names] + [(None,)], "id string")
    rows = p.select("id", placement.owner_column(F.col("id"), [0, 1]).alias("s")).collect()
    assert all(r.s == (None if r.id is None else placement.owner(r.id, [0, 1])) for r in rows)
    moved = placement.migration(p, [0, 1], [0, 1, 2]).collect()
    assert {r.target for r in moved} == {2} and {r.id for r in moved} == {n for n in names if placement.owner(n, [0, 1, 2]) == 2}


def test_term_frequencies_by_batch(spark, monkeypatch):
    """Ids and counts of many texts at once, over several blocks of words; no byte is an expression's step."""
    monkeypatch.setattr(text, "COUNTED", 3, raising=False)
    texts = ["b a b ñez", "", None, "the", "x" * 300 + " y y", "b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", text.term_frequencies(F.col("t")).alias("v"))
    assert "conv(" not in rows._jdf.queryExecution().toString()
    for r in rows.collect():
        want = {text.fnv1a(w.encode()): (texts[r.i] or "").split().count(w) for w in (texts[r.i] or "").split() if w not in text.STOP_WORDS}
        assert dict(zip(r.v["indices"], r.v["values"])) == want and r.v["indices"] == sorted(want)


def test_hash_embedder_in_batches(monkeypatch):
    """All texts are hashed together, a text once for all components."""
    from cairnspark.operators import fusion

    texts = ["", "a", "ñez " * 50, "x" * 3000] + [f"t{i}" * (i % 40) for i in range(100)]
    want = [[(text.fnv1a(f"{t}:{i}".encode(), 64) >> 40) / 2**23 - 1 for i in range(11)] for t in texts]
    monkeypatch.setattr(text, "fnv1a", None)
    assert fusion.hash_embedder(11)(texts) == want and fusion.hash_embedder(3)([]) == []
