"""Versioned collections, streaming apply, connectors, facade."""

import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark.functions import vectors as V
from cairnspark.operators import cells, evaluate, fusion, lexical, multivector, quantize, search
from cairnspark.plans.table import Catalog, Collection, ConflictError, Manifest
from cairnspark.schema import CollectionSpec, IndexSpec, SpecError
from cairnspark.session import AccessError, Engine, Grant, VectorStore
from cairnspark.sources import connectors, vecs
from cairnspark.streaming import oplog


def points(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], json.dumps(p)) for i, v, p in rows], "id string, vector array<float>, payload string")


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/cat")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_lifecycle(spark, catalog, tmp_path):
    c = catalog.create("a", CollectionSpec(2, "l2", filterable={"n": "numeric", "tag.x": "keyword"}))
    with pytest.raises(FileExistsError):
        catalog.create("a", CollectionSpec(2, "l2"))
    c.upsert(points(spark, [("p1", (0, 1), {"n": 1, "tag": {"x": "u"}}), ("p2", (1, 1), {"n": "1"}), ("p3", (2, 2), {})]))
    v1 = c.manifest().version
    c.upsert(points(spark, [("p2", (5, 5), {"n": 7})]))
    assert c.count() == 3 and ids(c.where({"gte": {"field": "n", "value": 1}})) == ["p1", "p2"]
    assert ids(c.where({"eq": {"field": "tag.x", "value": "u"}})) == ["p1"] and ids(c.where({"gte": {"field": "n", "value": 1}}, v1)) == ["p1"]
    assert c.delete(spark.createDataFrame([("p3",), ("zz",)], "id string")) == 1
    assert ids(c.snapshot()) == ["p1", "p2"] and ids(c.snapshot(v1)) == ["p1", "p2", "p3"]
    c.upsert(points(spark, [("p3", (9, 9), {})]))
    assert ids(c.snapshot()) == ["p1", "p2", "p3"] and c.tail(3).count() == 1
    before = sorted(map(tuple, c.snapshot().select("id", "lsn").collect()))
    c.compact()
    assert sorted(map(tuple, c.snapshot().select("id", "lsn").collect())) == before and len(c.manifest().segments) == 1
    assert c.vacuum() == 4 and c.count() == 3
    info = c.backup(f"file://{tmp_path}/backup")
    assert info["bytes"] > 0
    with pytest.raises(FileExistsError):
        c.backup(f"file://{tmp_path}/backup")
    back = Collection.restore(spark, f"file://{tmp_path}/backup", f"file://{tmp_path}/again")
    assert ids(back.snapshot()) == ["p1", "p2", "p3"] and c.delete_where({"gte": {"field": "n", "value": 5}}) == 1
    assert catalog.names() == ["a"] and {r["collection"]: r["points"] for r in catalog.stats().collect()} == {"a": 2, None: 2}
    assert catalog.drop("a") and not catalog.drop("a")


def test_prepared_operations_write_nothing(spark, catalog):
    c = catalog.create("prepared", CollectionSpec(2, "l2"))
    up = c.prepare_upsert(points(spark, [("p1", (0, 1), {})]))
    gone = c.prepare_delete(spark.createDataFrame([("p9",)], "id string"))
    assert [(r.id, r.op, r.lsn) for r in up.unionByName(gone).collect()] == [("p1", "upsert", 1), ("p9", "delete", 1)] and c.manifest().version == 0


def test_batches_and_conflicts(spark, catalog):
    c = catalog.create("b", CollectionSpec(2, "l2"))
    rows = points(spark, [("p", (0, 1), {"v": 1}), ("p", (0, 2), {"v": 2})]).withColumn("ord", F.get_json_object("payload", "$.v").cast("int"))
    c.upsert(rows)
    assert c.snapshot().first()["vector"] == [0, 2]
    with pytest.raises(Exception, match="components"):
        c.upsert(points(spark, [("p", (1, 2, 3), {})]))
    with pytest.raises(ConflictError):
        c.files.create(c._manifest(1), Manifest(1, 1, ()).to_json())
    with pytest.raises(SpecError, match="repeat"):
        c.upsert(rows.drop("ord"))


def test_followed_log(spark, catalog, tmp_path):
    c, log = catalog.create("f", CollectionSpec(1, "l2")), str(tmp_path / "log")
    schema = "id string, op string, lsn long, vector array<float>, payload string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
    write([("a", "upsert", 1, [1.0], "{}"), ("b", "upsert", 2, [2.0], "{}"), ("b", "delete", 3, None, None)])
    run = lambda cp: oplog.follow(oplog.read_log(spark, log, schema, 1), c, str(tmp_path / cp)).awaitTermination()
    run("cp")
    write([("b", "upsert", 2, [2.0], "{}"), ("a", "upsert", 4, [4.0], "{}"), ("c", "upsert", 5, [5.0], "{}")])
    run("cp")
    assert {r.id: r.vector[0] for r in c.snapshot().collect()} == {"a": 4.0, "c": 5.0}
    run("other")  # a replay from the start changes nothing
    assert {r.id: r.vector[0] for r in c.snapshot().collect()} == {"a": 4.0, "c": 5.0}


def test_stateful_apply(spark, tmp_path):
    log, name = str(tmp_path / "log"), "s" + uuid.uuid4().hex
    schema = "id long, op string, lsn long, value double"
    for rows in ([(1, "upsert", 5, 1.0), (2, "upsert", 6, 2.0)], [(1, "upsert", 3, 9.0), (2, "delete", 7, None)], [(2, "upsert", 6, 2.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
    out = oplog.apply_stateful(oplog.read_log(spark, log, schema, 1), "double")
    out.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = {}
    for r in spark.table(name).orderBy("lsn").collect():
        last[r.id] = (r.lsn, r.op)
    assert last == {1: (5, "upsert"), 2: (7, "delete")}


def test_importers(spark, tmp_path, catalog):
    a = tmp_path / "a.jsonl"
    a.write_text('{"id": 1, "vector": [1, 2], "payload": {"x": 1}}\n\n{"id": "b", "vector": {"only": [3, 4]}}\n')
    got = {r.id: (r.vector, r.payload) for r in connectors.read_points_jsonl(spark, str(a)).collect()}
    assert got == {"1": ([1, 2], '{"x":1}'), "b": ([3, 4], "{}")}
    b = tmp_path / "b.jsonl"
    b.write_text('{"id": 7, "embedding": " [0.5, 1] ", "name": "n", "k": 3}\n{"id": 8, "embedding": [1, 2], "name": null}\n')
    got = {r.id: (r.vector, json.loads(r.payload)) for r in connectors.read_rows_jsonl(spark, str(b)).collect()}
    assert got == {"7": ([0.5, 1], {"name": "n", "k": 3}), "8": ([1, 2], {"name": None})}
    c = tmp_path / "c.json"
    c.write_text('{"ids": ["p", "q"], "embeddings": [[1, 0], [0, 1]],\n "metadatas": [{"k": 1}, null], "documents": ["one", null]}')
    got = {r.id: (r.vector, json.loads(r.payload)) for r in connectors.read_parallel_arrays(spark, str(c)).collect()}
    assert got == {"p": ([1, 0], {"k": 1, "document": "one"}), "q": ([0, 1], {})}
    for bad in ('{"ids": ["p"], "embeddings": []}', '{"ids": ["p"], "embeddings": [[1]], "documents": []}'):
        c.write_text(bad)
        with pytest.raises(Exception, match="differ in length"):
            connectors.read_parallel_arrays(spark, str(c)).collect()
    a.write_text('{"id": 1, "vector": {"x": [1], "y": [2]}}\n')
    assert connectors.read_points_jsonl(spark, str(a), vector_name="y").first()["vector"] == [2]
    for match in ("several named",):
        with pytest.raises(Exception, match=match):
            connectors.read_points_jsonl(spark, str(a)).collect()
    a.write_text('{"id": true, "vector": [1]}\n')
    with pytest.raises(Exception, match="an id is"):
        connectors.read_points_jsonl(spark, str(a)).collect()
    lit = lambda t: spark.range(1).select(connectors.parse_literal(F.lit(t)).alias("v")).first()["v"]
    assert lit("[]") == [] and lit("[1, 2.5]") == [1, 2.5]
    with pytest.raises(Exception):
        lit("[1, x]")
    rows = connectors.read_rows_jsonl(spark, str(b))
    assert connectors.infer_dim(rows) == 2 and connectors.import_points(catalog, "imp", rows) == 2 and catalog.open("imp").count() == 2
    with pytest.raises(ValueError):
        connectors.infer_dim(rows.limit(0))


def test_paged_sources():
    store = [{"id": i, "vector": [i], "payload": {"n": i}} for i in range(5)]

    def scroll(path, body):
        at = body["offset"] or 0
        end = at + body["limit"]
        return {"result": {"points": store[at:end], "next_page_offset": end if end < 5 else None}}

    assert [x[0] for x in connectors.pages(scroll, "scroll", "c", 2)] == list("01234")

    def get(path, body):
        if body is None:
            return [{"id": "u-1", "name": "c"}, {"id": "u-2", "name": "d"}]
        assert path == "/collections/u-1/get"
        part = store[body["offset"] : body["offset"] + body["limit"]]
        return {"ids": [str(p["id"]) for p in part], "embeddings": [p["vector"] for p in part], "metadatas": [p["payload"] for p in part], "documents": ["d"] * len(part)}

    assert json.loads(list(connectors.pages(get, "offset", "c", 2))[4][2]) == {"n": 4, "document": "d"}


def test_vector_files(spark, tmp_path, monkeypatch):
    x = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "t_base.fvecs").write_bytes(vecs.encode(x))
    (tmp_path / "t_query.fvecs").write_bytes(vecs.encode(x[:1] + 0.1))
    assert [r.vector for r in vecs.read_vecs(spark, str(tmp_path / "t_base.fvecs")).orderBy("id").collect()] == x.tolist()
    monkeypatch.setattr(vecs, "SPLIT", 40)  # two rows a task
    assert [(r.id, r.vector) for r in vecs.read_vecs(spark, str(tmp_path / "t_base.fvecs")).orderBy("id").collect()] == list(enumerate(x.tolist()))
    got = vecs.load_benchmark(spark, f"file://{tmp_path}", "t", 2)
    assert [r.id for r in got["truth"].orderBy("rank").collect()] == [0, 1]
    with pytest.raises(ValueError):
        vecs.decode(vecs.encode(x)[:-4], "<f4")
    s = np.array([r.vector for r in vecs.synthetic(spark, 500, 8, seed=3).collect()])
    assert abs(s.mean()) < 0.05 and abs(s.std() - 1) < 0.05


def blobs(spark, n=1500, dim=16, k=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-5, 5, (k, dim))[rng.integers(0, k, n)] + rng.uniform(-0.5, 0.5, (n, dim))
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vector array<float>"), x


def test_layouts_recall(spark, tmp_path):
    p, x = blobs(spark)
    truth = {i: set(np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:10].tolist()) for i in range(5)}
    index = cells.CellIndex.build(p, f"file://{tmp_path}/ivf", cells=24, pq=4, iterations=8)
    again = cells.CellIndex.open(spark, index.path)
    pq = quantize.ProductQuantizer.train(p, 4, centroids=64)
    sq, bq = quantize.ScalarQuantizer.train(p), quantize.BinaryQuantizer.train(p)
    hit = {"cells": 0, "pq": 0, "sq": 0}
    coded = p.withColumn("code", pq.encode(F.col("vector"))).cache()
    for i, want in truth.items():
        q = x[i].tolist()
        got = {
            "cells": again.search(spark, q, 10, nprobe=8),
            "pq": quantize.two_phase(coded, pq.score(F.col("code"), q), q, 10, factor=10),
            "sq": quantize.two_phase(p, sq.score(sq.encode(F.col("vector")), q), q, 10),
        }
        for name, df in got.items():
            hit[name] += len(want & {r.id for r in df.collect()})
    assert all(v >= 45 for v in hit.values()), hit
    plan = again.search(spark, x[0].tolist(), nprobe=3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    err = coded.select(F.avg(F.aggregate(F.zip_with(pq.reconstruct(F.col("code")), F.col("vector").cast("array<double>"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)).alias("e")).first()["e"]
    assert err < ((x - x.mean(0)) ** 2).sum(1).mean() / 10
    assert p.select(bq.score(bq.encode(F.col("vector")), bq.encode(F.col("vector"))).alias("h")).distinct().collect()[0]["h"] == 0
    index.append(p.where("id < 3").withColumn("id", F.col("id") + 10_000))
    assert {10_000, 0} <= {r.id for r in index.search(spark, x[0].tolist(), 5, nprobe=4).collect()}
    even = index.rebalanced(spark, f"file://{tmp_path}/even", split=100, merge=5)
    assert even.sizes(spark).agg(F.sum("n")).first()[0] == 1503


def test_joins_over_layouts_recall(spark, tmp_path):
    """Every 100th row as a query against all rows; recall against the exact join."""
    p, x = blobs(spark)
    q = p.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    for metric in ("l2", "cosine"):
        truth = search.knn_join(p, q, 10, metric=metric)
        unit = metric == "cosine"
        v = V.normalize(F.col("vector")) if unit else F.col("vector")
        pq = quantize.ProductQuantizer.train(p.withColumn("vector", v), 8, centroids=64)
        sq = quantize.ScalarQuantizer.train(p)
        index = cells.CellIndex.build(p, f"file://{tmp_path}/join-{metric}", cells=24, metric=metric, iterations=8)
        found = {
            "cells": index.join(q, 10, nprobe=8),
            "pq": quantize.join(p.withColumn("code", pq.encode(v)), q, 10, pq, factor=10, metric=metric),
            "sq": quantize.join(p.withColumn("code", sq.encode(F.col("vector"))), q, 10, sq, metric=metric),
            "graph": cells.graph_join(p, q, 10, metric=metric),
        }
        for name, df in found.items():
            recall = evaluate.mean_recall(evaluate.recall_at_k(df, truth, 10)).first()[0]
            assert recall >= 0.9, (metric, name, recall)
        both = index.join(q, 10, nprobe=24)
        assert both.exceptAll(truth).count() == truth.exceptAll(both).count() == 0  # all cells: exact
    bq = quantize.BinaryQuantizer.train(p)
    near = bq.join(p.withColumn("code", bq.encode(F.col("vector"))), q, 5)
    bits = x.astype(np.float32).astype(float) > np.array(bq.mean)
    for r in near.collect():
        assert r.distance == (bits[r.query_id] != bits[r.id]).sum()
    assert near.where("rank = 1").select((F.col("id") == F.col("query_id")) | (F.col("distance") == 0)).distinct().collect()[0][0]


def test_join_with_one_vector_in_most_rows(spark):
    """A very frequent vector: ties go by id, and a task still sends k rows of each query at most."""
    p = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.col("id").cast("double"), F.lit(0.0))).alias("vector"))
    q = p.where("id in (0, 300)").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    assert [r.id for r in search.knn_join(p, q, 4).orderBy("query_id", "rank").collect()] == [0, 3, 6, 9] * 2


def test_maxsim_join(spark):
    rng = np.random.default_rng(3)
    rows = [(d, n, rng.normal(size=4).tolist()) for d in range(30) for n in range(d % 4 + 1)]
    tokens = spark.createDataFrame(rows, "doc_id long, ordinal long, vector array<double>")
    q = tokens.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    got = multivector.join(tokens, q, 3)
    for d in (0, 10, 20):
        want = multivector.search(tokens, [v for i, _, v in rows if i == d], 3).collect()
        assert [(r.doc_id, round(r.score, 9)) for r in got.where(F.col("query_id") == d).orderBy("rank").collect()] == [(r.doc_id, round(r.score, 9)) for r in want]


def test_knn_join_matches_brute_force(spark):
    p, x = blobs(spark, 300, 8)
    q = p.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    y = np.float32(x).astype(float)
    for metric in ("l2", "cosine", "dot"):
        got = {}
        for r in search.knn_join(p, q, 7, metric=metric).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        for i, found in got.items():
            key = {"l2": ((y - y[i]) ** 2).sum(1), "dot": -(y @ y[i]), "cosine": -(y @ y[i]) / np.linalg.norm(y, axis=1) / np.linalg.norm(y[i])}[metric]
            assert found == sorted(range(300), key=lambda j: (key[j], j))[:7]
    assert search.knn_join(p, q.limit(0), 3).count() == 0


def test_sparse_and_extraction(spark):
    d = spark.createDataFrame([(1, [1, 2], [1.0, 2.0], "dog"), (2, [1, 1], [1.0, 1.0], "dog"), (3, None, None, "dog dog cat"), (4, [2], [2.0], None), (5, None, None, None)], "id int, indices array<long>, values array<float>, text string")
    got = lexical.extract_postings(d)
    assert sorted({r.id for r in got.collect()}) == [1, 3, 4]
    assert [r.id for r in lexical.sparse_search(lexical.postings_from_sparse(d), {2: 1.0, 9: 5.0}).collect()] == [1, 4]


def test_bm25_by_hand(spark):
    d = spark.createDataFrame([(1, "red fox"), (2, "red red dog cat"), (3, "the of")], "id int, text string")
    import math

    dl, avg, n, df = {1: 2, 2: 4}, 3.0, 2, 2
    want = {i: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl[i] / avg)) for i, tf in ((1, 1), (2, 2))}
    got = {r.id: r.score for r in lexical.bm25_search(d, "red RED zebra").collect()}
    assert got == pytest.approx(want)


def test_documents(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/eng")
    e.create_collection("m", CollectionSpec(2, "cosine", multivector=True))
    docs = lambda rows: spark.createDataFrame(rows, "doc_id string, vectors array<array<float>>, payload string")
    e.upsert_documents("m", docs([("a", [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]], '{"n":1}'), ("b", [[0.0, 1.0]], "{}")]))
    assert [r.doc_id for r in e.search_documents("m", [[1.0, 0.0], [0.0, 1.0]]).collect()] == ["a", "b"] and e.document_count("m") == 2
    e.upsert_documents("m", docs([("a", [[0.0, 1.0]], '{"n":2}')]))
    r = e.get_document("m", "a").first()
    assert r.vectors == [[0, 1]] and r.payload == '{"n":2}' and e.count("m") == 2
    assert e.search_documents("m", []).count() == 0
    assert e.delete_document("m", "a") and not e.delete_document("m", "a") and e.document_count("m") == 1
    with pytest.raises(SpecError):
        e.search("m", [1.0, 0.0])
    got = spark.range(1).select(multivector.parse_token_id(F.lit("a\x1fb\x1f12")).alias("t"), multivector.parse_token_id(F.lit("x")).alias("u")).first()
    assert (got.t.doc_id, got.t.ordinal) == ("a\x1fb", 12) and got.u is None


def test_engine_and_store(spark, tmp_path):
    root = f"file://{tmp_path}/eng"
    e = Engine(spark, root)
    e.create_collection("docs", CollectionSpec(8, "cosine", filterable={"k": "numeric"}))
    fusion.register_provider("docs", embedder=fusion.hash_embedder(8), reranker=lambda q, ds: [float(len(set(q.split()) & set(d.split()))) for d in ds])
    s = VectorStore(e, "docs")
    s.add_texts(["red fox jumps", "blue dog sleeps", "green red dog"], ["1", "2", "3"])
    assert s.similarity_search("red fox jumps", 1) == ["red fox jumps"]
    assert [r.id for r in e.search_text("docs", "green dog", 2, rerank=True).collect()] == ["3", "2"]
    assert s.delete(["1", "9"]) == 1 and e.count("docs") == 2 and e.describe("docs")["count"] == 2
    assert [r.id for r in e.fetch("docs", offset=1, limit=5).collect()] == ["3"] and e.get("docs", "2").count() == 1
    guest = Engine(spark, root, Grant("read", ("do*",)))
    assert guest.count("docs") == 2
    with pytest.raises(AccessError):
        guest.delete("docs", ["2"])
    with pytest.raises(AccessError):
        guest.create_collection("x", CollectionSpec(2))
    assert guest.audit[-1]["outcome"] == "denied"
    with pytest.raises(SpecError):
        e.search("docs", [0.0] * 8, 10_001).collect()
    with pytest.raises(SpecError):
        e.create_collection("y", CollectionSpec(8, "dot", IndexSpec("ivf")))


def test_fusion_and_evaluation(spark):
    ranks = lambda xs: spark.createDataFrame([(x, i + 1) for i, x in enumerate(xs)], "id string, rank int")
    got = fusion.rrf([ranks("abc"), ranks("ca")], 3, 60).collect()
    assert [r.id for r in got] == ["a", "c", "b"] and got[0].score == pytest.approx(1 / 61 + 1 / 62)
    t = spark.createDataFrame([(0, i, i + 1) for i in range(4)], "query_id int, id int, rank int")
    f = spark.createDataFrame([(0, 0, 1), (0, 9, 2), (0, 2, 3)], "query_id int, id int, rank int")
    assert evaluate.mean_recall(evaluate.recall_at_k(f, t, 4)).first()["mean_recall"] == 0.5
    assert evaluate.mean_recall(evaluate.recall_at_k(f, t.limit(0), 4)).first()["mean_recall"] == 0.0
    v = spark.createDataFrame([(float(x),) for x in (5, 1, 3, 2)], "x double")
    assert evaluate.percentile_nearest(v, "x", 50).first()["value"] == 3.0  # round(1.5) is 2
    flat = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "id string, score double")
    assert {r.score for r in fusion.normalise_scores(flat).collect()} == {0.5}


def test_merge_and_listing(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "id string, score double")
    b = spark.createDataFrame([("x", 1.0), ("z", 1.5)], "id string, score double")
    assert [r.id for r in search.merge_top_k([a, b], 2).collect()] == ["x", "z"]
    p = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "id string, n int")
    assert [r.id for r in search.multi_get(p, ["c", "zz", "a"]).collect()] == ["c", "a"]
    assert [r.id for r in search.fetch(p, {"gte": {"field": "n", "value": 2}}, offset=1, limit=5).collect()] == ["c"]


def test_graph_join_beyond_one_batch(spark):
    """Recall on 12,000 rows of one partition: more than an Arrow batch, and blocks of several graphs."""
    x = np.random.default_rng(3).normal(size=(12_000, 32))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").coalesce(1)
    q = p.where("id % 600 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    got = {(r.query_id, r.id) for r in cells.graph_join(p, q, 10).collect()}
    want = {(i, int(j)) for i in range(0, 12_000, 600) for j in np.argsort(((x - x[i]) ** 2).sum(1))[:10]}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_code_join_on_a_larger_table(spark, metric):
    """Coarse product codes and 20,000 rows: neighbours outside the k x factor best codes are found."""
    x = np.random.default_rng(4).normal(size=(20_000, 16))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").coalesce(2)
    q = p.where("id % 1000 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    pq = quantize.ProductQuantizer.train(p.limit(500), 2, centroids=16, unit=metric == "cosine")
    coded = p.withColumn("code", pq.encode(V.normalize(F.col("vector")) if metric == "cosine" else F.col("vector")))
    got = [(r.query_id, r.rank, r.id) for r in quantize.join(coded, q, 10, pq, metric=metric).collect()]
    want = [(r.query_id, r.rank, r.id) for r in search.knn_join(p, q, 10, metric=metric).collect()]
    assert sorted(got) == sorted(want)
