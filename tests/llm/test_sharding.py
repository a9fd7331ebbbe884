import glob
import zlib
from collections import Counter

import pyarrow.parquet as pq
import xxhash

from cairnspark.llm import queries, sharding
from cairnspark.llm.common import new_path


def gapless(p):
    return all(sorted(g.slot) == list(range(len(g))) for _, g in p.groupby("shard"))


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    p = queries.op1_sharding(spark, sf).toPandas()
    assert sorted(p.doc_id) == sorted(docs) and gapless(p)
    assert set(p.law) == {"key"} and p.shard.between(0, 39).all()
    for r in p.itertuples():
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
    assert ((p.grown_shard == p.shard) | (p.grown_shard == 40)).all() and (p.grown_shard == 40).any()


def spark_hash(*values):
    """Spark's xxhash64 of ints, longs and strings: XXH64 seeded with the hash of what came before."""
    h = 42
    for v, size in values:
        h = xxhash.xxh64_intdigest(v.to_bytes(size, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def test_law_and_slots_again(spark, sf):
    """The owner by a second implementation, and slots from the order of records in the files."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = new_path(spark, "test-shards")
    rows = {r.doc_id: r for r in sharding.assign(docs, 40, path=path).collect()}
    law = lambda i, n: max(range(n), key=lambda s: (spark_hash((sharding.SEED, 4), (s, 4), (i, 8)), s))
    assert all((r.shard, r.grown_shard) == (law(i, 40), law(i, 41)) for i, r in rows.items())
    local = path.removeprefix("file://").removeprefix("file:")
    for shard in range(40):
        held = []
        for f in glob.glob(f"{local}/data/shard={shard}/*.parquet"):
            held += [(r["bucket"], r["place"], r["record"]["doc_id"]) for r in pq.ParquetFile(f).read(["bucket", "place", "record"]).to_pylist()]
        assert [(b, p) for b, p, _ in sorted(held)] == [(b, p) for b in sorted({x[0] for x in held}) for p in range(sum(x[0] == b for x in held))]
        assert [rows[i].slot for _, _, i in sorted(held)] == list(range(len(held)))


def test_buckets_do_not_hang_on_the_order_of_the_scan(spark):
    """A scan partition in two orders, with rows that are alike: the same records in each bucket."""
    rows = [(i % 50, f"text {i % 7}") for i in range(3000)]
    found = []
    for data in (rows, rows[::-1]):
        path = new_path(spark, "test-shards")
        sharding.write_shards(spark.createDataFrame(data, "doc_id long, text string").coalesce(1), path, 3, bucket_bytes=4000)
        back = sharding.read_shards(spark, path, spark.createDataFrame(data, "doc_id long, text string").schema)
        found.append(Counter((r.record, r.shard, r.bucket) for r in back.collect()))
    assert found[0] == found[1] and len({(s, b) for _, s, b in found[0]}) > 10


def test_key_law_does_not_depend_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = {r.doc_id: r for r in sharding.assign(docs.where("doc_id % 3 = 0"), 40).collect()}
    b = {r.doc_id: r for r in sharding.assign(docs.repartition(5), 41).collect()}
    assert all(b[i].shard == r.grown_shard for i, r in a.items())


def test_records_come_back_whole_and_shuffled(spark, awkward):
    path = new_path(spark, "test-shards")
    sharding.write_shards(awkward, path, 3, bucket_bytes=100_000)
    back = sharding.read_shards(spark, path, awkward.schema)
    assert Counter(r.record for r in back.collect()) == Counter(awkward.collect())
    assert gapless(back.drop("record").toPandas())


def test_fisher_yates_within_buckets(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'t' as text")
    path = new_path(spark, "test-shards")
    sharding.write_shards(docs, path, 2, bucket_bytes=10_000)
    rows = sharding.read_shards(spark, path, docs.schema).select("record.doc_id", "shard", "bucket", "slot").orderBy("shard", "slot").toPandas()
    assert rows.groupby("shard").bucket.apply(lambda b: b.is_monotonic_increasing).all() and rows.bucket.nunique() > 2
    # uniform: ids neither keep nor reverse their order
    assert all(abs(g.doc_id.rank().corr(g.slot.rank())) < 0.2 for _, g in rows.groupby(["shard", "bucket"]) if len(g) > 300)
    again = sharding.assign(docs, 2, bucket_bytes=10_000).select("doc_id", "shard", "slot").toPandas()
    assert again.merge(rows, on="doc_id").eval("slot_x == slot_y").all()


def test_hot_key_is_split_into_buckets(spark):
    docs = spark.range(4000).selectExpr("case when id % 3 = 0 then 7 else id end as doc_id", "repeat('x', 100) as text")
    p = sharding.assign(docs, 4, bucket_bytes=20_000).toPandas()
    hot = p[p.doc_id == 7]
    assert len(p) == 4000 and gapless(p) and hot.shard.nunique() == 1 and hot.bucket.nunique() > 3


def test_null_and_empty(spark, awkward, empty):
    p = sharding.assign(awkward, 5).toPandas()
    assert len(p) == awkward.count() and gapless(p)
    assert set(p[p.doc_id.isin([3, 4])]["size"]) == {16} and set(p[p.doc_id.isin([3, 4])].text_crc32) == {0}
    assert p[p.doc_id.isna()].shard.nunique() == 1
    assert sharding.assign(empty, 5).count() == 0
