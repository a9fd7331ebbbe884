"""Two-pass external shuffle into shards (DataFrame functions only).

Pass one scatters whole records into memory-sized buckets with seeded hashes:
the shard by rendezvous hashing of ``doc_id`` (law ``key``), the bucket inside
the shard by a hash of the content and of the row's place in its scan partition
sorted by that content.  So repeats of one key, and of one whole row, spread over
the buckets of their shard, and a scan task that runs again deals its rows alike
in whichever order it gets them.  Pass two gathers one bucket at a time,
permutes it with Fisher-Yates (Spark's ``shuffle`` function) and writes it.  The
buckets' row counts, taken from the written files, make slots gapless.

``path``/data/shard=N has the records as structs, so that their columns may have
any name, and ``path``/buckets a row for every bucket.

Defined results: null texts have no bytes (size 16) and crc32 of the empty
string; a very long text is one record of a bucket of its size; equal rendezvous
hashes go to the larger shard number; a null ``doc_id`` is one more key; repeated rows each get a slot of
their own; an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import maybe_broadcast, named, new_path, row_of

SEED = 20_240_607
RECORD_OVERHEAD = 16
#: A bucket's share of the heap an executor has for a core: a task holds one bucket, in more than one form.
HEAP_SHARE = 16
#: No bucket needs to be smaller than this many bytes.
LEAST_BUCKET = 32 << 20


def owner(key: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: the shard with the largest seeded hash; a further shard takes rows only into itself."""
    scores = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), s, key).alias("h"), s.alias("s")))
    return F.array_max(scores)["s"]


def size_of(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + RECORD_OVERHEAD).cast("long")


def bucket_bytes_of(spark: SparkSession) -> int:
    """Bytes of text of a memory-sized bucket in this session."""
    sc = spark.sparkContext
    conf = sc.getConf()
    heap = sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get("spark.executor.memory", "1g"))
    return max(LEAST_BUCKET, heap // int(conf.get("spark.executor.cores", "4")) // HEAP_SHARE)


def _by_shard(values: list[int]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col("shard") + 1)


def write_shards(docs: DataFrame, path: str, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, bucket_bytes: int | None = None) -> None:
    """Write all records of ``docs`` under ``path``, bucket after bucket, each bucket in Fisher-Yates order."""
    ident, text = named(id_col), named(text_col)
    volume = docs.select(owner(ident, shards, seed).alias("shard"), size_of(text).alias("size")).groupBy("shard").agg(F.sum("size").alias("b")).collect()  # a row for each shard
    counts, bucket_bytes = [1] * shards, bucket_bytes or bucket_bytes_of(docs.sparkSession)
    for r in volume:
        counts[r["shard"]] = max(1, -(-int(r["b"]) // bucket_bytes))
    content = [named(c) for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    rows = docs.select(row_of(docs).alias("record"), owner(ident, shards, seed).alias("shard"), F.xxhash64(F.lit(seed + 1), *content).alias("h"))
    # of rows that are alike only the number among them counts, so this does not hang on the order of the scan
    rows = rows.sortWithinPartitions("h").withColumn("u", F.xxhash64(F.lit(seed + 2), "h", F.monotonically_increasing_id())).drop("h")
    rows = rows.withColumn("bucket", F.pmod("u", _by_shard(counts)).cast("int"))
    # one partition for each bucket: hashing would put several into one task
    part = _by_shard([sum(counts[:s]) for s in range(shards)]) + F.col("bucket")
    rows = rows.withColumn("part", part.cast("int")).repartitionById(sum(counts), "part")
    # sorted first: a retried task gathers, and so permutes, a bucket in the same way
    gathered = rows.sortWithinPartitions("u").groupBy("part", "shard", "bucket").agg(F.collect_list("record").alias("records"))
    dealt = gathered.select("shard", "bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("place", "record"))
    # the writer wants its rows by shard; this keeps them by bucket and place too
    dealt.select("record", "bucket", "place", "shard").sortWithinPartitions("shard", "bucket", "place").write.partitionBy("shard").parquet(f"{path}/data")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # of buckets, not of records
    filled = _data(docs.sparkSession, path, docs.schema).groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n_rows"))
    filled.withColumn("first_slot", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).cast("long")).write.parquet(f"{path}/buckets")


def _data(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    # the schema is given: without rows there is no file to take it from
    schema = T.StructType([T.StructField("record", record), T.StructField("bucket", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/data")


def read_shards(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """record (of the type of the records written), shard, bucket and slot: the place in the shard, gapless from 0."""
    buckets = spark.read.parquet(f"{path}/buckets").select("shard", "bucket", "first_slot")
    rows = _data(spark, path, record).join(maybe_broadcast(buckets, buckets.count(), wide=True), ["shard", "bucket"])
    return rows.select("record", "shard", "bucket", (F.col("first_slot") + F.col("place")).alias("slot"))


def assign(docs: DataFrame, shards: int = 40, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, **options) -> DataFrame:
    """Shard all of ``docs`` (under ``path``, or a folder of the session) and tell from the files where each record stands.

    Per record: doc_id, size, text_crc32, law, shard, slot, grown_shard and bucket.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "shards")
    write_shards(docs, path, shards, id_col=id_col, text_col=text_col, seed=seed, **options)
    rows = read_shards(spark, path, docs.schema)
    ident, text = F.col("record").getField(id_col), F.col("record").getField(text_col)
    return rows.select(ident.alias("doc_id"), size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).cast("long").alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", owner(ident, shards + 1, seed).alias("grown_shard"), "bucket")
