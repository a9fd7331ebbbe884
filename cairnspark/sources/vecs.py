"""Vector files: little-endian int32 dimension, then that many float32 (fvecs) or int32 (ivecs), row after row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode(data: bytes, dtype: str) -> np.ndarray:
    if not data:
        return np.zeros((0, 0), dtype)
    dim = int(np.frombuffer(data[:4], "<i4")[0])
    rows = np.frombuffer(data, "<i4")
    if dim <= 0 or len(rows) % (dim + 1) or (rows.reshape(-1, dim + 1)[:, 0] != dim).any():
        raise ValueError("rows of a vector file share one positive dimension")
    return rows.reshape(-1, dim + 1)[:, 1:].view(dtype)


#: Bytes of a file that a task reads, about.
SPLIT = 64 << 20


def read_vecs(spark: SparkSession, path: str, kind: str = "fvecs") -> DataFrame:
    """(id, vector) with ids counted from 0 in each file; files of any size, a stretch of whole rows for each task."""
    dtype, sql = ("<f4", "float") if kind == "fvecs" else ("<i4", "int")
    files = spark.read.format("binaryFile").load(path).select("path", "length").collect()  # a row for each file, contents unread

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for name, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                system, local = fs.FileSystem.from_uri("file://" + name[5:] if name.startswith("file:/") and not name.startswith("file://") else name)
                with system.open_input_file(local) as f:
                    size = f.size()
                    if not size:
                        continue
                    dim = int(np.frombuffer(f.read_at(4, 0), "<i4")[0])
                    row = 4 * (dim + 1)
                    if dim <= 0 or size % row:
                        raise ValueError("rows of a vector file share one positive dimension")
                    each = max(1, SPLIT // row)
                    first, last = part * each, min((part + 1) * each, size // row)
                    for s in range(first, last, 8192):
                        x = decode(f.read_at(row * (min(s + 8192, last) - s), row * s), dtype)
                        if x.shape[1] != dim:
                            raise ValueError("rows of a vector file share one positive dimension")
                        flat = pa.array(x.ravel())
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(s, s + len(x))), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), flat)], names=["id", "vector"])

    # a row is at most all of a stretch, so this many stretches cover a file; the last ones may be empty
    parts = [(r["path"], i) for r in files for i in range(max(1, -(-r["length"] // (SPLIT // 2))))]
    if not parts:
        return spark.createDataFrame([], f"id long, vector array<{sql}>")
    return spark.createDataFrame(parts, "path string, part long").repartition(len(parts), "path", "part").mapInArrow(run, f"id long, vector array<{sql}>")


def encode(x: np.ndarray) -> bytes:
    kind = "<f4" if x.dtype.kind == "f" else "<i4"
    head = np.full((len(x), 1), x.shape[1], "<i4")
    return np.hstack([head, np.ascontiguousarray(x, kind).view("<i4")]).tobytes()


def synthetic(spark: SparkSession, n: int, dim: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """(id, vector): seeded standard normals, made on the executors."""
    parts = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.xxhash64(F.lit(seed), F.col("id"), i))
    uniform = lambda h: (F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = lambda h: (F.sqrt(-2 * F.log(uniform(h))) * F.cos(2 * np.pi * uniform(F.xxhash64(h)))).cast("float")
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return rows.select("id", F.transform(parts, normal).alias("vector"))


def load_benchmark(spark: SparkSession, folder: str, name: str, k: int = 100) -> dict[str, DataFrame]:
    """base, query and truth of a benchmark triple; the truth is computed where its file is absent."""
    from ..operators.search import knn_join
    from ..plans.table import Files

    base, query = (read_vecs(spark, f"{folder}/{name}_{x}.fvecs") for x in ("base", "query"))
    if Files(spark, folder).exists(f"{name}_groundtruth.ivecs"):
        truth = read_vecs(spark, f"{folder}/{name}_groundtruth.ivecs", "ivecs").select(F.col("id").alias("query_id"), F.posexplode("vector").alias("p", "id")).select("query_id", F.col("id").cast("long").alias("id"), (F.col("p") + 1).alias("rank"))
    else:
        truth = knn_join(base, query.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), k).select("query_id", "id", "rank")
    return {"base": base, "query": query, "truth": truth}
