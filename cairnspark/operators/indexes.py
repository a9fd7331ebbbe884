"""Which plan answers a collection's vector search: the specification's index kind decides.

* ``hnsw``, ``vamana``: the exact scan (no graph beats it on recall, and a scan is what a cluster is good at), or, where it was
  built with ``graph=True``, stored block graphs (:mod:`graph`) with a beam of ``ef``.
* ``ivf``: cells as partition folders (:mod:`cells`), ``ef`` cells are probed.
* ``disk_vamana``: product or binary codes beside the vectors; the best ``ef`` by code get exact scores.

An index is derived: it belongs to one version and is never needed for a right
answer.  Rows changed since are searched exactly and laid over its answer; a
filter, a pinned version or a missing index means the exact scan.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.table import Collection, Files
from ..schema import default_subspaces
from .cells import CellIndex
from .graph import GraphIndex
from .quantize import BinaryQuantizer, ProductQuantizer, two_phase
from .search import knn, merge_top_k

#: Cells or candidates looked at where a search names no ``ef``.
EF = 64
EXACT_KINDS = ("hnsw", "vamana")
#: Rows changed since the index was built, as a share of all, beyond which the exact scan is taken until a rebuild.
STALE_SHARE = 0.2


@dataclass
class Built:
    """A stored index of one version of a collection."""

    kind: str
    version: int
    path: str
    coder: dict | None


def _files(c: Collection) -> Files:
    return Files(c.spark, f"{c.root}/index")


def current(c: Collection) -> Built | None:
    files = _files(c)
    names = [n for n in files.names("") if n.endswith(".json")] if files.exists() else []
    return Built(**json.loads(files.read(names[-1]))) if names else None


def build(c: Collection, **options) -> dict:
    """Build the index over the newest version (readers keep the old one until this is published); what was built."""
    kind, m = c.spec.index.kind, c.manifest()
    graph = options.pop("graph", False) and kind in EXACT_KINDS
    if not graph and (kind in EXACT_KINDS or kind == "colbert"):
        return {"kind": kind, "plan": "exact", "version": m.version}
    path, rows, coder = f"{c.root}/index/{kind}-{uuid.uuid4().hex}", c.snapshot(m.version), None
    if graph:
        GraphIndex.build(rows, path, c.spec.metric, **options)
    elif kind == "ivf":
        CellIndex.build(rows, path, metric=c.spec.metric, pq=c.spec.index.pq_subspaces, **options)
    else:
        unit = c.spec.metric == "cosine"
        v = V.normalize(F.col("vector")) if unit else F.col("vector").cast("array<double>")
        if c.spec.index.binary:
            q = BinaryQuantizer.train(rows.withColumn("vector", v))
            coder = {"mean": list(q.mean)}
        else:
            q = ProductQuantizer.train(rows, c.spec.index.pq_subspaces or default_subspaces(c.spec.dim), unit=unit, **options)
            coder = {"books": q.books.tolist()}
        rows.withColumn("code", q.encode(v)).write.parquet(path)
    files = _files(c)
    number = len([n for n in files.names("") if n.endswith(".json")]) if files.exists() else 0
    files.create(f"{number:012d}.json", json.dumps({"kind": kind, "version": m.version, "path": path, "coder": coder}))
    return {"kind": kind, "plan": "graph" if graph else "cells" if kind == "ivf" else "codes", "version": m.version}


def _delta(c: Collection, built: Built) -> tuple[str, ...] | None:
    """Segments that came after the index; None if it cannot be told or they are too many rows."""
    if f"{built.version:012d}.json" not in c.files.names("manifest"):
        return None
    old, now = c.manifest(built.version), c.manifest()
    k = len(old.segments)
    if now.segments[:k] != old.segments or sum(now.rows[k:]) > STALE_SHARE * max(sum(now.rows), 1):
        return None
    return now.segments[k:]


def ready(c: Collection) -> bool:
    """Whether a search takes the plan its specification asks for."""
    if c.spec.index.kind in (*EXACT_KINDS, "colbert"):
        return True
    built = current(c)
    return built is not None and built.kind == c.spec.index.kind and _delta(c, built) is not None


def search(c: Collection, vector: Sequence[float], k: int = 10, *, tree=None, version: int | None = None, ef: int | None = None, exact: bool = False) -> DataFrame:
    """The k nearest live rows with their score."""
    kind, metric = c.spec.index.kind, c.spec.metric
    built = None if exact or tree is not None or version is not None or kind == "colbert" else current(c)
    newer = _delta(c, built) if built is not None and built.kind == kind else None
    if newer is None:
        return knn(c.where(tree, version), vector, k, metric=metric)
    changed = c._segments(newer).select("id").distinct() if newer else None
    columns = c.snapshot().columns
    if kind in EXACT_KINDS:
        asked = c.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id int, query_vector array<double>")
        hits = GraphIndex(built.path, metric).join(asked, k if changed is None else k + min(sum(c.manifest().rows), 4 * k), beam=ef or EF)
        if changed is not None:
            hits = hits.join(F.broadcast(changed), "id", "left_anti")
        # k rows get their columns
        found = c.snapshot(built.version).join(F.broadcast(hits.orderBy("rank").limit(k).select("id", "score")), "id")
    elif kind == "ivf":
        found = CellIndex.open(c.spark, built.path).search(c.spark, vector, k, nprobe=ef or EF, without=changed)
    else:
        rows = c.spark.read.parquet(built.path)
        rows = rows if changed is None else rows.join(F.broadcast(changed), "id", "left_anti")  # at most STALE_SHARE of the rows
        factor = max(4, -(-(ef or EF) // k))
        if built.coder.get("books"):
            approx = ProductQuantizer(_array(built.coder["books"])).score(F.col("code"), vector, "l2" if metric == "l2" else "cosine")
            up = metric == "l2"
        else:
            q = BinaryQuantizer(tuple(built.coder["mean"]))
            unit = V.normalize(F.array(*map(F.lit, map(float, vector)))) if metric == "cosine" else F.array(*map(F.lit, map(float, vector)))
            approx, up = q.score(F.col("code"), q.encode(unit)), True
        found = two_phase(rows, approx, vector, k, factor=factor, metric=metric, ascending=up)
    found = found.select(*columns, "score")
    if not newer:
        return found.orderBy(V.sort_key(metric, F.col("score")), "id")
    fresh = knn(c.snapshot().join(F.broadcast(changed), "id", "left_semi"), vector, k, metric=metric).select(*columns, "score")
    return merge_top_k([found, fresh], k, metric=metric)


def _array(books):
    import numpy as np

    return np.array(books)
