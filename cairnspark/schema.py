"""Collection specifications, their validation, and request limits."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

# fixed values: names and limits that specifications of collections must keep to
METRICS = ("l2", "cosine", "dot")
INDEX_KINDS = ("hnsw", "vamana", "disk_vamana", "ivf", "colbert")
ENCRYPTION = ("none", "dcpe", "client_side")
FIELD_TYPES = ("keyword", "numeric")
LIMITS = {"k": 10_000, "ef": 4096, "fetch": 10_000, "dim": 8192, "payload_bytes": 64 << 10, "batch": 1000, "sparse_terms": 4096, "bulk": 50_000}


class SpecError(ValueError):
    """A specification or request breaks a rule."""


@dataclass(frozen=True)
class IndexSpec:
    kind: str = "hnsw"
    pq_subspaces: int | None = None
    binary: bool = False


@dataclass(frozen=True)
class CollectionSpec:
    """Immutable once a collection exists."""

    dim: int
    metric: str = "cosine"
    index: IndexSpec = field(default_factory=IndexSpec)
    filterable: dict[str, str] = field(default_factory=dict)
    multivector: bool = False
    vector_encryption: str = "none"

    def check(self) -> CollectionSpec:
        if not 0 < self.dim <= LIMITS["dim"]:
            raise SpecError(f"dim is from 1 to {LIMITS['dim']}")
        for value, allowed in ((self.metric, METRICS), (self.index.kind, INDEX_KINDS), (self.vector_encryption, ENCRYPTION), *((t, FIELD_TYPES) for t in self.filterable.values())):
            if value not in allowed:
                raise SpecError(f"{value!r} is none of {', '.join(allowed)}")
        if self.multivector and self.metric == "l2":
            raise SpecError("late interaction needs a similarity: cosine or dot")
        if self.vector_encryption == "dcpe" and self.metric != "l2":
            raise SpecError("distance-preserving encryption keeps l2 distances only")
        if self.index.kind == "colbert" and not self.multivector:
            raise SpecError("token cells need a multi-vector collection")
        if self.index.kind in ("vamana", "disk_vamana", "ivf") and self.metric == "dot":
            raise SpecError(f"{self.index.kind} needs a metric: l2 or cosine")
        if self.vector_encryption == "client_side" and self.multivector:
            raise SpecError("client-side vectors cannot be multi-vector")
        if self.index.pq_subspaces and self.dim % self.index.pq_subspaces:
            raise SpecError("pq_subspaces divides dim")
        return self

    def struct(self) -> T.StructType:
        """Schema of the collection's rows."""
        cols = [T.StructField("id", T.StringType(), False), T.StructField("vector", T.ArrayType(T.FloatType(), False)), T.StructField("payload", T.StringType())]
        kinds = {"keyword": T.StringType(), "numeric": T.DoubleType()}
        return T.StructType(cols + [T.StructField(promoted(f), kinds[t]) for f, t in self.filterable.items()])

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> CollectionSpec:
        d = json.loads(text)
        return CollectionSpec(**{**d, "index": IndexSpec(**d["index"])})


def promoted(field_path: str) -> str:
    """Name of the typed column of a declared payload field; no two paths share one, whatever their case."""
    return "f_" + re.sub("[^a-z0-9]", lambda m: f"_{ord(m[0]):x}_", field_path)


def check_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._-]{1,255}", name) or name in (".", ".."):
        raise SpecError("a collection name has 1 to 255 letters, digits, dots, underscores or hyphens")
    return name


def check_limit(what: str, value: int) -> int:
    if value < 0 or value > LIMITS[what]:
        raise SpecError(f"{what} is at most {LIMITS[what]}")
    return value


def default_subspaces(dim: int) -> int:
    """The largest divisor of dim that is at most dim / 8 (1 at least)."""
    return next((m for m in range(max(1, dim // 8), 0, -1) if dim % m == 0), 1)
