"""Rendezvous placement of ids on shards, and shard maps."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import fnv1a

_M = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15


def weight(ident: str, shard: int) -> int:
    """Unsigned 64-bit score of an id on a shard: FNV-1a, offset by the shard, SplitMix64 finaliser."""
    z = (fnv1a(ident.encode(), 64) + shard * GOLDEN) & _M
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _M
    z = (z ^ z >> 27) * 0x94D049BB133111EB & _M
    return z ^ z >> 31


def owner(ident: str, shards: list[int]) -> int:
    return max(shards, key=lambda s: (weight(ident, s), -s))


def owners(idents: list[str], shards: list[int]) -> np.ndarray:
    """:func:`owner` of many ids, a byte position of all of them at a time."""
    data = [x.encode() for x in idents]
    size = np.array([len(x) for x in data], np.int64)
    flat, start = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64), np.cumsum(size) - size
    h = np.full(len(data), 0xCBF29CE484222325, np.uint64)
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        h[at] = (h[at] ^ flat[start[at] + k]) * np.uint64(0x100000001B3)
    order = sorted(shards)
    scores = []
    for s in order:
        z = h + np.uint64(s * GOLDEN & _M)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        scores.append(z ^ (z >> np.uint64(31)))
    return np.array(order)[np.argmax(np.stack(scores), axis=0)]


def owner_column(ident: Column, shards: list[int]) -> Column:
    """Owning shard by the same rule as :func:`owner` (Arrow batches: 64-bit wrap-around has no built-in); null for a null id."""
    import pandas as pd

    def run(ids):
        out = pd.Series(pd.NA, index=ids.index, dtype="Int64")
        known = ids.notna()
        if known.any():
            out[known] = owners(ids[known].tolist(), shards)
        return out

    return F.pandas_udf(run, T.LongType())(ident)


def migration(points: DataFrame, before: list[int], after: list[int], id_col: str = "id") -> DataFrame:
    """The rows that another shard owns under the new shard list, with ``donor`` and ``target``: what a rebalance copies and then drops."""
    ident = F.col(id_col).cast("string")
    return points.withColumns({"donor": owner_column(ident, before), "target": owner_column(ident, after)}).where("donor <> target")


def partitioned(points: DataFrame, shards: list[int], id_col: str = "id") -> DataFrame:
    """Rows with their ``shard``, those of a shard together."""
    return points.withColumn("shard", owner_column(F.col(id_col).cast("string"), shards)).repartition("shard")


def move_slice(shards: dict, before: list[int], after: list[int]) -> dict[int, int]:
    """Copy the rows that change hands to their new collections, then drop them from the old ones; rows copied to each.

    ``shards``: collections by number.  Each target gets one commit and each donor another, copies first, so a row is
    found on one shard or on both at any time and a broken run can be run again.
    """
    copied, gone = {}, {}
    for target in after:
        moved = None
        for donor in before:
            if donor == target:
                continue
            rows = migration(shards[donor].snapshot(), before, after).where((F.col("donor") == donor) & (F.col("target") == target))
            gone[donor] = gone.get(donor, []) + [rows.select("id")]
            rows = rows.select("id", "vector", "payload")
            moved = rows if moved is None else moved.unionByName(rows)
        if moved is not None and not moved.isEmpty():
            copied[target] = shards[target].apply(upserts=moved, action="migrate").rows[-1]
    for donor, parts in gone.items():
        ids = parts[0]
        for x in parts[1:]:
            ids = ids.unionByName(x)
        if not ids.isEmpty():
            shards[donor].apply(deletes=ids, action="migrate")
    return copied


def native_owner(ident: Column, shards: int, seed: int = 0) -> Column:
    """Rendezvous placement with Spark's own hash; stays in the JVM."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), s, ident).alias("h"), s.alias("s"))))["s"]


STATES = ("joining", "active", "leaving")


@dataclass(frozen=True)
class ShardMap:
    """Shards and their states; every change is a new version."""

    shards: dict[int, str] = field(default_factory=dict)
    version: int = 0

    def _with(self, shards: dict[int, str]) -> ShardMap:
        return replace(self, shards=shards, version=self.version + 1)

    def add(self, shard: int, state: str = "active") -> ShardMap:
        if shard in self.shards or state not in STATES:
            raise ValueError(f"shard {shard} exists, or {state!r} is no state")
        return self._with({**self.shards, shard: state})

    def join(self, shard: int) -> ShardMap:
        return self.add(shard, "joining")

    def _move(self, shard: int, before: str, after: str) -> ShardMap:
        if self.shards.get(shard) != before:
            raise ValueError(f"shard {shard} is not {before}")
        return self._with({**self.shards, shard: after})

    def promote(self, shard: int) -> ShardMap:
        return self._move(shard, "joining", "active")

    def leave(self, shard: int) -> ShardMap:
        return self._move(shard, "active", "leaving")

    def cancel(self, shard: int) -> ShardMap:
        return self._move(shard, "leaving", "active")

    def remove(self, shard: int) -> ShardMap:
        return self._with({s: x for s, x in self.shards.items() if s != shard})

    def active(self) -> list[int]:
        """Shards that answer queries: all but joining ones."""
        return sorted(s for s, x in self.shards.items() if x != "joining")

    def owners(self) -> list[int]:
        """Shards that new rows go to: all but leaving ones."""
        return sorted(s for s, x in self.shards.items() if x != "leaving")

    def owner(self, ident: str) -> int:
        return owner(ident, self.owners())

    def donor(self, ident: str) -> int | None:
        """The shard that held the id before the running change, if it is another one."""
        before = owner(ident, self.active())
        return before if before != self.owner(ident) else None
