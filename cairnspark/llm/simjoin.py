"""Similarity classes from banded signatures, without all pairs of a bucket.

Nodes come with band keys; two nodes of similarity ``threshold`` share a key with
near certainty.  Candidates are formed and verified in three rounds:

1. *star*: every member of a bucket against the bucket's most central node, the
   one with most fellow members over all of its buckets (the least on ties);
2. *forest*: in buckets whose members still lie in several components, a spanning
   forest of the plausible links (estimate above threshold less margin) between
   components;
3. *families*: nodes joined by links of both rounds form a family.  In a family of
   several components all pairs between components are compared, and a spanning
   forest of the confirmed links comes out.

Rounds 2 and 3 never form the pairs of a group as rows: its members are dealt to
blocks of a bounded number of members and hashes, a task holds two blocks at a
time, and at most as many links as members come out.  A group of any size is
spread over tasks; its largest component is sent once for each block of the
other members, so the rows of a group grow with its members times the blocks of
those outside the largest component.  Every pair that shares a bucket and is
plausible is verified on full sets or is inside one component already.

Full sets never travel in pairs: in round 1 a centre's set goes once to each
block of its members, in round 3 a member's set once to each pair of blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, maybe_broadcast, release, spread_join, written
from .components import connected_components
from .textbytes import mix, tidied

#: Members of a block that carry signatures only (forest), or full sets too (families).
LIGHT_BLOCK, BLOCK = 1024, 256
#: Hashes of the sets of a block with full sets, about (16 MB), and members compared with their centre in one group.
BLOCK_HASHES, STAR_BLOCK = 2 << 20, 256
#: Pairs compared at once inside a task.
PAIRS = 8192


#: (key, id) rows a task holds before it packs them by slice, slices for each shuffle partition, and (key, id) rows of a slice at most, about.
PACKED, SLICES, SLICE_ROWS = 1 << 19, 4, 1 << 20


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    return key[order], order


def _ranked(key: np.ndarray, id_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows by key, and the number of each among those of its key; a row may repeat."""
    key, order = _sorted(key)
    id_ = id_[order]
    again = key[1:] == key[:-1]
    multi = np.flatnonzero((np.append(False, again) | np.append(again, False))[: len(key)])
    id_[multi] = id_[multi][np.lexsort((id_[multi], key[multi]))]
    new = np.append(True, (key[1:] != key[:-1]) | (id_[1:] != id_[:-1]))[: len(key)]
    key, id_ = key[new], id_[new]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
    return key, id_, np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))


def _packed(nodes: DataFrame, slices: int) -> DataFrame:
    """(slice, rows): 12-byte (key, id) rows packed by slice of the key space; slice -1: 16-byte rows of keys this task knows to have three nodes or more.

    A key becomes 31 bits of slice and 32 of its own, so its row carries the latter only; slices grow with the rows, so
    unlike keys that fall together stay rare, and their candidates are verified like all others.  Of a key known to have
    three nodes only two go to its slice, so the slice of a very frequent key gets two rows from each packing, not all of
    them.  A node that repeats inside a packing counts once.
    """

    def pack(key, id_):
        bits = key.view(np.uint64)
        slice_of = bits % np.uint64(slices)
        key, id_, rank = _ranked(((slice_of << np.uint64(32)) | (bits >> np.uint64(32))).view(np.int64), id_)
        many = rank >= 2
        if many.any():
            yield -1, np.stack([key[many], id_[many]], 1).tobytes()
            key, id_ = key[~many], id_[~many]
        at = key >> 32
        low = (key & 0xFFFFFFFF).astype("<u4")
        # keys are sorted, so slices are too
        cuts = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1]))[: len(at)], len(at))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(at[s]), low[s:e].tobytes() + id_[s:e].tobytes()

    def run(batches):
        import pyarrow as pa

        held, n = [], 0

        def out():
            rows = list(pack(*(np.concatenate(x) for x in zip(*held)))) if held else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["slice", "rows"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = _sigs(b.column(1), np.int64)
            held.append((keys.ravel(), np.repeat(b.column(0).to_numpy(), keys.shape[1])))
            n += keys.size
            if n >= PACKED:
                yield out()
                held, n = [], 0
        yield out()

    return nodes.select("id", "keys").mapInArrow(tidied(run), "slice long, rows binary")


def _shared(packed: DataFrame) -> DataFrame:
    """(key, id) of the keys with two nodes or more, from rows sorted by slice."""

    def table(key, id_):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (key, id_)], names=["key", "id"])

    def shared(slice_, blobs):
        cut = [len(x) // 3 for x in blobs]  # 4 of each 12 bytes are keys
        key = np.concatenate([np.frombuffer(x, "<u4", c // 4) for x, c in zip(blobs, cut)]).astype(np.int64) | (slice_ << 32)
        id_ = np.concatenate([np.frombuffer(x, "<i8", c // 4, c) for x, c in zip(blobs, cut)])
        key, order = _sorted(key)
        again = key[1:] == key[:-1]
        multi = np.append(False, again) | np.append(again, False)
        # one node may have come from several tasks
        key, id_, _ = _ranked(key[multi], id_[order[multi]])
        again = key[1:] == key[:-1]
        multi = (np.append(False, again) | np.append(again, False))[: len(key)]
        return table(key[multi], id_[multi])

    def run(batches):
        last, blobs = None, []
        for b in batches:
            for s, rows in zip(b.column(0).to_pylist(), b.column(1)):
                if s == -1:
                    yield table(*np.frombuffer(rows.as_py(), np.int64).reshape(-1, 2).T)
                    continue
                if s != last and blobs:
                    yield shared(last, blobs)
                    blobs = []
                last = s
                blobs.append(rows.as_py())
        if blobs:
            yield shared(last, blobs)

    return packed.mapInArrow(tidied(run), "key long, id long")


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, id, n, m): members of the buckets of n >= 2 nodes; m is the most central. ``nodes``: id long, keys binary (as many longs for each); a node may repeat."""
    shape = nodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.octet_length("keys")), F.lit(0)).alias("b")).first()
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shape["n"] * shape["b"] // (8 * SLICE_ROWS * SLICES)))
    # rows of known keys need no meeting; their own salt spreads them
    salt = F.when(F.col("slice") < 0, F.xxhash64("rows")).otherwise(F.col("slice"))
    packed = _packed(nodes, SLICES * parts).withColumn("salt", salt).repartition(parts, "salt").sortWithinPartitions("slice").select("slice", "rows")
    raw = written(_shared(packed), "bucket-rows")
    members = written(raw.distinct(), "bucket-members")
    # what is told of a key or node is a table of its own, so that a frequent key can be spread
    sizes = written(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "bucket-sizes")
    keys = sizes.count()
    central = written(spread_join(members, sizes, ["key"], [F.col("id")], rows=keys, n="n").groupBy("id").agg(F.sum("n").alias("w")), "bucket-weights")
    best = members.join(maybe_broadcast(central, central.count()), "id").groupBy("key").agg(F.max(F.struct("w", (-F.col("id")).alias("i"))).alias("t"), F.count(F.lit(1)).alias("n"))
    top = written(best.select("key", "n", (-F.col("t.i")).alias("m")), "bucket-centres")
    out = written(spread_join(members, top, ["key"], [F.col("id")], rows=2 * keys, n="n").select("key", "id", "n", "m"), "bucket-stars")
    discard(raw, members, sizes, central, top)
    return out


def as_hashes(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sets that are stored as sorted distinct hashes: all of them one after the other, and their sizes."""
    return np.frombuffer(b"".join(items), np.uint64), np.array([len(x) // 8 for x in items], np.int64)


def _sigs(column, dtype="<u2") -> np.ndarray:
    """Rows of one length, as a matrix."""
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offs[-1] == offs[0]:
        return np.zeros((len(column), 1), dtype)
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(dtype).reshape(len(column), -1)


#: Bytes of sets that :func:`verify` decodes at once.
COMPARED = 8 << 20
#: Right sets of one left set compared at once.
LOOKED_UP = 256


def similar(items: list[bytes], left: np.ndarray, right: np.ndarray, threshold: tuple[int, int], decode: Callable) -> np.ndarray:
    """Whether the sets ``items[left]`` and ``items[right]`` have ``q * intersection >= p * union``, pair by pair.

    All right sets of a left one are looked up in it (``decode`` sorts) at once.
    """
    p, q = threshold
    out = np.zeros(len(left), bool)
    if not len(left):
        return out
    values, size = decode(items)
    start = np.cumsum(size) - size
    order = np.argsort(left, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(left[order]) != 0)), len(order))
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        at = order[s:e]
        one, many = left[at[0]], right[at]
        own = values[start[one] : start[one] + size[one]]
        for k in range(0, len(at), LOOKED_UP):
            n, first = size[many[k : k + LOOKED_UP]], start[many[k : k + LOOKED_UP]]
            before = np.cumsum(n) - n
            others = values[np.arange(n.sum()) + np.repeat(first - before, n)]
            seen = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others if len(own) else np.zeros(len(others), bool)
            total = np.append(0, np.cumsum(seen))
            both = total[before + n] - total[before]
            out[at[k : k + LOOKED_UP]] = (both > 0) & (q * both >= p * (size[one] + n - both))
    return out


def verify(pairs: DataFrame, facts: DataFrame, estimate: Callable, threshold: tuple[int, int], margin: float, decode: Callable) -> DataFrame:
    """Pairs (a, b) whose full sets have ``q * intersection >= p * union``; ``facts``: id, n, sig and items, of which ``decode`` makes sorted distinct hashes.

    ``a`` is the centre: its set goes once to each group of about STAR_BLOCK of its members, before them, and the worker
    looks theirs up in it.
    """
    p, q = threshold

    def run(batches):
        import pyarrow as pa

        last, open_hubs = None, []
        for b in batches:
            if not b.num_rows:
                continue
            a, block, kind, ids, n = (b.column(k).to_numpy() for k in range(5))
            sigs, items = _sigs(b.column(5)), b.column(6)
            cuts = np.append(np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (block[1:] != block[:-1]))), len(a))
            hubs, which, rows = [], [], []  # centres of this batch; the pairs to look at, as numbers of centres and rows
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if (a[s], block[s]) != last:
                    last, open_hubs = (a[s], block[s]), []
                while s < e and kind[s] == 0:
                    # an id may have several sets
                    open_hubs.append((int(a[s]), n[s], sigs[s], items[s].as_py()))
                    s += 1
                for hub in open_hubs if s < e else []:
                    which.append(np.full(e - s, len(hubs)))
                    rows.append(np.arange(s, e))
                    hubs.append(hub)
            x, at = np.concatenate([*which, np.zeros(0, np.int64)]), np.concatenate([*rows, np.zeros(0, np.int64)])
            size = np.array([h[1] for h in hubs], np.int64)
            ok = np.minimum(n[at], size[x]) * q >= np.maximum(n[at], size[x]) * p
            x, at = x[ok], at[ok]
            if len(x):
                signs = np.stack([h[2] for h in hubs])
                est = np.concatenate([estimate(signs[x[i : i + PAIRS]], sigs[at[i : i + PAIRS]], size[x[i : i + PAIRS]], n[at[i : i + PAIRS]]) for i in range(0, len(x), PAIRS)])
                x, at = x[est >= p / q - margin], at[est >= p / q - margin]
            left, right, i = [], [], 0
            while i < len(x):
                # sets of a bounded size at once, a centre's set once for its members
                held, sets, l, r = 0, [], [], []  # noqa: E741
                j = i
                while j < len(x) and (j == i or held < COMPARED):
                    if j == i or x[j] != x[j - 1]:
                        sets.append(hubs[x[j]][3])
                        hub = len(sets) - 1
                        held += len(sets[-1])
                    sets.append(items[at[j]].as_py())
                    held += len(sets[-1])
                    l.append(hub)
                    r.append(len(sets) - 1)
                    j += 1
                good = similar(sets, np.array(l), np.array(r), threshold, decode)
                left += [hubs[h][0] for h in x[i:j][good].tolist()]
                right += ids[at[i:j][good]].tolist()
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    hubs = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", "n", F.ceil(F.col("n") / STAR_BLOCK).cast("int").alias("blocks")), "hubs")
    rows = spread_join(pairs, hubs.select("a", "n", "blocks"), ["a"], [F.col("b")], rows=2 * hubs.count(), n="n")
    rows = rows.select("a", F.pmod(F.xxhash64(F.lit(7), "b"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("kind"), F.col("b").alias("id"))
    first = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), F.col("a").alias("id"))
    rows = rows.unionByName(first).join(facts, "id").select("a", "block", "kind", "id", "n", "sig", "items")
    return rows.repartition("a", "block").sortWithinPartitions("a", "block", "kind").mapInArrow(tidied(run), "a long, b long")


class Forest:
    """Union-find over component labels inside a task."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        """True if a and b were apart."""
        a, b = self.root(a), self.root(b)
        self.parent[a] = b
        return a != b


#: The share of equal registers may be this much below the estimate that decides.
SHARE = 0.1


def _apart(i, j, ids, comps, n, sig, p: int, q: int, margin: float, estimate: Callable):
    """Plausible pairs between components among the index pairs (i, j), most similar first; the share of equal registers is a first look only."""
    ok = (comps[i] != comps[j]) & (ids[i] != ids[j]) & (np.minimum(n[i], n[j]) * q >= np.maximum(n[i], n[j]) * p)
    i, j = i[ok], j[ok]
    if not len(i):
        return i, j
    share = np.concatenate([(sig[i[s : s + PAIRS]] == sig[j[s : s + PAIRS]]).mean(1) for s in range(0, len(i), PAIRS)])
    at = np.flatnonzero(share >= p / q - margin - SHARE)
    i, j = i[at], j[at]
    est = np.concatenate([np.zeros(0), *[estimate(sig[i[s : s + PAIRS]], sig[j[s : s + PAIRS]], n[i[s : s + PAIRS]], n[j[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)]])
    at = np.flatnonzero(est >= p / q - margin)
    at = at[np.argsort(-est[at], kind="stable")]
    return i[at], j[at]


def _grouped(handle: Callable):
    """mapInArrow function for rows sorted by their first four columns: ``handle`` gets tables of whole groups and their bounds, and returns pairs.

    A table ends with the last whole group of a batch, so it holds a batch and one group more.
    """

    def run(batches):
        import pyarrow as pa

        forest = Forest()

        def pairs(held):
            out = []
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                g = np.stack([t.column(k).to_numpy() for k in range(4)], 1)
                out = handle(t, np.append(np.flatnonzero(np.append(True, (g[1:] != g[:-1]).any(1))), len(g)), forest)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            g = np.stack([b.column(k).to_numpy() for k in range(4)], 1)
            cuts = np.flatnonzero((g[1:] != g[:-1]).any(1)) + 1
            last = tuple(held[-1].column(k)[-1].as_py() for k in range(4)) if held else None
            if last is not None and last != tuple(g[0].tolist()):
                yield pairs(held)
                held = []
            if len(cuts):
                yield pairs([*held, b.slice(0, cuts[-1])])
                held = [b.slice(cuts[-1])]
            else:
                held.append(b)
        yield pairs(held)

    return run


def _dealt(rows: DataFrame, group: str, block: int, hashes: int) -> DataFrame:
    """group, kind, l, r, id, comp, core, block: a row for each pair of blocks a member is compared in.

    Kind 0 compares blocks of members outside the group's largest component (the
    core) with each other, kind 1 such a block with a block of the core, so the
    core is sent once for each block of the others.  Groups of one component go.
    """
    parts = rows.groupBy(group, "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("h"))
    size = parts.groupBy(group).agg(F.max(F.struct("n", "comp", "h")).alias("top"), F.sum("n").alias("n"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda n, h: F.greatest(F.ceil(n / block), F.ceil(h / hashes), F.lit(1)).cast("long")
    rest = blocks(F.col("n") - F.col("top.n"), F.col("h") - F.col("top.h"))
    size = written(size.select(group, F.col("top.comp").alias("top"), blocks(F.col("top.n"), F.col("top.h")).alias("cores"), rest.alias("rests"), F.col("n").alias("rows")), "group-sizes")
    dealt = spread_join(rows.drop("n"), size, [group], [F.col("id")], rows=3 * size.count(), n="rows").withColumn("core", (F.col("comp") == F.col("top")).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), F.when(F.col("core") == 1, F.col("cores")).otherwise(F.col("rests"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    pair = lambda kind, l, r: F.struct(F.lit(kind).alias("kind"), l.alias("l"), r.alias("r"))  # noqa: E731, E741
    among = F.transform(upto("rests"), lambda x: pair(0, F.least(F.col("block"), x), F.greatest(F.col("block"), x)))
    outward = F.transform(upto("cores"), lambda x: pair(1, F.col("block"), x))
    inward = F.transform(upto("rests"), lambda x: pair(1, x, F.col("block")))
    return dealt.withColumn("g", F.explode(F.when(F.col("core") == 1, inward).otherwise(F.concat(among, outward)))).select(group, "g.*", "id", "comp", "core", "block")


#: Groups of at most this many rows are compared together with others.
SMALL = 64


def _index_pairs(bounds: np.ndarray, kind, left, right, core, blocks):
    """Runs of index pairs (i, j) that each group's kind asks for; small groups share runs."""
    start, size = bounds[:-1], np.diff(bounds)
    few = np.flatnonzero((size <= SMALL) & (size > 1))
    done = 0
    while done < len(few):
        total = np.cumsum(size[few[done:]] ** 2)
        take = max(1, int(np.searchsorted(total, PAIRS * 64, "right")))
        g = few[done : done + take]
        done += take
        n2 = size[g] ** 2
        group = np.repeat(g, n2)
        k = np.arange(len(group)) - np.repeat(np.cumsum(n2) - n2, n2)
        i, j = start[group] + k // size[group], start[group] + k % size[group]
        at = start[group]
        ok = np.where(kind[at] == 1, (core[i] == 0) & (core[j] == 1), np.where(left[at] == right[at], i < j, (blocks[i] == left[at]) & (blocks[j] == right[at])))
        yield i[ok], j[ok]
    for g in np.flatnonzero(size > SMALL).tolist():
        s, e = int(bounds[g]), int(bounds[g + 1])
        here = np.arange(s, e)
        if kind[s] == 1:
            i, j = here[core[s:e] == 0], here[core[s:e] == 1]
        elif left[s] == right[s]:
            yield tuple(x + s for x in np.triu_indices(e - s, 1))
            continue
        else:
            i, j = here[blocks[s:e] == left[s]], here[blocks[s:e] == right[s]]
        yield tuple(x.ravel() for x in np.meshgrid(i, j, indexing="ij"))


def _block_pairs(t, bounds, p: int, q: int, margin: float, estimate: Callable):
    """ids, comps and runs of plausible index pairs between components of a table in the form of :func:`_dealt` with n and sig."""
    kind, left, right, ids, comps, core, blocks, n = (t.column(k).to_numpy() for k in range(1, 9))
    sig = _sigs(t.column(9).chunk(0))
    return ids, comps, (_apart(i, j, ids, comps, n, sig, p, q, margin, estimate) for i, j in _index_pairs(bounds, kind, left, right, core, blocks))


def plausible(rows: DataFrame, sigs: DataFrame, estimate: Callable, threshold: tuple[int, int], margin: float) -> DataFrame:
    """A spanning forest of a task's plausible links between components in pairs of blocks of its buckets. ``rows``: key, id, comp."""
    p, q = threshold

    def handle(t, bounds, forest):
        ids, comps, runs = _block_pairs(t, bounds, p, q, margin, estimate)
        return [(min(x, y), max(x, y)) for i, j in runs for x, y, a, b in zip(ids[i].tolist(), ids[j].tolist(), comps[i].tolist(), comps[j].tolist()) if forest.join(a, b)]

    sized = rows.withColumn("n", F.lit(0).cast("long"))
    dealt = _dealt(sized, "key", LIGHT_BLOCK, BLOCK_HASHES).join(sigs, "id").select("key", "kind", "l", "r", "id", "comp", "core", "block", "n", "sig")
    dealt = dealt.repartition("key", "kind", "l", "r").sortWithinPartitions("key", "kind", "l", "r", "id")
    return dealt.mapInArrow(tidied(_grouped(handle)), "a long, b long").distinct()


def family_links(rows: DataFrame, facts: DataFrame, estimate: Callable, threshold: tuple[int, int], margin: float, decode: Callable) -> DataFrame:
    """Confirmed links between the components of each family, a spanning forest per task. ``rows``: fam, id, comp."""
    p, q = threshold

    def handle(t, bounds, forest):
        ids, comps, runs = _block_pairs(t, bounds, p, q, margin, estimate)
        items, out = t.column(10), []
        for i, j in runs:
            # what earlier runs have joined is not compared again
            apart = np.array([forest.root(a) != forest.root(b) for a, b in zip(comps[i].tolist(), comps[j].tolist())], bool)
            i, j = i[apart], j[apart]
            used, number = np.unique(np.concatenate([i, j]), return_inverse=True)
            good = similar(items.take(used).to_pylist(), number[: len(i)], number[len(i) :], threshold, decode)
            for a, b in zip(i[good].tolist(), j[good].tolist()):
                if forest.join(int(comps[a]), int(comps[b])):
                    out.append((min(int(ids[a]), int(ids[b])), max(int(ids[a]), int(ids[b]))))
        return out

    sized = rows.join(facts.groupBy("id").agg(F.sum("n").alias("n")), "id")
    dealt = _dealt(sized, "fam", BLOCK, BLOCK_HASHES).join(facts, "id").select("fam", "kind", "l", "r", "id", "comp", "core", "block", "n", "sig", "items")
    dealt = dealt.repartition("fam", "kind", "l", "r").sortWithinPartitions("fam", "kind", "l", "r", "id")
    return dealt.mapInArrow(tidied(_grouped(handle)), "a long, b long").distinct()


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, id, comp) of the buckets whose members lie in several components; in a bucket of two the only pair has been compared."""
    rows = members.where("n > 2").select("key", "id", "n").join(maybe_broadcast(comps, comps.count()), "id", "left").select("key", "id", "n", F.coalesce("comp", "id").alias("comp"))
    split = written(rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("n").alias("size")).where("lo < hi").select("key", "size"), "split-buckets")
    return spread_join(rows, split, ["key"], [F.col("id")], rows=split.count(), n="size").select("key", "id", "comp")


def classes(nodes: DataFrame, facts_of: Callable[[DataFrame], DataFrame], estimate: Callable, *, threshold: tuple[int, int] = (80, 100), margin: float = 0.2, decode: Callable = as_hashes) -> DataFrame:
    """(id, comp) of the nodes linked with others; comp is the least id of a class.

    ``facts_of`` gets a table of distinct ids and returns their id, n, sig and
    items; ``estimate`` gets two signature blocks and the set sizes.
    """
    members = buckets(nodes)
    release(nodes.sparkSession)
    tried = written(members.where("id <> m").select(F.col("m").alias("a"), F.col("id").alias("b")).distinct(), "star-pairs")
    facts = facts_of(written(tried.select(F.col("a").alias("id")).unionByName(tried.select(F.col("b").alias("id"))).distinct(), "candidates"))
    sigs = facts.select("id", "n", "sig")
    comps = written(connected_components(verify(tried, facts, estimate, threshold, margin, decode)), "components")
    rest = written(_open(members, comps), "open-buckets")
    discard(members)
    near = written(plausible(rest, sigs, estimate, threshold, margin), "plausible")
    discard(rest)
    if near.isEmpty():
        return comps
    release(nodes.sparkSession)
    # families: plausible links and components together; their members' confirmed links are a spanning forest
    inside = comps.where("id <> comp").select(F.col("comp").alias("a"), F.col("id").alias("b"))
    families = connected_components(near.unionByName(inside)).select("id", F.col("comp").alias("fam"))
    rows = written(families.join(comps, "id", "left").select("fam", "id", F.coalesce("comp", "id").alias("comp")), "families")
    links = written(family_links(rows, facts, estimate, threshold, margin, decode), "family-links")
    discard(facts, rows)
    if links.isEmpty():
        return comps
    return written(connected_components(links.unionByName(inside)), "components")
