import random
import re
from itertools import combinations

import numpy as np
import pytest

from cairnspark.llm import common, components, near_dedup, queries, simjoin


def shingles(text, k):
    t = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, k):
    """Classes of (id, text) by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for n, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(n)
    for a, b in {p for group in by.values() for p in combinations(group, 2)}:
        x, y = sets[a][1], sets[b][1]
        if 100 * len(x & y) >= 80 * len(x | y):
            root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        least[find(n)] = min(i, least.get(find(n), i))
    return {i: (len(s), least[find(n)]) for n, (i, s) in enumerate(sets)}


def test_query_against_all_pairs(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_minhash_near_dedup(spark, sf).collect()}
    want = brute(docs, 4)
    assert found == want and any(c != i for i, (_, c) in want.items())


def chains(seed=3):
    """Texts whose neighbours lie near the threshold, in chains, families and copies."""
    r = random.Random(seed)
    out = []
    for base in range(12):
        words = [f"v{r.randrange(4000)}" for _ in range(r.choice([30, 80, 300]))]
        for _ in range(r.randrange(4, 14)):
            out.append(" ".join(words))
            for _ in range(max(1, len(words) // r.choice([25, 40, 60]))):
                words[r.randrange(len(words))] = f"v{r.randrange(4000)}"
    out += [out[0].upper()] * 40 + ["one", "one", "Two words", "two  words\n"]
    r.shuffle(out)
    return list(enumerate(out, 100))


def test_chains_near_the_threshold(spark):
    rows = chains()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for k in (4, 5):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.components(df, shingle=k).collect()} == brute(rows, k)


@pytest.mark.parametrize("hot", [1024, 8])
def test_shuffled_joins_give_the_same(spark, monkeypatch, hot):
    """No broadcast at all, small blocks and one text in a third of all rows."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "WIDE_ROWS", 0)
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(components, "LOCAL_EDGES", 0)
    for name, value in (("LIGHT_BLOCK", 5), ("BLOCK", 3), ("STAR_BLOCK", 4), ("SLICE_ROWS", 50)):
        monkeypatch.setattr(simjoin, name, value)
    rows = chains(6) + [(i, "one text that many rows hold as it is") for i in range(1000, 1060)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.components(df, shingle=4).collect()} == brute(rows, 4)


def test_large_family_is_whole(spark):
    """A family larger than a block, whose members link to some of the others only."""
    r = random.Random(1)
    core = [f"c{i}" for i in range(100)]
    rows = []
    for i in range(700):
        w = list(core)
        for j in r.sample(range(0, 100, 5), r.choice([1, 2, 3])):
            w[j] = f"u{i}_{j}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.components(df, shingle=4).collect()} == brute(rows, 4)


def test_null_and_empty(spark, awkward, empty):
    got = near_dedup.components(awkward, shingle=5).toPandas()
    assert len(got) == awkward.count()
    by = {r.doc_id: r for r in got.dropna(subset=["doc_id"]).itertuples()}
    assert by[2].component_id == 1 and not by[2].kept and by[1].kept
    assert by[6].component_id == 5 and by[3].n_shingles == by[4].n_shingles == by[7].n_shingles == 0 and by[3].kept and by[4].kept
    lost = got[got.doc_id.isna()]
    assert sorted(lost.kept) == [False, True]  # the copy of 1 goes, the null text stays
    kept = near_dedup.dedup(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 1, 3, 4, 5, 7, 8]
    assert near_dedup.components(empty).count() == 0 and near_dedup.dedup(empty).count() == 0


def test_sketch():
    a, b = near_dedup._family()
    rng = np.random.default_rng(0)
    shared, x, y = (rng.integers(0, 1 << 64, n, np.uint64) for n in (4000, 500, 500))
    p, q = np.unique(np.append(shared, x)), np.unique(np.append(shared, y))
    m = [near_dedup.minima(s, a, b) for s in (p, q, np.unique(np.concatenate([p, q])))]
    rp, rq, both = map(near_dedup.registers, m)
    assert (np.maximum(rp, rq) == both).all()  # mergeable
    j = near_dedup.estimate(rp[None], rq[None], np.array([len(p)]), np.array([len(q)]))[0]
    assert abs(j - 4000 / 5000) < 0.12


@pytest.mark.parametrize("local", [1 << 20, 0])
def test_components(spark, monkeypatch, local):
    """Joined in one task, and by rounds over the cluster."""
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    got = {r.id: r.comp for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_least_labels():
    r = np.random.default_rng(3)
    for n, m in ((10, 8), (400, 380), (2000, 5000)):
        a, b = r.integers(-n, n, (2, m))
        forest = simjoin.Forest()
        for x, y in zip(a.tolist(), b.tolist()):
            forest.join(x, y)
        least = {}
        for x in {*a.tolist(), *b.tolist()}:
            least[forest.root(x)] = min(x, least.get(forest.root(x), x))
        ids, comp = components.least_labels(a, b)
        assert dict(zip(ids.tolist(), comp.tolist())) == {x: least[forest.root(x)] for x in {*a.tolist(), *b.tolist()}}
