import random
from itertools import combinations

import pytest

from cairnspark.llm import common, line_dedup, queries, simjoin


def grams(line, k=line_dedup.SHINGLE):
    return frozenset(line[i : i + k] for i in range(len(line) - k + 1))


def brute(docs, least=20):
    """doc to kept text, by comparing all pairs of lines that share a shingle; shorter lines have none."""
    places = {}
    for d, t in docs:
        for p, line in enumerate(t.split("\n") if t is not None else []):
            if len(line.strip()) >= max(least, 1):
                places.setdefault(line, []).append((d, p))
    lines = list(places)
    sets = [grams(x) for x in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for n, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(n)
    for a, b in {p for group in by.values() for p in combinations(group, 2)}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    first = {}
    for n, line in enumerate(lines):
        first[find(n)] = min(min(places[line]), first.get(find(n), (1 << 60, 0)))
    keep = {}
    for n, line in enumerate(lines):
        keep[line] = first[find(n)]
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if x not in keep or keep[x] == (d, p)) for d, t in docs}


def made(seed=2):
    r = random.Random(seed)
    pool = [" ".join(r.choice(["lorem", "ipsum", "dolor", "amet", "élan", "тест", "x" * r.randrange(3, 9)]) + str(r.randrange(99)) for _ in range(r.randrange(3, 30))) for _ in range(60)]

    def changed(x):
        for _ in range(r.choice([0, 1, 1, 2, 4])):
            i = r.randrange(len(x))
            x = x[:i] + r.choice("abc🙂") + x[i + r.choice([0, 1]) :]
        return x

    docs = [(i, "\n".join(r.choice(["short", "", "  ", changed(r.choice(pool)), r.choice(pool)]) for _ in range(r.randrange(0, 25)))) for i in range(40)]
    return docs + [(50, pool[0] + "\n" + pool[0]), (51, pool[0]), (52, "\n"), (53, None)]


def test_against_all_pairs(spark):
    docs = made()
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    want = brute(docs)
    assert {r.doc_id: r.text for r in out} == want
    for r in out:
        t = dict(docs)[r.doc_id]
        assert r.lines.n_lines == (len(t.split("\n")) if t is not None else 0)
        assert r.lines.n_dropped == (0 if t is None or r.text == t else len(t.split("\n")) - (len(r.text.split("\n")) if r.text or want[r.doc_id] else 0)) or r.text == ""


def test_repeated_nodes_of_a_packing(spark):
    """A node that repeats inside one packing doesn't hide another one of its key."""
    rows = [(a, k) for k in range(3000) for a in [(3 * k, 3 * k, 3 * k + 1), (3 * k + 1, 3 * k, 3 * k), (3 * k, 3 * k, 3 * k + 1, 3 * k + 1)][k % 3]]
    nodes = spark.createDataFrame([(a, bytearray((k << 33).to_bytes(8, "little"))) for a, k in rows], "id long, keys binary").coalesce(1)
    assert sorted((r.id, r.n, r.m) for r in simjoin.buckets(nodes).collect()) == sorted({(a, 2, 3 * k) for a, k in rows})


@pytest.mark.parametrize("least", [0, 5])
def test_short_lines(spark, least):
    """Lines of less than a shingle are compared for equality; blank ones are always kept."""
    docs = made(5) + [(60, "short\na b\n\t\n "), (61, "a b\nshort\n\t\n "), (62, "\t\t ab \t\t\t\t\t\t\t\t\t\t\t\t\t\t\t\t")]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_chars=least).collect()
    assert {r.doc_id: r.text for r in out} == brute(docs, least)


@pytest.mark.parametrize("hot", [1024, 8])
def test_shuffled_joins_give_the_same(spark, monkeypatch, hot):
    """No broadcast at all, and one line in every text."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "WIDE_ROWS", 0)
    monkeypatch.setattr(common, "HOT", hot)
    docs = [(i, f"{t}\none line that stands in every text" if t is not None else t) for i, t in made(7)]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.text for r in out} == brute(docs)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r.text for r in queries.op10_line_dedup(spark, sf).collect()}
    want = brute(docs)
    assert got == want and sum(want[d] != t for d, t in docs) > 5


def test_null_and_empty(spark, awkward, empty):
    out = line_dedup.dedup_lines(awkward)
    assert out.columns[:-1] == awkward.columns and out.columns[-1] == "lines_"
    rows = out.collect()
    assert len(rows) == awkward.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    # the first document in order has a null id; rows equal in id and text share their fate
    assert [r.text is None for r in by[None]].count(True) == 1 and {r.lines_.n_dropped for r in by[None]} == {0}
    assert [r.text for r in by[1]] == ["", ""] and by[2][0].text == "" and by[3][0].text is None and by[4][0].text == ""
    assert by[6][0].text == "" and by[5][0].lines_.n_dropped == 0 and by[7][0].text == " \t\n\r "
    assert line_dedup.dedup_lines(empty).count() == 0


def test_least_length():
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(None, min_chars=-1)
