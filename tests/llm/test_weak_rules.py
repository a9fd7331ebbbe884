import math
import re
from collections import Counter

import numpy as np
import pytest

from cairnspark.llm import queries, textstats, weak_rules


def base(text):
    """The contract's counts, one text at a time."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def held(rows, texts):
    for r in rows:
        want = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed) and 0 <= r.quality <= 1
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_quality_rules(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    held(rows, texts)


def more(text):
    """The counts beside the base ones, one text at a time."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_lines": len(lines),
        "n_ended_lines": sum(x[-1] in '.!?:;"' for x in lines),
        "n_distinct_words": len(set(words)),
        "n_upper": len(re.findall("[A-Z\u00c0-\u00de]", text)),
        "n_lower": len(re.findall("[a-z]", text)),
        "n_digits": len(re.findall("[0-9]", text)),
        "n_bang": text.count("!"),
        "n_pipe": text.count("|"),
        "n_punct": len(re.findall(r"""[.,;:?'"()-]""", text)),
        "n_wide": sum(ord(x) > 0x7F for x in text),
    }


def votes_of(text):
    """The ten rules as plain conditions; good 1, bad -1."""
    n, chars, symbols, dup, repeat = base(text)
    m = more(text)
    w, lines = max(n, 1), max(m["n_lines"], 1)
    upper = m["n_upper"] / max(m["n_upper"] + m["n_lower"] + m["n_wide"], 1)
    bad = [symbols / w > 0.2, symbols / max(chars, 1) > 0.03, m["n_bang"] / w > 0.3, upper > 0.5, repeat / w > 0.3, dup / lines > 0.3 and m["n_lines"] >= 3, m["n_distinct_words"] / w**0.5 < 2.5, not 2 <= chars / w <= 14, m["n_pipe"] * 10 > n]
    good = m["n_ended_lines"] / lines > 0.7 and upper < 0.2 and symbols / w < 0.1 and m["n_bang"] / w < 0.1 and repeat / w < 0.15
    return [-int(b) for b in bad] + [int(good)]


def test_query_end_to_end(spark, sf):
    """Votes, expectation-maximisation over single documents and posteriors, without the operator's own code."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    v = {i: votes_of(t) for i, t in docs.items()}
    acc, prior = [0.95] * 10, 0.5
    post = {}
    for _ in range(200):
        log = [math.log(a / (1 - a)) for a in acc]
        new = {i: 1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(a * b for a, b in zip(log, x))))) for i, x in v.items()}
        done, post = bool(post) and max(abs(new[i] - post[i]) for i in v) < 1e-9, new
        if done:
            break
        prior = (1 + sum(post.values())) / (2 + len(v))
        for k in range(10):
            cast = sum(x[k] != 0 for x in v.values())
            right = sum(post[i] if x[k] > 0 else 1 - post[i] for i, x in v.items() if x[k])
            extra = max(1.0, 0.02 * cast)
            acc[k] = min(max((right + 0.95 * extra) / (cast + extra), 0.5), 0.9999)
    for r in queries.op4_quality_rules(spark, sf).collect():
        assert [getattr(r, f"vote_{k}") for k in weak_rules.rules()] == v[r.doc_id]
        assert r.quality == pytest.approx(post[r.doc_id], abs=1e-6)
        n, *_, repeat = base(docs[r.doc_id])
        assert r.kept == (n >= 50 and 100 * repeat <= 50 * n and post[r.doc_id] >= 0.5)


def test_verdicts_agree_with_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_quality_rules(spark, sf).withColumnRenamed("quality", "posterior").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.97


def test_odd_texts(spark):
    odd = {0: "\n\n a \na\n a \n", 1: "a b a b a b", 2: "ä b ß\x0bc\x0cd", 3: "x|y #*$%&|<>", 4: "one two", 5: "\r\n\r\n", 6: ("same line\n" * 60).strip(), 7: "a\x1cb\x85c d"}
    held(weak_rules.assess(spark.createDataFrame(list(odd.items()), "doc_id long, text string")).collect(), odd)


def test_null_and_empty(spark, awkward, empty):
    rows = weak_rules.assess(awkward).collect()
    held([r for r in rows if r.doc_id], {r.doc_id: r.text for r in awkward.collect()})
    assert len(rows) == awkward.count() and all(r.base_failed for r in rows if r.doc_id in (3, 4, 7))
    assert weak_rules.assess(empty).count() == 0


def test_texts_of_a_batch_do_not_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    from pyspark.sql import functions as F

    count = lambda d: {r.doc_id: r for r in textstats.text_counts(d, F.col("text"), {"doc_id": F.col("doc_id")}).collect()}
    assert count(docs) == count(docs.repartition(40))


def votes(n, prior, accuracy, cast, seed=0):
    rng = np.random.default_rng(seed)
    y = np.where(rng.random(n) < prior, 1, -1)
    v = np.where(rng.random((n, len(accuracy))) < accuracy, y[:, None], -y[:, None])
    return y, np.where(rng.random(v.shape) < cast, v, 0)


def test_em_recovers_accuracies():
    want = [0.95, 0.9, 0.8, 0.7, 0.6]
    y, v = votes(20_000, 0.7, want, 0.7)
    patterns, inverse, weight = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    m = weak_rules.fit(list("abcde"), patterns, weight.astype(float), expected=0.7)
    assert m.prior == pytest.approx(0.7, abs=0.03) and m.accuracy == pytest.approx(want, abs=0.04)
    assert ((m.posterior(v) >= 0.5) == (y == 1)).mean() > 0.93


def test_column_is_the_posterior(spark):
    from pyspark.sql import functions as F

    m = weak_rules.LabelModel(["a", "b"], 0.6, np.array([0.9, 0.7]))
    rows = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    got = spark.createDataFrame(rows, "a int, b int").select("a", "b", m.column({"a": F.col("a"), "b": F.col("b")}).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([float(m.posterior(np.array([[r.a, r.b]]))[0]) for r in got])
