import hashlib
import re

from cairnspark.llm import queries, secret_scan

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base(text):
    """(start, kind, end) of the base spans, as the contract states them."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16])


def held(rows, texts):
    for r in rows:
        want = base(texts[r.doc_id])
        names = [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in want]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert [x for x in spans if not x.startswith("opaque")] == names
        assert [tuple(map(int, x.split(":")[1:])) for x in spans] == sorted(tuple(map(int, x.split(":")[1:])) for x in spans)
        assert r.n_live + r.n_example == len(spans) and r.n_opaque == len(spans) - len(names)


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op6_secret_scan(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and any(r.spans for r in rows)
    held(rows, texts)


def test_odd_texts(spark):
    odd = ["password=short", "PassWord = 'abcdefghijkl'", 'token":"aaaaaaaaaaaa', "paſſword=abcdefghijkl", "toKen=abcdefghijkl", "api_key : x=y=z-/+._0123", "secretsecret=abcdefghijklm", "AKIA" + "A" * 13, "xxAKIA" + "B7" * 8 + "AKIA", "0123456789abcdef0123456789ABCDEF", "é👩 token=0123456789abcdef0", "password=token=abcdefghijklmnop", "secret\n=abcdefghijklmn", "secret=  \"abcdefghijklmn", "passwd:0123456789abcdef01 hex 0123456789abcde"]
    df = spark.createDataFrame([(i, x, "en", "s") for i, x in enumerate(odd)], "doc_id long, text string, lang string, source string")
    held(secret_scan.scan(df).collect(), dict(enumerate(odd)))


def test_ownership_separates_copies_from_live_values(spark):
    live, copied = "Zq8Xv2Lk9Pw4Rt7Yb3Nc6Hd1Js5Gf0Ma", "Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8Ii9Jj0Kk"
    rows = [(i, f"the value {copied} again", "en", f"s{i}") for i in range(5)] + [(9, f"mine: {live} and password={live}", "en", "s1"), (10, f"mine: {live}", "en", "s1"), (11, f"password={copied}", "en", "s7")]
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].spans == "" for i in range(5))
    assert got[9].n_opaque == 1 and got[9].n_live == 2 and got[10].n_opaque == 1
    assert got[11].n_assign == 1 and got[11].n_example == 1  # a base span stays, marked as an example


def test_null_and_empty(spark, awkward, empty):
    rows = secret_scan.scan(awkward).collect()
    assert len(rows) == awkward.count()
    held([r for r in rows if r.doc_id], {r.doc_id: r.text for r in awkward.collect()})
    assert secret_scan.scan(empty).count() == 0
