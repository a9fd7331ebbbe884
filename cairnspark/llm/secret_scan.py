r"""Secret scan with corpus-wide ownership frequency.

Base kinds are found in every whole text (leftmost, non-overlapping per kind):

* ``assign``: a credential name, ``=`` or ``:`` and a value of 12 or more characters,
* ``access``: ``AKIA`` and capitals or digits, 18 or more characters,
* ``hex``: 16 or more of ``0-9a-f``.

The method adds ``opaque``: runs of 24 or more letters, digits and ``+/_-`` that
mix both cases and digits, have at least 3.5 bits a character and touch no base
span.  Hashes of all candidate values are counted by distinct repositories and
owners over the whole corpus: a value with more than ``max_owners`` owners or
``max_repos`` repositories is a widely copied example, the others are
owner-specific and look live.  Opaque spans stay only if owner-specific; base
spans always stay and are counted by verdict.

By default the owner is the column ``source`` and the repository is source and
``lang`` together, so a repository never has two owners and ``max_repos`` binds
only for an owner of several languages; give both where the table knows better.
A table without these columns has one owner and one repository, the empty name.

Offsets are code points, ends exclusive.  Defined results: a null text is empty;
a null owner or repository counts as one of its own; repeated rows each get a
result and count once per owner; spans that start together are ordered by kind;
a very long text is scanned whole, in one row; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, spread_join, written
from .textbytes import tidied

KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"


def finder():
    """Function from a text to its spans (kind index, start, end, value), by start, then kind."""
    import math
    import re

    assign, access, hexes, opaque = re.compile(ASSIGN), re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{16,}"), re.compile(OPAQUE)
    names = ("password", "passwd", "secret", "token", "apikey", "api_key")

    def bits(x: str) -> float:
        return -sum((p := x.count(c) / len(x)) * math.log2(p) for c in set(x))

    def find(text: str) -> list[tuple[int, int, int, str]]:
        low, out = text.lower(), []
        if any(n in low for n in names):
            out += [(0, m.start(), m.end(), m[2]) for m in assign.finditer(text) if len(m[2]) >= 12]
        if "AKIA" in text:
            out += [(1, m.start(), m.end(), m[0]) for m in access.finditer(text) if m.end() - m.start() >= 18]
        out += [(2, m.start(), m.end(), m[0]) for m in hexes.finditer(text)]
        base = list(out)
        for m in opaque.finditer(text):
            x = m[0]
            if re.search("[0-9]", x) and re.search("[A-Z]", x) and re.search("[a-z]", x) and bits(x) >= 3.5 and not any(s < m.end() and m.start() < e for _, s, e, _ in base):
                out.append((3, m.start(), m.end(), x))
        return sorted(out, key=lambda r: (r[1], r[0]))

    return find


def _scan(docs: DataFrame, id_col: str, text_col: str, owner: Column, repo: Column) -> DataFrame:
    def run(batches):
        import hashlib

        import pyarrow as pa

        find = finder()
        found_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value_hash", pa.binary())]))
        for b in batches:
            base, rows, n = [], [], ([], [], [])
            for text in b.column(1):
                spans = find(text.as_py() or "")
                for k in range(3):
                    n[k].append(sum(s[0] == k for s in spans))
                base.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, _ in spans if k < 3).encode()).hexdigest())
                rows.append([{"kind": k, "start": s, "end": e, "value_hash": hashlib.sha256(v.encode()).digest()[:16]} for k, s, e, v in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *[pa.array(x, pa.int64()) for x in n], pa.array(base, pa.string()), pa.array(rows, found_type)], names=["doc_id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    texts = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"))
    return texts.mapInArrow(tidied(run), f"doc_id {dict(texts.dtypes)['doc_id']}, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:int,start:long,end:long,value_hash:binary>>")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, max_owners: int = 1, max_repos: int = 3) -> DataFrame:
    """Per text: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_opaque, n_live, n_example.

    ``owner`` and ``repo``: columns, by default as the module says.
    """
    has = [F.col(c) for c in ("source", "lang") if c in docs.columns]
    owner = (F.col("source") if "source" in docs.columns else F.lit("")) if owner is None else owner
    repo = F.concat_ws("/", *has) if repo is None else repo
    rows = written(_scan(docs, id_col, text_col, owner, repo).withColumn("rid", F.monotonically_increasing_id()), "secret-rows")
    found = rows.select("rid", "owner", "repo", F.explode("found").alias("f")).select("rid", "owner", "repo", "f.*")
    # owners before values: a value copied everywhere shuffles one row per owner and task
    use = found.groupBy("value_hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n")).groupBy("value_hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"), F.sum("n").alias("n"))
    use = written(use.select("value_hash", ((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).alias("live"), "n"), "secret-values")
    found = found.select("rid", "kind", "start", "end", "value_hash")
    judged = spread_join(found, use, ["value_hash"], [F.col("rid"), F.col("start")], rows=2 * use.count(), n="n").where((F.col("kind") < 3) | F.col("live"))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    per_text = judged.groupBy("rid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("s")))), lambda x: x["s"]), ",").alias("spans"),
        F.count_if(F.col("kind") == 3).alias("n_opaque"),
        F.count_if(F.col("live")).alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
    )
    zero = F.lit(0).cast("long")
    return rows.drop("found", "owner", "repo").join(per_text, "rid", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), *[F.coalesce(c, zero).alias(c) for c in ("n_opaque", "n_live", "n_example")])
