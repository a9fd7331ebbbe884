"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, line_dedup, near_dedup, rule_ensemble, secret_scan, sharding, spm, token_count, warc, weak_rules
from .common import table

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("CAIRNSPARK_TOKENIZERS", "/opt/tokenizers")
SPM_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 40)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(table(spark, sf_dir, "documents"), shingle=4)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_decode(table(spark, sf_dir, "documents"), SPM_MODEL)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.assess(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "hit.*")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), SPM_MODEL)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "lines.*", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_minhash_near_dedup, op3_sentencepiece, op4_quality_rules, op5_warc, op6_secret_scan, op7_decontamination, op8_token_counts, op9_quality_classifier, op10_line_dedup)}


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def near_dedup_sql(k: int) -> str:
    """All pairs that share a shingle, then closure by recursion."""
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
  e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
  r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
  m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN m ON id = doc_id"""


WARC_SQL = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), t AS (SELECT *, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p), k AS (SELECT *, n >= 1000 AND page_id <> top AS again FROM t)
  SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to, url, CASE WHEN NOT again THEN CAST(n AS INTEGER) END AS stored_bytes FROM k"""

DECONTAMINATION_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  v AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda p: array_to_string(w[p:p + least(10, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
  x AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n),
  o AS (SELECT doc_id, p, v.n AS n, item_id FROM x JOIN v ON v.n = x.n AND array_to_string(w[p:p + x.n - 1], ' ') = g),
  h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM o) GROUP BY doc_id),
  t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

_CREDENTIAL = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def secret_scan_sql(max_owners: int = 1, max_repos: int = 3) -> str:
    """Places from the lengths of matches and of what lies between them; ownership by the values themselves."""
    kinds = [(_CREDENTIAL, f"regexp_extract(m, '{_CREDENTIAL}', 2)", 12), ("AKIA[A-Z0-9]+", "m", 18), ("[0-9a-f]+", "m", 16), ("[A-Za-z0-9+/_-]+", "m", 24)]
    found = " UNION ALL ".join(f"SELECT doc_id, owner, repo, {k} AS kind, s, s + len(m) AS e, v FROM (SELECT *, {value} AS v FROM (SELECT doc_id, owner, repo, m, CAST(sum(len(gap) + len(m)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - len(m) AS s FROM (SELECT doc_id, owner, repo, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap FROM (SELECT *, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM d)))) WHERE len(v) >= {least}" for k, (pattern, value, least) in enumerate(kinds))
    mixed = "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND list_entropy(string_split(v, '')) >= 3.5"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
  f AS ({found}),
  b AS (SELECT * FROM f WHERE kind < 3),
  a AS (SELECT * FROM b UNION ALL SELECT f.* FROM f WHERE kind = 3 AND {mixed} AND NOT EXISTS (FROM b WHERE b.doc_id = f.doc_id AND b.s < f.e AND f.s < b.e)),
  u AS (SELECT v, count(DISTINCT owner) <= {max_owners} AND count(DISTINCT repo) <= {max_repos} AS live FROM a GROUP BY v),
  j AS (SELECT a.*, live, ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || s || ':' || e AS x FROM a JOIN u USING (v) WHERE kind < 3 OR live),
  g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = {k}) AS n{k}" for k in range(4))}, count(*) FILTER (live) AS nl, count(*) FILTER (NOT live) AS ne, string_agg(x, ',' ORDER BY s, kind) AS spans, string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 3) AS base FROM j GROUP BY doc_id)
  SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n3, 0) AS n_opaque, coalesce(nl, 0) AS n_live, coalesce(ne, 0) AS n_example FROM d LEFT JOIN g USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL for those it can express; the others are held against brute force in the tests."""
    return {"op2_minhash_near_dedup": near_dedup_sql(4), "op5_warc": WARC_SQL, "op6_secret_scan": secret_scan_sql(), "op7_decontamination": DECONTAMINATION_SQL}
