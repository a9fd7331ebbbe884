r"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

Texts and items are lower-cased (A-Z) and cut into words
``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.  A window is ``window`` consecutive item
words, or a shorter item as a whole; a text's word is hit if it lies in an
occurrence of a window.

1. Items become shingles of three words (shorter for windows of fewer words).
   One pass over the texts keeps, by an equi-join on the shingle's hash, the
   positions whose shingle some item has, once per distinct text.
2. Shingles are ordered by how often they occur in these matches, rarest first.
   Containment of all of a window's shingles leaves a prefix of one: only
   occurrences of its rarest shingle are candidates.
3. Length and positional bounds: the window must fit between the text's ends
   when its rarest shingle stands where it was found.
4. Candidates are gathered by text and verified there: the words of the text at
   the window's place equal the window's words.

Work is linear in matches; no pair of texts is formed, so a widely copied
passage only adds its own occurrences.  Of each join only a side counted to be
small is broadcast; beyond that the join shuffles, and a shingle or text in very
many rows is spread over all tasks (:func:`common.spread_join`).

Defined results: shingles that are equally rare are taken by their place in the
window; a very long text stays one row with its words and places; null and empty texts have no words and are clean; items without
words are ignored; repeated item ids count as one item, a null one has the empty name; repeated rows each get a
result; the items table may be empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import discard, fresh, lower_ascii, row_of, spread_join, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _shingles(w: Column, k: int) -> Column:
    """Array of (position, hash) of the runs of k words."""
    n = F.size(w)
    at = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(k), *[F.get(w, i + j) for j in range(k)]).alias("h")))


def _windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """w (words), items (the ids of those that have it), len, k and shingles (array of position and hash) of each distinct window."""
    w = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item_id"), words(F.col(f"`{text_col}`")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = w.select("item_id", F.explode(starts).alias("s"), "w").select("item_id", F.slice("w", F.col("s") + 1, window).alias("w"))
    cut = cut.groupBy("w").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    cut = cut.withColumn("len", F.size("w")).withColumn("k", F.least(F.col("len"), F.lit(SHINGLE)))
    parts = _shingles(F.col("w"), SHINGLE)
    for k in range(1, SHINGLE):
        parts = F.when(F.col("k") == k, _shingles(F.col("w"), k)).otherwise(parts)
    return cut.withColumn("shingles", parts)


def _candidates(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, window: int) -> DataFrame:
    """tk (MD5 of a text) and c: an array of (start, w, items), the places where a window's rarest shingle stands."""
    wins = written(_windows(items, item_id, item_text, window), "bench-windows")
    grams = written(wins.select("k", F.explode("shingles.h").alias("h")).distinct(), "bench-shingles")
    sizes = {r["k"]: r["n"] for r in grams.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most SHINGLE rows
    texts = docs.select(_key(text_col).alias("tk"), words(F.col(f"`{text_col}`")).alias("w"))
    found = None
    for k, n in sorted(sizes.items()):
        at = texts.select("tk", F.size("w").alias("n_words"), F.explode(_shingles(F.col("w"), k)).alias("s")).select("tk", "n_words", "s.pos", "s.h")
        hit = spread_join(at, grams.where(F.col("k") == k).select("h"), ["h"], [F.col("tk"), F.col("pos")], rows=n, bound=common.WIDE_ROWS)
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = texts.select("tk", F.size("w").alias("n_words"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("h")).limit(0)
    found = written(found.select("tk", "n_words", "pos", "h").distinct(), "bench-matches")
    # rarest shingle first; a window with a shingle that never occurs needs no look
    seen = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "bench-frequencies")
    parts = wins.select("w", "items", F.explode("shingles").alias("s")).select("w", "items", "s.pos", "s.h").join(seen, "h", "left")
    prefix = parts.groupBy("w", "items").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pos", "h")).alias("p")).where("p.n > 0")
    prefix = written(prefix.select(F.col("p.h").alias("h"), F.col("p.pos").alias("at"), "w", "items"), "bench-prefixes")
    # length and positional bounds, before any verification; a window row is some ten times a row of two longs
    placed = spread_join(found, prefix, ["h"], [F.col("tk"), F.col("pos")], rows=10 * prefix.count(), counts=seen)
    placed = placed.select("tk", "n_words", (F.col("pos") - F.col("at")).alias("start"), "w", "items").where((F.col("start") >= 0) & (F.col("start") + F.size("w") <= F.col("n_words")))
    out = written(placed.groupBy("tk").agg(F.collect_list(F.struct("start", "w", "items")).alias("c")), "bench-candidates")
    discard(grams, found, seen, prefix)
    return out


def _key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every row and column of ``docs`` with one more, ``hit``: n_words, n_hit, n_items, items_sha256, contaminated."""
    cand = _candidates(docs, items, text_col, item_id, item_text, window)
    weight = cand.agg(F.coalesce(F.sum(F.size("c")), F.lit(0)).alias("n")).first()["n"]
    rows = docs.select(row_of(docs).alias("r"), _key(text_col).alias("tk"))
    # copies of one text differ in other columns; a candidate is some ten times a row of two longs
    other = [F.col(f"r.`{c}`") for c, t in docs.dtypes if c != text_col and "map<" not in t and "variant" not in t]
    rows = spread_join(rows, cand, ["tk"], other, rows=10 * weight, how="left", wide=True).select("r", "c", words(F.col(f"r.`{text_col}`")).alias("w"))
    true = F.filter(F.coalesce("c", F.array().cast(cand.schema["c"].dataType)), lambda x: F.slice(F.col("w"), x["start"] + 1, F.size(x["w"])) == x["w"])
    rows = rows.select("r", F.size("w").cast("long").alias("n_words"), true.alias("o"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("o", lambda x: F.sequence(x["start"], x["start"] + F.size(x["w"]) - 1)))))
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("o", lambda x: x["items"]))))
    hit = F.struct("n_words", covered.cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("o") > 0).alias("contaminated"))
    name = fresh(docs.columns, "hit")
    return rows.select(*[F.col(f"r.`{c}`").alias(c) for c in docs.columns], hit.alias(name))
