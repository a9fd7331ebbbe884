"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a text's counts.  The
votes are reduced to a table of vote patterns (at most 3 ** rules rows, whatever
the corpus size); expectation-maximisation over the patterns estimates the
accuracy of each rule, and a text's posterior probability of being
good replaces all-must-pass filtering.  Scoring is a column expression.

Defined results: a null or empty text has no words, so `base_failed`; repeated
rows get equal results; an empty table gives no rows (the model then is its
starting point); a very long text is counted whole; a quality of exactly
``min_quality`` is kept; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .textstats import text_counts

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _ratio(a: Column, b: str) -> Column:
    return a / F.greatest(F.col(b), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Name to vote; over the columns of :func:`textstats.text_counts`.

    A defect votes bad and its absence abstains; only well-formed prose votes good.
    """
    c = F.col
    letters = c("n_upper") + c("n_lower") + c("n_wide")
    symbols, share, bangs = _ratio(c("n_symbols"), "n_words"), _ratio(c("n_symbols"), "word_chars"), _ratio(c("n_bang"), "n_words")
    upper = c("n_upper") / F.greatest(letters, F.lit(1))
    repeats, lines = _ratio(c("n_repeat_words"), "n_words"), _ratio(c("n_dup_lines"), "n_lines")
    variety, mean = c("n_distinct_words") / F.sqrt(F.greatest(c("n_words"), F.lit(1))), _ratio(c("word_chars"), "n_words")
    ended, none = _ratio(c("n_ended_lines"), "n_lines"), F.lit(False)
    return {
        "symbols": _vote(none, symbols > 0.2),
        "symbol_share": _vote(none, share > 0.03),
        "exclamations": _vote(none, bangs > 0.3),
        "capitals": _vote(none, upper > 0.5),
        "repeats": _vote(none, repeats > 0.3),
        "lines": _vote(none, (lines > 0.3) & (c("n_lines") >= 3)),
        "variety": _vote(none, variety < 2.5),
        "word_length": _vote(none, (mean < 2) | (mean > 14)),
        "pipes": _vote(none, c("n_pipe") * 10 > c("n_words")),
        "prose": _vote((ended > 0.7) & (upper < 0.2) & (symbols < 0.1) & (bangs < 0.1) & (repeats < 0.15), none),
    }


@dataclass
class LabelModel:
    """``prior``: probability of good; ``accuracy``: of each rule's cast votes.  Abstentions carry no evidence."""

    names: list[str]
    prior: float
    accuracy: np.ndarray

    def weights(self) -> np.ndarray:
        return np.log(self.accuracy / (1 - self.accuracy))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        z = np.log(self.prior / (1 - self.prior)) + patterns @ self.weights()
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def column(self, votes: dict[str, Column]) -> Column:
        z = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for w, name in zip(self.weights(), self.names):
            z = z + votes[name] * float(w)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(names: list[str], patterns: np.ndarray, weight: np.ndarray, *, rounds: int = 200, expected: float = 0.95, strength: float = 0.02) -> LabelModel:
    """EM for the accuracies; ``patterns``: distinct vote rows, ``weight``: their counts.

    A rule starts at accuracy ``expected``, which also counts as ``strength`` of
    its cast votes (and one vote at least) in each estimate.
    """
    model = LabelModel(names, 0.5, np.full(len(names), expected))
    if not len(patterns):
        return model
    cast = weight @ (patterns != 0)
    extra = np.maximum(1.0, strength * cast)
    good = model.posterior(patterns)
    for _ in range(rounds):
        right = (weight * good) @ (patterns == 1) + (weight * (1 - good)) @ (patterns == -1)
        prior = (1 + weight @ good) / (2 + weight.sum())
        model = LabelModel(names, float(prior), np.clip((right + expected * extra) / (cast + extra), 0.5, 0.9999))
        before, good = good, model.posterior(patterns)
        if np.abs(good - before).max() < 1e-9:
            break
    return model


def assess(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_quality: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, quality (posterior) and each rule's vote."""
    counts = written(text_counts(docs, F.col(f"`{text_col}`"), {"doc_id": F.col(f"`{id_col}`")}), "rule-counts")
    votes = rules()
    seen = counts.select(*[v.cast("tinyint").alias(k) for k, v in votes.items()]).groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).orderBy(*votes).collect()  # at most 3 ** rules rows
    model = fit(list(votes), np.array([[r[k] for k in votes] for r in seen], int).reshape(len(seen), len(votes)), np.array([r["n"] for r in seen], float))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    quality = model.column(votes)
    return counts.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (quality >= min_quality)).alias("kept"), quality.alias("quality"), *[v.alias(f"vote_{k}") for k, v in votes.items()])
