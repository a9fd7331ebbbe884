"""Quality classifier: a sparse rule ensemble.

Boosted trees are grown on statistics of labelled texts; every path from a root
is a conjunctive rule; a lasso logistic regression weighs the rules and drops
most of them; the rest become one Spark column expression.  Inputs are counts
of the text alone.

The classifier is fitted on at most ``fit_rows`` labelled rows (those with the
smallest hash of their id); every text is scored.

Defined results: null and empty texts have zero counts and a score like any
other; a document labelled twice has the mean label, rounded half up; without
usable labels of both kinds the score is the (smoothed) share of label 1; a null
id is never labelled and not held out; repeated rows repeat; an empty table gives
no rows; a very long text is counted whole; of labelled rows with equal hashes the
least id is fitted first; a score of exactly 0.5 is predicted 1; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_of
from .textstats import text_counts

FIT_ROWS = 20_000


def statistics() -> dict[str, Column]:
    """Inputs of the classifier, over the columns of :func:`textstats.text_counts`."""
    c, one = F.col, F.lit(1)
    words, lines = F.greatest(c("n_words"), one), F.greatest(c("n_lines"), one)
    letters = F.greatest(c("n_upper") + c("n_lower") + c("n_wide"), one)
    return {
        "log_words": F.log1p(c("n_words")),
        "word_length": c("word_chars") / words,
        "symbols": c("n_symbols") / words,
        "exclamations": c("n_bang") / words,
        "pipes": c("n_pipe") / words,
        "capitals": c("n_upper") / letters,
        "digits": c("n_digits") / F.greatest(c("word_chars"), one),
        "punctuation": c("n_punct") / words,
        "repeated_words": c("n_repeat_words") / words,
        "repeated_lines": c("n_dup_lines") / lines,
        "variety": c("n_distinct_words") / F.sqrt(words),
        "line_words": c("n_words") / lines,
        "ended_lines": c("n_ended_lines") / lines,
    }


Rule = tuple[tuple[int, bool, float], ...]  # (input, whether above, threshold)


@dataclass
class RuleModel:
    names: list[str]
    intercept: float
    rules: list[tuple[Rule, float]]

    def column(self, inputs: dict[str, Column]) -> Column:
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            test = F.lit(True)
            for i, above, at in rule:
                x = inputs[self.names[i]]
                test = test & ((x > at) if above else (x <= at))
            z = z + F.when(test, weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _tree(codes: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], depth: int, path: Rule, out: list[Rule], step: np.ndarray, least: int = 10) -> None:
    """Grow one tree by second-order gain; append each node's path to ``out`` and leaf values to ``step``."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    step[rows] = -g / (h + 1.0)
    if path:
        out.append(path)
    if depth == 0 or len(rows) < 2 * least:
        return
    best = (1e-6, -1, -1)
    for f in range(codes.shape[1]):
        if not len(cuts[f]):
            continue
        c = codes[rows, f]
        n = len(cuts[f]) + 1
        gs, hs, ns = (np.cumsum(np.bincount(c, weights=w, minlength=n))[:-1] for w in (gradient[rows], hessian[rows], np.ones(len(rows))))
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        gain[(ns < least) | (len(rows) - ns < least)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    if best[1] < 0:
        return
    _, f, k = best
    left = codes[rows, f] <= k
    for above, part in ((False, rows[left]), (True, rows[~left])):
        _tree(codes, gradient, hessian, part, cuts, depth - 1, (*path, (f, above, float(cuts[f][k]))), out, step, least)


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, bins: int = 64, rate: float = 0.2, seed: int = 7) -> list[Rule]:
    """Rules of boosted trees, each grown on half of the rows."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rng, found = np.random.default_rng(seed), []
    for _ in range(trees):
        p = _sigmoid(z)
        step = np.zeros(len(y))
        rows = np.sort(rng.permutation(len(y))[: max(1, len(y) // 2)]) if len(y) > 200 else np.arange(len(y))
        paths: list[Rule] = []
        _tree(codes, p - y, p * (1 - p), rows, cuts, depth, (), paths, step)
        found += paths
        z[rows] += rate * step[rows]
    return list(dict.fromkeys(found))


def covers(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for i, above, at in rule:
            out[:, j] *= (x[:, i] > at) if above else (x[:, i] <= at)
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Lasso logistic regression by accelerated proximal gradient; the intercept is free."""
    n, m = r.shape
    a = np.hstack([np.ones((n, 1)), r])
    v = np.ones(m + 1)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    lip = float(v @ (a.T @ (a @ v))) / (4 * n) * 1.05
    w = np.zeros(m + 1)
    w[0] = np.log(y.mean() / (1 - y.mean()))
    u, t = w.copy(), 1.0
    for _ in range(rounds):
        new = u - a.T @ (_sigmoid(a @ u) - y) / n / lip
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - penalty / lip, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return float(w[0]), w[1:]


def fit(names: list[str], x: np.ndarray, y: np.ndarray, **options) -> RuleModel:
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(names, float(np.log(p / (1 - p))), [])
    rules = grow(x, y, **options)
    intercept, weights = lasso(covers(rules, x), y)
    return RuleModel(names, intercept, [(r, float(w)) for r, w in zip(rules, weights) if w])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "quality", fit_rows: int = FIT_ROWS) -> RuleModel:
    """Fit on the labelled rows that are not held out; no label of a held-out row is read."""
    ident, mark, inputs = F.col(f"`{label_id}`"), F.col(f"`{label}`"), statistics()
    marks = labels.where(ident.isNotNull() & mark.isNotNull() & ~held_out(ident)).groupBy(ident.alias("id")).agg((F.avg(mark) >= 0.5).cast("int").alias("y"))
    # the ids to fit on are picked first: at most fit_rows small rows are broadcast, and only their texts are counted
    order = F.xxhash64(F.lit(11), F.col("id"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(marks.orderBy(order, "id").limit(fit_rows)), "id")
    rows = text_counts(texts, F.col("text"), {"id": F.col("id"), "y": F.col("y")}).select("id", "y", *[v.alias(k) for k, v in inputs.items()]).orderBy(order, "id", *inputs).limit(fit_rows).toPandas()
    return fit(list(inputs), rows[list(inputs)].to_numpy(float).reshape(len(rows), len(inputs)), rows["y"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""
    score = train(docs, labels, id_col=id_col, text_col=text_col, **options).column(statistics())
    scored = text_counts(docs, F.col(f"`{text_col}`"), {"doc_id": F.col(f"`{id_col}`")})
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores 0.5 or more."""
    score = train(docs, labels, text_col=text_col, **options).column(statistics())
    scored = text_counts(docs.select(row_of(docs).alias("row")), ("row", text_col), {"row": F.col("row")})
    return scored.where(score >= 0.5).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
