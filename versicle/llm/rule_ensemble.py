"""Quality classifier as a sparse rule ensemble.

Shallow trees are boosted on text statistics, every path from a root becomes a conjunctive rule, rule weights are fitted
by L1-penalised logistic regression, and the rules that keep a weight are compiled into one Spark column expression.

Labelled rows are used up to `max_rows`, those with the least id hash, so the fit does not depend on partitions. They
are the only rows that reach the driver; scores come from column expressions over whole texts.

Defined cases. Null or empty text: all statistics are 0, and the rules score that like any text. Null doc_id: scored,
not held out, never a training row. Labels without a document or without a value are left out; no usable labels give
0.5, labels of one class a constant near that class. Rows that repeat are scored each; ids that repeat among the labels
count once for each row. An empty table gives an empty result; further columns are carried by `classify`.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, text_of

MAX_ROWS, THRESHOLD = 12_000, 0.3
STATS = ("log_words", "word_length", "symbols", "bangs", "bars", "distinct", "capitals", "digits", "echoes", "repeated_lines", "letters")


def stats_of(text: Column) -> Column:
    """A struct of STATS. Ratios are to the number of words or characters. Words and lines are bound once, so that a
    filter on the score can move below the projection without repeating their work."""
    rest = lambda p: F.char_length(F.regexp_replace(text, p, ""))
    by = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    chars = F.char_length(text)

    def of_words(w: Column, lines: Column) -> Column:
        n = F.size(w)
        echoes = F.size(F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.get(w, i) == F.get(w, i + 1)))
        values = (
            F.log1p(n), by(rest(f"[{SPACE}]+"), n), by(chars - rest(r"[#*$%&|<>]+"), n), by(F.regexp_count(text, F.lit("!!")), n),
            by(F.regexp_count(text, F.lit(r" \| ")), n), by(F.size(F.array_distinct(w)), n), by(chars - rest("[A-Z]+"), chars), by(chars - rest("[0-9]+"), chars),
            by(echoes, n), by(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)), by(chars - rest(r"[A-Za-z\x{C0}-\x{24F}]+"), chars),
        )
        return F.struct(*[v.cast("double").alias(k) for k, v in zip(STATS, values)])

    words = F.filter(F.split(text, f"[{SPACE}]+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x != "")
    return let(F.struct(words.alias("w"), lines.alias("l")), lambda t: of_words(t["w"], t["l"]))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is at most, threshold) hold; `at most` False means above."""

    tests: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, low, t in self.tests:
            out &= (x[:, f] <= t) == low
        return out

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for f, low, t in self.tests:
            c = stats[STATS[f]]
            out = out & (c <= F.lit(t) if low else c > F.lit(t))
        return out


@dataclass
class Ensemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r, w in self.rules:
            z += w * r.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: Column) -> Column:
        z = F.lit(self.intercept)
        for r, w in self.rules:
            z = z + F.when(r.column(stats), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _tree_rules(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, least: int):
    """Grows one regression tree on gradients; returns its step for each row and its paths."""
    step, paths = np.zeros(len(x)), []

    def grow(rows: np.ndarray, tests: tuple) -> None:
        if tests:
            paths.append(Rule(tests))
        best = (1e-6, None)
        if len(tests) < depth and len(rows) >= 2 * least:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for f, ts in enumerate(cuts):
                at = np.searchsorted(ts, x[rows, f])  # x <= ts[k] is at <= k
                n = np.cumsum(np.bincount(at, minlength=len(ts) + 1))[:-1]
                a, b = (np.cumsum(np.bincount(at, v[rows], len(ts) + 1))[:-1] for v in (g, h))
                gain = a * a / (b + 1) + (total_g - a) ** 2 / (total_h - b + 1) - total_g**2 / (total_h + 1)
                gain[(n < least) | (len(rows) - n < least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (f, float(ts[gain.argmax()])))
        if best[1] is None:
            step[rows] = -g[rows].sum() / (h[rows].sum() + 1)
            return
        f, t = best[1]
        low = x[rows, f] <= t
        grow(rows[low], (*tests, (f, True, t)))
        grow(rows[~low], (*tests, (f, False, t)))

    grow(np.arange(len(x)), ())
    return step, paths


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, penalty: float = 0.0005, rounds: int = 400) -> Ensemble:
    if not len(y):
        return Ensemble(0.0, [])
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    if y.min() == y.max():
        return Ensemble(float(np.log(base / (1 - base))), [])
    cuts = [(q[1:] + q[:-1]) / 2 for f in range(x.shape[1]) for q in [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)))]]
    z, rules = np.full(len(y), np.log(base / (1 - base))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        step, paths = _tree_rules(x, p - y, p * (1 - p), cuts, depth, max(5, len(y) // 100))
        z += rate * step
        rules |= dict.fromkeys(paths)
    held = {r: r.holds(x) for r in rules}
    rules = list({v.tobytes(): r for r, v in reversed(held.items()) if 0 < v.mean() < 1}.values())  # one of those that hold alike
    if not rules:
        return Ensemble(float(np.log(base / (1 - base))), [])
    m = np.stack([held[r] for r in rules], 1).astype(np.float64)
    mean = m.mean(0)
    m = m - mean  # not scaled: the penalty then weighs on rules that few rows decide
    # accelerated proximal gradient; the intercept is not penalised
    size = len(y)
    v = np.ones(m.shape[1])
    for _ in range(20):
        v = m.T @ (m @ v)
        v /= np.linalg.norm(v)
    lip = 0.25 * float(np.linalg.norm(m.T @ (m @ v))) / size * 1.05 + 0.25
    w = u = np.zeros(m.shape[1])
    b = c = float(np.log(base / (1 - base)))
    t = 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(m @ u + c))) - y
        new = u - m.T @ r / size / lip
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / lip, 0)
        nb, nt = c - r.mean() / lip, (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    kept = np.flatnonzero(np.abs(w) > 1e-9)
    return Ensemble(float(b - (w[kept] * mean[kept]).sum()), [(rules[k], float(w[k])) for k in kept])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Ensemble:
    """Fits on at most max_rows labelled rows that are not held out, or twice as many where ids repeat in docs."""
    some = (
        labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id", "_y")
        .limit(max_rows)
    )
    # at most max_rows ids and labels, so their broadcast is bounded
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "_id")
    got = rows.select("_id", "_y", stats_of(text_of()).alias("s")).select("_id", "_y", "s.*")
    # ids that repeat in docs make more rows: of these the first by id hash and statistics, twice max_rows at most
    got = got.orderBy(F.xxhash64("_id"), "_id", *STATS, "_y").limit(2 * max_rows).drop("_id").toPandas()
    got = got.sort_values([*STATS, "_y"], kind="stable")
    return fit_rules(got[list(STATS)].to_numpy(np.float64), got["_y"].to_numpy(np.float64))


def classify(docs: DataFrame, model: Ensemble, text_col: str = "text") -> DataFrame:
    """docs with `_score`."""
    return docs.withColumn("_score", let(stats_of(text_of(text_col)), model.column))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    return classify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
