"""Quality: a sparse ensemble of rules, scored by compiled Spark column expressions.

``STATISTICS`` are plain column expressions over the whole text. Small regression trees are
boosted on them over a bounded sample; every path from a root is a rule, the conjunction of
its conditions. A logistic model with an L1 penalty gives most rules the weight zero; the
others, with their conditions, become one Spark column, so scoring runs no Python at all.

Null texts count as empty, and statistics that have no denominator are 0, so every row has a
score. Without labelled rows of both kinds the score is 1 for all (nothing speaks against
them).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.toxicity import sample

PREFIX = "_q_"


def statistics(docs: DataFrame, text: str = "text", prefix: str = PREFIX) -> DataFrame:
    """``docs`` with the numbers that rules look at, all DOUBLE and none null, in columns that
    start with ``prefix``."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn(prefix + "text", t).withColumn(prefix + "words", F.filter(F.split(F.translate(t, "\n\t\r", "   "), " "), lambda w: w != ""))
    c = lambda name: F.col(prefix + name)
    n = F.greatest(F.length(c("text")), F.lit(1)).cast("double")
    words = F.greatest(F.size(c("words")), F.lit(1)).cast("double")
    without = lambda pattern: F.length(F.regexp_replace(c("text"), pattern, ""))
    chars = F.length(c("text"))
    lines = F.filter(F.split(c("text"), "\n"), lambda x: x != "")
    rows = rows.withColumn(prefix + "distinct", F.array_distinct(c("words"))).withColumn(prefix + "lines", lines)
    line_count = F.greatest(F.size(c("lines")), F.lit(1)).cast("double")
    # a word's successor being itself is what a run of repeats is made of
    repeats = F.size(F.filter(F.zip_with(F.slice(c("words"), 2, 1 << 30), c("words"), lambda a, b: a == b), lambda same: same))
    found = {
        "chars": n,
        "word_count": words,
        "word_length": chars / words,
        "distinct_words": F.size(c("distinct")) / words,
        "repeats": repeats / words,
        "letters": 1 - without(r"[\p{L}]+") / n,
        "capitals": 1 - without(r"[\p{Lu}]+") / n,
        "digits": 1 - without(r"[0-9]+") / n,
        "marks": 1 - without(r"[^\p{L}\p{N}\s]+") / n,
        "odd_marks": 1 - without(r"[^\p{L}\p{N}\s.,;:!?'\"()\-]+") / n,
        "stops": 1 - without(r"[.!?]+") / n,
        "commas": (chars - F.length(F.replace(c("text"), F.lit(","), F.lit("")))) / words,
        "bars": (chars - F.length(F.replace(c("text"), F.lit("|"), F.lit("")))) / words,
        "shouts": (chars - F.length(F.replace(c("text"), F.lit("!"), F.lit("")))) / words,
        "lines": line_count,
        "line_length": chars / line_count,
        "distinct_lines": F.size(F.array_distinct(c("lines"))) / line_count,
    }
    return rows.select(*[F.col(f"`{x}`") for x in docs.columns], *[v.cast("double").alias(prefix + k) for k, v in found.items()])


def names(rows: DataFrame, prefix: str = PREFIX) -> list[str]:
    return [c for c in rows.columns if c.startswith(prefix)]


Condition = tuple[int, bool, float]  # statistic, above, threshold


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rules: set, step: np.ndarray, least: int, rng: np.random.Generator) -> None:
    """Grows one tree on gradients, adds its paths to ``rules`` and its leaves to ``step``."""
    best = None
    if depth and len(rows) >= 2 * least:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for k in rng.permutation(x.shape[1])[: max(3, x.shape[1] // 2)].tolist():
            order = rows[np.argsort(x[rows, k], kind="stable")]
            v, sg, sh = x[order, k], np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.arange(least - 1, len(rows) - least)
            cut = cut[v[cut] < v[cut + 1]]
            if len(cut):
                gain = sg[cut] ** 2 / (sh[cut] + 1) + (total_g - sg[cut]) ** 2 / (total_h - sh[cut] + 1) - total_g**2 / (total_h + 1)
                i = int(gain.argmax())
                if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
                    best = (gain[i], k, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    if best is None:
        step[rows] = -g[rows].sum() / (h[rows].sum() + 1)
        return
    _, k, at = best
    above = x[rows, k] > at
    for side in (False, True):
        longer = (*path, (k, side, at))
        rules.add(longer)
        _tree(x, g, h, rows[above == side], depth - 1, longer, rules, step, least, rng)


def _holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    return np.logical_and.reduce([(x[:, k] > at) == above for k, above, at in rule])


@dataclass
class Rules:
    statistics: list[str]
    rules: list[tuple[tuple[Condition, ...], float]]
    bias: float

    def column(self, prefix: str = "") -> Column:
        """The score (0 to 1) as an expression over ``statistics``, their names after ``prefix``."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = reduce(Column.__and__, [F.col(prefix + self.statistics[k]) > at if above else F.col(prefix + self.statistics[k]) <= at for k, above, at in rule])
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def train(x: np.ndarray, labels: np.ndarray, columns: list[str], seed: int = 11, trees: int = 60, depth: int = 3, penalty: float = 0.004, steps: int = 400) -> Rules:
    """Rules from trees boosted on (x, labels), weighted by lasso logistic regression: all
    distinct ones are offered, and its penalty chooses."""
    y = labels.astype(np.float64)
    if len(np.unique(y)) < 2:
        return Rules(columns, [], 30.0)
    rng, margin, rules = np.random.default_rng(seed), np.zeros(len(y)), set()
    # the rarer label weighs as much as the other one up to a factor of four
    odds = min(4.0, max(0.25, (y == 1).sum() / (y == 0).sum()))
    w = np.where(y == 0, np.sqrt(odds), 1 / np.sqrt(odds))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step, rows = np.zeros(len(y)), np.flatnonzero(rng.random(len(y)) < 0.7)
        own: set = set()
        _tree(x, w * (p - y), w * p * (1 - p), rows, depth, (), own, step, max(3, len(y) // 200), rng)
        rules |= own
        margin += 0.2 * step
    kept, seen = [], set()
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        holds = _holds(x, rule)
        mark = np.packbits(holds).tobytes()
        if 0 < holds.sum() < len(y) and mark not in seen:
            seen.add(mark)
            kept.append((rule, holds))
    z = np.stack([h for _, h in kept], axis=1).astype(np.float64) if kept else np.zeros((len(y), 0))
    # accelerated proximal gradient; the bias has no penalty
    full, weights = np.hstack([z, np.ones((len(y), 1))]), w / w.sum()
    size = 4 / max(np.linalg.norm(full * np.sqrt(weights)[:, None], 2) ** 2, 1e-9)
    beta = ahead = np.zeros(full.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(full @ ahead)))
        new = ahead - size * (full.T @ (weights * (p - y)))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - size * penalty, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, beta = new + (last - 1) / t * (new - beta), new
    return Rules(columns, [(rule, float(b)) for (rule, _), b in zip(kept, beta[:-1]) if b], float(beta[-1]))


def fit(docs: DataFrame, labels: DataFrame, accept, label: str = "quality", most: tuple[int, int] = (6000, 9000)) -> Rules:
    """Trains on the driver on the statistics of a bounded sample of labelled rows: ``most`` of
    labels 0 and 1. Statistics are those of whole texts; no text reaches the driver."""
    rows = statistics(sample(docs, labels, label, accept, most))
    columns = names(rows)
    got = rows.select("doc_id", "label", *columns).toPandas().sort_values(["doc_id", "label", *columns])
    return train(got[columns].to_numpy(np.float64), got["label"].to_numpy(), [c.removeprefix(PREFIX) for c in columns])


def score(docs: DataFrame, rules: Rules, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score as ``name``; a column of that name is replaced, others may have
    any names and stay. Repeated rows have equal scores."""
    docs, prefix = docs.drop(name), PREFIX
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    rows = statistics(docs, text, prefix)
    return rows.withColumn(name, rules.column(prefix)).drop(*names(rows, prefix))
