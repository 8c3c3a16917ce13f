"""A quality classifier: a sparse ensemble of rules over text statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuestream.llm.common import held_out, table

#: The ensemble is fitted on about so many labelled rows at most.
FIT_ROWS = 20_000
TREES, DEPTH, LEAST_ROWS = 40, 3, 10
#: The weight of the lasso, and the steps of its fit.
LASSO, STEPS = 2e-3, 600
THRESHOLD = 0.3

#: A rule is a conjunction of (statistic, at most?, cut); if not at most, then above.
Rule = tuple[tuple[str, bool, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, 0 where they are not defined; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    chars, words, lines = F.length(text), F.split(text, " "), F.split(text, "\n")
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / F.greatest(chars, F.lit(1))
    return {
        "chars": chars.cast("double"),
        "word_chars": chars / F.size(words),
        "upper": share(r"\p{Lu}"),
        "digits": share("[0-9]"),
        "stops": share("[.,;:?]"),
        "symbols": share(r"[^\p{L}\p{N}\s.,;:?'-]"),
        "spaces": share(r"\s"),
        "new_words": F.size(F.array_distinct(words)) / F.size(words),
        "new_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_words": F.size(words) / F.size(lines),
    }


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self, stats: dict[str, Column]) -> Column:
        """The ensemble as one column expression."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, at_most, cut in rule:
                holds = holds & ((stats[name] <= cut) if at_most else (stats[name] > cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _split(x: np.ndarray, y: np.ndarray) -> tuple[float, int, float] | None:
    """The cut that lessens the squared error most: gain, statistic, cut."""
    best = None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        value, target = x[order, j], y[order]
        left = np.cumsum(target)[:-1]
        n = np.arange(1, len(y))
        gain = left**2 / n + (target.sum() - left) ** 2 / (len(y) - n)
        gain[(value[1:] == value[:-1]) | (n < LEAST_ROWS) | (len(y) - n < LEAST_ROWS)] = -np.inf
        k = int(np.argmax(gain)) if len(gain) else 0
        if len(gain) and np.isfinite(gain[k]) and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), j, float((value[k] + value[k + 1]) / 2))
    return best


def _paths(x: np.ndarray, y: np.ndarray, names: list[str], rule: Rule = (), depth: int = DEPTH) -> list[tuple[Rule, float]]:
    """Every node of a regression tree as (rule, mean); leaves last among their kin."""
    found = [(rule, float(y.mean()))]
    cut = _split(x, y) if depth and len(y) >= 2 * LEAST_ROWS and y.std() > 1e-9 else None
    if cut:
        _, j, at = cut
        low = x[:, j] <= at
        found += _paths(x[low], y[low], names, (*rule, (names[j], True, at)), depth - 1)
        found += _paths(x[~low], y[~low], names, (*rule, (names[j], False, at)), depth - 1)
    return found


def _holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, at_most, cut in rule:
        column = x[:, names.index(name)]
        out &= (column <= cut) if at_most else (column > cut)
    return out


def fit(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 7) -> Ensemble:
    """Boosted trees on half samples give rules; a lasso logistic fit weighs them.

    Without labels every score is 0.5, with labels of one kind it is near that kind."""
    if not len(y):
        return Ensemble(0.0, [])
    rate = float(np.clip(y.mean(), 0.01, 0.99))
    bias = float(np.log(rate / (1 - rate)))
    rng, rules, margin = np.random.default_rng(seed), {}, np.full(len(y), bias)
    for _ in range(TREES):
        rows = rng.random(len(y)) < 0.5
        if rows.sum() < 2 * LEAST_ROWS:
            break
        residual = y - 1 / (1 + np.exp(-margin))
        paths = _paths(x[rows], residual[rows], names)
        for rule, mean in paths:
            if rule:
                rules.setdefault(rule, None)
        leaves = [p for p in paths if not any(q[0][: len(p[0])] == p[0] and q is not p for q in paths)]
        for rule, mean in leaves:
            margin[_holds(rule, x, names)] += mean
    # Rules that hold on the same rows are one; the first, from an earlier tree, stays.
    distinct = {}
    for rule in rules:
        distinct.setdefault(np.packbits(_holds(rule, x, names)).tobytes(), rule)
    kept = list(distinct.values())
    del distinct
    if not kept:
        return Ensemble(bias, [])
    r = np.zeros((len(y), len(kept)), np.float32)
    for k, rule in enumerate(kept):
        r[:, k] = _holds(rule, x, names)
    weights, ahead, momentum = np.zeros(len(kept), np.float32), np.zeros(len(kept), np.float32), 1.0
    bias_ahead = bias
    # The step is one over a bound of the curvature: the greatest eigenvalue, by power iteration, of the rules and
    # the bias.
    v, v_bias = np.ones(len(kept), np.float32), 1.0
    for _ in range(30):
        out = r @ v + v_bias
        v, v_bias = r.T @ out, float(out.sum())
        norm = float(np.sqrt(v @ v + v_bias**2))
        v, v_bias = v / norm, v_bias / norm
    step = 4 * len(y) / float(np.linalg.norm(r @ v + v_bias) ** 2) * 0.95
    for _ in range(STEPS):
        error = (1 / (1 + np.exp(-np.clip(r @ ahead + bias_ahead, -50, 50))) - y).astype(np.float32)
        moved = ahead - step * (r.T @ error) / len(y)
        new = (np.sign(moved) * np.maximum(np.abs(moved) - step * LASSO, 0)).astype(np.float32)
        new_bias = bias_ahead - step * float(error.mean())
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, bias_ahead = (new + (momentum - 1) / grown * (new - weights)).astype(np.float32), new_bias + (momentum - 1) / grown * (new_bias - bias)
        weights, bias, momentum = new, new_bias, grown
    return Ensemble(bias, [(rule, float(w)) for rule, w in zip(kept, weights, strict=True) if w])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Ensemble:
    """Fit on a bounded sample of labelled documents, drawn by a hash of doc_id: at most about
    fit_rows of them are sent to the documents, and their statistics (no texts) to the driver."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(max(n, 1))) < fit_rows)
    stats = statistics(F.col("text"))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", *[c.alias(k) for k, c in stats.items()])
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("quality", *stats)).alias("row")).select("row.*", "doc_id").orderBy("doc_id").toPandas()
    return fit(rows[list(stats)].to_numpy(float), rows["quality"].to_numpy(float), list(stats))


def scored(docs: DataFrame, model: Ensemble, text_col: str = "text", threshold: float = THRESHOLD, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with two more columns: score (0 to 1) and predicted (1 if score >= threshold).

    A null text is scored as an empty one; every text gets a score. Repeated rows score alike. An empty
    table gives an empty result. Columns of docs that clash with the new names are replaced.

    A number of the row, which no filter may be pushed below, stands beside the statistics: a filter on the score
    would else compute them anew for every condition of every rule.
    """
    stats = statistics(F.col(text_col))
    kept = [c for c in docs.columns if c not in (score, predicted)]
    named = docs.select(*kept, *[c.alias(f"__{k}") for k, c in stats.items()], F.monotonically_increasing_id().alias("__row"))
    rated = F.when(F.col("__row") >= 0, model.score({k: F.col(f"__{k}") for k in stats})).otherwise(F.lit(0.0))
    out = named.withColumn(score, rated).drop("__row", *[f"__{k}" for k in stats])
    return out.withColumn(predicted, (F.col(score) >= threshold).cast("int"))


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)))
    return scored(docs.select("doc_id", "text"), model).select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_rule_ensemble": op10_rule_ensemble}
ORACLES: dict[str, str] = {}
