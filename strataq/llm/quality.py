"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark column expressions.

Small boosted trees over the statistics of a bounded labelled sample give paths from the root; each path is a conjunctive
rule. A lasso logistic regression over the rules keeps few of them, and what is kept becomes one Column per row: scoring is
a projection in the JVM, without a join, a shuffle or Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import nested, unnested

#: Bound of the labelled sample: the rows with the least hashes of their ids.
SAMPLE_ROWS = 8000
TREES, DEPTH, RATE, CUTS, LEAST_ROWS, SEED = 60, 3, 0.3, 24, 15, 7
#: Weights of the L1 penalty that are tried; the largest whose held-back loss is within a standard error of the best is taken.
PENALTIES = (0.02, 0.01, 0.005, 0.0025, 0.00125, 0.0006)
STEPS = 300

UPPER, DIGITS, SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*+<=>@^_~\\{}[]|"
FEATURES = ("log_words", "distinct_words", "word_length", "upper", "digits", "symbols", "exclaims", "bars", "stops", "commas", "distinct_lines", "line_words", "repeats", "longest_word", "letters")


def statistics(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """`keep` columns and the FEATURES (double, finite) of every whole text; a null text counts as the empty text."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(*keep, t.alias("_t"), F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "").alias("_w"), F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "").alias("_l"))
    out = out.withColumns({"_n": F.greatest(F.length("_t"), F.lit(1)), "_k": F.greatest(F.size("_w"), F.lit(1)), "_m": F.greatest(F.size("_l"), F.lit(1))})
    without = lambda chars: (F.length("_t") - F.length(F.translate("_t", chars, ""))).cast("double")
    count = lambda mark: (F.length("_t") - F.length(F.replace(F.col("_t"), F.lit(mark), F.lit("")))).cast("double")
    n, k, m = F.col("_n"), F.col("_k"), F.col("_m")
    exprs = {
        "log_words": F.log2(F.size("_w") + F.lit(1.0)),
        "distinct_words": F.size(F.array_distinct("_w")) / F.pow(k.cast("double"), F.lit(0.8)),
        "word_length": F.length("_t") / k,
        "upper": without(UPPER) / n,
        "digits": without(DIGITS) / n,
        "symbols": without(SYMBOLS) / n,
        "exclaims": count("!") / n,
        "bars": count("|") / n,
        "stops": count(".") / k,
        "commas": count(",") / k,
        "distinct_lines": F.size(F.array_distinct("_l")) / m,
        "line_words": F.log2(k / m + F.lit(1.0)),
        "repeats": F.regexp_count(F.col("_t"), F.lit(r"(?<![^ ])([^ ]+) \1(?![^ ])")) / k,
        "longest_word": F.log2(F.coalesce(F.array_max(F.transform("_w", F.length)), F.lit(0)) + F.lit(1.0)),
        "letters": without("aeiouAEIOU") / n,
    }
    return out.select(*(c for c in out.columns if c not in ("_t", "_w", "_l", "_n", "_k", "_m")), *(v.cast("double").alias(c) for c, v in exprs.items()))


@dataclass
class Rules:
    """rules: lists of (feature, is_at_most, threshold); weights: one for each; bias."""

    rules: list[list[tuple[str, bool, float]]]
    weights: list[float]
    bias: float

    def score(self) -> Column:
        """The probability of label 1 as a column over the statistics."""
        z = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = None
            for name, at_most, cut in rule:
                test = F.col(name) <= cut if at_most else F.col(name) > cut
                holds = test if holds is None else holds & test
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _paths(x: np.ndarray, residual: np.ndarray, hessian: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator, path: tuple, out: list, update: np.ndarray) -> None:
    """Grows one tree, collects the path to each of its nodes, and adds its leaves' values to `update`."""
    g, h = residual[rows], hessian[rows]
    best = (1e-6, None, None)
    if len(path) < DEPTH and len(rows) >= 2 * LEAST_ROWS:
        total = g.sum() ** 2 / (h.sum() + 1)
        for f in rng.choice(x.shape[1], size=max(2, x.shape[1] * 2 // 3), replace=False):
            v = x[rows, f]
            for c in cuts[f]:
                low = v <= c
                n = int(low.sum())
                if n < LEAST_ROWS or len(rows) - n < LEAST_ROWS:
                    continue
                gl, hl = g[low].sum(), h[low].sum()
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - total
                if gain > best[0]:
                    best = (gain, f, c)
    if best[1] is None:
        update[rows] += g.sum() / (h.sum() + 1)
        return
    _, f, c = best
    low = x[rows, f] <= c
    for side, at_most in ((rows[low], True), (rows[~low], False)):
        own = (*path, (int(f), at_most, float(c)))
        out.append(own)
        _paths(x, residual, hessian, side, cuts, rng, own, out, update)


def extract_rules(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Distinct root paths of TREES boosted trees, each grown on a random half of the rows."""
    rng = np.random.default_rng(SEED)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, CUTS))) for f in range(x.shape[1])]
    margin, found = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.permutation(len(y))[: max(1, len(y) // 2)])
        grown = len(found)
        update = np.zeros(len(y))
        _paths(x, y - p, p * (1 - p), rows, cuts, rng, (), found, update)
        margin[rows] += RATE * update[rows]
        if len(found) == grown:
            break
    return list(dict.fromkeys(found))


def _holds(x: np.ndarray, rules: list[tuple]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for f, at_most, c in rule:
            out[:, j] *= (x[:, f] <= c) == at_most
    return out


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on the mean logistic loss plus penalty * |w|_1."""
    step = 4.0 / (np.linalg.norm(a, 2) ** 2 / len(a) + 1)
    v, vb, t = w.copy(), bias, 1.0
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-(a @ v + vb))) - y
        new = v - step * (a.T @ r) / len(a)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_bias = vb - step * r.mean()
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / s * (new - w), new_bias + (t - 1) / s * (new_bias - bias)
        w, bias, t = new, new_bias, s
    return w, bias


def _loss(a: np.ndarray, y: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    z = a @ w + bias
    return np.logaddexp(0, z) - y * z


def train(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = FEATURES) -> Rules:
    """Rules for label 1. With no row, or labels of one kind only, there are no rules and the bias gives their share."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Rules([], [], float(np.log((share + 0.01) / (1.01 - share))))
    rules = extract_rules(x, y)
    a = _holds(x, rules)
    back = np.arange(len(y)) % 4 == 3
    bias0 = float(np.log(y.mean() / (1 - y.mean())))
    w, bias, tried = np.zeros(len(rules)), bias0, []
    for penalty in PENALTIES:
        w, bias = _lasso(a[~back], y[~back], penalty, w, bias)
        loss = _loss(a[back], y[back], w, bias)
        tried.append((penalty, loss.mean(), loss.std() / max(1, len(loss)) ** 0.5))
    best = min(tried, key=lambda t: t[1])
    penalty = next(t[0] for t in tried if t[1] <= best[1] + best[2] / 2)
    w, bias = np.zeros(len(rules)), bias0
    for p in (q for q in PENALTIES if q >= penalty):
        w, bias = _lasso(a, y, p, w, bias)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Rules([[(names[f], m, c) for f, m, c in rules[j]] for j in kept], [float(w[j]) for j in kept], float(bias))


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, text: str = "text", key: str = "doc_id", label: str = "quality") -> Rules:
    """Learns from at most SAMPLE_ROWS label rows for which train_rows (over the label table's key) holds.

    Label rows with a null key or a label other than 0 or 1 are left out; a key counts once for each of its labels, and of
    several rows of a key the one with the least statistics counts. The sample is the keys with the least hashes, so it is the
    same however the tables are cut; a threshold of the hash leaves some three times as many rows to choose from.
    """
    share = min(1.0, 3 * SAMPLE_ROWS / max(1, labels.count()))
    ids = labels.where(train_rows & F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_y"))
    ids = ids.where(F.xxhash64("_id") <= min(int(-(2**63) + share * (2**64 - 1)), 2**63 - 1)).distinct()
    ids = ids.orderBy(F.xxhash64("_id"), "_id", "_y").limit(SAMPLE_ROWS)
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(ids), "_id")
    found = statistics(rows, "_text", [F.col("_id").alias("id"), F.col("_y").alias("y")]).groupBy("id", "y").agg(F.min(F.struct(*FEATURES)).alias("x")).collect()
    found.sort(key=lambda r: (str(r["id"]), r["y"]))
    x = np.array([tuple(r["x"]) for r in found], float).reshape(len(found), len(FEATURES))
    order = np.random.default_rng(SEED).permutation(len(found))
    return train(x[order], np.array([r["y"] for r in found], float)[order])


def predict(docs: DataFrame, rules: Rules, keep: list[Column], text: str = "text") -> DataFrame:
    """`keep` columns, score (double, 0 to 1) and predicted (1 if score >= 0.5, else 0) for every row, empty texts too. A kept
    column called score or predicted is left out."""
    scored = statistics(docs, text, [nested(keep)]).select("_kept", rules.score().alias("score"))
    return unnested(scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), ["score", "predicted"])
