"""Linear text models over n-gram features, their calibration and cross-fitting.

Feature tables are long (id, gram, w) and stay in Spark; a fit gathers a bounded
labelled sample per fold or candidate and runs in one grouped task, so that
folds and candidates are fitted side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.tables import stage


def nb_log_ratio(counts: DataFrame, labels: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """(gram, ratio): log of the smoothed shares of a gram among texts of label 1 and of label 0."""
    n = labels.agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"))
    held = counts.select("id", "gram").join(labels, "id").groupBy("gram").agg(F.count_if(F.col("label") == 1).alias("c1"), F.count_if(F.col("label") == 0).alias("c0"))
    p = (F.col("c1") + smoothing) / (F.col("n1") + 2 * smoothing)
    q = (F.col("c0") + smoothing) / (F.col("n0") + 2 * smoothing)
    return held.crossJoin(F.broadcast(n)).select("gram", F.ln(p / q).alias("ratio"))


def linear_score(weights: DataFrame, model: DataFrame, bias: float = 0.0) -> DataFrame:
    """(id, margin): the sum of feature times weight; ids without any known feature get the bias alone."""
    hit = weights.select("id", "gram", "w").join(model.select("gram", F.col("weight")), "gram", "left")
    return hit.groupBy("id").agg((F.coalesce(F.sum(F.col("w") * F.col("weight")), F.lit(0.0)) + bias).alias("margin"))


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 30, balanced: bool = True) -> np.ndarray:
    """Logistic regression with an L2 penalty, by Newton steps; the bias (last) is not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    cost = np.where(y == 1, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (len(y) - y.sum()))) if balanced else np.ones(len(y))
    ridge = np.diag(np.append(np.full(x.shape[1] - 1, 1 / c), 1e-9))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (cost * (p - y)) + ridge @ w
        step = np.linalg.solve((x * (cost * p * (1 - p))[:, None]).T @ x + ridge, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_squared_hinge(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 50) -> np.ndarray:
    """A linear SVM with squared hinge loss and balanced costs, by Newton steps on the active rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    sign = 2.0 * y - 1
    cost = c * np.where(y == 1, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (len(y) - y.sum())))
    w, loss = np.zeros(x.shape[1]), lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - sign * (x @ v)) ** 2).sum()
    for _ in range(rounds):
        gap = np.maximum(0, 1 - sign * (x @ w))
        on = gap > 0
        grad = w - 2 * x[on].T @ (cost[on] * sign[on] * gap[on])
        if np.abs(grad).max() < 1e-8:
            break
        step = np.linalg.solve(np.eye(len(w)) + 2 * (x[on] * cost[on][:, None]).T @ x[on], grad)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
    return w


def platt(margins: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept that minimise the log loss of sigmoid(a * margin + b), without a penalty."""
    rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
    v = np.array([1.0, np.log(rate / (1 - rate))])
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    loss = lambda u: np.mean(np.logaddexp(0, x @ u) - y * (x @ u))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -709, 709)))
        grad = x.T @ (p - y) / len(y)
        if np.abs(grad).max() < 1e-10:
            break
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + 1e-12 * np.eye(2), grad)
        size = 1.0
        while loss(v - size * step) > loss(v) and size > 1e-8:
            size /= 2
        v = v - size * step
    return float(v[0]), float(v[1])


def orient(margin, positive: object, classes: tuple):
    """A margin that grows toward the positive one of two classes; solvers grow it toward the second."""
    if positive not in classes or len(classes) != 2:
        raise ValueError("the positive class must be one of two")
    return margin if classes[1] == positive else -margin


TRAINERS = {"logistic": fit_logistic, "svm": fit_squared_hinge}


def calibrated(x: np.ndarray, y: np.ndarray, fold: np.ndarray, kind: str, c: float) -> tuple[np.ndarray, float, float]:
    """Weights fitted on all rows, and a sigmoid fitted on margins that each row got from the other folds' models."""
    apart = np.zeros(len(y))
    for f in np.unique(fold):
        w = TRAINERS[kind](x[fold != f], y[fold != f], c)
        apart[fold == f] = x[fold == f] @ w[:-1] + w[-1]
    return TRAINERS[kind](x, y, c), *platt(apart, y)


def _dealt(rows: DataFrame, features: str, label: str, fold: str, folds: int) -> DataFrame:
    """Each row for every fold's fit, its own among them."""
    own = rows.select("id", F.col(features).alias("x"), F.col(label).cast("int").alias("label"), F.col(fold).cast("int").alias("fold"))
    return own.withColumn("fit_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))


def _parts(part: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    return part["fit_fold"].iloc[0], np.stack(part["x"].to_numpy()), part["label"].to_numpy(float), part["fold"].to_numpy()


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -709, 709)))


def _judged(part: pd.DataFrame, x, y, f, own: int, kind: str, c: float) -> pd.DataFrame:
    w, a, b = calibrated(x[f != own], y[f != own], f[f != own], kind, c)
    m = x[f == own] @ w[:-1] + w[-1]
    out = part[f == own]
    return pd.DataFrame({"id": out["id"], "label": out["label"], "fold": out["fold"], "margin": m, "p": _sigmoid(a * m + b)})


def cross_fit(rows: DataFrame, features: str = "x", label: str = "label", fold: str = "fold", kind: str = "logistic", c: float = 1.0, folds: int = 5) -> DataFrame:
    """(id, label, fold, margin, p): each row scored by a model that its fold had no part in.

    ``rows``: id, a feature array, a 0/1 label and a fold; a bounded labelled
    sample, with whole components in a fold. Each row goes to the fits of all
    other folds and to its own fold's scoring, so that the folds are grouped tasks
    that run side by side. The sigmoid is fitted on margins of rows that the model
    behind them did not see. A fold without rows gives none.
    """

    def one(part: pd.DataFrame) -> pd.DataFrame:
        own, x, y, f = _parts(part)
        return _judged(part, x, y, f, own, kind, c)

    return _dealt(rows, features, label, fold, folds).groupBy("fit_fold").applyInPandas(one, "id bigint, label int, fold int, margin double, p double")


def _cut(x: np.ndarray, dims: int) -> np.ndarray:
    """The first dimensions of each row, of length one again."""
    x = x[:, :dims]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def candidate_grid(spark, **axes: list) -> DataFrame:
    """All combinations of the axes' values, numbered in the order in which the axes are named."""
    out = None
    for name, values in axes.items():
        table = spark.createDataFrame([(k, v) for k, v in enumerate(values)], [f"__{name}", name])
        out = table if out is None else out.crossJoin(table)  # a few rows each
    place = F.lit(0)
    for name, values in axes.items():
        place = place * len(values) + F.col(f"__{name}")
    return out.withColumn("candidate", place.cast("int")).select("candidate", *axes)


def nested_search(rows: DataFrame, candidates: list[tuple[str, float, int]], anchor: int = 0, folds: int = 5, features: str = "x", label: str = "label", fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Chooses a candidate (kind, c, dimensions) in each outer fold by the other folds alone, and scores the fold with it.

    Within an outer fold's training side every candidate is cross-fitted. Safety
    comes first: one that calls a larger share of negatives positive than the
    anchor is out; of the rest the lowest log loss wins, then the place in the
    list. The anchor is always safe, so it is what is fallen back on. Returns the
    choices (fold, candidate, false_positive_rate, log_loss) and the scored rows
    (id, label, fold, candidate, margin, p).

    An outer fold and a candidate make a grouped task over the bounded sample.
    """
    table = [(k, *c) for k, c in enumerate(candidates)]

    def inner(part: pd.DataFrame) -> pd.DataFrame:
        own, x, y, f = _parts(part)
        _, kind, c, dims = table[part["candidate"].iloc[0]]
        x, y, f = _cut(x, dims)[f != own], y[f != own], f[f != own]
        p = np.zeros(len(y))
        for k in np.unique(f):
            w, a, b = calibrated(x[f != k], y[f != k], f[f != k], kind, c)
            p[f == k] = _sigmoid(a * (x[f == k] @ w[:-1] + w[-1]) + b)
        e = np.clip(p, 1e-15, 1 - 1e-15)
        loss = float(np.mean(-(y * np.log(e) + (1 - y) * np.log(1 - e))))
        return pd.DataFrame([(own, table[part["candidate"].iloc[0]][0], float((p[y == 0] >= 0.5).mean()) if (y == 0).any() else 0.0, loss)], columns=["fold", "candidate", "false_positive_rate", "log_loss"])

    dealt = _dealt(rows, features, label, fold, folds)
    tried = dealt.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(len(table) - 1))))
    scores = stage(tried.groupBy("fit_fold", "candidate").applyInPandas(inner, "fold int, candidate int, false_positive_rate double, log_loss double"), "candidate-scores")
    limit = scores.filter(F.col("candidate") == anchor).select("fold", (F.col("false_positive_rate") + 1e-15).alias("__limit"))
    best = scores.join(limit, "fold").filter("false_positive_rate <= __limit").groupBy("fold").agg(F.min_by(F.struct("candidate", "false_positive_rate", "log_loss"), F.struct("log_loss", "candidate")).alias("b"))
    best = stage(best.select("fold", "b.*"), "candidate-choices")

    def outer(part: pd.DataFrame) -> pd.DataFrame:
        own, x, y, f = _parts(part)
        at = int(part["candidate"].iloc[0])
        _, kind, c, dims = table[at]
        return _judged(part, _cut(x, dims), y, f, own, kind, c).assign(candidate=at)[["id", "label", "fold", "candidate", "margin", "p"]]

    chosen = dealt.join(best.select(F.col("fold").alias("fit_fold"), "candidate"), "fit_fold")
    return best, chosen.groupBy("fit_fold").applyInPandas(outer, "id bigint, label int, fold int, candidate int, margin double, p double")


def nested_fusion(rows: DataFrame, weights: list[float], first: str = "pa", second: str = "pb", label: str = "label", fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Blends two models' out-of-fold probabilities with a weight that each fold takes from the other folds alone.

    The weight of the second model is safe if the blend calls no larger share of
    negatives positive than the first model does; the lowest log loss wins, then
    the smaller weight. Weight 0 must be among them. The sums of each fold and
    weight are made once; a fold's outside is the total without its own. Returns
    the choices (fold, weight, false_positive, log_loss) and the rows with ``weight`` and ``p``.
    """
    table = rows.sparkSession.createDataFrame([(float(w),) for w in weights], "weight double")
    blended = rows.crossJoin(F.broadcast(table)).withColumn("p", _blend(F.col(first), F.col(second), F.col("weight")))
    e = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-15)), F.lit(1e-15))
    negative = F.col(label) == 0
    sums = blended.groupBy(F.col(fold).alias("fold"), "weight").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(negative & (F.col("p") >= 0.5)).alias("fp"), F.count_if(negative & (F.col(first) >= 0.5)).alias("fp_first"), F.sum(-F.when(negative, F.ln(1 - e)).otherwise(F.ln(e))).alias("loss")
    )
    sums = stage(sums, "fusion-sums")
    total = sums.groupBy("weight").agg(*[F.sum(c).alias(f"__{c}") for c in ("n", "fp", "fp_first", "loss")])
    outside = sums.join(F.broadcast(total), "weight").select("fold", "weight", *[(F.col(f"__{c}") - F.col(c)).alias(c) for c in ("n", "fp", "fp_first", "loss")])
    safe = outside.filter("fp <= fp_first").withColumn("log_loss", F.col("loss") / F.col("n"))
    order = F.struct(F.round("log_loss", 12).alias("l"), "weight")
    best = safe.groupBy("fold").agg(F.min_by(F.struct("weight", F.col("fp").alias("false_positive"), "log_loss"), order).alias("b")).select("fold", "b.*")
    best = stage(best, "fusion-choices")
    scored = rows.join(F.broadcast(best.select(F.col("fold").alias(fold), "weight")), fold)  # a row per fold
    return best, scored.withColumn("p", _blend(F.col(first), F.col(second), F.col("weight")))


def _blend(a: Column, b: Column, weight: Column) -> Column:
    logit = lambda p: F.ln(F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6)) / (1 - F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))))
    return F.when(weight == 0, a).otherwise(1 / (1 + F.exp(-((1 - weight) * logit(a) + weight * logit(b)))))


def search(rows: DataFrame, grid: list[tuple[str, float]], folds: int = 5, **columns) -> DataFrame:
    """One row per (kind, c): errors, log loss and complexity of its cross-fitted scores, the best first.

    Safety comes first: the fewest negatives called positive, then the log loss, then the simpler model.
    """
    out = None
    for kind, c in grid:
        scored = cross_fit(rows, kind=kind, c=c, folds=folds, **columns)
        e = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-15)), F.lit(1e-15))
        line = scored.agg(
            F.lit(kind).alias("kind"), F.lit(c).alias("c"), F.count_if((F.col("label") == 0) & (F.col("p") >= 0.5)).alias("false_positive"),
            F.avg(-F.when(F.col("label") == 1, F.ln(e)).otherwise(F.ln(1 - e))).alias("log_loss"),
        )
        out = line if out is None else out.unionByName(line)
    return out.orderBy("false_positive", "log_loss", "c", "kind")
