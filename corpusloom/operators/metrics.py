"""Evaluation of probabilities against labels: weighted metrics, bands, grids, gates and intervals.

``label`` is 1 for the class that the probability is of. Uncertain rows carry a
null label; each function says what they count as.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The bands of lengths and probabilities; the last probability band is closed.
LENGTH_BANDS = ((300, "0000-0299"), (600, "0300-0599"), (1200, "0600-1199"), (2400, "1200-2399"), (None, "2400+"))
PROBABILITY_BANDS = ((0.10, "0.00-0.10"), (0.25, "0.10-0.25"), (0.50, "0.25-0.50"), (0.75, "0.50-0.75"), (0.90, "0.75-0.90"), (None, "0.90-1.00"))


def band(value: Column, bands) -> Column:
    out = None
    for upper, name in bands[:-1]:
        out = (F.when if out is None else out.when)(value < upper, name)
    return out.otherwise(bands[-1][1])


def confusion(rows: DataFrame, p: str, label: str, at: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (of each group in ``by``): tp, fp, fn, tn, precision, recall, f1 (0 over nothing), accuracy, Brier score and log loss."""
    yes, y = F.col(p) >= at, F.col(label) == 1
    e = F.greatest(F.least(F.col(p), F.lit(1 - 1e-15)), F.lit(1e-15))
    sums = rows.groupBy(*by).agg(
        F.count_if(yes & y).alias("tp"), F.count_if(yes & ~y).alias("fp"), F.count_if(~yes & y).alias("fn"), F.count_if(~yes & ~y).alias("tn"),
        F.avg((F.col(p) - F.col(label)) * (F.col(p) - F.col(label))).alias("brier"), F.avg(-F.when(y, F.ln(e)).otherwise(F.ln(1 - e))).alias("log_loss"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + F.col("tn"), tp + fp + fn + F.col("tn"))})


def average_precision(rows: DataFrame, p: str, label: str, weight: str | None = None) -> DataFrame:
    """Step-wise average precision; rows of equal score count as one step.

    Scores are summed per distinct value first; running sums go over ranges of
    the score that are numbered by their leading digits, so that no window has
    to hold all values.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    step = rows.groupBy(F.col(p).alias("s")).agg(F.sum(w * F.col(label)).alias("tp"), F.sum(w).alias("n")).withColumn("b", F.floor(F.col("s") * 1024))
    outer = step.groupBy("b").agg(F.sum("tp").alias("btp"), F.sum("n").alias("bn"))
    higher = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)  # at most 1025 rows
    outer = outer.select("b", F.coalesce(F.sum("btp").over(higher), F.lit(0.0)).alias("otp"), F.coalesce(F.sum("bn").over(higher), F.lit(0.0)).alias("on"))
    within = Window.partitionBy("b").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = step.join(F.broadcast(outer), "b").select("tp", (F.sum("tp").over(within) + F.col("otp")).alias("hits"), (F.sum("n").over(within) + F.col("on")).alias("seen"))
    return run.agg(F.try_divide(F.sum(F.col("tp") * F.col("hits") / F.col("seen")), F.sum("tp")).alias("average_precision"))


def weighted_overall(rows: DataFrame, p: str, label: str, weight: str) -> DataFrame:
    """Weighted log loss, Brier score, accuracy and both directed error rates; uncertain rows are left out."""
    sure = rows.filter(F.col(label).isNotNull())
    w, y = F.col(weight), F.col(label) == 1
    e = F.greatest(F.least(F.col(p), F.lit(1 - 1e-15)), F.lit(1e-15))
    yes = F.col(p) >= 0.5
    hajek = lambda num, den=None: F.try_divide(F.sum(w * num), F.sum(w if den is None else w * den))
    one = lambda c: c.cast("double")
    return sure.agg(
        hajek(-F.when(y, F.ln(e)).otherwise(F.ln(1 - e))).alias("log_loss"),
        hajek((F.col(p) - F.col(label)) * (F.col(p) - F.col(label))).alias("brier"),
        hajek(one(yes == y)).alias("accuracy"),
        hajek(one(yes & ~y), one(~y)).alias("negative_error"),
        hajek(one(~yes & y), one(y)).alias("positive_error"),
        (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_n"),
    )


def coverage_threshold(rows: DataFrame, score: str, q: float) -> DataFrame:
    """The least value that the share q of scores does not exceed ("higher" quantile), by counts per value."""
    n = rows.count()
    at = math.ceil(q * (n - 1)) + 1
    value = rows.groupBy(F.col(score).alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("b", F.floor(F.col("v") * 1024))
    outer = value.groupBy("b").agg(F.sum("c").alias("c")).select("b", (F.sum("c").over(Window.orderBy("b")) - F.col("c")).alias("before"))
    run = value.join(F.broadcast(outer), "b").withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("b").orderBy("v")))
    return run.filter(F.col("upto") >= at).agg(F.min("v").alias("threshold"))


def threshold_histogram(rows: DataFrame, p: str, weight: Column, steps: int = 100) -> DataFrame:
    """Counts and weights per cell of the probability grid; what a grid of thresholds needs of the rows.

    Cell k holds p in (k-1, k] / steps, so a closed lower tail at k / steps is the
    sum of the cells up to k; ``on_edge`` is the part with p = k / steps, which a
    closed upper tail at k / steps takes too.
    """
    cell = F.ceil(F.round(F.col(p) * steps, 9)).cast("long")
    edge = F.round(F.col(p) * steps, 9) == cell
    label = F.col("label")
    out = {"n": F.lit(1.0), "w": weight, "w2": weight * weight, "yes": F.when(label == 1, weight), "no": F.when(label == 0, weight), "unsure": F.when(label.isNull(), weight)}
    out |= {f"n_{k}": F.when(label.eqNullSafe(v), F.lit(1.0)) for k, v in (("yes", 1), ("no", 0), ("unsure", None))}
    return rows.groupBy(cell.alias("cell")).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in out.items()], *[F.coalesce(F.sum(F.when(edge, c)), F.lit(0.0)).alias(n + "_edge") for n, c in out.items()])


def tails(histogram: DataFrame, steps: int = 100, last: int = 49, raw: bool = False) -> DataFrame:
    """Per threshold k / steps: counts, weights and the Hajek risk of both tails, uncertain rows as adverse.

    The low tail keeps rows; those labelled 1 are wrong there. The high tail
    excludes; those labelled 0 are wrong there. With ``raw`` the unweighted errors
    of both tails and the ``total`` of rows are added. The histogram has ``steps`` + 1
    rows at most, so the cross join is of two tiny tables.
    """
    grid = histogram.sparkSession.range(1, last + 1).select(F.col("id").alias("k"))
    met = grid.crossJoin(F.broadcast(histogram))
    low, high = F.col("cell") <= F.col("k"), F.col("cell") > steps - F.col("k")
    edge = F.col("cell") == steps - F.col("k")
    up = lambda c: F.when(high, F.col(c)).when(edge, F.col(c + "_edge")).otherwise(0.0)
    down = lambda c: F.when(low, F.col(c)).otherwise(0.0)
    sums = met.groupBy("k").agg(*[F.sum(f(c)).alias(f"{t}_{c}") for t, f in (("keep", down), ("exclude", up)) for c in ("n", "w", "w2", "yes", "no", "unsure", "n_yes", "n_no", "n_unsure")], F.sum("n").alias("total"))
    errors = {"keep_errors": F.col("keep_n_yes") + F.col("keep_n_unsure"), "exclude_errors": F.col("exclude_n_no") + F.col("exclude_n_unsure"), "total": F.col("total")}
    return sums.select(
        *([c.cast("long").alias(n) for n, c in errors.items()] if raw else []),
        (F.col("k") / steps).alias("t"),
        F.col("keep_n").cast("long").alias("keep_n"), F.try_divide(F.col("keep_yes") + F.col("keep_unsure"), F.col("keep_w")).alias("keep_risk"),
        F.try_divide(F.col("keep_w") * F.col("keep_w"), F.col("keep_w2")).alias("keep_ess"),
        F.col("exclude_n").cast("long").alias("exclude_n"), F.try_divide(F.col("exclude_no") + F.col("exclude_unsure"), F.col("exclude_w")).alias("exclude_risk"),
        F.try_divide(F.col("exclude_w") * F.col("exclude_w"), F.col("exclude_w2")).alias("exclude_ess"),
    )


def routing_grid(tail_rows: DataFrame, total: int, min_support: int = 30, max_keep: float = 0.05, max_exclude: float = 0.02) -> DataFrame:
    """Every pair of a keep threshold t and an exclude threshold 1 - u, with rates and gates."""
    keep = tail_rows.select(F.col("t").alias("t_keep"), "keep_n", "keep_risk")
    drop = tail_rows.select(F.bround(1 - F.col("t"), 2).alias("t_exclude"), "exclude_n", "exclude_risk")
    grid = keep.crossJoin(F.broadcast(drop)).withColumn("manual_rate", 1 - (F.col("keep_n") + F.col("exclude_n")) / F.lit(total))
    support = (F.col("keep_n") >= min_support) & (F.col("exclude_n") >= min_support)
    return grid.withColumn("passes", support & F.coalesce((F.col("keep_risk") <= max_keep) & (F.col("exclude_risk") <= max_exclude), F.lit(False)))


def pareto(points: DataFrame, *objectives: str) -> DataFrame:
    """Points that no other point beats: at least as low in all objectives and lower in one. For small grids."""
    other = points.select(*[F.col(o).alias("o_" + o) for o in objectives]).distinct()
    no_worse, better = F.lit(True), F.lit(False)
    for o in objectives:
        no_worse, better = no_worse & (F.col("o_" + o) <= F.col(o)), better | (F.col("o_" + o) < F.col(o))
    return points.join(other, no_worse & better, "left_anti")


def risk_coverage(rows: DataFrame, p: str, label: str, grid: DataFrame) -> DataFrame:
    """Coverage and errors when only rows with max(p, 1 - p) >= confidence are decided; by counts per grid cell."""
    near = F.greatest(F.col(p), 1 - F.col(p))
    wrong = (F.col(p) >= 0.5) != (F.col(label) == 1)
    cells = rows.select(F.floor(F.round(near * 100, 9)).cast("long").alias("cell"), wrong.alias("wrong"), F.col(p).alias("p")).groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("wrong").alias("errors"), F.count_if(F.col("wrong") & (F.col("p") >= 0.5)).alias("false_positive")
    )
    total = F.sum("n")
    covered = lambda c: F.coalesce(F.sum(F.when(F.col("cell") >= F.round(F.col("confidence") * 100, 9), F.col(c))), F.lit(0))
    out = grid.crossJoin(F.broadcast(cells)).groupBy("confidence").agg(covered("n").alias("covered"), covered("errors").alias("errors"), covered("false_positive").alias("false_positive"), total.alias("total"))
    return out.select("confidence", "covered", (F.col("covered") / F.col("total")).alias("coverage"), "errors", F.try_divide("errors", "covered").alias("risk"), "false_positive", (F.col("errors") - F.col("false_positive")).alias("false_negative"))


def error_bands(rows: DataFrame, band_col: Column, p: str, label: str, size: str) -> DataFrame:
    wrong = (F.col(p) >= 0.5) != (F.col(label) == 1)
    return rows.groupBy(band_col.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("errors"), (F.count_if(wrong) / F.count(F.lit(1))).alias("rate"), F.count_if(F.col(label) == 1).alias("positive"),
        F.min(size).alias("shortest"), F.percentile(size, 0.5).alias("median"), F.max(size).alias("longest"),
    )


# Intervals.


def _beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for k in range(0, 400):
        m = k // 2
        t = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + t * d) or tiny)
        c = (1 + t / c) or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def clopper_pearson(events: int, n: int, confidence: float = 0.95, side: str = "upper") -> float | None:
    """The exact one-sided bound of a rate; null over nothing."""
    if not n:
        return None
    if (side == "upper" and events >= n) or (side == "lower" and events <= 0):
        return 1.0 if side == "upper" else 0.0
    a, b, target = (events + 1, n - events, confidence) if side == "upper" else (events, n - events + 1, 1 - confidence)
    lo, hi = 0.0, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _beta_cdf(mid, a, b) < target else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson_columns(events: Column, n: Column, confidence: float = 0.95) -> Column:
    """Lower and upper two-sided bounds as a struct, for columns of counts."""
    each = 1 - (1 - confidence) / 2

    def bounds(e: pd.Series, m: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(clopper_pearson(int(x), int(y), each, "lower"), clopper_pearson(int(x), int(y), each)) for x, y in zip(e, m)], columns=["lower", "upper"])

    return F.pandas_udf(bounds, "lower double, upper double")(events, n)


def cluster_bootstrap(rows: DataFrame, component: str, numerator: Column, denominator: Column, replicates: int = 500, seed: int = 0, alpha: float = 0.1) -> DataFrame:
    """Percentile interval of a ratio when whole components are drawn again with replacement.

    Each component is summed once. In a replicate it gets a Poisson(1) weight
    from its hash, the limit of drawing as many components with replacement, so
    replicates need no shared draw and sums are combined before the shuffle.
    """
    sums = rows.groupBy(component).agg(F.sum(numerator).alias("a"), F.sum(denominator).alias("b"))
    drawn = sums.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("m", _poisson(seed, component))
    ratio = drawn.groupBy("r").agg(F.try_divide(F.sum(F.col("a") * F.col("m")), F.sum(F.col("b") * F.col("m"))).alias("x"))
    q = F.percentile("x", F.array(F.lit(alpha / 2), F.lit(0.5), F.lit(1 - alpha / 2)))
    return ratio.agg(q.alias("q"), F.count("x").alias("valid")).select(F.col("q")[0].alias("lower"), F.col("q")[1].alias("median"), F.col("q")[2].alias("upper"), "valid")


def paired_deltas(rows: DataFrame, base: str, candidate: str, label: str) -> DataFrame:
    """Candidate less baseline: log loss, Brier score, and the rate at which negatives come out positive."""
    y = F.col(label) == 1
    clip = lambda c: F.greatest(F.least(F.col(c), F.lit(1 - 1e-15)), F.lit(1e-15))
    loss = lambda c: -F.when(y, F.ln(clip(c))).otherwise(F.ln(1 - clip(c)))
    square = lambda c: (F.col(c) - F.col(label)) * (F.col(c) - F.col(label))
    wrong = lambda c: F.try_divide(F.count_if(~y & (F.col(c) >= 0.5)), F.count_if(~y))
    return rows.agg((F.avg(loss(candidate)) - F.avg(loss(base))).alias("d_log_loss"), (F.avg(square(candidate)) - F.avg(square(base))).alias("d_brier"), (wrong(candidate) - wrong(base)).alias("d_false_positive"))


def paired_bootstrap(rows: DataFrame, component: str, base: str, candidate: str, label: str, replicates: int = 500, seed: int = 0, alpha: float = 0.1) -> DataFrame:
    """Percentile intervals of the deltas of :func:`paired_deltas` when whole components are drawn again: metric, lower, median, upper, valid.

    Each component is summed once and weighted as in :func:`cluster_bootstrap`.
    A replicate without negatives has no error rate; with fewer than 95 % valid
    replicates a metric's interval is null.
    """
    y = F.col(label) == 1
    clip = lambda c: F.greatest(F.least(F.col(c), F.lit(1 - 1e-15)), F.lit(1e-15))
    loss = lambda c: -F.when(y, F.ln(clip(c))).otherwise(F.ln(1 - clip(c)))
    square = lambda c: (F.col(c) - F.col(label)) * (F.col(c) - F.col(label))
    wrong = lambda c: (~y & (F.col(c) >= 0.5)).cast("double")
    parts = {
        "d_log_loss": (loss(candidate) - loss(base), F.lit(1.0)), "d_brier": (square(candidate) - square(base), F.lit(1.0)),
        "d_false_positive": (wrong(candidate) - wrong(base), (~y).cast("double")),
    }
    sums = rows.groupBy(component).agg(*[F.sum(x).alias(f"{m}_{k}") for m, pair in parts.items() for k, x in enumerate(pair)])
    drawn = sums.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("m", _poisson(seed, component))
    ratio = lambda m: F.try_divide(F.sum(F.col(f"{m}_0") * F.col("m")), F.sum(F.col(f"{m}_1") * F.col("m")))
    each = drawn.groupBy("r").agg(*[ratio(m).alias(m) for m in parts])
    long = each.select(F.explode(F.create_map(*[x for m in parts for x in (F.lit(m), F.col(m))])).alias("metric", "x"))
    q = F.percentile("x", F.array(F.lit(alpha / 2), F.lit(0.5), F.lit(1 - alpha / 2)))
    out = long.groupBy("metric").agg(q.alias("q"), F.count("x").alias("valid"))
    enough = F.col("valid") >= 0.95 * replicates
    return out.select("metric", *[F.when(enough, F.col("q")[k]).alias(n) for k, n in enumerate(("lower", "median", "upper"))], "valid")


def _poisson(seed: int, component: str) -> Column:
    """A Poisson(1) weight of a component in replicate ``r``, from its hash."""
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]).tolist()
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("r"), F.col(component)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return sum(((u >= e).cast("int") for e in edges[1:]), (u >= edges[0]).cast("int"))


def strategy_points(population: DataFrame, sample: DataFrame, audit: DataFrame, limits: tuple[float, float] = (0.05, 0.02), support: int = 30, workload: float = 0.5) -> DataFrame:
    """Every pair of thresholds with what it does to the population, and what a weighted sample and an audit say of its risk.

    The arguments are rows of :func:`tails` with ``raw``. Each tail has, of
    sample and audit, its rows, raw errors and risk, weighted risk, effective
    size and the exact one-sided limit of the raw risk; ``limit`` is the larger
    one. A tail passes with enough support and its limit within ``limits``; a
    point passes if both tails do and the manual share is at most ``workload``.
    """
    sides = []
    for side, worst in zip(("keep", "exclude"), limits):
        table = population.select("t", F.col(f"{side}_n").alias(f"{side}_population"), *(["total"] if side == "keep" else []))
        for name, rows in (("sample", sample), ("audit", audit)):
            n, errors = F.col(f"{side}_n"), F.col(f"{side}_errors")
            told = {"n": n, "errors": errors, "raw_risk": F.try_divide(errors, n), "risk": F.col(f"{side}_risk"), "ess": F.col(f"{side}_ess"), "limit": _upper_limit(errors, n)}
            table = table.join(rows.select("t", *[c.alias(f"{side}_{name}_{k}") for k, c in told.items()]), "t")
        limit = F.greatest(f"{side}_sample_limit", f"{side}_audit_limit")
        fine = (F.col(f"{side}_sample_n") >= support) & F.coalesce(limit <= worst, F.lit(False))
        sides.append(table.withColumns({f"{side}_limit": limit, f"{side}_passes": fine}).withColumnRenamed("t", f"t_{side}"))
    keep, drop = sides
    grid = keep.crossJoin(F.broadcast(drop.withColumn("t_exclude", F.bround(1 - F.col("t_exclude"), 2))))  # thresholds against thresholds
    manual = F.col("total") - F.col("keep_population") - F.col("exclude_population")
    grid = grid.withColumns({"manual": manual, "manual_rate": manual / F.col("total"), "workload_passes": manual / F.col("total") <= workload})
    return grid.withColumn("passes", F.col("keep_passes") & F.col("exclude_passes") & F.col("workload_passes"))


def _upper_limit(events: Column, n: Column, confidence: float = 0.95) -> Column:
    def bound(e: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([clopper_pearson(int(x), int(y), confidence) for x, y in zip(e, m)], dtype="float64")

    return F.pandas_udf(bound, "double")(events, n)


def acceptance(deltas: DataFrame) -> DataFrame:
    """The point gates of a candidate, and whether all hold."""
    gates = deltas.select("*", (F.col("d_false_positive") <= 0).alias("gate_errors"), (F.col("d_log_loss") <= -0.01).alias("gate_log_loss"), (F.col("d_brier") <= 0).alias("gate_brier"))
    return gates.withColumn("accepted", F.col("gate_errors") & F.col("gate_log_loss") & F.col("gate_brier"))


def audit_verdict(rows: DataFrame, action: str, adverse: Column, limits: dict[str, int]) -> DataFrame:
    """Per tail: audited rows, adverse ones, and whether the tail may be used."""
    allowed = F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v)])
    out = rows.filter(F.col(action).isin(*limits)).groupBy(action).agg(F.count(F.lit(1)).alias("audited"), F.count_if(adverse).alias("adverse"))
    return out.withColumn("enabled", F.col("adverse") <= allowed[F.col(action)])


def locked_test(rows: DataFrame, keep: float, exclude: float, max_keep_errors: int, max_exclude_errors: int, min_support: int) -> DataFrame:
    """Errors first, then support; a failure of either leaves manual review only."""
    kept, out = F.col("p") <= keep, F.col("p") >= exclude
    sums = rows.agg(F.count_if(kept).alias("keep_n"), F.count_if(out).alias("exclude_n"), F.count_if(kept & (F.col("label") == 1)).alias("keep_errors"), F.count_if(out & (F.col("label") == 0)).alias("exclude_errors"))
    bad = (F.col("keep_errors") > max_keep_errors) | (F.col("exclude_errors") > max_exclude_errors)
    few = (F.col("keep_n") < min_support) | (F.col("exclude_n") < min_support)
    return sums.withColumn("status", F.when(bad, "FAILED_MANUAL_ONLY").when(few, "SUPPORT_MANUAL_ONLY").otherwise("PASSED"))


def subgroup_metrics(rows: DataFrame, p: str, label: str, group: str) -> DataFrame:
    """The figures of :func:`confusion` for each group that holds both classes."""
    return confusion(rows, p, label, by=(group,)).filter("tp + fn > 0 and fp + tn > 0")


def directional(rows: DataFrame, before: str, after: str, label: str) -> DataFrame:
    """One row: errors of either kind before and after, answers mended and broken, and whether no kind of error grew."""
    y = F.col(label) == 1
    was, now = (F.col(c) >= 0.5 for c in (before, after))
    sums = rows.agg(
        F.count_if(was & ~y).alias("false_positive_before"), F.count_if(now & ~y).alias("false_positive_after"), F.count_if(~was & y).alias("false_negative_before"), F.count_if(~now & y).alias("false_negative_after"),
        F.count_if((was != y) & (now == y)).alias("mended"), F.count_if((was == y) & (now != y)).alias("broken"),
    )
    return sums.withColumn("passes", (F.col("false_positive_after") <= F.col("false_positive_before")) & (F.col("false_negative_after") <= F.col("false_negative_before")))
