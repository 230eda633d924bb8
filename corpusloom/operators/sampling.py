"""Queues, balanced takes, stratified samples with weights, and splits, all in hash order."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.tables import stage


def hash_order(seed: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]).cast("binary"), 256)


def global_rank(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Numbers all rows from 1 in an order, without bringing them into one task.

    Rows are dealt by ranges of the order and written; each part's rows are
    numbered in it, and the counts of the parts before are added. Only one count
    per part reaches the one task that sums them.
    """
    keys = [o.alias(f"__o{k}") for k, o in enumerate(order)]
    parts = rows.select("*", *keys).repartitionByRange(*[F.col(f"__o{k}") for k in range(len(keys))]).withColumn("__part", F.spark_partition_id())
    parts = stage(parts, "ranked")
    before = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = before.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*[f"__o{k}" for k in range(len(keys))]))
    return parts.withColumn(name, within.cast("long")).join(F.broadcast(before), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before", *[f"__o{k}" for k in range(len(keys))])


#: Keys that the rows of one stratum are dealt over before the last pick.
SALTS = 64


def first_of_each(rows: DataFrame, keys: list[str], n: Column, *order: Column | str, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each stratum in an order, numbered from 1, without sorting a whole stratum in one task.

    Rows are dealt over ``SALTS`` parts of their stratum first; the first n of
    each part then meet for the last pick.
    """
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS))
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    named = rows.select("*", *[o.alias(f"__o{k}") for k, o in enumerate(order)], part.alias("__part"))
    sort = [f"__o{k}" for k in range(len(order))]
    for by in (Window.partitionBy(*keys, "__part"), Window.partitionBy(*keys)):
        named = named.withColumn(name, F.row_number().over(by.orderBy(*sort)).cast("long")).filter(F.col(name) <= n)
    return named.drop("__part", *sort)


def first_per_stratum(rows: DataFrame, stratum: str, take: DataFrame, order: Column, tie: str) -> DataFrame:
    """The first rows of each stratum in an order, as many as ``take`` (stratum, n_h) says, with weights.

    Adds ``population`` N, ``rank``, ``inclusion_probability`` n/N and ``analysis_weight`` N/n.
    """
    sizes = take.join(rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("population")), stratum)
    taken = first_of_each(rows.join(F.broadcast(sizes), stratum), [stratum], F.col("n_h"), order, tie)  # a row per stratum of the plan
    return taken.withColumn("inclusion_probability", F.col("n_h") / F.col("population")).withColumn("analysis_weight", F.col("population") / F.col("n_h"))


def allocate(targets: dict[str, int], populations: dict[str, int]) -> dict[str, int]:
    """Gives a stratum's shortfall to strata with room, in proportion to it (largest remainders, ties in plan order)."""
    got = {s: min(n, populations.get(s, 0)) for s, n in targets.items()}
    while (short := sum(targets.values()) - sum(got.values())) > 0:
        room = {s: populations.get(s, 0) - got[s] for s in targets if populations.get(s, 0) > got[s]}
        if not room:
            break
        share = {s: short * r / sum(room.values()) for s, r in room.items()}
        give = {s: min(room[s], math.floor(x)) for s, x in share.items()}
        left = short - sum(give.values())
        for s in sorted(room, key=lambda s: -(share[s] - math.floor(share[s]))):
            if left and give[s] < room[s]:
                give[s], left = give[s] + 1, left - 1
        for s, n in give.items():
            got[s] += n
    return got


def balanced_take(rows: DataFrame, group: str, order: Column, tie: str, n: int) -> DataFrame:
    """n rows, one from each group in turn."""
    return first_of_each(rows, [group], F.lit(n), order, tie, name="turn").orderBy("turn", group).limit(n)


def quantile_rows(rows: DataFrame, key: str, order: list[str], k: int = 5) -> DataFrame:
    """Up to k rows of each key at even places of its order, the first and the last among them."""
    w = Window.partitionBy(key)
    numbered = rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("at", (F.row_number().over(w.orderBy(*order)) - 1).cast("long"))
    take = F.least(F.col("n"), F.lit(k)).cast("int")
    places = F.when(take == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), take - 1), lambda i: F.bround(i * (F.col("n") - 1) / (take - 1), 0).cast("long")))
    return numbered.filter(F.array_contains(places, F.col("at"))).drop("n")


def temporal_holdout(rows: DataFrame, time: str, tie: Column, fraction: float, component: str) -> DataFrame:
    """Marks the latest share of rows as test, and all rows of the components they touch."""
    total = rows.count()
    ranked = global_rank(rows, F.col(time), tie)
    touched = ranked.filter(F.col("rank") > total - math.ceil(total * fraction)).select(component).distinct().withColumn("__test", F.lit(True))
    return ranked.join(touched, component, "left").withColumn("split", F.when(F.col("__test"), "test").otherwise("development")).drop("__test", "rank")


def group_folds(groups: list[tuple[str, int, int]], k: int) -> dict[str, int]:
    """Folds for groups (key, negatives, positives), which are never torn.

    Larger groups first, each to the fold where the squared distance from even
    class counts ends up least. k falls until each fold and its rest hold both
    classes; a bounded driver-side step over one row per group.
    """
    order = sorted(groups, key=lambda g: (-(g[1] + g[2]), g[0]))
    for folds in range(k, 1, -1):
        held, out = [[0, 0] for _ in range(folds)], {}
        for key, a, b in order:
            best = min(range(folds), key=lambda f: (sum(((held[f][c] + x) ** 2 - held[f][c] ** 2) / max(1, sum(g[c + 1] for g in groups)) ** 2 for c, x in ((0, a), (1, b))), f))
            held[best][0] += a
            held[best][1] += b
            out[key] = best
        if all(h[0] and h[1] for h in held):
            return out
    raise ValueError("no split has both classes on both sides")


def exclude(rows: DataFrame, blocked: DataFrame, *keys: str) -> DataFrame:
    return rows.join(blocked, list(keys), "left_anti")


def without_touched_components(rows: DataFrame, component: str, reference: DataFrame, key: str) -> DataFrame:
    """Rows whose component holds none of the reference's keys."""
    touched = rows.join(reference, key, "left_semi").select(component).distinct()
    return rows.join(touched, component, "left_anti")


def nearest_controls(cases: DataFrame, pool: DataFrame, group: list[str], band: str, size: str, seed: str = "controls", id_col: str = "id") -> DataFrame:
    """A control for each case from the same group (label and split, say); no control is used twice.

    A control of the case's own length band is preferred: the k-th case of a
    band (by id) gets the k-th control (in hash order). What is left then goes, by
    the ids of the cases, to the remaining control of the group with the nearest
    size, the first in hash order among equals. Returns the case, its control,
    the group, ``matching`` (``band`` or ``nearest``) and ``difference``.

    A group with fewer controls than cases is an error. That last step goes case
    by case in a task per group; of its controls it reads, for each size, as many
    as the group has such cases, which is all that can be taken.
    """
    short = cases.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).join(pool.groupBy(*group).agg(F.count(F.lit(1)).alias("m")), group, "left")
    if not (lacking := short.filter("coalesce(m, 0) < n").limit(5)).isEmpty():
        raise ValueError(f"fewer controls than cases in {[r.asDict() for r in lacking.collect()]}")
    key = [*group, band]
    order = hash_order(seed, F.col(id_col))
    numbered = cases.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(id_col)).cast("long"))
    wanted = cases.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    first = first_of_each(pool.join(wanted, key), key, F.col("__n"), order, name="k").select(*key, "k", F.col(id_col).alias("control"), F.col(size).alias("control_size"))
    met = stage(numbered.join(first, [*key, "k"], "left"), "controls-met")
    taken = met.filter("control is not null")
    left = met.filter("control is null").select(F.col(id_col).alias("id"), *group, F.col(size).alias("size"))
    needed = left.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    free = pool.join(taken.select(F.col("control").alias(id_col)), id_col, "left_anti").join(needed, group)
    free = first_of_each(free, [*group, size], F.col("__n"), order, name="__k").select(F.col(id_col).alias("id"), *group, F.col(size).alias("size"))
    kinds = {f.name: f.dataType.simpleString() for f in cases.schema.fields}

    def pick(key, asked, offered):
        order = [hashlib.sha256(f"{seed}|{i}".encode()).hexdigest() for i in offered["id"]]
        offered = offered.assign(order=order).sort_values("order")
        names, sizes, out = offered["id"].tolist(), offered["size"].to_numpy(float), []
        for i, n in asked.sort_values("id")[["id", "size"]].itertuples(index=False):
            at = int(np.argmin(np.abs(sizes - n)))  # the first in hash order among equals
            out.append((i, names[at], *key, "nearest", int(n - sizes[at])))
            sizes[at] = np.inf
        return pd.DataFrame(out, columns=["case", "control", *group, "matching", "difference"])

    ddl = f"case {kinds[id_col]}, control {kinds[id_col]}, " + ", ".join(f"{g} {kinds[g]}" for g in group) + ", matching string, difference bigint"
    nearest = left.groupBy(*group).cogroup(free.groupBy(*group)).applyInPandas(pick, ddl)
    exact = taken.select(F.col(id_col).alias("case"), "control", *group, F.lit("band").alias("matching"), (F.col(size) - F.col("control_size")).cast("long").alias("difference"))
    return exact.union(nearest)


def slots(gaps: dict[str, int]) -> list[str]:
    """The order in which frames are filled: always the one with the larger share of its gap left."""
    left, out = dict(gaps), []
    while any(left.values()):
        frame = max(sorted(gaps), key=lambda f: left[f] / gaps[f] if gaps[f] else -1)
        left[frame] -= 1
        out.append(frame)
    return out


def replacement_outcome(usable: Column, duplicate: Column, review: Column, needed: Column, label: Column, final: Column) -> Column:
    """What becomes of a queued replacement; the first reason that holds."""
    # The names of the outcomes.
    return (
        F.when(~usable, "structure_unusable")
        .when(duplicate, "confirmed_duplicate")
        .when(review, "duplicate_review_required")
        .when(~needed, "not_needed")
        .when(label.isNull(), "label_required")
        .when(~final, "label_not_final")
        .otherwise("selected")
    )


def audit_sample(scored: DataFrame, n: int, audit: str, key: str, tails: tuple[str, ...], action: str = "action") -> DataFrame:
    """``n`` members of each tail in hash order, with a task id and one order over all; a tail with fewer is an error.

    Adds ``task_id`` (24 hex digits of a keyed hash) and ``position``, which mixes the tails.
    """
    tailed = scored.filter(F.col(action).isin(*tails))
    sizes = {r[0]: r[1] for r in tailed.groupBy(action).count().collect()}  # a row per tail
    if short := [t for t in tails if sizes.get(t, 0) < n]:
        raise ValueError(f"fewer than {n} members in {short}")
    keyed = lambda word: F.sha2(F.concat_ws("|", F.lit(audit), F.lit(word), F.col(key).cast("string")).cast("binary"), 256)
    drawn = first_of_each(tailed, [action], F.lit(n), keyed("draw"), key).drop("rank")
    place = F.row_number().over(Window.orderBy(keyed("shuffle"), key)).cast("long")  # n rows per tail
    return drawn.withColumn("task_id", F.substring(keyed("task"), 1, 24)).withColumn("position", place)


def one_per_author(posts: DataFrame, authors: DataFrame, author: str, key: str, seed: str) -> DataFrame:
    """One post of each of the given authors, the first in hash order."""
    return first_of_each(posts.join(authors.select(author).distinct(), author, "left_semi"), [author], F.lit(1), hash_order(seed, F.col(key)), key).drop("rank")


def task_plan(queue: DataFrame, labels: DataFrame, key: str, needed: int, reserve: int) -> DataFrame:
    """The first members of a ranked queue as tasks: those needed, then a reserve, each with the label it had before if any."""
    tasks = queue.filter(F.col("rank") <= needed + reserve).withColumn("role", F.when(F.col("rank") <= needed, "needed").otherwise("reserve"))
    return tasks.join(labels.withColumnRenamed("label", "prior_label"), key, "left")


def global_split(rows: DataFrame, time: str, tie: Column, component: str, label: str, test: float, validation: float, strict: bool = False) -> DataFrame:
    """Adds ``split``: the latest share with all its components is ``test``, one grouped fold of the rest ``validation``, the rest ``train``.

    Of about 1 / ``validation`` folds of whole components, the one is taken whose
    share and whose share of positive labels are nearest to the wanted ones. The
    counts of components are dealt on the driver, a row each, as folds need them all.
    The test rows do not depend on the folds: where the latest rows touch all
    components every row is ``test``, and a rest that has no fold with both classes
    on both sides is ``train`` as a whole. With ``strict`` that is an error instead.
    """
    marked = temporal_holdout(rows, time, tie, test, component)
    rest = marked.filter(F.col("split") != "test")
    groups = [tuple(r) for r in rest.groupBy(component).agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).collect()]
    try:
        folds = group_folds(groups, max(2, round(1 / validation)))
    except ValueError:
        if strict:
            raise
        return marked.withColumn("split", F.when(F.col("split") == "test", "test").otherwise("train"))
    n, positive = sum(a + b for _, a, b in groups), sum(b for *_, b in groups)

    def distance(fold: int) -> float:
        own = [(a, b) for c, a, b in groups if folds[c] == fold]
        size = sum(a + b for a, b in own)
        return abs(size / n - validation) + abs(sum(b for _, b in own) / size - positive / n)

    best = min(sorted(set(folds.values())), key=distance)
    held = rows.sparkSession.createDataFrame([(c,) for c, f in folds.items() if f == best], f"{component} {rows.schema[component].dataType.simpleString()}")
    held = held.withColumn("__held", F.lit(True))
    out = marked.join(held, component, "left")
    return out.withColumn("split", F.when(F.col("split") == "test", "test").when(F.col("__held"), "validation").otherwise("train")).drop("__held")
