"""Joins that fail closed: rows that belong together must all be there, once each, and agree."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


class LineageError(ValueError):
    """Rows that break a rule; the message names the rule and some of them."""


def refuse(violations: DataFrame, rule: str, shown: int = 5) -> None:
    """Raises if there is any violation. Only a few rows are read."""
    if some := violations.limit(shown).collect():
        raise LineageError(f"{rule}: {[r.asDict() for r in some]}")


def coverage(left: DataFrame, right: DataFrame, key: list[str], same: tuple[str, ...] = ()) -> DataFrame:
    """(key, state) of each key on either side.

    ``missing``: on the left only; ``unexpected``: on the right only;
    ``duplicate``: on a side more than once; ``changed``: a column of ``same``
    differs; else ``covered``. Null keys are keys like any other.
    """
    held = F.struct(*[F.col(c) for c in same]) if same else F.lit(0)
    side = lambda t, mark: t.select(*key, F.lit(mark).alias("__side"), F.xxhash64(held, *[F.col(c).isNull() for c in same]).alias("__is"))
    counted = side(left, 1).union(side(right, 2)).groupBy(*key).agg(
        F.count_if(F.col("__side") == 1).alias("__l"), F.count_if(F.col("__side") == 2).alias("__r"), (F.min("__is") == F.max("__is")).alias("__same")
    )
    state = F.when(F.col("__r") == 0, "missing").when(F.col("__l") == 0, "unexpected").when((F.col("__l") > 1) | (F.col("__r") > 1), "duplicate")
    return counted.select(*key, state.when(~F.col("__same"), "changed").otherwise("covered").alias("state"))


def matched(left: DataFrame, right: DataFrame, key: list[str], same: tuple[str, ...] = ()) -> DataFrame:
    """The 1:1 join of two tables that must cover each other and agree in ``same``; anything else is an error."""
    refuse(coverage(left, right, key, same).filter("state <> 'covered'"), "tables do not cover each other")
    return left.join(right.drop(*same), key)


def bound(members: DataFrame, *tables: tuple[DataFrame, list[str]]) -> DataFrame:
    """Members joined with each table on its key; a member that a table has not exactly once is an error."""
    for table, key in tables:
        found = members.select(*key).distinct().join(table.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")), key, "left")
        refuse(found.filter("coalesce(__n, 0) <> 1"), f"members without one row by {key}")
        members = members.join(table, key)
    return members


def usable_members(members: DataFrame, versions: DataFrame, key: list[str], status: str = "status") -> DataFrame:
    """Members whose version is usable; a member without its version is an error."""
    return bound(members, (versions, key)).filter(F.col(status) == "usable")


def returned_tasks(tasks: DataFrame, private: DataFrame, key: str, text: str, digest: str) -> DataFrame:
    """Coded tasks with what only the private map knows; both must hold the same tasks, and texts must be unchanged."""
    joined = matched(tasks, private, [key])
    refuse(joined.filter(~F.sha2(F.col(text).cast("binary"), 256).eqNullSafe(F.col(digest))).select(key), "texts were changed")
    return joined


def without_trained(population: DataFrame, training: DataFrame, key: list[str], strict: bool = False) -> DataFrame:
    """The population without what a model was trained on; with ``strict`` an overlap is an error instead."""
    if strict:
        refuse(population.join(training, key, "left_semi").select(*key), "trained members among those to be scored")
    return population.join(training, key, "left_anti")


def evidence(origins: dict[str, DataFrame], binding: DataFrame, key: list[str]) -> DataFrame:
    """All origins' evidence in one table with its ``origin`` and what the binding says of its key; an unbound key is an error."""
    union = None
    for name, rows in origins.items():
        rows = rows.withColumn("origin", F.lit(name))
        union = rows if union is None else union.unionByName(rows)
    return bound(union, (binding, key))


def orphans(child: DataFrame, parents: dict[str, tuple[DataFrame, dict[str, str]]], key: list[str]) -> DataFrame:
    """(key, lacks): child rows for which a parent table has no row that agrees in the given columns.

    ``parents``: a name, the rows that count, and which child column names which parent column.
    """
    out = None
    for name, (rows, columns) in parents.items():
        had = rows.select(*[F.col(b).alias(a) for a, b in columns.items()]).distinct()
        lacking = child.join(had, list(columns), "left_anti").select(*key, F.lit(name).alias("lacks"))
        out = lacking if out is None else out.union(lacking)
    return out


def overlaps(parts: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """(key, parts): what more than one of the parts holds, with their names."""
    union = None
    for name, rows in parts.items():
        rows = rows.select(*key, F.lit(name).alias("__part")).distinct()
        union = rows if union is None else union.union(rows)
    return union.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("__part")), "|").alias("parts"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")


def split_leaks(assignments: DataFrame, component: str, split: str = "split") -> DataFrame:
    """(component, splits): components that more than one split holds."""
    return assignments.groupBy(component).agg(F.array_join(F.array_sort(F.collect_set(split)), "|").alias("splits")).filter(F.instr("splits", "|") > 0)


def manifests(rows: DataFrame, group: str, order: list[str], columns: list[str]) -> DataFrame:
    """(group, members, sha256): a digest of each group's rows as a JSON list of objects, in order.

    Rows come to a group's task sorted and go through its hash one by one, so no
    group is held; a group is one stream, as a digest in order has to be.
    """
    token = F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})
    kind = rows.schema[group].dataType
    return streamed_digests(rows.select(F.col(group).alias("group"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)], token.alias("token")), len(order), kind).withColumnRenamed("group", group)


def streamed_digests(rows: DataFrame, n_order: int, kind) -> DataFrame:
    """(group, members, sha256) of rows (group, __o0, ..., token): the tokens of a group in order, as a JSON list."""
    arrow = to_arrow_type(kind)

    def told(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((arrow, pa.int64(), pa.string()))], ["group", "members", "sha256"])

    def run(batches):
        at, digest, n, begun = None, None, 0, False
        for batch in batches:
            out = []
            for group, token in zip(batch.column("group").to_pylist(), batch.column("token").to_pylist()):
                if not begun or group != at:
                    if begun:
                        digest.update(b"]")
                        out.append((at, n, digest.hexdigest()))
                    at, digest, n, begun = group, hashlib.sha256(b"["), 0, True
                digest.update((b"," if n else b"") + token.encode())
                n += 1
            yield told(out)
        if begun:
            digest.update(b"]")
            yield told([(at, n, digest.hexdigest())])

    dealt = rows.repartition("group").sortWithinPartitions("group", *[f"__o{k}" for k in range(n_order)])
    return dealt.mapInArrow(run, f"group {kind.simpleString()}, members bigint, sha256 string")


def decision_faults(decisions: DataFrame, labels: DataFrame, routes: DataFrame, key: list[str]) -> DataFrame:
    """(key, fault): decisions that their own evidence does not bear out.

    A manual one must say what its evidence's label says (``related`` keeps,
    ``unrelated`` excludes, anything else is for review), a model's what the
    route of a completed run says; ``no_evidence`` where there is none.
    """
    said = F.when(F.col("label") == "related", "keep").when(F.col("label") == "unrelated", "exclude").otherwise("review")
    routed = F.when(F.col("route") == "auto_keep", "keep").when(F.col("route") == "auto_exclude", "exclude").otherwise("review")
    manual = labels.select(*key, said.alias("__wanted"), F.lit("manual_evidence").alias("source"))
    model = routes.filter(F.col("status") == "completed").select(*key, routed.alias("__wanted"), F.lit("model_route").alias("source"))
    met = decisions.join(manual.union(model), [*key, "source"], "left")
    fault = F.when(F.col("__wanted").isNull(), "no_evidence").when(F.col("__wanted") != F.col("action"), "other_action")
    return met.select(*key, "source", fault.alias("fault")).filter("fault is not null")


def sample_faults(rows: DataFrame, key: list[str], frames: dict[str, int]) -> DataFrame:
    """(rule, violations) of a reference sample: unique keys, frame sizes, weights that are 1 / probability, digests of the texts."""
    repeated = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("unique_key"))
    off = F.abs(F.col("weight") * F.col("probability") - 1) > 2e-5
    sums = rows.agg(
        F.count_if(F.coalesce(off, F.lit(True))).alias("weight_is_inverse"),
        F.count_if(~F.sha2(F.col("text").cast("binary"), 256).eqNullSafe(F.col("text_sha256"))).alias("text_digest"),
        *[F.abs(F.count_if(F.col("frame") == name) - n).alias(f"frame_{name}") for name, n in frames.items()],
        F.count_if(~F.coalesce(F.col("frame").isin(*frames), F.lit(False))).alias("frame_known"),
    )
    line = repeated.crossJoin(F.broadcast(sums))  # one row each
    names = line.columns
    return line.select(F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("long"))])).alias("rule", "violations"))


def reprojected(stored: DataFrame, fields: Column, key: list[str], text: str) -> DataFrame:
    """Keys whose stored text is not what its source fields give when they are projected again."""
    return stored.filter(~fields.eqNullSafe(F.col(text))).select(*key)


def in_frame_order(rows: DataFrame, frames: tuple[str, ...], *then: str) -> DataFrame:
    """Rows sorted by their frame's place in a list (others last), then by the given columns."""
    place = F.coalesce(*[F.when(F.col("frame") == name, F.lit(k)) for k, name in enumerate(frames)], F.lit(len(frames)))
    return rows.orderBy(place, *then)


def queue_prefix(queue: DataFrame, most: int, rank: str = "rank") -> DataFrame:
    return queue.filter(F.col(rank) <= most)


def pairs_touching(pairs: DataFrame, queue: DataFrame, key: str) -> DataFrame:
    """Pairs (left, right) with at least one side in a queue."""
    side = lambda s: queue.select(F.col(key).alias(s)).distinct().withColumn(f"__{s}", F.lit(True))
    return pairs.join(side("left"), "left", "left").join(side("right"), "right", "left").filter("__left or __right").drop("__left", "__right")


def latest(versions: DataFrame, key: list[str], version: str) -> DataFrame:
    return versions.groupBy(*key).agg(F.max(version).alias(version))
