"""Integrity rules: each reports its violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows that break each rule, or for which it is null; one pass over the table."""
    counts = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return counts.select(F.explode(F.create_map(*[x for n in rules for x in (F.lit(n), F.col(n))])).alias("rule", "violations"))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()])
    return rows.withColumn("rule", F.explode(F.filter(broken, lambda x: x.isNotNull())))


def foreign_keys(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key no parent has; null keys refer to nothing."""
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def count_mismatches(parent: DataFrame, key: str, counted: str, child: DataFrame, child_key: str) -> DataFrame:
    """Parents whose stated number of children is not the real one."""
    real = child.groupBy(F.col(child_key).alias(key)).agg(F.count(F.lit(1)).alias("real"))
    return parent.join(real, key, "left").withColumn("real", F.coalesce("real", F.lit(0))).filter(~F.col(counted).eqNullSafe(F.col("real")))


def transitions(before: DataFrame, after: DataFrame, key: str, state: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows that were deleted or whose state moved where it must not."""
    met = before.select(key, F.col(state).alias("was")).join(after.select(key, F.col(state).alias("now")), key, "left")
    fine = F.lit(False)
    for a, targets in allowed.items():
        fine = fine | ((F.col("was") == a) & F.col("now").isin(a, *targets))
    return met.filter(~F.coalesce(fine, F.lit(False)))


def equal_multisets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows by which two tables differ, with how often more the first has them."""
    side = lambda t, n: t.select("*", F.lit(n).alias("__d"))
    return side(a, 1).union(side(b, -1)).groupBy(*a.columns).agg(F.sum("__d").alias("surplus")).filter("surplus <> 0")


def fingerprint(rows: DataFrame) -> DataFrame:
    """An order-free digest of a table: count, and sums of two hashes of every row."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("xx"), F.bit_xor(F.xxhash64(F.lit(1), *columns)).alias("xor"))


def single_chain(ledger: DataFrame, subject: str) -> DataFrame:
    """Subjects whose decisions do not form one chain: several roots, or a decision superseded twice."""
    roots = ledger.groupBy(subject).agg(F.count_if(F.col("supersedes_id").isNull()).alias("roots"))
    forks = ledger.filter("supersedes_id is not null").groupBy(subject, "supersedes_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(subject).distinct().withColumn("forked", F.lit(True))
    return roots.join(forks, subject, "left").filter("roots <> 1 or forked")
