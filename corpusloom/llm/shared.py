"""Expressions and joins that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.tables import read_table, stage, unstage  # noqa: F401  the operators take them from here

#: Tables of one row per source (host) are broadcast up to so many rows, some 10 MB.
BROADCAST_ROWS = 100_000
#: Beyond that, a source's rows are dealt over so many keys.
SALTS = 64

#: White space that parts words, as a Java regular expression's class.
SPACES = r"[\x20\x09-\x0D]"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and ``\\t`` to ``\\r``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_unit(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from an MD5 of the keys, the same in every run and engine."""
    text = F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def join_by_source(docs: DataFrame, source: str, table: DataFrame, key: str, spread: Column) -> DataFrame:
    """Left join of ``docs`` with a staged table that has one row per source, null included.

    The table is broadcast if its counted rows are few. Otherwise its rows are
    repeated for each salt and ``spread`` deals a source's documents over the salts.
    """
    same = F.col(source).eqNullSafe(F.col(key))
    if table.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(table), same, "left").drop(key)
    dealt = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = docs.withColumn("__salted", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, same & (F.col("__salted") == F.col("__salt")), "left").drop("__salt", "__salted", key)
