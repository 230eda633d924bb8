"""Exact dedup: a tree-merge of sorted digest runs, in DataFrame operations only.

Every row is reduced to a digest of its normalised text and dealt to one of
``runs`` runs by its id. A run holds each digest once, with the smallest
identifier and a count, sorted by digest. The runs are merged in the rounds of a
binomial tree: in round k, of each ``fan_in`` runs whose numbers agree but for
digit k, the others send theirs to the lowest; there all are merged in the order
of the digests, and of neighbours with one verified digest the smallest
identifier stays. When one run is left, the verdicts go down the same tree. Equal
digests of a round stem from different runs, so a text that a third of all rows
share is spread over all runs at first, and ``fan_in`` rows at most meet for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, read_table, stage

_KEY = ["__sha", "__check", "__bytes"]


def _merge(runs: DataFrame, stride: int) -> DataFrame:
    """Sends the runs to the lowest of each ``stride`` and merges them there, sorted by digest, with the smallest identifier first."""
    met = runs.withColumn("__run", F.expr(f"__run - __run % {stride}"))
    of = Window.partitionBy("__run", *_KEY)
    sorted_ = of.orderBy(F.col("__keep_id").asc_nulls_last(), "__keep_n")
    return met.withColumns({"__at": F.row_number().over(sorted_), "__size": F.sum("__size").over(of)}).filter("__at = 1").drop("__at")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64, fan_in: int = 4, carry: bool = False) -> DataFrame:
    """Finds equal texts; of each group the row with the smallest id stays.

    Texts are equal when identical after replacing each run of white space
    (space, ``\\t`` to ``\\r``) by one space. Rows are merged only where the
    SHA-256, an independent 64-bit hash and the byte length all agree, at every
    level. Returns one row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``; with ``carry`` the input's columns and ``kept`` instead.

    Nulls: a null text counts as empty; a null id is larger than any id, and a
    group with null ids only has a null ``keep_id``. Of rows that repeat an id
    and a text exactly one stays. An empty table gives an empty result. Other
    columns are ignored (with ``carry``: returned; names that start with two
    underscores are reserved).
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES + "+", " ")
    hashed = docs.select(
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if carry else []),
        F.col(id_col).alias("__id"),
        F.monotonically_increasing_id().alias("__n"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("__sha"),
        F.xxhash64(text).alias("__check"),
        F.octet_length(text).alias("__bytes"),
    )
    base = stage(hashed.withColumn("__run", F.pmod(F.xxhash64("__id", "__n"), F.lit(runs)).cast("int")), "exact-rows")
    least = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__n").alias("n")))
    first = base.groupBy("__run", *_KEY).agg(least.alias("__keep"), F.count(F.lit(1)).alias("__size"))
    first = first.select("__run", *_KEY, F.col("__keep.id").alias("__keep_id"), F.col("__keep.n").alias("__keep_n"), "__size")
    levels, strides = [stage(first.sortWithinPartitions("__run", *_KEY), "exact-run", sweep=True)], [1]
    while strides[-1] < runs:
        strides.append(strides[-1] * fan_in)
        levels.append(stage(_merge(levels[-1], strides[-1]), "exact-run", sweep=True))
    verdict = levels.pop().filter("__size > 1")
    while levels:
        below = levels.pop().select(F.expr(f"__run - __run % {strides.pop()}").alias("__above"), F.col("__run").alias("__own"), *_KEY)
        verdict = below.join(verdict.withColumnRenamed("__run", "__above"), ["__above", *_KEY]).drop("__above").withColumnRenamed("__own", "__run")
    out = base.join(verdict, ["__run", *_KEY], "left")
    kept = F.coalesce(F.col("__n") == F.col("__keep_n"), F.lit(True)).alias("kept")
    if carry:
        return out.select("__row", kept)
    return out.select(
        F.col("__id").alias("doc_id"),
        F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep_id")).alias("keep_id"),
        F.coalesce("__size", F.lit(1).cast("long")).alias("group_size"),
        kept,
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows that :func:`exact_dedup` keeps, with the input's columns."""
    return exact_dedup(docs, carry=True, **options).filter("kept").select("__row.*")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, sha256(body) as text_sha256
from t window w as (partition by body)
"""
