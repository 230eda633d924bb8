"""Mixing sources to target weights, by repetition rates and a seeded coin per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import hash_unit, join_by_source, n_words, read_table, stage


def source_rates(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per source: ``source, source_size, target, rate``.

    Sources by code point (null last) take the weights in turn and share the
    size of all documents. A target stops at ``cap`` times its source's size
    and the excess is shared again by weight among the others, until none is
    above. With ratio r = cap * size / weight in rising order, the sources that
    stop are those before the first k with (total - stopped) / (weight of the
    rest) <= r, so prefix sums over this table replace the rounds.
    """
    sums = stage(docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(n_words(F.col(text_col))).alias("source_size")), "mix-sources")
    # One row a source from here on: these windows see the aggregated table only.
    ranked = sums.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("__w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__rank") - 1) % len(weights) + 1).cast("long"))
    most = F.col("source_size") * cap
    by_ratio = Window.orderBy((most / F.col("__w")).asc(), F.col("__rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    filled = (
        weighed.withColumn("__before", F.sum(most).over(by_ratio) - most)
        .withColumn("__rest", F.sum("__w").over(every) - F.sum("__w").over(by_ratio) + F.col("__w"))
        .withColumn("__all", F.sum("source_size").over(every))
        .withColumn("__level", (F.col("__all") - F.col("__before")) / F.col("__rest"))
    )
    # From the first k that holds on, levels only fall: it has the highest level of those that hold.
    share = F.max(F.when(F.col("__level") <= most / F.col("__w"), F.col("__level"))).over(every)
    target = F.least(most.cast("double"), F.col("__w") * F.coalesce(F.col("__level_1"), F.lit(0.0)))
    return filled.withColumn("__level_1", share).select(
        "source", "source_size", target.alias("target"), F.coalesce(F.try_divide(target, F.col("source_size")), F.lit(0.0)).alias("rate")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Adds ``__size, __source_size, __target, __copies`` to every document.

    A document is taken floor(rate) times and once more where a number in
    [0, 1) hashed from the seed and its id is below the rate's fraction, so
    reruns agree and the order of rows has no say.

    Nulls: a null text has size 0; the null source is a source of its own; a
    null id draws one number that all null ids share. Documents of sources
    without a word are taken 0 times. An empty table stays empty. Other
    columns are returned; those four names are reserved.
    """
    rates = stage(source_rates(docs, weights, cap, source_col, text_col), "mix-rates")
    rates = rates.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("rate").alias("__rate"))
    docs = docs.withColumn("__size", n_words(F.col(text_col)))
    joined = join_by_source(docs, source_col, rates, "__source", F.col(id_col))
    whole = F.floor("__rate")
    extra = (hash_unit(seed, F.col(id_col)) < F.col("__rate") - whole).cast("int")
    return joined.withColumn("__copies", (whole + extra).cast("int")).drop("__rate")


def take_copies(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the input's columns."""
    mixed = mix(docs, **options).filter("__copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )


SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as k from d group by source),
w as (select *, case (k - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from s),
f as (select *, 3 * source_size / weight as ratio,
        sum(source_size) over ()::bigint as total,
        (sum(3 * source_size) over up)::bigint - 3 * source_size as stopped,
        (sum(weight) over ())::bigint - (sum(weight) over up)::bigint + weight as rest
      from w window up as (order by 3 * source_size / weight, k rows unbounded preceding)),
l as (select max((total - stopped) / rest) as level from f where (total - stopped) / rest <= ratio),
t as (select source, source_size, least((3 * source_size)::double, weight * level) as target from f, l),
r as (select d.doc_id, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) as rate
      from d join t on d.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size, target,
  size * (floor(rate)::bigint + case when ('0x' || substr(md5('mix' || chr(31) || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / 4503599627370496.0 < rate - floor(rate) then 1 else 0 end) as taken
from r
"""
