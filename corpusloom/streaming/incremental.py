"""Incremental work: versions of changed rows, scored batches that can resume, and a cache of encoded texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.values import keyed_id


def bump_versions(current: DataFrame, history: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """Current rows with ``version`` and ``change``: new, changed in a watched column, or unchanged."""
    old = history.select(key, F.col("version").alias("__was"), *[F.col(c).alias(f"__{c}") for c in watched])
    same = F.lit(True)
    for c in watched:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    change = F.when(F.col("__was").isNull(), "new").when(same, "unchanged").otherwise("changed")
    met = current.join(old, key, "left").withColumn("change", change)
    version = F.coalesce(F.col("__was"), F.lit(0)) + F.when(F.col("change") == "unchanged", 0).otherwise(1)
    return met.withColumn("version", version.cast("long")).drop("__was", *[f"__{c}" for c in watched])


def reused_identities(current: DataFrame, history: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """Keys that now name another post: each is a violation."""
    met = current.select(key, *identity).join(history.select(key, *[F.col(c).alias(f"__{c}") for c in identity]), key)
    differs = F.lit(False)
    for c in identity:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return met.filter(differs).select(key)


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds ``batch``: fixed-size runs in an order, and an identifier bound to what the batch holds."""
    from corpusloom.operators.sampling import global_rank

    ranked = global_rank(rows, F.col(order), name="__rank").withColumn("batch", F.floor((F.col("__rank") - 1) / size)).drop("__rank")
    held = ranked.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("decimal(38,0)")).cast("string").alias("__sum"))
    return ranked.join(held.select("batch", "rows", keyed_id(24, F.lit("batch"), F.col("batch"), F.col("__sum")).alias("batch_id")), "batch")


def split_by_cache(rows: DataFrame, cache: DataFrame, text_hash: str, namespace: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their vector, distinct missing texts) of a cache keyed by namespace and text hash."""
    own = cache.filter(F.col("namespace") == namespace).select(text_hash, "vector")
    return rows.join(own, text_hash), rows.join(own, text_hash, "left_anti").dropDuplicates([text_hash])


def append_to_cache(missing: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str, namespace: str, text_hash: str) -> None:
    """Encodes what the cache lacks and appends it."""
    encode(missing).select(F.lit(namespace).alias("namespace"), text_hash, "vector").write.mode("append").parquet(path)


def score_arrivals(spark: SparkSession, source: str, schema: str, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: Column) -> None:
    """Scores CSV files that have arrived and stops; a later call takes only new ones.

    Each micro-batch is written under its own number, so one that is run again
    after a failure replaces its rows. A key that repeats, within a batch or
    from an earlier one, fails the batch; the keys stand beside the scores.
    """

    def write(batch: DataFrame, number: int) -> None:
        keys = batch.groupBy(key.alias("k")).count()
        keys.select("k").write.mode("overwrite").parquet(f"{sink}.keys/batch={number}")
        known = batch.sparkSession.read.parquet(f"{sink}.keys").filter(F.col("batch") != number)
        if not keys.filter("count > 1").isEmpty() or not keys.join(known, "k", "left_semi").isEmpty():
            raise ValueError(f"batch {number} repeats a key")
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("header", True).option("mode", "FAILFAST").csv(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_activity(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, late: str = "1 day") -> None:
    """Events per type and day from a growing folder; a watermark bounds the state and drops what comes too late."""
    stream = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    daily = stream.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    flat = daily.select(F.col("window.start").alias("day"), "event_type", "n", "value")
    flat.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def supersession_chains(ledger: DataFrame, subject: str) -> DataFrame:
    """The latest decision of each subject and how many came before it."""
    w = Window.partitionBy(subject)
    return ledger.withColumn("k", F.row_number().over(w.orderBy(F.desc("decision_id")))).withColumn("decisions", F.count(F.lit(1)).over(w)).filter("k = 1").drop("k")
