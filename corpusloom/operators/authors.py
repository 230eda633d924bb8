"""Author histories: candidates, strata, platform coverage, selection and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.values import rate

from .sampling import balanced_take, hash_order

# The codes of both criteria.
EA_POSITIVE, EA_NONE, EA_UNK = ("EA_PROFILE", "EA_CONTENT", "EA_RECOGNITION"), "EA_NONE", "EA_UNK"
CE_POSITIVE, CE_NONE = ("CE_FIRST_HAND", "CE_CONSUMER_VIEW"), "CE_NONE"


def candidates(posts: DataFrame, min_dates: int = 3, min_span: int = 30) -> DataFrame:
    """Per (platform, author): posts, dates, span, profile material, and stratum."""
    out = posts.groupBy("platform", "author").agg(
        F.count(F.lit(1)).alias("posts"), F.count_distinct("day").alias("dates"), F.datediff(F.max("day"), F.min("day")).cast("long").alias("span_days"), F.bool_or("profile").alias("profile")
    )
    long = F.coalesce((F.col("dates") >= min_dates) & (F.col("span_days") >= min_span), F.lit(False))
    return out.withColumn("stratum", F.when(long & F.col("profile"), "HISTORY_RICH").when(long | F.col("profile") | (F.col("posts") >= 2), "BOUNDARY").otherwise("RANDOM_FRAME"))


def platform_coverage(posts: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Per platform: authors, and for each flag how many have it in some post, and their rate."""
    author = posts.groupBy("platform", "author").agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])
    sums = author.groupBy("platform").agg(F.count(F.lit(1)).alias("authors"), *[F.count_if(F.col(n)).alias(n) for n in flags])
    return sums.select("*", *[rate(F.col(n), F.col("authors")).alias(n + "_rate") for n in flags])


def select_authors(rows: DataFrame, plan: dict[str, int], total: int, seed: str) -> DataFrame:
    """As many authors of each stratum as planned, platforms in turn; shortages go to whoever is left."""
    order = hash_order(seed, F.col("platform"), F.col("author"))
    out = None
    for stratum, n in plan.items():
        part = balanced_take(rows.filter(F.col("stratum") == stratum), "platform", order, "author", n).drop("turn")
        out = part if out is None else out.unionByName(part)
    left = total - out.count()
    if left > 0:
        out = out.unionByName(balanced_take(rows.join(out, ["platform", "author"], "left_anti"), "platform", order, "author", left).drop("turn"))
    return out


def derive_role(scope: Column, ea: Column, ce: Column, dates: Column, span: Column, profile: Column, min_dates: int = 3, min_span: int = 30) -> Column:
    """(expert, consumer, sustained, coverage, role) of coded material; code arrays are sorted and distinct."""
    has = lambda codes, c: F.array_contains(codes, c)
    alone = lambda codes, c: has(codes, c) & (F.size(codes) > 1)
    sustained = (dates >= min_dates) & (span >= min_span)
    covered = sustained & profile
    wrong = alone(ea, EA_NONE) | alone(ea, EA_UNK) | alone(ce, CE_NONE) | alone(ce, "CE_UNK") | (~covered & (has(ea, EA_NONE) | has(ce, CE_NONE)))
    expert = F.when(has(ea, EA_NONE), "0").when((F.size(ea) > 0) & ~has(ea, EA_UNK), "1").otherwise("UNK")
    consumer = F.when(F.forall(F.array(*[F.lit(c) for c in CE_POSITIVE]), lambda c: F.array_contains(ce, c)) & (F.size(ce) == 2), "1").when(has(ce, CE_NONE), "0").otherwise("UNK")
    row = lambda *v: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in zip(("expert", "consumer", "sustained", "coverage", "role"), v)])
    enough = covered & (expert != "UNK") & (consumer != "UNK")
    role = F.when((expert == "1") & (consumer == "0"), "KOL_TYPE").when((expert == "0") & (consumer == "1"), "KOC_TYPE").when(expert == "1", "HYBRID").otherwise("ORDINARY")
    return (
        F.when(scope.isin("ORGANIZATION", "MULTI_AUTHOR"), row("NA", "NA", "NA", "OUT_OF_SCOPE", "NA"))
        .when(scope == "UNCLEAR", row("UNK", "UNK", "UNK", "INSUFFICIENT", "UNK"))
        .when(wrong, row("INVALID", "INVALID", "INVALID", "INVALID", "INVALID"))
        .when(enough, row(expert, consumer, "1", "SUFFICIENT", role))
        .otherwise(row(expert, consumer, F.when(sustained, "1").otherwise("UNK"), "INSUFFICIENT", "UNK"))
    )
