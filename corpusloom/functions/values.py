"""Identifiers, dates, numbers and arrays as column expressions."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_hash(*fields: tuple[str, Column]) -> Column:
    """SHA-256 of compact JSON with sorted keys (texts, whole numbers and truth values)."""
    body = F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields, key=lambda x: x[0])]), {"ignoreNullFields": "false"})
    return F.sha2(body.cast("binary"), 256)


def keyed_id(length: int, *parts: Column) -> Column:
    """The first ``length`` hexadecimal digits of the SHA-256 of parts joined by ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"), 256), 1, length)


def seed_of(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def pseudonym(secret: bytes, *parts: Column) -> Column:
    """HMAC-SHA-256 over parts joined by U+001F; the secret stays in the closure."""

    @F.pandas_udf("string")
    def sign(text: pd.Series) -> pd.Series:
        return text.map(lambda x: hmac.new(secret, x.encode(), hashlib.sha256).hexdigest())

    return sign(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _digits(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else format(v, ".17g"))


def seventeen_digits(x: Column) -> Column:
    """A double with 17 significant digits, as C's %.17g writes it."""
    return F.pandas_udf(_digits, "string")(x)


def pseudo_probability(key: Column, salt: str = "") -> Column:
    """A number in [0, 1) from 32 bits of a hash; stands in for a model's probability."""
    text = F.concat(key.cast("string"), F.lit(salt)) if salt else key.cast("string")
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def own_date(c: Column) -> Column:
    """The date in a timestamp text's own offset; null if its first ten characters are no date."""
    return F.try_to_date(F.substring(F.trim(c), 1, 10), "yyyy-MM-dd")


def span_days(first: Column, last: Column) -> Column:
    return F.datediff(last, first)


def length_ratio_ppm(a: Column, b: Column) -> Column:
    least, most = F.least(a, b).cast("long"), F.greatest(a, b).cast("long")
    return F.when(most == 0, F.lit(1_000_000).cast("long")).otherwise(F.floor(F.try_divide(least * 1_000_000, most)))


def similarity_ppm(s: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(1_000_000), F.floor(s * 1e6 + 0.5))).cast("long")


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(709.0)), F.lit(-709.0))))


def logit(p: Column, edge: float = 1e-6) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - edge)), F.lit(edge))
    return F.ln(p / (1 - p))


def logit_blend(p: Column, q: Column, weight: float) -> Column:
    return sigmoid((1 - weight) * logit(p) + weight * logit(q))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / n)


def project(v: Column, dimensions: int) -> Column:
    """The first dimensions, brought to length one again."""
    return unit(F.slice(v, 1, dimensions))


def is_unit(v: Column, slack: float = 1e-5) -> Column:
    return F.forall(v, lambda x: ~F.isnan(x)) & (F.abs(norm(v) - 1) < slack)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def chunk_ranges(n: Column, budget: int) -> Column:
    """[start, end) ranges that cover n tokens."""
    n = n.cast("long")
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(budget).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + budget, n).alias("end")))


def head_tail(n: Column, budget: int) -> Column:
    """How many tokens the head and the tail keep, and how many are left out between them."""
    head = F.least(n, F.lit(budget - budget // 2))
    tail = F.least(n - head, F.lit(budget // 2))
    return F.struct(head.cast("long").alias("head"), tail.cast("long").alias("tail"), (n - head - tail).cast("long").alias("omitted"))


def rate(part: Column, whole: Column, digits: int = 6) -> Column:
    """A rounded rate, half to even; null over nothing."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def rank_index(n: Column, q: float) -> Column:
    """The place, from 0, of a quantile by rank, half to even."""
    return F.greatest(F.lit(0), F.least(n - 1, F.bround((n - 1) * F.lit(q), 0))).cast("long")


def grid(spark, name: str, first: int = 1, last: int = 49, of: int = 100):
    """first/of to last/of in steps of 1/of."""
    return spark.range(first, last + 1).select((F.col("id") / F.lit(of)).alias(name))
