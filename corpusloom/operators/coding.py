"""Human coding: agreement between coders, sheets to long labels, review summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_matrix(rows: DataFrame, left: str, right: str) -> DataFrame:
    return rows.groupBy(left, right).agg(F.count(F.lit(1)).alias("n"))


def krippendorff_alpha(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Nominal alpha of two coders: one row with units, disagreement and alpha.

    1 - observed / expected disagreement, where the expected one comes from the
    pooled values of both; without any expected disagreement it is 1 if the
    coders agree and null if not. Rows that either coder left blank are left out.
    """
    both = rows.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).cast("string").alias("l"), F.col(right).cast("string").alias("r"))
    cells = both.groupBy("l", "r").agg(F.count(F.lit(1)).alias("n"))
    seen = cells.agg(F.sum("n").alias("units"), F.sum(F.when(F.col("l") != F.col("r"), F.col("n")).otherwise(0)).alias("unequal"))
    pooled = cells.select(F.col("l").alias("v"), "n").union(cells.select("r", "n")).groupBy("v").agg(F.sum("n").alias("c"))
    same = pooled.agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.sum("c").alias("total"))
    expected = 1 - F.try_divide(F.col("same"), F.col("total") * (F.col("total") - 1))
    observed = F.try_divide(F.col("unequal"), F.col("units"))
    out = seen.crossJoin(F.broadcast(same)).select("units", "unequal", observed.alias("observed"), expected.alias("expected"))
    alpha = F.when(F.col("expected") == 0, F.when(F.col("observed") == 0, 1.0)).otherwise(1 - F.col("observed") / F.col("expected"))
    return out.select("units", "unequal", alpha.alias("alpha"), F.coalesce(alpha >= 0.8, F.lit(False)).alias("passes"))


def discrepancies(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, left, right) where two coders' sheets differ."""
    long = lambda t, v: t.select(key, F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])).alias("field", v))
    return long(a, "left").join(long(b, "right"), [key, "field"]).filter(~F.col("left").eqNullSafe(F.col("right")))


def unknown_counts(rows: DataFrame, fields: list[str], unknown: str = "UNK") -> DataFrame:
    return rows.select(F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])).alias("field", "v")).groupBy("field").agg(F.count_if(F.col("v") == unknown).alias("unknown"), F.count(F.lit(1)).alias("n"))


def sheet_to_labels(sheet: DataFrame, unit: str, coder: str, fields: list[str], note: str) -> DataFrame:
    """One row per judgement; blank rows are skipped and the note goes along as JSON."""
    used = sheet.filter(F.coalesce(*[F.nullif(F.trim(f), F.lit("")) for f in fields]).isNotNull())
    value = F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.nullif(F.trim(f), F.lit("")))])).alias("field", "value")
    return used.select(unit, coder, F.to_json(F.struct(F.trim(note).alias("note"))).alias("notes"), value)


def sheet_issues(sheet: DataFrame, unit: str, rules: dict[str, Column]) -> DataFrame:
    """(unit, issue): every rule that a row breaks."""
    found = F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()])
    return sheet.select(unit, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue"))


def review_summary(rows: DataFrame, group: str, old: str, new: str) -> DataFrame:
    """Per group: labels kept, changed and unsure, and the rate of change."""
    unsure = F.col(new) == "uncertain"
    changed = ~unsure & (F.col(old) != F.col(new))
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~unsure & ~changed).alias("maintained"), F.count_if(changed).alias("changed"), F.count_if(unsure).alias("uncertain"), (F.count_if(changed) / F.count(F.lit(1))).alias("change_rate")
    )


def apply_corrections(labels: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """The corrected label where there is one, with hashes of both states."""
    met = labels.join(corrections.select(key, F.col(column).alias("__new")), key, "left")
    digest = lambda c: F.sha2(F.concat_ws("|", F.col(key).cast("string"), c).cast("binary"), 256)
    after = F.coalesce(F.col("__new"), F.col(column))
    return met.select(*[c for c in labels.columns if c != column], after.alias(column), digest(F.col(column)).alias("before_sha256"), digest(after).alias("after_sha256"))


def coding_rows(units: DataFrame, fields: DataFrame, coders: DataFrame, task: str) -> DataFrame:
    """A blank row for each unit, field and coder, with a keyed id; the tables of fields and coders are a few rows each."""
    met = units.crossJoin(F.broadcast(fields)).crossJoin(F.broadcast(coders))
    name = F.concat_ws("\x1f", F.lit(task), F.col("coder"), F.col("unit_id").cast("string"), F.col("field_name"))
    blank = {c: F.lit("") for c in ("label_value", "review_flag", "reason_code", "evidence_quote")}
    return met.withColumn("annotation_id", F.concat(F.lit("ANN-"), F.substring(F.sha2(name.cast("binary"), 256), 1, 20))).withColumns(blank)
