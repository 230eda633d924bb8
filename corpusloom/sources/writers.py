"""Sinks: immutable tables with manifests, fixed-size batches, CSV with a fixed column order, snapshots."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.expectations import fingerprint


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, data: bytes, replace: bool = False) -> None:
    """Writes a small file whole or not at all: under another name first, then moved into place."""
    target, files = _path(spark, path)
    aside, _ = _path(spark, path + ".part")
    out = files.create(aside, True)
    out.write(bytearray(data))
    out.close()
    if replace:  # one step, so that a reader finds the old file or the new one
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(files.makeQualified(aside), files.makeQualified(target), options)
    elif not files.rename(aside, target):
        files.delete(aside, False)
        raise FileExistsError(path)


def read_small(spark: SparkSession, path: str) -> bytes | None:
    target, files = _path(spark, path)
    if not files.exists(target):
        return None
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def write_immutable(rows: DataFrame, path: str) -> dict:
    """A table with a manifest; the same rows again are reused, others are an error."""
    spark = rows.sparkSession
    state = fingerprint(rows).first().asDict() | {"columns": [list(x) for x in rows.dtypes]}
    had = read_small(spark, f"{path}.manifest.json")
    if had is not None:
        if json.loads(had) != json.loads(json.dumps(state)):
            raise ValueError(f"{path} already holds other rows")
        return state
    rows.write.mode("overwrite").parquet(path)  # a table without a manifest is a run that did not end
    write_bytes(spark, f"{path}.manifest.json", json.dumps(state, sort_keys=True).encode())
    return state


def write_batches(rows: DataFrame, path: str, batch: str = "batch") -> None:
    """One folder for each batch number."""
    rows.repartition(batch).write.partitionBy(batch).parquet(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV parts in a fixed column order."""
    rows.select(*columns).write.option("header", True).option("escape", '"').csv(path)


def csv_bytes(rows: DataFrame, columns: list[str], most: int = 100_000) -> bytes:
    """A small review sheet with a byte order mark; more than ``most`` rows are an error, never cut."""
    import csv
    import io

    held = rows.select(*columns).limit(most + 1).collect()
    if len(held) > most:
        raise ValueError("too many rows for one sheet")
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(columns)
    writer.writerows(["" if x is None else x for x in r] for r in held)
    return b"\xef\xbb\xbf" + out.getvalue().encode()


def review_task(rows: DataFrame, seed: str, shown: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """A blind sheet (task id and what reviewers may see) and the private map back to the keys."""
    task = F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary"), 256), 1, 24).alias("task_id")
    return rows.select(task, *shown), rows.select(task, key)


def snapshot(posts: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str, flag: str, root: str, version: str) -> dict:
    """Copies flagged posts and the child rows that refer to them, then moves the pointer to this version.

    A flag other than 0 or 1 fails the copy. Until all is written and the pointer
    file is replaced, readers see the version before.
    """
    spark = posts.sparkSession
    if posts.filter(~F.coalesce(F.col(flag).isin(0, 1), F.lit(False))).limit(1).count():
        raise ValueError(f"{flag} must be 0 or 1")
    kept = posts.filter(F.col(flag) == 1)
    manifest = {"version": version, "tables": {"posts": write_immutable(kept, f"{root}/{version}/posts")}}
    for name, (rows, foreign) in children.items():
        closed = rows.join(kept.select(F.col(key).alias(foreign)), foreign, "left_semi")
        manifest["tables"][name] = write_immutable(closed, f"{root}/{version}/{name}")
    body = json.dumps(manifest, sort_keys=True).encode()
    write_bytes(spark, f"{root}/{version}/manifest.json", body, replace=True)
    write_bytes(spark, f"{root}/current.json", json.dumps({"version": version, "sha256": hashlib.sha256(body).hexdigest()}).encode(), replace=True)
    return manifest


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    pointer = json.loads(read_small(spark, f"{root}/current.json"))
    return spark.read.parquet(f"{root}/{pointer['version']}/{table}")
