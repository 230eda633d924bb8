"""Sources with a fixed, fail-closed schema."""

from __future__ import annotations

import hashlib
import json
from dataclasses import MISSING, fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_posts(spark: SparkSession, path: str, columns: list[str], order: str | None = None) -> DataFrame:
    """The named columns only, so that the scan reads no others."""
    rows = spark.read.parquet(path).select(*columns)
    return rows.orderBy(order) if order else rows


def with_columns(rows: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """For each wanted name the first of some columns that exists, or null."""
    return rows.select(*[next((F.col(f"`{c}`") for c in names if c in rows.columns), F.lit(None)).alias(n) for n, names in wanted.items()])


def read_strict_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV whose header names the schema's columns in order; a short, long or untypable row fails the read."""
    wanted = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    head = spark.read.option("header", False).option("escape", '"').csv(path).limit(1).collect()
    names = [x.lstrip("﻿") if isinstance(x, str) else x for x in (head[0] if head else [])]
    if names != wanted.names:
        raise ValueError(f"the header is {names}, not {wanted.names}")
    return (
        spark.read.schema(wanted).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("multiLine", True)
        .option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).csv(path)
    )


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file's bytes, by Spark's own reader, so that any store works."""
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def read_verified_json(spark: SparkSession, path: str, sha256: str) -> dict:
    data = read_bytes(spark, path)
    if hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError(f"{path} is not the file that was sealed")
    return json.loads(data)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_media(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (path, sha256) rows that are missing or differ."""
    met = expected.join(found.select(F.col("path"), F.col("sha256").alias("real")), "path", "left")
    return met.filter(~F.col("sha256").eqNullSafe(F.col("real"))).select("path", F.when(F.col("real").isNull(), "missing").otherwise("different").alias("state"))


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str, chunk: int = 1000) -> DataFrame:
    """A read-only SQLite query, for small local sources; refused while a journal lies beside the file."""
    import os
    import sqlite3

    if any(os.path.exists(path + s) for s in ("-wal", "-shm", "-journal")):
        raise ValueError("a journal lies beside the database")
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        con.execute("pragma query_only = on")
        cursor, out = con.execute(query), None
        while rows := cursor.fetchmany(chunk):
            part = spark.createDataFrame(rows, schema)
            out = part if out is None else out.unionByName(part)
        return out if out is not None else spark.createDataFrame([], schema)
    finally:
        con.close()


def load_config(kind: type, values: dict, path: str = ""):
    """A frozen dataclass from a mapping; unknown, missing and unsafe values are errors."""
    known = {f.name: f for f in fields(kind)}
    if extra := set(values) - set(known):
        raise ValueError(f"unknown keys at {path or 'the top'}: {sorted(extra)}")
    out = {}
    for name, field in known.items():
        if name not in values:
            if field.default is MISSING and field.default_factory is MISSING:
                raise ValueError(f"{path}{name} is missing")
            continue
        value = values[name]
        if isinstance(value, str) and (value.startswith("/") or ".." in value.split("/")):
            raise ValueError(f"{path}{name} holds an absolute or rising path")
        if any(word in name.lower() for word in ("password", "secret", "token_key", "cookie")):
            raise ValueError(f"{path}{name} must not be in a configuration")
        out[name] = load_config(field.type, value, f"{path}{name}.") if is_dataclass(field.type) else tuple(value) if isinstance(value, list) else value
    return kind(**out)


def config_id(values: dict) -> str:
    return hashlib.sha256(json.dumps(values, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
