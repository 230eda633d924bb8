"""Joins that fail closed, on small tables."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import leakage, lineage, sampling


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_coverage(spark):
    left = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (3, "a"), (5, None), (6, None), (None, "a")], "k int, s string")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a"), (5, None), (6, "a")], "k int, s string")
    states = {1: "covered", 2: "changed", 3: "duplicate", 4: "unexpected", 5: "covered", 6: "changed", None: "missing"}
    assert {r.k: r.state for r in lineage.coverage(left, right, ["k"], ("s",)).collect()} == states
    with pytest.raises(lineage.LineageError):
        lineage.matched(left, right, ["k"])
    assert got(lineage.matched(left.filter("k in (1, 5)"), right.filter("k in (1, 5)").withColumn("x", F.lit(1)), ["k"], ("s",))) == [(1, "a", 1), (5, None, 1)]
    assert lineage.coverage(left.limit(0), right.limit(0), ["k"]).count() == 0


def test_bound(spark):
    members = spark.createDataFrame([(1, 10), (2, 20)], "k int, p int")
    table = spark.createDataFrame([(1, "usable"), (2, "invalid"), (2, "usable"), (3, "usable")], "k int, status string")
    for rows in (table, table.filter("k <> 2")):
        with pytest.raises(lineage.LineageError):
            lineage.bound(members, (rows, ["k"]))
    assert got(lineage.usable_members(members, table.filter("k <> 2 or status = 'invalid'"), ["k"])) == [(1, 10, "usable")]
    with pytest.raises(lineage.LineageError):
        lineage.without_trained(members, table, ["k"], strict=True)
    assert lineage.without_trained(members, table.filter("k = 3"), ["k"], strict=True).count() == 2


def test_returned_tasks(spark):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    tasks = spark.createDataFrame([(1, "x", "yes"), (2, "y", "no")], "task int, text string, label string")
    private = spark.createDataFrame([(1, digest("x")), (2, digest("y"))], "task int, sha string")
    assert lineage.returned_tasks(tasks, private, "task", "text", "sha").count() == 2
    for wrong in (private.withColumn("sha", F.lit(digest("x"))), private.filter("task = 1")):
        with pytest.raises(lineage.LineageError):
            lineage.returned_tasks(tasks, wrong, "task", "text", "sha")


def test_manifests(spark):
    rows = [(g, i, f"é{i}" if i % 3 else None) for g in (1, None, 2) for i in range(50)]
    table = spark.createDataFrame(rows, "g int, i int, t string").repartition(7)
    out = {r.g: (r.members, r.sha256) for r in lineage.manifests(table, "g", ["i"], ["i", "t"]).collect()}
    for g in (1, None, 2):
        want = json.dumps([{"i": i, "t": t} for x, i, t in rows if x == g], ensure_ascii=False, separators=(",", ":"))
        assert out[g] == (50, hashlib.sha256(want.encode()).hexdigest())
    assert lineage.manifests(table.limit(0), "g", ["i"], ["i", "t"]).count() == 0


def test_component_ids(spark):
    rows = spark.createDataFrame([(x,) for x in ("a", "b\"", "c", "d")], "id string")
    edges = spark.createDataFrame([("a", "c"), ("c", "b\"")], "left string, right string")
    out = {r.id: r for r in leakage.component_ids(rows, edges).collect()}
    digest = lambda m: hashlib.sha256(json.dumps(m, separators=(",", ":")).encode()).hexdigest()[:32]
    assert out["c"].root == "a" and out["c"].size == 3 and out["c"].component_id == digest(["a", "b\"", "c"]) and out["d"].component_id == digest(["d"])


def test_global_split(spark):
    rows = spark.createDataFrame([(i, i % 40, int(i % 3 == 0)) for i in range(400)], "t int, c int, y int")
    out = sampling.global_split(rows, "t", F.col("t"), "c", "y", 0.05, 0.2)
    assert lineage.split_leaks(out, "c").count() == 0 and out.count() == 400
    sizes = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes["test"] == 200 and 30 <= sizes["validation"] <= 50 and out.filter("t >= 380 and split <> 'test'").count() == 0
    assert {r.y for r in out.filter("split = 'validation'").collect()} == {0, 1}


def test_global_split_without_folds(spark):
    split = lambda rows, **more: sampling.global_split(spark.createDataFrame(rows, "t int, c int, y int"), "t", F.col("t"), "c", "y", 0.05, 0.2, **more)
    everywhere = [(i, i % 10, int(i % 3 == 0)) for i in range(400)]  # the latest 20 touch all components
    assert [tuple(r) for r in split(everywhere).groupBy("split").count().collect()] == [("test", 400)]
    one_left = [(i, i % 10 if i < 380 else i % 9, int(i % 3 == 0)) for i in range(400)]
    out = split(one_left)
    assert {r.c for r in out.filter("split = 'train'").collect()} == {9} and {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"test": 362, "train": 38}
    for rows in (everywhere, one_left):
        with pytest.raises(ValueError):
            split(rows, strict=True)


def test_split_query_without_folds(spark, tmp_path):
    import duckdb

    from corpusloom.plans import registry

    registry.load()
    con = duckdb.connect()
    # The latest 5 % of the labelled rows touch all components but one, or all.
    for case, latest in (("one", 49), ("all", 50)):
        spark.range(1100).filter(f"id < 1000 or id % 50 < {latest}").selectExpr("id as doc_id", "'t' as text", "'s' as source", "'en' as lang").coalesce(1).write.parquet(f"{tmp_path}/{case}/documents.parquet")
        spark.range(1100).selectExpr("id as doc_id", "id % 3 % 2 as quality", "0 as toxic").coalesce(1).write.parquet(f"{tmp_path}/{case}/labels.parquet")
        for t in ("documents", "labels"):
            con.sql(f"create or replace view {t} as select * from '{tmp_path}/{case}/{t}.parquet/*.parquet'")
        got = sorted(tuple(r) for r in registry.QUERIES["split_global_test"](spark, f"{tmp_path}/{case}").collect())
        assert got == sorted(con.sql(registry.SQL["split_global_test"]).fetchall()) and len({c for _, c in got}) == latest


def test_audit_short(spark):
    rows = spark.createDataFrame([(i, "keep" if i % 2 else "exclude") for i in range(10)], "k int, action string")
    assert sampling.audit_sample(rows, 5, "a", "k", ("keep", "exclude")).count() == 10
    with pytest.raises(ValueError):
        sampling.audit_sample(rows, 6, "a", "k", ("keep", "exclude"))


def test_frame_order(spark):
    rows = spark.createDataFrame([("x", 1), ("b", 2), ("a", 3), ("a", 1), (None, 0)], "frame string, rank int")
    assert [tuple(r) for r in lineage.in_frame_order(rows, ("a", "b"), "rank").collect()] == [("a", 1), ("a", 3), ("b", 2), (None, 0), ("x", 1)]
