"""Groups that must not be torn apart: components over authors, exact clusters and confirmed pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.tables import stage

from .components import connected_components
from .lineage import streamed_digests


def star_edges(rows: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """(left, right): each member of a group with its least one; a null key makes no edge."""
    least = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_col).alias("left"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(least, key).filter(F.col("left") != F.col(id_col)).select("left", F.col(id_col).alias("right"))


def component_ids(rows: DataFrame, edges: DataFrame, id_col: str = "id", length: int = 32) -> DataFrame:
    """Each id with its component's root, size, and an identifier hashed from the sorted members."""
    roots = connected_components(edges)
    rooted = rows.select(F.col(id_col).alias("id")).join(roots.withColumnRenamed("vertex", "id"), "id", "left").withColumn("root", F.coalesce("component", "id"))
    rooted = stage(rooted.select("id", "root"), "rooted")

    token = F.to_json(F.array("id"))
    tokens = rooted.select(F.col("root").alias("group"), F.col("id").alias("__o0"), F.substring(token, F.lit(2), F.length(token) - 2).alias("token"))
    named = streamed_digests(tokens, 1, rooted.schema["root"].dataType)
    named = named.select(F.col("group").alias("root"), F.col("members").alias("size"), F.substring("sha256", 1, length).alias("component_id"))
    return rooted.join(named, "root").select("id", "root", "size", "component_id")


def leakage_groups(posts: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Components of posts (id, author, cluster) joined by author, exact cluster and confirmed pairs.

    ``confirmed`` (left_cluster, right_cluster) links the least members of two
    clusters but flags all of their members. A blank author never joins posts.
    Returns ``id, root, size, component_id, by_author, by_exact, by_confirmed``.
    """
    known = stage(posts.select("id", F.nullif(F.trim("author"), F.lit("")).alias("author"), "cluster"), "leakage-posts")
    first = known.groupBy("cluster").agg(F.min("id").alias("m"))
    linked = (
        confirmed.join(first.select(F.col("cluster").alias("left_cluster"), F.col("m").alias("left")), "left_cluster")
        .join(first.select(F.col("cluster").alias("right_cluster"), F.col("m").alias("right")), "right_cluster")
        .select("left", "right")
    )
    edges = star_edges(known, "author").union(star_edges(known, "cluster")).union(linked)
    touched = confirmed.select(F.col("left_cluster").alias("cluster")).union(confirmed.select("right_cluster")).distinct().withColumn("by_confirmed", F.lit(True))
    authors = known.filter("author is not null").groupBy("author").agg((F.count(F.lit(1)) > 1).alias("by_author"))
    clusters = known.groupBy("cluster").agg((F.count(F.lit(1)) > 1).alias("by_exact"))
    flags = known.join(authors, "author", "left").join(clusters, "cluster").join(touched, "cluster", "left")
    no = F.lit(False)
    flags = flags.select("id", F.coalesce("by_author", no).alias("by_author"), F.coalesce("by_exact", no).alias("by_exact"), F.coalesce("by_confirmed", no).alias("by_confirmed"))
    return component_ids(known, edges).join(flags, "id")


def representatives(members: DataFrame) -> DataFrame:
    """Of (id, root, text) rows: the fullest text of each component stands for it, then the least id."""
    fullness = F.length(F.regexp_replace("text", r"(?U)\s", ""))
    best = members.groupBy("root").agg(F.min(F.struct((-F.coalesce(fullness, F.lit(-1))).alias("lack"), F.col("id"))).alias("best"))
    return members.join(best.select("root", F.col("best.id").alias("__best")), "root").withColumn("is_representative", F.col("id") == F.col("__best")).drop("__best")


def label_conflicts(members: DataFrame, label: str = "label") -> DataFrame:
    """Components of (root, label) rows whose members carry more than one label."""
    return members.filter(F.col(label).isNotNull()).groupBy("root").agg(F.count_distinct(label).alias("labels"), F.count(F.lit(1)).alias("members")).filter("labels > 1")


def crowded_components(members: DataFrame, accepted: DataFrame) -> DataFrame:
    """Components with more than one accepted member: each is a violation."""
    return members.join(accepted, "id", "left_semi").groupBy("root").agg(F.count(F.lit(1)).alias("accepted")).filter("accepted > 1")


def joint_components(initial: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(id, initial, joint): components of (id, component) rows after confirmed pairs (left, right) of ids were added; none is torn."""
    least = initial.groupBy("component").agg(F.min("id").alias("left"))
    star = initial.join(least, "component").filter(F.col("id") != F.col("left")).select("left", F.col("id").alias("right"))
    joint = connected_components(star.union(confirmed.select("left", "right")))
    met = initial.join(joint.select(F.col("vertex").alias("id"), F.col("component").alias("joint")), "id", "left")
    return met.select("id", F.col("component").alias("initial"), F.coalesce("joint", "id").alias("joint"))


def duplicate_plan(members: DataFrame, confirmed: DataFrame) -> DataFrame:
    """What becomes of (id, text, label) rows under confirmed duplicate pairs: component, representative, ``excluded`` and ``state``.

    The fullest text of a component stands for it and the others are excluded,
    unless their labels differ (``label_conflict``), when nothing is decided.
    """
    edges = confirmed.select("left", "right")
    roots = connected_components(edges).withColumnRenamed("vertex", "id")
    rooted = stage(members.join(roots, "id", "left").withColumn("root", F.coalesce("component", "id")).drop("component"), "duplicate-plan")
    kinds = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("size"), (F.min("label") != F.max("label")).alias("conflict"))
    out = representatives(rooted).join(kinds, "root")
    state = F.when(F.coalesce("conflict", F.lit(False)), "label_conflict").when(F.col("size") > 1, "resolved").otherwise("single")
    return out.select("id", "root", "is_representative", ((state == "resolved") & ~F.col("is_representative")).alias("excluded"), state.alias("state"))
