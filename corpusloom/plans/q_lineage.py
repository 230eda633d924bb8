"""Queries on joins that fail closed, manifests, splits, audits and coding sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import coding, leakage, lineage, metrics, sampling

from .q_corpus import keyed, table
from .q_eval import SCORED, rounded, scored
from .q_text import EXACT, POSTS, docs, posts
from .registry import add

ORDERS = "o_orderkey as post_id, o_orderkey % 3 as version"


def versions(spark, sf):
    """Orders as post versions with a state."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("post_id"), (F.col("o_orderkey") % 3).alias("version"), F.when(F.col("o_orderstatus") == "F", "usable").otherwise("invalid").alias("status"), "o_custkey")


add(
    "join_usable_versions",
    lambda s, d: lineage.usable_members(versions(s, d).filter("post_id % 4 = 0").select("post_id", "version"), versions(s, d), ["post_id", "version"]).select("post_id", "version", "status"),
    f"select {ORDERS}, 'usable' as status from orders where o_orderstatus = 'F' and o_orderkey % 4 = 0",
)
add(
    "join_bound_results",
    lambda s, d: lineage.bound(
        table(s, d, "orders").select("o_orderkey", "o_custkey").filter("o_orderkey % 5 = 0"), (table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), ["o_custkey"]), (table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), ["c_nationkey"])
    ).select("o_orderkey", "n_name"),
    "select o_orderkey, n_name from orders join customer on o_custkey = c_custkey join nation on n_nationkey = c_nationkey where o_orderkey % 5 = 0",
)
add(
    "join_coverage_states",
    lambda s, d: lineage.coverage(docs(s, d).select("doc_id", "source"), docs(s, d).filter("doc_id % 7 <> 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).alias("doc_id"), F.when(F.col("doc_id") % 13 == 0, "other").otherwise(F.col("source")).alias("source")), ["doc_id"], ("source",)),
    """with r as (select doc_id + case when doc_id % 11 = 0 then 1 else 0 end as doc_id, case when doc_id % 13 = 0 then 'other' else source end as source from documents where doc_id % 7 <> 0),
      n as (select doc_id, count(*) as n, min(source) as a, max(source) as b from r group by doc_id)
      select coalesce(d.doc_id, n.doc_id) as doc_id, case when n.n is null then 'missing' when d.doc_id is null then 'unexpected' when n.n > 1 then 'duplicate' when n.a <> d.source then 'changed' else 'covered' end as state
      from documents d full join n on n.doc_id = d.doc_id""",
)
add(
    "join_returned_tasks",
    lambda s, d: lineage.returned_tasks(docs(s, d).select("doc_id", "text"), docs(s, d).select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")), "doc_id", "text", "text_sha256").select("doc_id", "source", "text_sha256"),
    "select doc_id, source, sha256(text) as text_sha256 from documents",
)
add(
    "join_paired_members",
    lambda s, d: rounded(lineage.matched(scored(s, d).select("doc_id", "label", "source", "pa"), scored(s, d).select("doc_id", "label", "source", "pb"), ["doc_id"], ("label", "source")).select("doc_id", "label", (F.col("pb") - F.col("pa")).alias("delta"))),
    f"with {SCORED} select doc_id, label, round(pb - pa, 9) as delta from scored",
)
add(
    "join_untrained",
    lambda s, d: lineage.without_trained(docs(s, d).select("doc_id", "lang"), table(s, d, "labels"), ["doc_id"]),
    "select doc_id, lang from documents where doc_id not in (select doc_id from labels)",
)
add(
    "join_evidence_origins",
    lambda s, d: lineage.evidence({n: table(s, d, "labels").filter(F.col("doc_id") % 3 == k).select("doc_id", "quality") for k, n in enumerate(("final", "wave_a", "wave_b"))}, docs(s, d).select("doc_id", "source"), ["doc_id"]).groupBy("origin", "source").agg(F.count("*").alias("n"), F.sum("quality").alias("related")),
    "select case doc_id % 3 when 0 then 'final' when 1 then 'wave_a' else 'wave_b' end as origin, source, count(*) as n, sum(quality)::bigint as related from labels join documents using (doc_id) group by all",
)
add(
    "join_without_authors",
    lambda s, d: lineage.without_trained(table(s, d, "events").select("event_id", "user_id"), table(s, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id")), ["user_id"]),
    "select event_id, user_id from events where user_id not in (select c_custkey from customer where c_acctbal < 0)",
)
add(
    "check_lineage",
    lambda s, d: lineage.orphans(
        table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag"),
        {"open_order": (table(s, d, "orders").filter("o_orderstatus <> 'P'"), {"l_orderkey": "o_orderkey"}), "rich_supplier": (table(s, d, "supplier").filter("s_acctbal > 0"), {"l_suppkey": "s_suppkey"})},
        ["l_orderkey", "l_linenumber"],
    ).groupBy("lacks").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first")),
    """select 'open_order' as lacks, count(*) as n, min(l_orderkey) as first from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P') having count(*) > 0
      union all select 'rich_supplier', count(*), min(l_orderkey) from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0) having count(*) > 0""",
)
add(
    "set_overlaps",
    lambda s, d: lineage.overlaps({"a": docs(s, d).filter("doc_id % 2 = 0"), "b": docs(s, d).filter("doc_id % 3 = 0"), "c": table(s, d, "labels")}, ["doc_id"]),
    """with p as (select doc_id, 'a' as part from documents where doc_id % 2 = 0 union all select doc_id, 'b' from documents where doc_id % 3 = 0 union all select doc_id, 'c' from labels)
      select doc_id, string_agg(part, '|' order by part) as parts from p group by doc_id having count(*) > 1""",
)
add(
    "split_leaks",
    lambda s, d: lineage.split_leaks(table(s, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 10 == 0, "test").otherwise("train").alias("split")), "o_custkey"),
    "select o_custkey, 'test|train' as splits from orders group by o_custkey having count(distinct o_orderkey % 10 = 0) > 1",
)
add(
    "check_manifests",
    lambda s, d: lineage.manifests(docs(s, d), "source", ["doc_id"], ["doc_id", "lang"]),
    """select source, count(*) as members, sha256('[' || string_agg('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}', ',' order by doc_id) || ']') as sha256 from documents group by source""",
)


def split_rows(spark, sf):
    return lineage_split(keyed(spark, sf).join(table(spark, sf, "labels"), "doc_id").select("doc_id", (F.col("doc_id") % 50).alias("component"), "quality"))


def lineage_split(rows):
    return sampling.global_split(rows, "doc_id", sampling.hash_order("split", F.col("doc_id")), "component", "quality", 0.05, 0.2)


add("split_global", lambda s, d: split_rows(s, d).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("component").alias("components")))
add(
    "split_global_test",
    lambda s, d: split_rows(s, d).filter("split = 'test'").select("doc_id", "component"),
    """with r as (select doc_id, doc_id % 50 as component, row_number() over (order by doc_id desc) as k, count(*) over () as n from labels join documents using (doc_id))
      select doc_id, component from r where component in (select component from r where k <= ceil(n * 0.05))""",
)
DECIDED = """e as (select doc_id, quality, toxic, case when doc_id % 6 = 0 then 'manual_evidence' else 'model_route' end as source, case quality when 1 then 'keep' else 'exclude' end as action from labels)"""


def decision_faults(spark, sf):
    rows = table(spark, sf, "labels")
    source = F.when(F.col("doc_id") % 6 == 0, "manual_evidence").otherwise("model_route")
    decided = rows.select("doc_id", source.alias("source"), F.when(F.col("quality") == 1, "keep").otherwise("exclude").alias("action"))
    labels = rows.filter("doc_id % 18 <> 0").select("doc_id", F.when(F.col("toxic") == 1, "uncertain").when(F.col("quality") == 1, "related").otherwise("unrelated").alias("label"))
    routes = rows.select("doc_id", F.when(F.col("quality") == 1, "auto_keep").otherwise("auto_exclude").alias("route"), F.when(F.col("doc_id") % 5 == 0, "running").otherwise("completed").alias("status"))
    return lineage.decision_faults(decided, labels, routes, ["doc_id"])


add(
    "check_decisions",
    decision_faults,
    f"""with {DECIDED} select doc_id, source, case when source = 'manual_evidence' and doc_id % 18 <> 0 then 'other_action' else 'no_evidence' end as fault from e
      where (source = 'manual_evidence' and (doc_id % 18 = 0 or toxic = 1)) or (source = 'model_route' and doc_id % 5 = 0)""",
)


def sample_rows(spark, sf):
    frame = F.when(F.col("doc_id") % 3 == 0, "probability").when(F.col("doc_id") % 3 == 1, "targeted").otherwise("other")
    p = F.lit(1.0) / (F.col("doc_id") % 4 + 2)
    return docs(spark, sf).select("doc_id", "text", frame.alias("frame"), p.alias("probability"), F.when(F.col("doc_id") % 9 == 0, 1.0).otherwise(1 / p).alias("weight"), F.when(F.col("doc_id") % 10 == 0, "-").otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("text_sha256"))


add(
    "check_reference_sample",
    lambda s, d: lineage.sample_faults(sample_rows(s, d), ["doc_id"], {"probability": 10, "targeted": 20}),
    """with c as (select count(*) filter (where doc_id % 9 = 0) as w, count(*) filter (where doc_id % 10 = 0) as t, abs(count(*) filter (where doc_id % 3 = 0) - 10) as a, abs(count(*) filter (where doc_id % 3 = 1) - 20) as b, count(*) filter (where doc_id % 3 = 2) as o from documents)
      select 'unique_key' as rule, 0::bigint as violations union all select 'weight_is_inverse', w from c union all select 'text_digest', t from c union all select 'frame_probability', a from c union all select 'frame_targeted', b from c union all select 'frame_known', o from c""",
)
add(
    "check_reprojected",
    lambda s, d: lineage.reprojected(posts(s, d).withColumn("stored", F.when(F.col("doc_id") % 8 == 0, F.col("title")).otherwise(text.model_text(F.col("title"), F.col("body")))), text.model_text(F.col("title"), F.col("body")), ["doc_id"], "stored"),
    "select doc_id from documents where doc_id % 8 = 0",
)
add(
    "queue_prefix_pairs",
    lambda s, d: lineage.pairs_touching(
        table(s, d, "orders").select((F.col("o_orderkey") % 1000).alias("left"), F.col("o_custkey").alias("right")).distinct(), lineage.queue_prefix(sampling.global_rank(docs(s, d).select("doc_id"), sampling.hash_order("queue", F.col("doc_id")), F.col("doc_id")), 40), "doc_id"
    ),
    """with q as (select doc_id from documents order by sha256('queue|' || doc_id), doc_id limit 40) select distinct o_orderkey % 1000 as "left", o_custkey as "right" from orders where o_orderkey % 1000 in (select doc_id from q) or o_custkey in (select doc_id from q)""",
)
add(
    "source_latest_versions",
    lambda s, d: lineage.latest(table(s, d, "events").select("user_id", F.col("event_id").alias("version")), ["user_id"], "version"),
    "select user_id, max(event_id) as version from events group by user_id",
)
add(
    "text_profile_fields",
    lambda s, d: table(s, d, "customer").select(
        "c_custkey", text.verification(F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(" "), F.when(F.col("c_custkey") % 3 < 2, F.col("c_custkey") % 3)).alias("verification"),
        text.observation(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))).alias("followers"), text.any_text(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.lit(" "), F.lit(None)).alias("has_profile"),
        text.url_of(F.when(F.col("c_custkey") % 4 == 0, F.lit("  ")).otherwise(F.col("c_name")), F.lit("source")).alias("url"),
    ),
    """select c_custkey, case when c_custkey % 5 = 0 then c_name when c_custkey % 3 = 1 then 'VERIFIED' when c_custkey % 3 = 0 then 'UNVERIFIED' end as verification, case when c_acctbal > 0 then 'OBSERVED' else 'MISSING' end as followers,
      c_custkey % 2 = 0 as has_profile, case when c_custkey % 4 = 0 then 'source' else c_name end as url from customer""",
)
add(
    "text_strong_conflicts",
    lambda s, d: text.without_texts(docs(s, d).select("doc_id", "text"), "text").join(scored(s, d).select("doc_id", text.strong_conflict(F.when(F.col("label") == 1, "related").otherwise("unrelated"), F.col("pa")).alias("conflict")), "doc_id").filter("conflict").select("doc_id", "text_sha256"),
    f"with {SCORED} select doc_id, sha256(text) as text_sha256 from scored join documents using (doc_id) where (label = 1 and pa >= 0.9) or (label = 0 and pa <= 1 - 0.9)",
)
#: Model texts, and whether a Delta document is left in them.
RESIDUE = (
    (1, '[TITLE]\nt\n[BODY]\n {"ops":[{"insert":"a"}]}', True), (2, "[TITLE]\nt\n[BODY]\nplain", False), (3, "no mark", True), (4, '[TITLE]\nt\n[BODY]\n{"ops":{}}', False), (5, '[TITLE]\nt\n[BODY]\n{"ops": [', False),
    (6, '[TITLE]\nt\n[BODY]\nsays {"ops":[]}', False), (7, "[TITLE]\nt\n[BODY]\n", False), (8, None, True),
)
add(
    "text_residue_forms",
    lambda s, d: s.createDataFrame([x[:2] for x in RESIDUE], "i int, text string").select("i", text.has_residue(F.col("text")).alias("residue")),
    "select * from (values " + ", ".join(f"({i}, {str(r).lower()})" for i, _, r in RESIDUE) + ") v(i, residue)",
)


def audited(spark, sf):
    action = F.when(F.col("pa") <= 0.3, "auto_keep").when(F.col("pa") >= 0.7, "auto_exclude").otherwise("manual")
    return sampling.audit_sample(scored(spark, sf).select("doc_id", action.alias("action")), 10, "audit-1", "doc_id", ("auto_keep", "auto_exclude"))


add(
    "sample_audit",
    audited,
    f"""with {SCORED}, a as (select doc_id, case when pa <= 0.3 then 'auto_keep' when pa >= 0.7 then 'auto_exclude' else 'manual' end as action from scored),
      r as (select *, row_number() over (partition by action order by sha256('audit-1|draw|' || doc_id), doc_id) as k from a where action <> 'manual')
      select doc_id, action, substr(sha256('audit-1|task|' || doc_id), 1, 24) as task_id, row_number() over (order by sha256('audit-1|shuffle|' || doc_id), doc_id) as position from r where k <= 10""",
)
add(
    "sample_text_pilot",
    lambda s, d: sampling.one_per_author(table(s, d, "events").select("event_id", "user_id"), table(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id")), "user_id", "event_id", "pilot"),
    "select event_id, user_id from events where user_id in (select c_custkey from customer where c_acctbal > 0) qualify row_number() over (partition by user_id order by sha256('pilot|' || event_id), event_id) = 1",
)
add(
    "sample_task_plan",
    lambda s, d: sampling.task_plan(sampling.global_rank(docs(s, d).select("doc_id"), sampling.hash_order("plan", F.col("doc_id")), F.col("doc_id")), table(s, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", 30, 12),
    """with r as (select doc_id, row_number() over (order by sha256('plan|' || doc_id), doc_id) as rank from documents)
      select doc_id, rank, case when rank <= 30 then 'needed' else 'reserve' end as role, quality as prior_label from r left join labels using (doc_id) where rank <= 42""",
)
add(
    "eval_length_subgroups",
    lambda s, d: rounded(metrics.subgroup_metrics(scored(s, d).withColumn("long", F.col("size") > 1500), "pa", "label", "long").select("long", "tp", "fp", "fn", "tn", "f1", "accuracy")),
    f"""with {SCORED}, c as (select size > 1500 as long, count(*) filter (where pa >= 0.5 and label = 1) as tp, count(*) filter (where pa >= 0.5 and label = 0) as fp, count(*) filter (where pa < 0.5 and label = 1) as fn, count(*) filter (where pa < 0.5 and label = 0) as tn from scored group by long)
      select *, round(coalesce(2 * tp / (2 * tp + fp + fn), 0), 9) as f1, round((tp + tn) / (tp + fp + fn + tn), 9) as accuracy from c where tp + fn > 0 and fp + tn > 0""",
)
add(
    "eval_directional",
    lambda s, d: metrics.directional(scored(s, d), "pa", "pb", "label"),
    f"""with {SCORED}, c as (select count(*) filter (where pa >= 0.5 and label = 0) as false_positive_before, count(*) filter (where pb >= 0.5 and label = 0) as false_positive_after, count(*) filter (where pa < 0.5 and label = 1) as false_negative_before,
      count(*) filter (where pb < 0.5 and label = 1) as false_negative_after, count(*) filter (where (pa >= 0.5) <> (label = 1) and (pb >= 0.5) = (label = 1)) as mended, count(*) filter (where (pa >= 0.5) = (label = 1) and (pb >= 0.5) <> (label = 1)) as broken from scored)
      select *, false_positive_after <= false_positive_before and false_negative_after <= false_negative_before as passes from c""",
)


def coded(spark, sf):
    fields = spark.createDataFrame([("D1", "topic"), ("D2", "tone")], "dimension_code string, field_name string")
    coders = spark.createDataFrame([("a",), ("b",)], "coder string")
    return coding.coding_rows(docs(spark, sf).select(F.col("doc_id").alias("unit_id"), "source"), fields, coders, "pilot-1").select("unit_id", "field_name", "coder", "annotation_id", "label_value")


add(
    "coding_rows",
    coded,
    """select doc_id as unit_id, field_name, coder, 'ANN-' || substr(sha256('pilot-1' || chr(31) || coder || chr(31) || doc_id || chr(31) || field_name), 1, 20) as annotation_id, '' as label_value
      from documents, (values ('topic'), ('tone')) f(field_name), (values ('a'), ('b')) c(coder)""",
)


def duplicate_rows(spark, sf):
    members = keyed(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("body").alias("text"), F.col("quality").alias("label"), "key")
    return members.drop("key"), leakage.star_edges(members.select("id", "key"), "key").union(members.filter("id % 25 = 0").select(F.col("id").alias("left"), (F.col("id") + 1).alias("right")))


def planned(spark, sf):
    members, edges = duplicate_rows(spark, sf)
    return leakage.duplicate_plan(members, edges.join(members.select(F.col("id").alias("right")), "right", "left_semi").select("left", "right"))


EDGES = """m as (select k.doc_id as id, k.body as text, l.quality as label, k.key from keyed k left join labels l using (doc_id)),
  e as (select min(id) over (partition by key) as a, id as b from m union select id, id + 1 from m where id % 25 = 0 and id + 1 in (select id from m)), sym as (select a, b from e union select b, a from e),
  comp(v, c) using key (v) as (select a, least(a, min(b)) from sym group by a union select sym.a, min(comp.c) from comp join sym on sym.b = comp.v join recurring.comp as was on was.v = sym.a where comp.c < was.c group by sym.a)"""
add(
    "graph_duplicate_plan",
    planned,
    f"""with recursive {POSTS}, keyed as (select *, {EXACT} as key from posts), {EDGES},
      r as (select m.*, c as root, row_number() over (partition by c order by length(regexp_replace(text, '\\s', '', 'g')) desc, id) = 1 as is_representative, count(*) over (partition by c) as size, min(label) over (partition by c) <> max(label) over (partition by c) as conflict from m join comp on v = id)
      select id, root, is_representative, not is_representative and size > 1 and not coalesce(conflict, false) as excluded, case when coalesce(conflict, false) then 'label_conflict' when size > 1 then 'resolved' else 'single' end as state from r""",
)


def joint(spark, sf):
    """Blocks of four ids as components, of which the first two of each three are joined by one confirmed pair."""
    ids = docs(spark, sf).select(F.col("doc_id").alias("id"))
    pairs = ids.filter("id % 12 = 3").select(F.col("id").alias("left"), (F.col("id") + 1).alias("right"))
    return leakage.joint_components(ids.withColumn("component", F.col("id") - F.col("id") % 4), pairs.join(ids.withColumnRenamed("id", "right"), "right", "left_semi"))


add(
    "graph_joint_components",
    joint,
    """with b as (select doc_id, doc_id // 4 as k, min(doc_id) over (partition by doc_id // 4) as m from documents), p as (select x.k + 1 as k, x.m as up from b x join b y on y.doc_id = x.doc_id + 1 where x.doc_id % 12 = 3)
      select doc_id as id, 4 * b.k as initial, coalesce(up, m) as joint from b left join p on p.k = b.k""",
)
