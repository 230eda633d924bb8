"""Queries on duplicates, components, joins, set operations, sampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text, values
from corpusloom.operators import duplicates, leakage, sampling
from corpusloom.operators.components import connected_components
from corpusloom.plans.tables import read_table, stage

from .q_text import EXACT, POSTS, docs, posts
from .registry import add


def table(spark, sf, name):
    return read_table(spark, sf, name)


def keyed(spark, sf):
    return posts(spark, sf).withColumn("key", text.exact_key(F.col("title"), F.col("body")))


KEYED = f"{POSTS}, keyed as (select *, {EXACT} as key from posts)"
LABELLED = "labelled as (select d.doc_id, d.source, d.lang, length(d.text) as n, case l.quality when 1 then 'related' else 'unrelated' end as label, l.toxic from documents d join labels l using (doc_id))"

add(
    "exact_clusters",
    lambda s, d: duplicates.exact_clusters(keyed(s, d), "key", "doc_id", "source"),
    f"with {KEYED} select key, min(doc_id) as representative, count(*) as size, min(source) <> max(source) as is_cross_platform from keyed group by key",
)
add(
    "exact_cluster_members",
    lambda s, d: duplicates.exact_members(keyed(s, d), "key", "doc_id").select("doc_id", "representative", "size"),
    f"with {KEYED} select doc_id, min(doc_id) over (partition by key) as representative, count(*) over (partition by key) as size from keyed",
)
add(
    "cluster_label_conflicts",
    lambda s, d: duplicates.conflicts(keyed(s, d).join(table(s, d, "labels"), "doc_id").withColumn("cluster", F.substring("key", 1, 2)), "cluster", "quality"),
    f"with {KEYED} select substr(key, 1, 2) as cluster, count(distinct quality) as decisions, count(*) as rows from keyed join labels using (doc_id) group by cluster having count(distinct quality) > 1",
)


def near_texts(spark, sf):
    """Representatives of the exact clusters with their near text."""
    first = keyed(spark, sf).groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    return posts(spark, sf).join(first, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), text.near_text(F.col("title"), F.col("body")).alias("text"))


NEAR = f"""{KEYED}, t as (select doc_id as id, regexp_replace(title || chr(10) || body, '^\\s+|\\s+$', '', 'g') as text from keyed where doc_id in (select min(doc_id) from keyed group by key)),
  big as (select * from t where length(replace(text, chr(10), '')) >= 3), total as (select count(*) as nd from big),
  lines as (select id, unnest(string_split(text, chr(10))) as line from big),
  lg as (select distinct id, unnest(flatten([list_transform(generate_series(1, length(line) - s + 1), lambda i: line[i:i + s - 1]) for s in [3, 4, 5]])) as gram from lines),
  df as (select gram, count(*) as df from lg group by gram having count(*) between 2 and greatest(2, least(200, (select nd * 50000 // 1000000 from total)))),
  keys as (select id, gram, df, row_number() over (partition by id order by df, length(gram) desc, gram) as k from lg join df using (gram) qualify k <= 12),
  bp as (select a.id as "left", b.id as "right", count(*) as shared from keys a join keys b on a.gram = b.gram and a.id < b.id group by all)"""

add(
    "sim_blocking_keys",
    lambda s, d: duplicates.blocking_keys(stage(near_texts(s, d), "near-texts")),
    f"with {NEAR} select id, gram, df from keys",
)
add("sim_blocked_pairs", lambda s, d: duplicates.blocked_pairs(stage(duplicates.blocking_keys(stage(near_texts(s, d), "near-texts")), "blocking-keys")), f'with {NEAR} select "left", "right", shared from bp')
add(
    "sim_near_pairs",
    lambda s, d: duplicates.near_pairs(near_texts(s, d)).select("left", "right", F.floor(F.col("similarity_ppm") / 10).alias("similarity_10ppm"), "length_ratio_ppm", "shared"),
    f"""with {NEAR}, sized as (select bp.*, least(length(a.text), length(b.text)) * 1000000 // greatest(length(a.text), length(b.text)) as length_ratio_ppm
        from bp join big a on a.id = "left" join big b on b.id = "right"),
      one as (select id, regexp_replace(text, '\\s\\s+', ' ', 'g') as x from big),
      g as (select id, gram, count(*) as n from (select id, unnest(flatten([list_transform(generate_series(1, length(x) - s + 1), lambda i: x[i:i + s - 1]) for s in [3, 4, 5]])) as gram from one) group by all),
      f as (select gram, ln((1.0 + (select nd from total)) / (1 + count(*))) + 1 as idf from g group by gram having count(*) between 2 and (select greatest(2, floor(0.995 * nd)) from total)),
      w as (select id, gram, (1 + ln(n)) * idf as w from g join f using (gram)), l as (select id, sqrt(sum(w * w)) as len from w group by id),
      s as (select p."left", p."right", sum(a.w * b.w) / any_value(la.len * lb.len) as s from sized p join w a on a.id = p."left" join w b on b.id = p."right" and b.gram = a.gram
        join l la on la.id = p."left" join l lb on lb.id = p."right" where length_ratio_ppm >= 500000 group by all),
      q as (select *, greatest(0, least(1000000, floor(s * 1e6 + 0.5)))::bigint as ppm from s)
      select q."left", q."right", ppm // 10 as similarity_10ppm, length_ratio_ppm, shared from q join sized using ("left", "right") where ppm >= 800000""",
)
add(
    "sim_all_pairs",
    lambda s, d: duplicates.all_pairs(table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text", F.sha2(F.col("text").cast("binary"), 256).alias("hash")), 0.15),
    """with one as (select item_id as id, text, regexp_replace(text, '\\s\\s+', ' ', 'g') as x from benchmark), total as (select count(*) as nd from one),
      g as (select id, gram, count(*) as n from (select id, unnest(flatten([list_transform(generate_series(1, length(x) - s + 1), lambda i: x[i:i + s - 1]) for s in [3, 4, 5]])) as gram from one) group by all),
      f as (select gram, ln((1.0 + (select nd from total)) / (1 + count(*))) + 1 as idf from g group by gram), w as (select id, gram, n * idf as w from g join f using (gram)),
      l as (select id, sqrt(sum(w * w)) as len from w group by id),
      s as (select a.id as "left", b.id as "right", sum(a.w * b.w) / any_value(la.len * lb.len) as s from w a join w b on a.gram = b.gram and a.id < b.id join l la on la.id = a.id join l lb on lb.id = b.id group by all)
      select "left", "right", case when x.text = y.text then 'exact_normalized_hash' else 'text_similarity' end as reason, round(s, 6) as similarity
      from s join one x on x.id = "left" join one y on y.id = "right" where s >= 0.15 or x.text = y.text""",
)


def cluster_edges(spark, sf):
    return leakage.star_edges(keyed(spark, sf).select(F.col("doc_id").alias("id"), "key"), "key")


CC = """sym as (select a, b from e union select b, a from e), reach(v, r) as (select a, a from sym union select sym.b, reach.r from reach join sym on sym.a = reach.v),
  comp as (select v, min(r) as component from reach group by v)"""
add(
    "graph_components",
    lambda s, d: connected_components(table(s, d, "events").select((F.col("user_id") + 1_000_000).alias("left"), (F.col("event_id") % 997).alias("right"))),
    """with recursive e as (select distinct user_id + 1000000 as a, event_id % 997 as b from events), sym as (select a, b from e union select b, a from e),
      comp(v, c) using key (v) as (select a, least(a, min(b)) from sym group by a union
        select sym.a, min(comp.c) from comp join sym on sym.b = comp.v join recurring.comp as was on was.v = sym.a where comp.c < was.c group by sym.a)
      select v as vertex, c as component from comp""",
)


def leakage_posts(spark, sf):
    """Documents as posts: a hash bucket as author (blank for some), exact clusters, and confirmed pairs between neighbours."""
    p = keyed(spark, sf).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a"), (F.col("doc_id") % 17 + F.col("doc_id") % 100 * 100).cast("string"))).otherwise(" ").alias("author"), F.col("key").alias("cluster"))
    firsts = p.groupBy("cluster").agg(F.min("id").alias("m"))
    pairs = firsts.alias("a").join(firsts.alias("b"), F.expr("a.m % 40 = 0 and b.m = a.m + 1")).select(F.col("a.cluster").alias("left_cluster"), F.col("b.cluster").alias("right_cluster"))
    return p, pairs


add(
    "graph_leakage_groups",
    lambda s, d: leakage.leakage_groups(*leakage_posts(s, d)),
    f"""with recursive {KEYED}, p as (select doc_id as id, case when doc_id % 3 = 0 then 'a' || (doc_id % 17 + doc_id % 100 * 100) end as author, key as cluster from keyed),
      f as (select cluster, min(id) as m from p group by cluster), c as (select x.cluster as lc, y.cluster as rc, x.m as a, y.m as b from f x join f y on x.m % 40 = 0 and y.m = x.m + 1),
      e as (select min(id) over (partition by author) as a, id as b from p where author is not null union select min(id) over (partition by cluster), id from p union select a, b from c), {CC},
      m as (select component as root, count(*) as size, substr(sha256(replace(to_json(list(v order by v))::varchar, ' ', '')), 1, 32) as component_id from comp group by component),
      au as (select author, count(*) > 1 as x from p where author is not null group by author), ex as (select cluster, count(*) > 1 as x from p group by cluster)
      select p.id, comp.component as root, m.size, m.component_id, coalesce(au.x, false) as by_author, ex.x as by_exact, p.cluster in (select lc from c union select rc from c) as by_confirmed
      from p join comp on comp.v = p.id join m on m.root = comp.component left join au on au.author = p.author join ex on ex.cluster = p.cluster""",
)
add(
    "graph_representatives",
    lambda s, d: leakage.representatives(keyed(s, d).select(F.col("doc_id").alias("id"), F.col("source").alias("root"), F.col("body").alias("text"))).filter("is_representative").select("id", "root"),
    f"with {KEYED} select doc_id as id, source as root from keyed qualify row_number() over (partition by source order by length(regexp_replace(body, '\\s', '', 'g')) desc, doc_id) = 1",
)
add(
    "graph_label_conflicts",
    lambda s, d: leakage.label_conflicts(keyed(s, d).join(table(s, d, "labels"), "doc_id").select(F.col("source").alias("root"), F.col("quality").alias("label"))),
    f"with {KEYED} select source as root, count(distinct quality) as labels, count(quality) as members from keyed join labels using (doc_id) group by source having count(distinct quality) > 1",
)
add(
    "graph_crowded_components",
    lambda s, d: leakage.crowded_components(keyed(s, d).select(F.col("doc_id").alias("id"), F.col("key").alias("root")), table(s, d, "labels").select(F.col("doc_id").alias("id"))),
    f"with {KEYED} select key as root, count(*) as accepted from keyed where doc_id in (select doc_id from labels) group by key having count(*) > 1",
)
# Joins and set operations.
add(
    "join_three_way",
    lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")),
    "select c_mktsegment, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by c_mktsegment",
)
add(
    "join_components_anti",
    lambda s, d: sampling.without_touched_components(keyed(s, d).select("doc_id", "source", "key"), "key", table(s, d, "labels"), "doc_id").select("doc_id", "source"),
    f"with {KEYED} select doc_id, source from keyed where key not in (select key from keyed where doc_id in (select doc_id from labels))",
)


def benchmark_hits(spark, sf, size=8):
    """Documents that share a run of words with a benchmark item: one hashed key per run, no text in the shuffle."""
    runs = lambda t, i: t.select(i, F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("w")).filter(F.size("w") >= size).select(
        i, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (size - 1)), lambda k: F.xxhash64(F.array_join(F.slice("w", k, size), " "))))).alias("run")
    )
    protected = runs(table(spark, sf, "benchmark"), "item_id").select("run").distinct()
    return runs(docs(spark, sf), "doc_id").join(protected, "run", "left_semi").groupBy("doc_id").agg(F.count("*").alias("runs"))


add(
    "join_benchmark_overlap",
    benchmark_hits,
    """with w as (select doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') as w from documents), b as (select string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') as w from benchmark),
      r as (select distinct doc_id, unnest(list_transform(generate_series(1, len(w) - 7), lambda k: array_to_string(w[k:k + 7], ' '))) as run from w where len(w) >= 8),
      p as (select distinct unnest(list_transform(generate_series(1, len(w) - 7), lambda k: array_to_string(w[k:k + 7], ' '))) as run from b where len(w) >= 8)
      select doc_id, count(*) as runs from r where run in (select run from p) group by doc_id""",
)
add(
    "join_evidence_by_hash",
    lambda s, d: keyed(s, d).select("doc_id", "key").join(keyed(s, d).join(table(s, d, "labels"), "doc_id").groupBy("key").agg(F.min("quality").alias("inherited")), "key", "left").groupBy("inherited").agg(F.count("*").alias("n")),
    f"with {KEYED}, h as (select key, min(quality) as inherited from keyed join labels using (doc_id) group by key) select inherited, count(*) as n from keyed left join h using (key) group by inherited",
)
add(
    "join_full_coverage",
    lambda s, d: table(s, d, "documents").select("doc_id", "source").join(table(s, d, "labels").select(F.col("doc_id").alias("l_id"), "quality"), F.col("doc_id") == F.col("l_id"), "full_outer").select(F.when(F.col("l_id").isNull(), "missing").when(F.col("doc_id").isNull(), "unexpected").otherwise("covered").alias("state")).groupBy("state").agg(F.count("*").alias("n")),
    "select case when l.doc_id is null then 'missing' when d.doc_id is null then 'unexpected' else 'covered' end as state, count(*) as n from documents d full join labels l on d.doc_id = l.doc_id group by state",
)
def control_rows(spark, sf, toxic):
    """Labelled documents as cases (toxic) or controls, with a split by the id and a length band."""
    rows = docs(spark, sf).join(table(spark, sf, "labels").filter(F.col("toxic") == toxic), "doc_id")
    size = F.length("text")
    return rows.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.when(F.col("doc_id") % 3 == 0, "validation").otherwise("training").alias("split"), F.floor(F.log2(size + 1)).alias("band"), size.cast("long").alias("size"))


def matched(spark, sf):
    """Each case with a control of its own label and split; groups with too few controls are left out."""
    cases, pool = control_rows(spark, sf, 1), control_rows(spark, sf, 0)
    key = ["label", "split"]
    enough = cases.groupBy(*key).agg(F.count("*").alias("n")).join(pool.groupBy(*key).agg(F.count("*").alias("m")), key).filter("m >= n").select(*key)
    return sampling.nearest_controls(cases.join(enough, key, "left_semi"), pool, key, "band", "size")


add("join_nearest_controls", matched)
# The first step alone: the k-th case of a band by id gets its k-th control in hash order.
add(
    "join_banded_controls",
    lambda s, d: matched(s, d).filter("matching = 'band'"),
    """with r as (select doc_id as id, quality as label, case when doc_id % 3 = 0 then 'validation' else 'training' end as split, floor(log2(length(text) + 1))::bigint as band, length(text) as size, toxic from documents join labels using (doc_id)),
      g as (select label, split from r group by all having count(*) filter (where toxic = 1) between 1 and count(*) filter (where toxic = 0)),
      a as (select *, row_number() over (partition by label, split, band order by id) as k from r join g using (label, split) where toxic = 1),
      b as (select *, row_number() over (partition by label, split, band order by sha256('controls|' || id)) as k from r where toxic = 0)
      select a.id as "case", b.id as control, label, split, 'band' as matching, a.size - b.size as difference from a join b using (label, split, band, k)""",
)
add(
    "set_equality",
    lambda s, d: _set_report(s, d),
    """select 'documents_labels' as pair, (select count(*) from (select doc_id from documents except select doc_id from labels)) as only_left, (select count(*) from (select doc_id from labels except select doc_id from documents)) as only_right,
      (select count(*) from (select doc_id from labels intersect select doc_id from documents)) as both""",
)
add(
    "set_duplicate_ids",
    lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1").groupBy("n").agg(F.count("*").alias("keys")),
    "select n, count(*) as keys from (select count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1) group by n",
)


def _set_report(spark, sf):
    """What two key sets have alone and in common, in one pass over their union."""
    sides = docs(spark, sf).select("doc_id", F.lit(1).alias("side")).union(table(spark, sf, "labels").select("doc_id", F.lit(2))).distinct()
    state = sides.groupBy("doc_id").agg(F.sum("side").alias("state"))
    return state.agg(F.count_if(F.col("state") == 1).alias("only_left"), F.count_if(F.col("state") == 2).alias("only_right"), F.count_if(F.col("state") == 3).alias("both")).withColumn("pair", F.lit("documents_labels"))


# Samples and splits.
add(
    "sample_replacement_queue",
    lambda s, d: sampling.global_rank(sampling.exclude(docs(s, d).select("doc_id"), table(s, d, "labels"), "doc_id"), sampling.hash_order("seed", F.col("doc_id")), F.col("doc_id")),
    "select doc_id, row_number() over (order by sha256('seed|' || doc_id), doc_id) as rank from documents where doc_id not in (select doc_id from labels)",
)
add(
    "sample_balanced_take",
    lambda s, d: sampling.balanced_take(docs(s, d).select("doc_id", "source"), "source", sampling.hash_order("take", F.col("doc_id")), "doc_id", 50),
    "select doc_id, source, turn from (select doc_id, source, row_number() over (partition by source order by sha256('take|' || doc_id), doc_id) as turn from documents) order by turn, source limit 50",
)


def stratified(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("stratum"))
    sizes = {r[0]: r[1] for r in orders.groupBy("stratum").count().collect()}  # one row per stratum of the plan
    plan = sampling.allocate({p: 10 * (k + 1) for k, p in enumerate(sorted(sizes))}, sizes)
    take = spark.createDataFrame(sorted(plan.items()), "stratum string, n_h bigint")
    return sampling.first_per_stratum(orders, "stratum", F.broadcast(take), sampling.hash_order("seed|wave-a", F.col("o_orderkey")), "o_orderkey")


add(
    "sample_stratified",
    stratified,
    """with s as (select o_orderpriority as stratum, 10 * row_number() over (order by o_orderpriority) as n_h from (select distinct o_orderpriority from orders)),
      r as (select o_orderkey, o_orderpriority as stratum, count(*) over (partition by o_orderpriority) as population, row_number() over (partition by o_orderpriority order by sha256('seed|wave-a|' || o_orderkey), o_orderkey) as rank from orders)
      select o_orderkey, stratum, population, rank, n_h, n_h / population as inclusion_probability, population / n_h as analysis_weight from r join s using (stratum) where rank <= n_h""",
)
add(
    "sample_quantile_rows",
    lambda s, d: sampling.quantile_rows(table(s, d, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", F.col("at").alias("place")),
    """with n as (select user_id, event_id, count(*) over (partition by user_id) as n, row_number() over (partition by user_id order by ts, event_id) - 1 as place from events),
      p as (select *, least(n, 5) as k from n), q as (select *, list_transform(generate_series(0, k - 1), lambda i: case when k = 1 then 0 else round_even(i * (n - 1) / (k - 1), 0)::bigint end) as places from p)
      select user_id, event_id, place from q where list_contains(places, place)""",
)
add(
    "split_temporal_holdout",
    lambda s, d: sampling.temporal_holdout(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", sampling.hash_order("global-temporal-test", F.col("o_orderkey")), 0.05, "o_custkey").groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("components")),
    """with r as (select *, row_number() over (order by o_orderdate desc, sha256('global-temporal-test|' || o_orderkey) desc) as rank, count(*) over () as n from orders),
      t as (select distinct o_custkey from r where rank <= ceil(n * 0.05)) select case when o_custkey in (select o_custkey from t) then 'test' else 'development' end as split, count(*) as n, count(distinct o_custkey) as components from orders group by split""",
)


def grouped_folds(spark, sf, k=5):
    rows = keyed(spark, sf).join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.col("source").alias("component"), "quality")
    groups = [tuple(r) for r in rows.groupBy("component").agg(F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") == 1)).collect()]
    folds = spark.createDataFrame(list(sampling.group_folds(groups, k).items()), "component string, fold int")
    return rows.join(F.broadcast(folds), "component").groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("unrelated"), F.count_distinct("component").alias("components"))


add("split_group_folds", grouped_folds)
add(
    "sample_outcomes",
    lambda s, d: docs(s, d).join(table(s, d, "labels"), "doc_id", "left").select(sampling.replacement_outcome(F.length("text") >= 100, F.col("doc_id") % 11 == 0, F.col("doc_id") % 13 == 0, F.col("doc_id") % 2 == 0, F.col("quality"), F.coalesce(F.col("toxic") == 0, F.lit(False))).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n")),
    """select case when length(text) < 100 then 'structure_unusable' when doc_id % 11 = 0 then 'confirmed_duplicate' when doc_id % 13 = 0 then 'duplicate_review_required' when doc_id % 2 <> 0 then 'not_needed'
      when quality is null then 'label_required' when toxic <> 0 then 'label_not_final' else 'selected' end as outcome, count(*) as n from documents left join labels using (doc_id) group by outcome""",
)
