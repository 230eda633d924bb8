"""Queries on features, models, incremental work and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import values
from corpusloom.operators import duplicates, models, neighbours
from corpusloom.streaming import incremental

from .q_corpus import near_texts, table
from .q_eval import SCORED, scored
from .q_text import docs
from .registry import add

GRAMS = """d as (select doc_id as id, regexp_replace(text, '\\s\\s+', ' ', 'g') as x from documents), g as (select id, gram, count(*) as n from (select id, unnest(list_transform(generate_series(1, length(x) - 2), lambda i: x[i:i + 2])) as gram from d where length(x) > 2) group by all)"""


def trigrams(spark, sf):
    return duplicates.gram_counts(docs(spark, sf).select(F.col("doc_id").alias("id"), "text"), (3,))


add(
    "model_idf",
    lambda s, d: duplicates.gram_counts(docs(s, d).select(F.col("doc_id").alias("id"), "text"), (3,)).groupBy("gram").agg(F.count("*").alias("df"), F.sum("n").alias("n")).filter("df >= 2").select("gram", "df", "n", F.round(F.ln((1.0 + F.lit(docs(s, d).count())) / (1 + F.col("df"))) + 1, 9).alias("idf")),
    f"with {GRAMS} select gram, count(*) as df, sum(n)::bigint as n, round(ln((1.0 + (select count(*) from documents)) / (1 + count(*))) + 1, 9) as idf from g group by gram having count(*) >= 2",
)


def labels(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))


add(
    "model_nb_log_ratio",
    lambda s, d: models.nb_log_ratio(trigrams(s, d), labels(s, d)).select("gram", F.round("ratio", 9).alias("ratio")),
    f"""with {GRAMS}, n as (select count(*) filter (where toxic = 1) as n1, count(*) filter (where toxic = 0) as n0 from labels), c as (select gram, count(*) filter (where toxic = 1) as c1, count(*) filter (where toxic = 0) as c0 from g join labels on id = doc_id group by gram)
      select gram, round(ln(((c1 + 1) / (n1 + 2)) / ((c0 + 1) / (n0 + 2))), 9) as ratio from c, n""",
)
add(
    "model_linear_score",
    lambda s, d: models.linear_score(trigrams(s, d).withColumn("w", F.lit(1.0)), models.nb_log_ratio(trigrams(s, d), labels(s, d)).withColumnRenamed("ratio", "weight")).select("id", F.round("margin", 5).alias("margin"), F.round(values.sigmoid(F.col("margin") / 1000), 6).alias("p")),
    f"""with {GRAMS}, n as (select count(*) filter (where toxic = 1) as n1, count(*) filter (where toxic = 0) as n0 from labels), c as (select gram, count(*) filter (where toxic = 1) as c1, count(*) filter (where toxic = 0) as c0 from g join labels on id = doc_id group by gram),
      w as (select gram, ln(((c1 + 1) / (n1 + 2)) / ((c0 + 1) / (n0 + 2))) as weight from c, n), m as (select id, coalesce(sum(weight), 0) as m from g left join w using (gram) group by id) select id, round(m, 5) as margin, round(1 / (1 + exp(-m / 1000)), 6) as p from m""",
)


def embedded(spark, sf):
    """Embeddings with their class against the rest, and a fold by hash; four neighbours are a component."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), (F.col("label") == 0).cast("int").alias("label"), F.pmod(F.xxhash64(F.floor(F.col("vec_id") / 4)), F.lit(5)).alias("fold"))


add("model_cross_fit", lambda s, d: models.cross_fit(embedded(s, d)))
add("model_cross_fit_svm", lambda s, d: models.cross_fit(embedded(s, d), kind="svm"))
CANDIDATES = [("logistic", 0.1, 32), ("logistic", 1.0, 64), ("svm", 0.1, 64)]
add("model_nested_choices", lambda s, d: models.nested_search(embedded(s, d), CANDIDATES)[0])
add("model_nested_search", lambda s, d: models.nested_search(embedded(s, d), CANDIDATES)[1])
add(
    "model_candidate_grid",
    lambda s, d: models.candidate_grid(s, family=["tfidf_svm", "nb_svm", "tfidf_logistic"], span=["2-4", "2-5", "3-5"], min_df=[1, 2], c=[0.5, 1.0, 2.0]),
    """select (row_number() over (order by f.i, s.i, m.i, c.i) - 1)::int as candidate, f.v as family, s.v as span, m.v as min_df, c.v as c from (values (0, 'tfidf_svm'), (1, 'nb_svm'), (2, 'tfidf_logistic')) f(i, v),
      (values (0, '2-4'), (1, '2-5'), (2, '3-5')) s(i, v), (values (0, 1), (1, 2)) m(i, v), (values (0, 0.5), (1, 1.0), (2, 2.0)) c(i, v)""",
)


def fused(spark, sf):
    return models.nested_fusion(scored(spark, sf).select("doc_id", "label", "pa", "pb", (F.col("doc_id") % 5).alias("fold")), [0.0, 0.25, 0.5, 0.75, 1.0])


_B = "case when weight = 0 then pa else 1 / (1 + exp(-((1 - weight) * ln(greatest(least(pa, 1 - 1e-6), 1e-6) / (1 - greatest(least(pa, 1 - 1e-6), 1e-6))) + weight * ln(greatest(least(pb, 1 - 1e-6), 1e-6) / (1 - greatest(least(pb, 1 - 1e-6), 1e-6)))))) end"
FUSED = f"""{SCORED}, x as (select doc_id, label, pa, pb, doc_id % 5 as fold, weight, {_B} as p from scored, (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double as weight)),
  o as (select f.fold, weight, count(*) filter (where label = 0 and p >= 0.5) as fp, count(*) filter (where label = 0 and pa >= 0.5) as fp_first,
    avg(-case when label = 0 then ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)) else ln(greatest(least(p, 1 - 1e-15), 1e-15)) end) as log_loss from x join (select distinct fold from x) f on f.fold <> x.fold group by all),
  best as (select fold, weight, fp as false_positive, log_loss from o where fp <= fp_first qualify row_number() over (partition by fold order by round(log_loss, 12), weight) = 1)"""
add("model_fusion_choices", lambda s, d: fused(s, d)[0].withColumn("log_loss", F.round("log_loss", 9)), f"with {FUSED} select fold, weight, false_positive, round(log_loss, 9) as log_loss from best")
add("model_fusion", lambda s, d: fused(s, d)[1].select("doc_id", "weight", F.round("p", 9).alias("p")), f"with {FUSED} select doc_id, weight, round(p, 9) as p from x join best using (fold, weight)")
add("model_search", lambda s, d: models.search(embedded(s, d), [("logistic", 0.1), ("logistic", 1.0), ("svm", 0.1)]))
add(
    "vectors_top_neighbours",
    lambda s, d: _neighbours(s, d),
    """with q as (select vec_id as query, embedding as v from embeddings where vec_id % 50 = 0), p as (select query, vec_id as neighbour, sum_ from (select query, e.vec_id, list_inner_product(v::double[], e.embedding::double[]) / sqrt(list_inner_product(v::double[], v::double[]) * list_inner_product(e.embedding::double[], e.embedding::double[])) as sum_ from q, embeddings e where e.vec_id <> query)),
      r as (select query, neighbour, row_number() over (partition by query order by round(sum_, 6) desc, neighbour) as place from p) select query, neighbour, place from r where place <= 5""",
)


def _neighbours(spark, sf, k=5):
    """Queries are the rows whose id is divisible by 50, against all rows."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), values.unit(F.col("embedding")).alias("u"))
    return neighbours.nearest(rows, rows.filter("id % 50 = 0").select(F.col("id").alias("query"), F.col("u").alias("q")), k)


def _history(spark, sf):
    o = table(spark, sf, "orders")
    return o.filter("o_orderkey % 10 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority", (F.col("o_orderkey") % 3 + 1).alias("version"))


add(
    "inc_version_bump",
    lambda s, d: incremental.bump_versions(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), _history(s, d), "o_orderkey", ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "change", "version"),
    "select o_orderkey, case when o_orderkey % 10 = 0 then 'new' when o_orderkey % 7 = 0 then 'changed' else 'unchanged' end as change, case when o_orderkey % 10 = 0 then 1 when o_orderkey % 7 = 0 then o_orderkey % 3 + 2 else o_orderkey % 3 + 1 end::bigint as version from orders",
)
add(
    "inc_reused_identities",
    lambda s, d: incremental.reused_identities(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), _history(s, d), "o_orderkey", ["o_orderstatus"]),
    "select o_orderkey from orders where o_orderkey % 10 <> 0 and o_orderkey % 7 = 0",
)
add(
    "inc_batches",
    lambda s, d: incremental.batches(docs(s, d).select("doc_id", "source"), "doc_id", 250).groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count_distinct("batch_id").alias("ids")),
    "with r as (select doc_id, (row_number() over (order by doc_id) - 1) // 250 as batch from documents) select batch, count(*) as n, min(doc_id) as first, max(doc_id) as last, 1::bigint as ids from r group by batch",
)


def _cache(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    cache = rows.filter("doc_id % 3 = 0").select(F.lit("v1").alias("namespace"), "text_sha256", F.array(F.lit(1.0)).alias("vector")).dropDuplicates(["text_sha256"])
    hits, missing = incremental.split_by_cache(rows, cache, "text_sha256", "v1")
    return hits.agg(F.count("*").alias("n")).select(F.lit("hit").alias("state"), "n").union(missing.agg(F.count("*")).select(F.lit("missing"), "count(1)"))


add(
    "inc_cache_hits",
    _cache,
    "with h as (select distinct text from documents where doc_id % 3 = 0) select 'hit' as state, count(*) as n from documents where text in (select text from h) union all select 'missing', count(distinct text) from documents where text not in (select text from h)",
)
add(
    "source_pruned_scan",
    lambda s, d: docs(s, d).select("doc_id", "lang").filter("lang = 'de'"),
    "select doc_id, lang from documents where lang = 'de'",
)
add(
    "source_closure",
    lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n")),
    "select l_returnflag, count(*) as n from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F') group by l_returnflag",
)
