"""Queries on evaluation, routing, authors, coding and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import values
from corpusloom.operators import authors, coding, expectations, metrics, routing

from .q_corpus import KEYED, keyed, table
from .q_text import docs
from .registry import add

HASH = "('0x' || substr(sha256({0}), 1, 8))::bigint / 4294967296.0"
#: Labelled documents with two pseudo-models' probabilities and a weight.
SCORED = f"""scored as (select doc_id, d.source, length(text) as size, quality as label, toxic, {HASH.format("doc_id || 'a'")} as pa, {HASH.format("doc_id || 'b'")} as pb,
  1.0 + doc_id % 4 as w, case when doc_id % 10 = 0 then null else quality end as sure from documents d join labels l using (doc_id))"""
LOSS = "-case when {1} = 1 then ln(greatest(least({0}, 1 - 1e-15), 1e-15)) else ln(1 - greatest(least({0}, 1 - 1e-15), 1e-15)) end"


def scored(spark, sf):
    p = lambda salt: values.pseudo_probability(F.col("doc_id"), salt)
    both = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return both.select("doc_id", "source", F.length("text").alias("size"), F.col("quality").alias("label"), "toxic", p("a").alias("pa"), p("b").alias("pb"), (1.0 + F.col("doc_id") % 4).alias("w"), F.when(F.col("doc_id") % 10 == 0, None).otherwise(F.col("quality")).alias("sure"))


def rounded(df, digits=9):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


add(
    "eval_confusion",
    lambda s, d: rounded(metrics.confusion(scored(s, d), "pa", "label")),
    f"""with {SCORED}, c as (select count(*) filter (where pa >= 0.5 and label = 1) as tp, count(*) filter (where pa >= 0.5 and label = 0) as fp, count(*) filter (where pa < 0.5 and label = 1) as fn, count(*) filter (where pa < 0.5 and label = 0) as tn,
      round(avg((pa - label) ** 2), 9) as brier, round(avg({LOSS.format("pa", "label")}), 9) as log_loss from scored)
      select *, round(coalesce(tp / (tp + fp), 0), 9) as precision, round(coalesce(tp / (tp + fn), 0), 9) as recall, round(2 * tp / (2 * tp + fp + fn), 9) as f1, round((tp + tn) / (tp + fp + fn + tn), 9) as accuracy from c""",
)
add(
    "eval_average_precision",
    lambda s, d: rounded(metrics.average_precision(scored(s, d), "pa", "label", "w")),
    f"""with {SCORED}, g as (select pa, sum(w * label) as tp, sum(w) as n from scored group by pa), r as (select tp, sum(tp) over o as hits, sum(n) over o as seen from g window o as (order by pa desc))
      select round(sum(tp * hits / seen) / sum(tp), 9) as average_precision from r""",
)
add(
    "eval_weighted_overall",
    lambda s, d: rounded(metrics.weighted_overall(scored(s, d), "pa", "sure", "w"), 8),
    f"""with {SCORED}, s as (select *, case when (pa >= 0.5) = (sure = 1) then 1 else 0 end as ok from scored where sure is not null)
      select round(sum(w * {LOSS.format("pa", "sure")}) / sum(w), 8) as log_loss, round(sum(w * (pa - sure) ** 2) / sum(w), 8) as brier, round(sum(w * ok) / sum(w), 8) as accuracy,
      round(sum(w * (1 - ok)) filter (where sure = 0) / sum(w) filter (where sure = 0), 8) as negative_error, round(sum(w * (1 - ok)) filter (where sure = 1) / sum(w) filter (where sure = 1), 8) as positive_error, round(sum(w) ** 2 / sum(w * w), 8) as effective_n from s""",
)
add(
    "eval_coverage_threshold",
    lambda s, d: metrics.coverage_threshold(scored(s, d), "pa", 0.9),
    f"with {SCORED}, r as (select pa, row_number() over (order by pa) as k, count(*) over () as n from scored) select pa as threshold from r where k = ceil(0.9 * (n - 1)) + 1",
)
TAILS = f"""{SCORED}, k as (select unnest(generate_series(1, 49)) / 100 as t), tails as (select t, count(*) filter (where round(pa, 11) <= t) as keep_n,
  coalesce(sum(w) filter (where round(pa, 11) <= t and (sure = 1 or sure is null)), 0) / sum(w) filter (where round(pa, 11) <= t) as keep_risk, sum(w) filter (where round(pa, 11) <= t) ** 2 / sum(w * w) filter (where round(pa, 11) <= t) as keep_ess,
  count(*) filter (where round(pa, 11) >= round(1 - t, 2)) as exclude_n, coalesce(sum(w) filter (where round(pa, 11) >= round(1 - t, 2) and (sure = 0 or sure is null)), 0) / sum(w) filter (where round(pa, 11) >= round(1 - t, 2)) as exclude_risk,
  sum(w) filter (where round(pa, 11) >= round(1 - t, 2)) ** 2 / sum(w * w) filter (where round(pa, 11) >= round(1 - t, 2)) as exclude_ess from scored, k group by t)"""


def tails(spark, sf):
    return metrics.tails(metrics.threshold_histogram(scored(spark, sf).drop("label").withColumnRenamed("sure", "label"), "pa", F.col("w")))


add(
    "eval_tails",
    lambda s, d: rounded(tails(s, d)),
    f"with {TAILS} select t, keep_n, round(keep_risk, 9) as keep_risk, round(keep_ess, 9) as keep_ess, exclude_n, round(exclude_risk, 9) as exclude_risk, round(exclude_ess, 9) as exclude_ess from tails",
)
GRID = f"""{TAILS}, total as (select count(*) as total from scored), grid as (select a.t as t_keep, a.keep_n, a.keep_risk, round(1 - b.t, 2) as t_exclude, b.exclude_n, b.exclude_risk, 1 - (a.keep_n + b.exclude_n) / total as manual_rate,
  a.keep_n >= 30 and b.exclude_n >= 30 and coalesce(a.keep_risk <= 0.9 and b.exclude_risk <= 0.2, false) as passes from tails a, tails b, total)"""


def grid(spark, sf):
    return metrics.routing_grid(tails(spark, sf), scored(spark, sf).count(), 30, 0.9, 0.2)


add("route_grid", lambda s, d: rounded(grid(s, d)), f"with {GRID} select t_keep, keep_n, round(keep_risk, 9) as keep_risk, t_exclude, exclude_n, round(exclude_risk, 9) as exclude_risk, round(manual_rate, 9) as manual_rate, passes from grid")


def strategy(spark, sf):
    """All labelled documents as the population, every other one as the sample, the rest as the audit."""
    rows = scored(spark, sf).drop("label").withColumnRenamed("sure", "label")
    told = lambda part: metrics.tails(metrics.threshold_histogram(part, "pa", F.col("w")), raw=True)
    return metrics.strategy_points(told(rows), told(rows.filter("doc_id % 2 = 0")), told(rows.filter("doc_id % 2 = 1")), (0.95, 0.3), 10)


def _side(side: str, where: str, wrong: str) -> str:
    at = f"p {where}"
    each = "".join(
        f", count(*) filter (where {at} and doc_id % 2 = {k}) as {side}_{name}_n, count(*) filter (where {at} and doc_id % 2 = {k} and (sure = {wrong} or sure is null)) as {side}_{name}_errors,"
        f" coalesce(sum(w) filter (where {at} and doc_id % 2 = {k} and (sure = {wrong} or sure is null)), 0) / sum(w) filter (where {at} and doc_id % 2 = {k}) as {side}_{name}_risk,"
        f" sum(w) filter (where {at} and doc_id % 2 = {k}) ** 2 / sum(w * w) filter (where {at} and doc_id % 2 = {k}) as {side}_{name}_ess"
        for k, name in enumerate(("sample", "audit"))
    )
    return f"select t, count(*) filter (where {at}) as {side}_population{each} from r, k group by t"


_RISKS = [f"{side}_{name}_{c}" for side in ("keep", "exclude") for name in ("sample", "audit") for c in ("risk", "ess")]
add(
    "route_strategy_points",
    lambda s, d: rounded(strategy(s, d).drop(*[f"{side}_{name}_{c}" for side in ("keep", "exclude") for name in ("sample", "audit") for c in ("raw_risk", "limit")], "keep_limit", "exclude_limit", "keep_passes", "exclude_passes", "passes")),
    f"""with {SCORED}, r as (select *, round(pa, 11) as p from scored), k as (select unnest(generate_series(1, 49)) / 100 as t), a as ({_side("keep", "<= t", "1")}), b as ({_side("exclude", ">= round(1 - t, 2)", "0")}), n as (select count(*) as total from scored)
      select a.t as t_keep, round(1 - b.t, 2) as t_exclude, * exclude (t) replace ({", ".join(f"round({c}, 9) as {c}" for c in _RISKS)}), total - keep_population - exclude_population as manual, round((total - keep_population - exclude_population) / total, 9) as manual_rate,
      (total - keep_population - exclude_population) / total <= 0.5 as workload_passes from a, b, n""",
)
add("route_strategy_gates", lambda s, d: rounded(strategy(s, d).select("t_keep", "t_exclude", "keep_sample_limit", "keep_audit_limit", "keep_limit", "exclude_limit", "keep_passes", "exclude_passes", "passes")))
add("eval_paired_bootstrap", lambda s, d: metrics.paired_bootstrap(scored(s, d), "source", "pa", "pb", "label"))
FRONT = "points as (select t_keep, t_exclude, round(keep_risk, 6) as kr, round(exclude_risk, 6) as er, round(manual_rate, 6) as mr from grid where keep_risk is not null and exclude_risk is not null)"
add(
    "route_pareto",
    lambda s, d: metrics.pareto(grid(s, d).dropna(subset=["keep_risk", "exclude_risk"]).select("t_keep", "t_exclude", F.round("keep_risk", 6).alias("kr"), F.round("exclude_risk", 6).alias("er"), F.round("manual_rate", 6).alias("mr")), "kr", "er", "mr"),
    f"with {GRID}, {FRONT} select * from points p where not exists (select 1 from points q where q.kr <= p.kr and q.er <= p.er and q.mr <= p.mr and (q.kr < p.kr or q.er < p.er or q.mr < p.mr))",
)
add(
    "route_workload_points",
    lambda s, d: rounded(routing.closest_points(grid(s, d), s.createDataFrame([(0.2,), (0.5,), (0.8,)], "target double"))),
    f"""with {GRID}, t as (select unnest([0.2, 0.5, 0.8])::double as target) select target, t_keep, t_exclude, round(manual_rate, 9) as manual_rate from t, grid
      qualify row_number() over (partition by target order by round(abs(manual_rate - target), 9), t_keep, t_exclude) = 1""",
)
add(
    "route_best_point",
    lambda s, d: rounded(grid(s, d).filter("passes").orderBy(F.round("manual_rate", 9), F.round("exclude_risk", 9), F.round("keep_risk", 9), "t_keep", "t_exclude").limit(1).select("t_keep", "t_exclude", "manual_rate")),
    f"with {GRID} select t_keep, t_exclude, round(manual_rate, 9) as manual_rate from grid where passes order by round(manual_rate, 9), round(exclude_risk, 9), round(keep_risk, 9), t_keep, t_exclude limit 1",
)
add(
    "eval_risk_coverage",
    lambda s, d: rounded(metrics.risk_coverage(scored(s, d), "pa", "label", values.grid(s, "confidence", 50, 99))),
    f"""with {SCORED}, k as (select unnest(generate_series(50, 99)) / 100 as confidence), m as (select *, greatest(pa, 1 - pa) as near, (pa >= 0.5) <> (label = 1) as wrong from scored)
      select confidence, count(*) filter (where round(near, 11) >= confidence) as covered, round(count(*) filter (where round(near, 11) >= confidence) / count(*), 9) as coverage, count(*) filter (where round(near, 11) >= confidence and wrong) as errors,
      round(count(*) filter (where round(near, 11) >= confidence and wrong) / nullif(count(*) filter (where round(near, 11) >= confidence), 0), 9) as risk, count(*) filter (where round(near, 11) >= confidence and wrong and pa >= 0.5) as false_positive,
      count(*) filter (where round(near, 11) >= confidence and wrong and pa < 0.5) as false_negative from m, k group by confidence""",
)
BANDS = "case when size < 300 then '0000-0299' when size < 600 then '0300-0599' when size < 1200 then '0600-1199' when size < 2400 then '1200-2399' else '2400+' end"
add(
    "eval_error_bands",
    lambda s, d: rounded(metrics.error_bands(scored(s, d), metrics.band(F.col("size"), metrics.LENGTH_BANDS), "pa", "label", "size")),
    f"""with {SCORED}, m as (select *, {BANDS} as band, (pa >= 0.5) <> (label = 1) as wrong from scored) select band, count(*) as n, count(*) filter (where wrong) as errors, round(count(*) filter (where wrong) / count(*), 9) as rate,
      count(*) filter (where label = 1) as positive, min(size) as shortest, median(size) as median, max(size) as longest from m group by band""",
)
add(
    "eval_probability_bands",
    lambda s, d: scored(s, d).groupBy(metrics.band(F.col("pa"), metrics.PROBABILITY_BANDS).alias("band")).agg(F.count("*").alias("n"), F.sum("label").alias("positive")),
    f"""with {SCORED} select case when pa < 0.1 then '0.00-0.10' when pa < 0.25 then '0.10-0.25' when pa < 0.5 then '0.25-0.50' when pa < 0.75 then '0.50-0.75' when pa < 0.9 then '0.75-0.90' else '0.90-1.00' end as band, count(*) as n, sum(label)::bigint as positive from scored group by band""",
)
add(
    "eval_error_crosstab",
    lambda s, d: scored(s, d).filter((F.col("pa") >= 0.5) != (F.col("label") == 1)).groupBy(F.when(F.col("pa") >= 0.5, "to_positive").otherwise("to_negative").alias("direction")).pivot("toxic", [0, 1]).agg(F.count("doc_id")).select("direction", F.coalesce("0", F.lit(0)).alias("plain"), F.coalesce("1", F.lit(0)).alias("toxic")),
    f"with {SCORED} select case when pa >= 0.5 then 'to_positive' else 'to_negative' end as direction, count(*) filter (where toxic = 0) as plain, count(*) filter (where toxic = 1) as toxic from scored where (pa >= 0.5) <> (label = 1) group by direction",
)
add(
    "eval_acceptance",
    lambda s, d: rounded(metrics.acceptance(metrics.paired_deltas(scored(s, d), "pa", "pb", "label")), 8),
    f"""with {SCORED}, x as (select avg({LOSS.format("pb", "label")}) - avg({LOSS.format("pa", "label")}) as l, avg((pb - label) ** 2) - avg((pa - label) ** 2) as b,
      avg(case when pb >= 0.5 then 1.0 else 0 end) filter (where label = 0) - avg(case when pa >= 0.5 then 1.0 else 0 end) filter (where label = 0) as e from scored)
      select round(l, 8) as d_log_loss, round(b, 8) as d_brier, round(e, 8) as d_false_positive, e <= 0 as gate_errors, l <= -0.01 as gate_log_loss, b <= 0 as gate_brier, e <= 0 and l <= -0.01 and b <= 0 as accepted from x""",
)
add(
    "eval_locked_test",
    lambda s, d: metrics.locked_test(scored(s, d).withColumnRenamed("pa", "p"), 0.14, 0.86, 20, 20, 30),
    f"""with {SCORED}, c as (select count(*) filter (where pa <= 0.14) as keep_n, count(*) filter (where pa >= 0.86) as exclude_n, count(*) filter (where pa <= 0.14 and label = 1) as keep_errors, count(*) filter (where pa >= 0.86 and label = 0) as exclude_errors from scored)
      select *, case when keep_errors > 20 or exclude_errors > 20 then 'FAILED_MANUAL_ONLY' when keep_n < 30 or exclude_n < 30 then 'SUPPORT_MANUAL_ONLY' else 'PASSED' end as status from c""",
)
add(
    "eval_audit",
    lambda s, d: metrics.audit_verdict(scored(s, d).withColumn("action", routing.route(F.col("pa"), 0.31, 0.96)), "action", F.col("toxic") == 1, {"keep": 7, "exclude": 3}),
    f"with {SCORED}, a as (select *, case when pa <= 0.31 then 'keep' when pa >= 0.96 then 'exclude' end as action from scored) select action, count(*) as audited, count(*) filter (where toxic = 1) as adverse, count(*) filter (where toxic = 1) <= case action when 'keep' then 7 else 3 end as enabled from a where action is not null group by action",
)
add("eval_clopper_pearson", lambda s, d: scored(s, d).groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("events"), F.count("*").alias("n")).withColumn("b", metrics.clopper_pearson_columns(F.col("events"), F.col("n"))).select("source", "events", "n", "b.lower", "b.upper"))
add("eval_cluster_bootstrap", lambda s, d: metrics.cluster_bootstrap(scored(s, d), "source", F.col("w") * F.col("toxic"), F.col("w")))
add(
    "eval_quantile_interval",
    lambda s, d: scored(s, d).agg(F.percentile("pa", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q")).select(*[F.round(F.col("q")[i], 9).alias(n) for i, n in enumerate(("low", "mid", "high"))]),
    f"with {SCORED} select round(quantile_cont(pa, 0.025), 9) as low, round(quantile_cont(pa, 0.5), 9) as mid, round(quantile_cont(pa, 0.975), 9) as high from scored",
)
ROUTE = "case when {0} <= {1} then 'keep' when {0} >= {2} then 'exclude' else 'manual_review' end"
add(
    "route_three_way",
    lambda s, d: docs(s, d).select("doc_id", (p := values.pseudo_probability(F.col("doc_id"))).alias("p"), routing.route(p, 0.31, 0.96).alias("action"), routing.route(p, 0.14, 0.86).alias("rerouted"), routing.route(p, 0.31, 0.96, F.col("doc_id") % 2 == 0).alias("half_enabled")),
    f"""with p as (select doc_id, {HASH.format("doc_id::varchar")} as p from documents) select doc_id, p, {ROUTE.format("p", 0.31, 0.96)} as action, {ROUTE.format("p", 0.14, 0.86)} as rerouted,
      case when doc_id % 2 = 0 then {ROUTE.format("p", 0.31, 0.96)} else 'manual_review' end as half_enabled from p""",
)
add(
    "route_manual_tasks",
    lambda s, d: routing.manual_tasks(docs(s, d).select("doc_id", routing.route(values.pseudo_probability(F.col("doc_id")), 0.31, 0.96).alias("action")), table(s, d, "labels").select("doc_id"), "doc_id"),
    f"with p as (select doc_id, {HASH.format('doc_id::varchar')} as p from documents) select doc_id, 'manual_review' as action from p where p > 0.31 and p < 0.96 and doc_id not in (select doc_id from labels)",
)


def final_actions(spark, sf):
    label = lambda c: F.when(c == 1, "related").when(c == 0, "unrelated")
    rows = docs(spark, sf).select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    model = routing.route(values.pseudo_probability(F.col("doc_id")), 0.31, 0.96)
    done = routing.final_action(label(F.when(F.col("doc_id") % 3 == 0, F.col("quality"))), label(F.when(F.col("doc_id") % 3 == 1, F.col("quality"))), model, model == "keep")
    return rows.select(done.alias("x")).groupBy("x.action", "x.source").agg(F.count("*").alias("n"))


add(
    "route_final_actions",
    final_actions,
    f"""with p as (select d.doc_id, quality, {HASH.format("d.doc_id::varchar")} as p from documents d left join labels using (doc_id)), x as (select *, case when doc_id % 3 = 1 and quality is not null then 'human_training_label' when doc_id % 3 = 0 and quality is not null then 'human_audit_label'
      when p > 0.31 and p < 0.96 then 'model_middle_band' when p <= 0.31 then 'model_audit_released' else 'model_tail_downgraded' end as source from p)
      select case when source like 'human%' then case quality when 1 then 'keep' else 'exclude' end when source = 'model_audit_released' then 'keep' else 'manual_review' end as action, source, count(*) as n from x group by all""",
)
add(
    "route_merge_candidates",
    lambda s, d: routing.merge_candidates(
        keyed(s, d).select("doc_id", "key").join(table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "keep").otherwise("exclude").alias("human_action")), "doc_id", "left"),
        docs(s, d).select("doc_id", values.pseudo_probability(F.col("doc_id")).alias("p")), "doc_id", 0.31, 0.96, "key",
    ).groupBy("decision", "origin", "conflict").agg(F.count("*").alias("n"), F.count("probability").alias("with_probability")),
    f"""with {KEYED}, m as (select key, case when quality = 1 then 'keep' when quality = 0 then 'exclude' when {HASH.format("k.doc_id::varchar")} <= 0.31 then 'keep' when {HASH.format("k.doc_id::varchar")} >= 0.96 then 'exclude' else 'manual_review' end as decision,
      case when quality is null then 'model' else 'human' end as origin from keyed k left join labels l on l.doc_id = k.doc_id), c as (select *, min(decision) over (partition by key) <> max(decision) over (partition by key) as conflict from m)
      select decision, origin, conflict, count(*) as n, count(*) filter (where origin = 'model') as with_probability from c group by all""",
)


def ledger(spark, sf):
    """Events as decisions; every third one supersedes the one before."""
    return table(spark, sf, "events").select(F.col("event_id").alias("decision_id"), F.col("user_id").alias("subject"), F.when(F.col("event_id") % 3 == 2, F.col("event_id") - 1).alias("supersedes_id"))


LEDGER = "ledger as (select event_id as decision_id, user_id as subject, case when event_id % 3 = 2 then event_id - 1 end as supersedes_id from events)"
add("route_current_decisions", lambda s, d: routing.current_decisions(ledger(s, d)).select("decision_id", "subject"), f"with {LEDGER} select decision_id, subject from ledger a where not exists (select 1 from ledger b where b.supersedes_id = a.decision_id)")
add(
    "check_single_chain",
    lambda s, d: expectations.single_chain(ledger(s, d), "subject").select("subject", "roots"),
    f"with {LEDGER}, r as (select subject, count(*) filter (where supersedes_id is null) as roots from ledger group by subject) select subject, roots from r where roots <> 1 or subject in (select subject from ledger where supersedes_id is not null group by subject, supersedes_id having count(*) > 1)",
)
add(
    "route_strata",
    lambda s, d: scored(s, d).groupBy(routing.wave_a_stratum(F.col("pa"), F.col("pb")).alias("stratum"), routing.cross_action(routing.route(F.col("pb"), 0.14, 0.86), routing.route(F.col("pa"), 0.2, 0.8)).alias("cross")).agg(F.count("*").alias("n")),
    f"""with {SCORED} select case when pa >= 0.9 and pb >= 0.9 then 'both_high' when pb >= 0.9 then 'dense_high' when pa >= 0.9 then 'sparse_high' when (pa >= 0.5) <> (pb >= 0.5) then 'disagree' when pa >= 0.5 then 'both_unrelated' else 'both_related' end as stratum,
      'dense_' || {ROUTE.format("pb", 0.14, 0.86)} || '__sparse_' || {ROUTE.format("pa", 0.2, 0.8)} as cross, count(*) as n from scored group by all""",
)


# Authors: events stand in for posts, their type for the platform.


def author_posts(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("platform"), F.col("user_id").alias("author"), F.to_date("ts").alias("day"), (F.col("user_id") % 4 == 0).alias("profile"), F.col("value"))


AUTHORS = """authors as (select *, case when dates >= 3 and span_days >= 14 and profile then 'HISTORY_RICH' when dates >= 3 and span_days >= 14 or profile or posts >= 2 then 'BOUNDARY' else 'RANDOM_FRAME' end as stratum from (
  select event_type as platform, user_id as author, count(*) as posts, count(distinct ts::date) as dates, date_diff('day', min(ts::date), max(ts::date)) as span_days, bool_or(user_id % 4 = 0) as profile from events group by all))"""
add("author_candidates", lambda s, d: authors.candidates(author_posts(s, d), min_span=14), f"with {AUTHORS} select * from authors")
add(
    "author_platform_coverage",
    lambda s, d: authors.platform_coverage(author_posts(s, d), {"profile": F.col("profile"), "valued": F.col("value") > 50}),
    """with a as (select event_type as platform, user_id, bool_or(user_id % 4 = 0) as p, bool_or(value > 50) as v from events group by all)
      select platform, count(*) as authors, count(*) filter (where p) as profile, count(*) filter (where v) as valued, round_even(count(*) filter (where p) / count(*), 6) as profile_rate, round_even(count(*) filter (where v) / count(*), 6) as valued_rate from a group by platform""",
)
add("author_selection", lambda s, d: authors.select_authors(authors.candidates(author_posts(s, d), min_span=14), {"HISTORY_RICH": 15, "BOUNDARY": 5, "RANDOM_FRAME": 5}, 25, "authors").select("platform", "author", "stratum"))


def roles(spark, sf):
    """Every combination of scope, codes and coverage for the candidate authors."""
    rows = authors.candidates(author_posts(spark, sf), min_span=14)
    pick = lambda values_, k: F.element_at(F.array(*[F.array(*[F.lit(c) for c in v]).cast("array<string>") for v in values_]), (F.pmod(F.floor(F.col("author") / k), F.lit(len(values_))) + 1).cast("int"))
    ea = pick([["EA_PROFILE"], ["EA_NONE"], ["EA_UNK"], []], 1)
    ce = pick([["CE_FIRST_HAND", "CE_CONSUMER_VIEW"], ["CE_NONE"], ["CE_FIRST_HAND"]], 4)
    scope = F.when(F.col("author") % 13 == 0, "ORGANIZATION").when(F.col("author") % 13 == 1, "UNCLEAR").otherwise("INDIVIDUAL")
    return rows.select(authors.derive_role(scope, ea, ce, F.col("dates"), F.col("span_days"), F.col("profile"), min_span=14).alias("r")).groupBy("r.coverage", "r.role").agg(F.count("*").alias("n"))


add(
    "author_roles",
    roles,
    f"""with {AUTHORS}, x as (select *, author % 4 as ea, (author // 4) % 3 as ce, dates >= 3 and span_days >= 14 and profile as ok, case when author % 13 = 0 then 'OUT_OF_SCOPE' when author % 13 = 1 then 'INSUFFICIENT' end as fixed from authors),
      y as (select *, case when fixed is not null then fixed when not ok and (ea = 1 or ce = 1) then 'INVALID' when ok and ea < 2 and ce < 2 then 'SUFFICIENT' else 'INSUFFICIENT' end as coverage from x)
      select coverage, case coverage when 'OUT_OF_SCOPE' then 'NA' when 'INSUFFICIENT' then 'UNK' when 'INVALID' then 'INVALID' else case when ea = 0 and ce = 1 then 'KOL_TYPE' when ea = 1 and ce = 0 then 'KOC_TYPE' when ea = 0 then 'HYBRID' else 'ORDINARY' end end as role, count(*) as n from y group by all""",
)
# Coding.
add("coding_confusion", lambda s, d: coding.confusion_matrix(table(s, d, "labels"), "quality", "toxic"), "select quality, toxic, count(*) as n from labels group by all")
add(
    "coding_alpha",
    lambda s, d: rounded(coding.krippendorff_alpha(table(s, d, "labels"), "quality", "toxic")),
    """with b as (select quality::varchar as l, toxic::varchar as r from labels), v as (select l as v from b union all select r from b), c as (select v, count(*) as c from v group by v),
      e as (select 1 - sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) as e from c), o as (select count(*) as units, count(*) filter (where l <> r) as unequal from b)
      select units, unequal, round(1 - unequal / units / e, 9) as alpha, 1 - unequal / units / e >= 0.8 as passes from o, e""",
)


def coder(spark, sf, k):
    return table(spark, sf, "labels").select("doc_id", F.when((F.col("doc_id") + k) % 9 == 0, "UNK").otherwise(F.col("quality").cast("string")).alias("quality"), F.when((F.col("doc_id") * k) % 7 == 1, "UNK").otherwise(F.col("toxic").cast("string")).alias("toxic"))


CODERS = "a as (select doc_id, case when (doc_id + 1) % 9 = 0 then 'UNK' else quality::varchar end as q, case when doc_id % 7 = 1 then 'UNK' else toxic::varchar end as t from labels), b as (select doc_id, case when (doc_id + 2) % 9 = 0 then 'UNK' else quality::varchar end as q, case when (doc_id * 2) % 7 = 1 then 'UNK' else toxic::varchar end as t from labels)"
add(
    "coding_discrepancies",
    lambda s, d: coding.discrepancies(coder(s, d, 1), coder(s, d, 2), "doc_id", ["quality", "toxic"]),
    f"""with {CODERS}, m as (select doc_id, 'quality' as field, a.q as "left", b.q as "right" from a join b using (doc_id) union all select doc_id, 'toxic', a.t, b.t from a join b using (doc_id)) select * from m where "left" <> "right" """,
)
add("coding_unknown", lambda s, d: coding.unknown_counts(coder(s, d, 1), ["quality", "toxic"]), f"with {CODERS} select 'quality' as field, count(*) filter (where q = 'UNK') as unknown, count(*) as n from a union all select 'toxic', count(*) filter (where t = 'UNK'), count(*) from a")
add(
    "coding_sheet_labels",
    lambda s, d: coding.sheet_to_labels(table(s, d, "conversations").select("conv_id", F.col("turn").cast("string").alias("coder"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(" ").alias("role"), F.when(F.col("turn") % 3 == 0, " yes ").alias("keep"), F.lit(" ok ").alias("note")), "conv_id", "coder", ["role", "keep"], "note"),
    """with s as (select conv_id, turn::varchar as coder, case when turn % 2 = 0 then role end as role, case when turn % 3 = 0 then 'yes' end as keep from conversations), u as (select * from s where coalesce(role, keep) is not null)
      select conv_id, coder, '{"note":"ok"}' as notes, 'role' as field, role as value from u union all select conv_id, coder, '{"note":"ok"}', 'keep', keep from u""",
)
add(
    "coding_sheet_issues",
    lambda s, d: coding.sheet_issues(table(s, d, "conversations"), "conv_id", {"empty_text": F.trim("text") == "", "short_text": F.length("text") < 60, "bad_role": ~F.col("role").isin("user", "assistant")}).groupBy("issue").agg(F.count("*").alias("n")),
    "select issue, n from (select 'empty_text' as issue, count(*) as n from conversations where trim(text) = '' union all select 'short_text', count(*) from conversations where length(text) < 60 union all select 'bad_role', count(*) from conversations where role not in ('user', 'assistant')) where n > 0",
)
add(
    "coding_review_summary",
    lambda s, d: rounded(coding.review_summary(coder(s, d, 1).join(table(s, d, "labels").select("doc_id", F.col("toxic").cast("string").alias("old")), "doc_id").withColumn("new", F.when(F.col("toxic") == "UNK", "uncertain").otherwise(F.col("toxic"))), "quality", "old", "new")),
    f"with {CODERS} select q as quality, count(*) as n, count(*) filter (where t = toxic::varchar) as maintained, count(*) filter (where t <> 'UNK' and t <> toxic::varchar) as changed, count(*) filter (where t = 'UNK') as uncertain, round(count(*) filter (where t <> 'UNK' and t <> toxic::varchar) / count(*), 9) as change_rate from a join labels using (doc_id) group by q",
)
add(
    "coding_corrections",
    lambda s, d: coding.apply_corrections(table(s, d, "labels"), table(s, d, "labels").filter("doc_id % 5 = 0").select("doc_id", (1 - F.col("quality")).alias("quality")), "doc_id", "quality").select("doc_id", "quality", "before_sha256", "after_sha256"),
    "with x as (select doc_id, quality as q, case when doc_id % 5 = 0 then 1 - quality else quality end as quality from labels) select doc_id, quality, sha256(doc_id || '|' || q) as before_sha256, sha256(doc_id || '|' || quality) as after_sha256 from x",
)
# Integrity.
add(
    "check_expectations",
    lambda s, d: expectations.report(table(s, d, "lineitem"), {"quantity_positive": F.col("l_quantity") > 0, "discount_range": F.col("l_discount").between(0, 0.05), "flag_known": F.col("l_returnflag").isin("A", "N")}),
    """select 'quantity_positive' as rule, count(*) filter (where not l_quantity > 0) as violations from lineitem union all select 'discount_range', count(*) filter (where not l_discount between 0 and 0.05) from lineitem
      union all select 'flag_known', count(*) filter (where l_returnflag not in ('A', 'N')) from lineitem""",
)
add(
    "check_violations",
    lambda s, d: expectations.violations(table(s, d, "orders"), {"price": F.col("o_totalprice") < 400000, "status": F.col("o_orderstatus") != "P"}).groupBy("rule", "o_orderpriority").agg(F.count("*").alias("n")),
    "select 'price' as rule, o_orderpriority, count(*) as n from orders where not o_totalprice < 400000 group by all union all select 'status', o_orderpriority, count(*) from orders where o_orderstatus = 'P' group by all",
)
add(
    "check_foreign_keys",
    lambda s, d: expectations.foreign_keys(table(s, d, "orders"), table(s, d, "customer").filter("c_acctbal >= 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey"),
    "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal >= 0)",
)
add(
    "check_count_mismatches",
    lambda s, d: expectations.count_mismatches(table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("stated")), "o_orderkey", "stated", table(s, d, "lineitem"), "l_orderkey"),
    "with r as (select l_orderkey as k, count(*) as c from lineitem group by k) select o_orderkey, o_orderkey % 5 as stated, coalesce(c, 0) as real from orders left join r on k = o_orderkey where o_orderkey % 5 <> coalesce(c, 0)",
)
add(
    "check_equal_multisets",
    lambda s, d: expectations.equal_multisets(table(s, d, "documents").select("lang", "source"), table(s, d, "documents").filter("doc_id % 4 <> 0").select("lang", "source")),
    "select lang, source, count(*) as surplus from documents where doc_id % 4 = 0 group by all",
)
add("check_fingerprint", lambda s, d: expectations.fingerprint(table(s, d, "orders")))
add(
    "check_transitions",
    lambda s, d: expectations.transitions(table(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s")), table(s, d, "orders").filter("o_orderkey % 50 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "F").otherwise(F.col("o_orderstatus")).alias("s")), "o_orderkey", "s", {"O": ("P", "F"), "P": ("F",)}),
    """with m as (select a.o_orderkey, a.o_orderstatus as was, case when b.o_orderkey is null then null when b.o_orderkey % 7 = 0 then 'F' else b.o_orderstatus end as now from orders a left join (select * from orders where o_orderkey % 50 <> 0) b using (o_orderkey))
      select o_orderkey, was, now from m where not coalesce((was = 'O' and now in ('O', 'P', 'F')) or (was = 'P' and now in ('P', 'F')), false)""",
)
