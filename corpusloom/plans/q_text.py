"""Queries on text rules, identifiers and numbers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import normaliser, text, values

from .registry import add
from .tables import read_table


def docs(spark, sf):
    return read_table(spark, sf, "documents")


def posts(spark, sf):
    """Documents as posts: the first line is the title."""
    return docs(spark, sf).select("doc_id", "source", "lang", text.title_of(F.col("text")).alias("title"), text.body_of(F.col("text")).alias("body"))


POSTS = r"""posts as (select doc_id, source, lang, split_part(text, chr(10), 1) as title,
  case when contains(text, chr(10)) then substr(text, instr(text, chr(10)) + 1) else '' end as body from documents)"""
#: Rows whose keys are the same within a class: full-width and compatibility forms, case folding, controls, white space; null as empty.
FORMS = (
    (1, "ＡＢＣ", "x", 1), (2, "abc", "X", 1), (3, "STRASSE", "", 2), (4, "straße", "", 2), (5, "ﬁn", "Ⅳ", 3), (6, "fin", "iv", 3), (7, "a\u200bb", "c d", 4), (8, "AB", "c\u3000\tD\r\n", 4),
    (9, "ab", "c", 5), (10, "a", "bc", 6), (11, None, "e\u0301", 7), (12, "", "É", 7), (13, "ß", "SS", 8), (14, "ss", "ẞ", 8),
)
NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '#([^#\n]{{1,100}})#', '[TOPIC]\1[/TOPIC]', 'g'),
  '(^|[^\p{{L}}\p{{N}}_.+@-])@[\p{{L}}\p{{N}}_·.-]*[\p{{L}}\p{{N}}_·]', '\1[MENTION]', 'g'), '[ \t]+', ' ', 'g'), '(?m) +$|^ +', '', 'g'), chr(10) || ' ')"""
#: DuckDB has NFC, not NFKC, and lower case, not case folding: on these tables' letters only the sharp s makes a difference.
FOLDED = r"replace(regexp_replace(lower(nfc_normalize({0})), '\s', '', 'g'), 'ß', 'ss')"
#: Texts, what becomes of them, and how many addresses, topics, names and controls are in them.
REPLACED = (
    (1, "see https://a.example/x?y=1, and www.b.example.", "see [URL], and [URL].", 2, 0, 0, 0), (2, "#one two# by @ann-b- at a@b.c", "[TOPIC]one two[/TOPIC] by [MENTION]- at a@b.c", 0, 1, 1, 0),
    (3, "a\u200bb\ufeff\x07  c\u3000d", "ab c d", 0, 0, 0, 3), (4, "x\r\n\r\r\u2028\u0085 y ", "x\n\ny", 0, 0, 0, 0), (5, None, "", 0, 0, 0, 0), (6, "HTTP://A.B/#t#", "[URL]", 1, 0, 0, 0),
)
_OPS = '{"ops":[%s]}'
#: Posts that hold Delta documents, and their title, body, status, reason, text inserts and silent embeds.
DELTAS = (
    (1, "t", _OPS % '{"insert":"one\\n"},{"insert":{"image":"x"}},{"insert":"two","attributes":{"bold":true}},{"insert":{"cut-off":1}}', "t", "one\ntwo", "usable", "structure_usable", 2, 2),
    (2, "\ufeff " + _OPS % '{"insert":"head"}', "plain {", "head", "plain {", "usable", "structure_usable", 1, 0), (3, "t", '{"ops": [', "t", "", "invalid", "structured_text_malformed", 0, 0),
    (4, "t", '{"ops":{}}', "t", "", "invalid", "structured_text_operations_invalid", 0, 0), (5, "t", _OPS % '{"insert":"a"},{"retain":1}', "t", "", "invalid", "structured_text_operation_invalid", 1, 0),
    (6, _OPS % '{"insert":{"poll":1}}', "body", "", "body", "invalid", "structured_text_embed_unsupported", 0, 0), (7, "", _OPS % '{"insert":"\u200b\ufeff"}', "", "", "invalid", "structured_text_no_text", 1, 0),
    (8, '{"a":1}', "{plain", '{"a":1}', "{plain", "usable", "structure_usable", 0, 0), (9, "t", _OPS % "", "t", "", "invalid", "structured_text_no_text", 0, 0),
)
EXACT = f"sha256('T:' || {FOLDED.format('title')} || chr(31) || 'B:' || {FOLDED.format('body')})"

add(
    "text_topics",
    lambda s, d: docs(s, d).select("doc_id", text.replace_topics(F.col("text")).alias("body"), F.regexp_count("text", F.lit(text.TOPIC_PATTERN)).cast("long").alias("topics")),
    r"select doc_id, regexp_replace(text, '#([^#\n]{1,100})#', '[TOPIC]\1[/TOPIC]', 'g') as body, len(regexp_extract_all(text, '#([^#\n]{1,100})#'))::bigint as topics from documents",
)
add(
    "text_collapse",
    lambda s, d: docs(s, d).select("doc_id", text.collapse(F.col("text")).alias("body"), text.completeness(F.col("text")).cast("long").alias("completeness")),
    r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as body,
      length(regexp_replace(text, '\s', '', 'g'))::bigint as completeness from documents""",
)
add(
    "text_model_text",
    lambda s, d: posts(s, d).select("doc_id", F.sha2(text.model_text(F.col("title"), F.col("body")).cast("binary"), 256).alias("model_sha256"), F.length(text.near_text(F.col("title"), F.col("body"))).cast("long").alias("near_chars")),
    f"""with {POSTS} select doc_id, sha256('[TITLE]' || chr(10) || title || chr(10) || '[BODY]' || chr(10) || body) as model_sha256,
      length(regexp_replace(title || chr(10) || body, '^\\s+|\\s+$', '', 'g'))::bigint as near_chars from posts""",
)
add(
    "text_exact_key",
    lambda s, d: posts(s, d).select("doc_id", text.exact_key(F.col("title"), F.col("body")).alias("exact_sha256")),
    f"with {POSTS} select doc_id, {EXACT} as exact_sha256 from posts",
)
add(
    "text_exact_key_forms",
    lambda s, d: s.createDataFrame(FORMS, "i int, title string, body string, class int").withColumn("key", text.exact_key(F.col("title"), F.col("body"))).select("i", "class", F.min("i").over(Window.partitionBy("key")).alias("first")),
    "select i, class, min(i) over (partition by class) as first from (values " + ", ".join(f"({i}, {c})" for i, _, _, c in FORMS) + ") v(i, class)",
)
add(
    "text_structure_status",
    lambda s, d: posts(s, d).withColumn("s", text.structure_status(F.col("title"), F.col("body"), F.when(F.col("doc_id") % 7 == 0, "deleted").when(F.col("doc_id") % 7 == 1, " Partial ").otherwise("ok"))).groupBy("s.status", "s.reason").agg(F.count("*").alias("n")),
    f"""with {POSTS}, r as (select case when title || body = '' then 'empty_title_and_body' when doc_id % 7 = 0 then 'invalid_source_status'
      when doc_id % 7 = 1 then 'uncertain_source_status' else 'structure_usable' end as reason from posts)
      select case reason when 'structure_usable' then 'usable' when 'uncertain_source_status' then 'uncertain' else 'invalid' end as status, reason, count(*) as n from r group by all""",
)
add(
    "text_replacement_counts",
    lambda s, d: docs(s, d).withColumn("c", text.replacement_counts(F.col("text"))).agg(*[F.sum(F.col("c")[k]).cast("long").alias(k) for k in ("url", "topic", "control")]),
    r"""select sum(len(regexp_extract_all(text, 'https?://[^\s<>\[\]{}()!;,@]+|www\.[^\s<>\[\]{}()!;,@]+')))::bigint as url, sum(len(regexp_extract_all(text, '#([^#\n]{1,100})#')))::bigint as topic,
      sum(len(regexp_extract_all(text, '[\x00-\x08\x0E-\x1B\x7F]')))::bigint as control from documents""",
)
add(
    "text_replacement_forms",
    lambda s, d: s.createDataFrame([x[:2] for x in REPLACED], "i int, text string").withColumn("c", text.replacement_counts(F.col("text"))).select("i", text.normalise(F.col("text")).alias("normal"), *[F.col("c")[k].cast("long").alias(k) for k in ("url", "topic", "mention", "control")]),
    "select * from (values " + ", ".join("({}, '{}', {}::bigint, {}::bigint, {}::bigint, {}::bigint)".format(i, n.replace("\n", "' || chr(10) || '"), *c) for i, _, n, *c in REPLACED) + ") v(i, normal, url, topic, mention, control)",
)
add(
    "text_delta_forms",
    lambda s, d: s.createDataFrame([x[:3] for x in DELTAS], "i int, title string, body string").withColumn("n", normaliser.normalised(F.col("title"), F.col("body"), F.lit("ok"))).select("i", "n.title", "n.body", "n.status", "n.reason", "n.inserts", F.col("n.ignored_embeds").alias("embeds")),
    "select * from (values " + ", ".join("({}, '{}', '{}', '{}', '{}', {}, {})".format(i, *[x.replace("\n", "' || chr(10) || '") for x in want[:4]], *want[4:]) for i, _, _, *want in DELTAS) + ") v(i, title, body, status, reason, inserts, embeds)",
)
add("text_normalised_posts", lambda s, d: posts(s, d).select("doc_id", normaliser.normalised(F.col("title"), F.col("body"), F.lit("ok")).alias("n")).select("doc_id", "n.model_sha256", "n.exact_sha256", "n.status", "n.mentions", "n.topics", "n.emoji"))
add(
    "text_segments",
    lambda s, d: docs(s, d).select("doc_id", F.posexplode(text.segments(F.col("text"))).alias("position", "segment")).withColumn("position", F.col("position").cast("long")),
    r"""with c as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([。！？；!?;])', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') as p from documents),
      e as (select doc_id, case when len(p) = 0 then ['[EMPTY]'] else p end as p from c)
      select doc_id, generate_subscripts(p, 1)::bigint - 1 as position, unnest(p) as segment from e""",
)
add(
    "text_evidence_spans",
    lambda s, d: posts(s, d).withColumn("quote", F.nullif(F.substring(F.col("body"), 5, 24), F.lit(""))).withColumn("e", text.evidence_span(F.col("body"), F.col("quote"))).select("doc_id", F.col("e.start").cast("long").alias("start"), F.col("e.end").cast("long").alias("end")),
    f"""with {POSTS}, q as (select doc_id, body, nullif(substr(body, 5, 24), '') as quote from posts), f as (select *, instr(substr(body, instr(body, quote) + 1), quote) = 0 as single from q)
      select doc_id, case when single then instr(body, quote) - 1 end::bigint as start, case when single then instr(body, quote) + length(quote) - 1 end::bigint as "end" from f""",
)
add(
    "text_pipe_codes",
    lambda s, d: docs(s, d).select("doc_id", F.array_join(text.pipe_codes(F.concat_ws("|", "source", F.lit(" "), "lang", F.lit("x"), "source")), ",").alias("codes")),
    "select doc_id, array_to_string(list_sort(list_distinct([source, lang, 'x'])), ',') as codes from documents",
)
add(
    "text_parsers",
    lambda s, d: s.sql("select stack(9, 1, '7', '1.5', 2, '07', 'nan', 3, ' 12 ', ' ', 4, '+3', 'inf', 5, '1.0', '-2e3', 6, '', null, 7, null, 'x', 8, '0', '1e400', 9, '99999999999999999999', '0.1') as (i, a, b)").select(
        "i", text.positive_int(F.col("a")).alias("whole"), text.optional_float(F.col("b")).alias("real")
    ),
    "select * from (values (1, 7::bigint, 1.5::double), (2, null, null), (3, 12, null), (4, null, null), (5, null, -2000.0), (6, null, null), (7, null, null), (8, null, null), (9, null, 0.1)) v(i, whole, real)",
)
add(
    "text_title_fallback",
    lambda s, d: read_table(s, d, "pages").select("page_id", F.coalesce(F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)), F.lit("")), F.col("url")).alias("title")),
    "select page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), ''), url) as title from pages",
)
add(
    "text_has_text",
    lambda s, d: docs(s, d).groupBy("source").agg(F.count_if(text.has_text(F.col("text"))).alias("with_text"), F.count_if(~text.has_text(F.col("lang")) | ~text.has_text(F.col("text"))).alias("blank")),
    r"select source, count(*) filter (where regexp_matches(text, '\S')) as with_text, count(*) filter (where not regexp_matches(lang, '\S') or not regexp_matches(text, '\S')) as blank from documents group by source",
)
add(
    "ids_canonical",
    lambda s, d: docs(s, d).select("doc_id", values.canonical_hash(("source", F.col("source")), ("doc_id", F.col("doc_id")), ("lang", F.col("lang"))).alias("row_sha256"), values.keyed_id(24, F.lit("plan"), F.lit("wave-a"), F.col("doc_id"), F.lit(1)).alias("task_id")),
    """select doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') as row_sha256, substr(sha256('plan|wave-a|' || doc_id || '|1'), 1, 24) as task_id from documents""",
)
add(
    "ids_pseudo_probability",
    lambda s, d: docs(s, d).select("doc_id", values.pseudo_probability(F.col("doc_id")).alias("p"), values.seed_of(F.col("source")).cast("string").alias("seed")),
    "select doc_id, ('0x' || substr(sha256(doc_id::varchar), 1, 8))::bigint / 4294967296.0 as p, ('0x' || substr(sha256(source), 1, 16))::uhugeint::varchar as seed from documents",
)
add("ids_pseudonym", lambda s, d: docs(s, d).select("doc_id", values.pseudonym(b"round-1", F.col("source"), F.col("doc_id")).alias("pseudonym")))
add("ids_seventeen_digits", lambda s, d: docs(s, d).select("doc_id", values.seventeen_digits(values.pseudo_probability(F.col("doc_id"))).alias("digits")))
add(
    "numbers_dates",
    lambda s, d: read_table(s, d, "events").select("event_id", values.own_date(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))).cast("string").alias("day"), values.own_date(F.col("event_type")).cast("string").alias("none")),
    "select event_id, strftime(ts, '%Y-%m-%d') as day, null::varchar as none from events",
)
add(
    "numbers_ppm",
    lambda s, d: docs(s, d).select("doc_id", values.length_ratio_ppm(F.length("text"), F.lit(1500)).alias("ratio_ppm"), values.similarity_ppm(values.pseudo_probability(F.col("doc_id")) * 1.2 - 0.1).alias("similarity_ppm")),
    """select doc_id, least(length(text), 1500)::bigint * 1000000 // greatest(length(text), 1500) as ratio_ppm,
      greatest(0, least(1000000, floor((('0x' || substr(sha256(doc_id::varchar), 1, 8))::bigint / 4294967296.0 * 1.2 - 0.1) * 1e6 + 0.5)))::bigint as similarity_ppm from documents""",
)
add(
    "numbers_logit_blend",
    lambda s, d: docs(s, d).select("doc_id", F.round(values.logit_blend(values.pseudo_probability(F.col("doc_id"), "a"), values.pseudo_probability(F.col("doc_id"), "b"), 0.25), 9).alias("p")),
    """with p as (select doc_id, ('0x' || substr(sha256(doc_id || 'a'), 1, 8))::bigint / 4294967296.0 as a, ('0x' || substr(sha256(doc_id || 'b'), 1, 8))::bigint / 4294967296.0 as b from documents),
      c as (select doc_id, greatest(1e-6, least(1 - 1e-6, a)) as a, greatest(1e-6, least(1 - 1e-6, b)) as b from p)
      select doc_id, round(1 / (1 + exp(-(0.75 * ln(a / (1 - a)) + 0.25 * ln(b / (1 - b))))), 9) as p from c""",
)
add(
    "vectors_projection",
    lambda s, d: read_table(s, d, "embeddings").withColumn("u", values.project(F.col("embedding"), 16)).select("vec_id", F.size("u").cast("long").alias("n"), F.round(F.col("u")[0], 5).alias("first"), values.is_unit(F.col("u")).alias("is_unit"), F.round(values.norm(F.col("embedding")), 4).alias("norm")),
    """with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), u as (select vec_id, v, sqrt(list_sum(list_transform(v[1:16], lambda x: x * x))) as n from e)
      select vec_id, 16::bigint as n, round(v[1] / n, 5) as first, true as is_unit, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) as norm from u""",
)
add(
    "vectors_chunk_ranges",
    lambda s, d: read_table(s, d, "conversations").select("conv_id", "turn", F.posexplode(values.chunk_ranges(F.length("text"), 128)).alias("k", "r")).select("conv_id", "turn", F.col("k").cast("long").alias("k"), "r.start", "r.end"),
    """with c as (select conv_id, turn, length(text) as n from conversations), s as (select *, unnest(generate_series(0, greatest(0, (n - 1) // 128))) as k from c where n > 0)
      select conv_id, turn, k::bigint as k, (128 * k)::bigint as start, least(128 * k + 128, n)::bigint as "end" from s""",
)
add(
    "vectors_head_tail",
    lambda s, d: docs(s, d).withColumn("v", values.head_tail(F.length("text"), 511)).select("doc_id", "v.head", "v.tail", "v.omitted"),
    "select doc_id, least(length(text), 256)::bigint as head, least(length(text) - least(length(text), 256), 255)::bigint as tail, greatest(0, length(text) - 511)::bigint as omitted from documents",
)


def chunk_mean(spark, sf):
    """The mean of a group's vectors, of length one: averages per dimension, combined before the shuffle."""
    long = read_table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    mean = long.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = mean.groupBy("label").agg(F.sum(F.col("x") * F.col("x")).alias("n"))
    return mean.join(whole, "label").select("label", F.col("k").cast("long").alias("k"), F.round(F.col("x") / F.sqrt("n"), 4).alias("x"))


add(
    "vectors_chunk_mean",
    chunk_mean,
    """with l as (select label, generate_subscripts(embedding, 1) - 1 as k, unnest(embedding)::double as x from embeddings), m as (select label, k, avg(x) as x from l group by all),
      n as (select label, sum(x * x) as n from m group by label) select label, k::bigint as k, round(x / sqrt(n), 4) as x from m join n using (label)""",
)
