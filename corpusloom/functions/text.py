"""Text rules as column expressions, for whole-stage code generation.

White space is meant as Unicode has it (``(?U)\\s``), not as Java's ASCII default.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks and patterns that define the normalised form.
TITLE, BODY, URL, MENTION, EMOJI = "[TITLE]", "[BODY]", "[URL]", "[MENTION]", "[EMOJI]"
TOPIC_OPEN, TOPIC_CLOSE = "[TOPIC]", "[/TOPIC]"
URL_PATTERN = r"(?i)(?:https?://|www\.)[^\s<>\[\]{}（）()，。！？；：、、“”‘’,!;@]+"
TOPIC_PATTERN = r"#([^#\n]{1,100})#"
MENTION_PATTERN = r"(?<![\p{L}\p{N}_.+-])@[\p{L}\p{N}_·.-]+"
INVALID_STATUSES = ("error", "failed", "login_required", "deleted", "unavailable")
UNCERTAIN_STATUSES = ("partial", "unknown")
FULL_MATCH_RULES = (
    ("login_wall", "(?:请先登录|登录后查看|登录即可查看)"),
    ("capture_error", "(?:抓取失败|加载失败|网络错误|页面出错)"),
    ("content_unavailable", "(?:内容不存在|内容已删除|帖子不存在|该内容无法查看)"),
    ("placeholder_text", "(?:暂无内容|暂无正文|无正文|加载中[.。…]*)"),
)

_WS = r"(?U)\s"
#: The controls and white space of ASCII.
_ASCII_UNSEEN = "".join(map(chr, [*range(33), 127]))


def canonical_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n|[\r\u0085  ]", "\n")


def strip(c: Column) -> Column:
    """Drops white space of any kind at both ends."""
    return F.regexp_replace(c, rf"{_WS}+\z|\A{_WS}+", "")


def replace_urls(c: Column) -> Column:
    """``[URL]`` for a URL; closing ``.,!;:`` stay behind it."""
    # The match ends on a character that is no closing mark, or takes all if it has nothing else.
    return F.regexp_replace(c, URL_PATTERN[:-1] + r"*[^\s<>\[\]{}（）()，。！？；：、、“”‘’,!;@.:]|(?i)(?:https?://|www\.)(?=[.:])", URL)


def replace_topics(c: Column) -> Column:
    return F.regexp_replace(c, TOPIC_PATTERN, F.lit(TOPIC_OPEN + "$1" + TOPIC_CLOSE))


def replace_mentions(c: Column) -> Column:
    """``[MENTION]`` for a name behind @; closing ``.`` and ``-`` stay behind it."""
    return F.regexp_replace(c, r"(?<![\p{L}\p{N}_.+-])@[\p{L}\p{N}_·.-]*[\p{L}\p{N}_·]", MENTION)


def count_controls(c: Column) -> Column:
    """Format and control characters and variation selectors, white space aside."""
    return F.regexp_count(c, F.lit(r"(?U)[\p{Cf}\p{Cc}︎️&&[^\s]]"))


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)[\p{Cf}\p{Cc}︎️&&[^\s]]", ""), r"(?U)[\s&&[^\n]]", " ")


def collapse(c: Column) -> Column:
    """One space for a run of horizontal white space, stripped lines, two line ends at most in a row."""
    one = F.regexp_replace(c, r"(?U)[\s&&[^\n]]+", " ")
    lines = F.array_join(F.transform(F.split(one, "\n", -1), lambda x: F.trim(x)), "\n")
    return strip(F.regexp_replace(lines, "\n{3,}", "\n\n"))


def normalise(c: Column) -> Column:
    """The normalised field, but for NFKC and emoji, which need :mod:`normaliser`."""
    text = canonical_newlines(F.coalesce(c, F.lit("")))
    return collapse(strip_controls(replace_mentions(replace_topics(replace_urls(text)))))


def replacement_counts(c: Column) -> Column:
    """A map of how often each rule applies, in the order of the rules."""
    text = canonical_newlines(F.coalesce(c, F.lit("")))
    urls = replace_urls(text)
    topics = replace_topics(urls)
    mentions = replace_mentions(topics)
    return F.create_map(
        F.lit("url"), F.regexp_count(text, F.lit(URL_PATTERN)),
        F.lit("topic"), F.regexp_count(urls, F.lit(TOPIC_PATTERN)),
        F.lit("mention"), F.regexp_count(topics, F.lit(MENTION_PATTERN)),
        F.lit("control"), count_controls(mentions),
    )


def title_of(text: Column) -> Column:
    return F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)


def body_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + 1, F.length(text))).otherwise("")


def model_text(title: Column, body: Column) -> Column:
    return F.concat(F.lit(TITLE + "\n"), title, F.lit("\n" + BODY + "\n"), body)


def near_text(title: Column, body: Column) -> Column:
    return strip(F.concat_ws("\n", title, body))


def _folded(fields: pd.Series) -> pd.Series:
    from .normaliser import exact_field as fold

    return fields.map(lambda x: None if x is None else fold(x))


def exact_field(c: Column) -> Column:
    """The field in NFKC, without controls, case or white space.

    Plain ASCII stays in the JVM; only other fields go through the Arrow kernel,
    as Spark has neither NFKC nor full case folding.
    """
    text = F.coalesce(c, F.lit(""))
    other = F.when(F.octet_length(text) > F.length(text), text)
    plain = F.lower(F.translate(text, _ASCII_UNSEEN, ""))
    return F.coalesce(F.pandas_udf(_folded, "string")(other), plain)


def exact_key(title: Column, body: Column) -> Column:
    return F.sha2(F.concat(F.lit("T:"), exact_field(title), F.lit("\x1fB:"), exact_field(body)).cast("binary"), 256)


def structure_status(title: Column, body: Column, source_status: Column) -> Column:
    """(status, reason): the first rule that applies decides; short texts are never invalid."""
    say = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    status = F.lower(strip(F.coalesce(source_status, F.lit(""))))
    both = F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(body, F.lit("")))
    out = F.when(both == "", say("invalid", "empty_title_and_body")).when(status.isin(*INVALID_STATUSES), say("invalid", "invalid_source_status"))
    for name, pattern in FULL_MATCH_RULES:
        out = out.when(both.rlike(rf"(?i)\A{pattern}\z"), say("invalid", name))
    out = out.when(status.isin(*UNCERTAIN_STATUSES), say("uncertain", "uncertain_source_status"))
    out = out.when(both.rlike(r"(?U)\A(?:\[(?:URL|MENTION|EMOJI)\]|\s)+\z"), say("uncertain", "replacement_tokens_only"))
    return out.otherwise(say("usable", "structure_usable"))


def completeness(c: Column) -> Column:
    """Code points that are not white space."""
    return F.length(F.regexp_replace(c, _WS, ""))


def segments(c: Column) -> Column:
    """Sentences: cut behind ``。！？；!?;`` and at line ends; ``[EMPTY]`` for none."""
    parts = F.filter(F.transform(F.split(c, r"(?<=[。！？；!?;])|\n"), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("[EMPTY]")))


def evidence_span(text: Column, quote: Column, start: Column | None = None) -> Column:
    """(start, end) of a quote, from 0; null if it is absent, or repeated and no start is given."""
    at = F.instr(text, quote)
    found = F.when((at > 0) & (F.position(quote, text, at + 1) == 0), at - 1)
    if start is not None:
        found = F.when(start.isNotNull(), F.when(F.substr(text, start + 1, F.length(quote)) == quote, start)).otherwise(found)
    return F.when(found.isNotNull(), F.struct(found.alias("start"), (found + F.length(quote)).alias("end")))


def pipe_codes(c: Column) -> Column:
    """Sorted distinct codes of a ``|``-separated cell."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), strip), lambda x: x != "")))


def positive_int(c: Column) -> Column:
    """A whole number over 0 in its canonical form; white space around it is allowed, anything else null."""
    text = strip(c)
    return F.when(text.rlike(r"\A[1-9][0-9]*\z"), text.try_cast("bigint"))


def optional_float(c: Column) -> Column:
    value = F.nullif(strip(c), F.lit("")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def review_flag(c: Column) -> Column:
    """``?`` or ``1`` say yes, blank no; anything else is an error."""
    text = strip(F.coalesce(c, F.lit("")))
    return F.when(text.isin("?", "1"), True).when(text == "", False).otherwise(F.raise_error(F.lit("not a review flag")).cast("boolean"))


def has_text(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def url_of(canonical: Column, source: Column) -> Column:
    """The canonical address unless it is blank."""
    return F.coalesce(F.nullif(F.trim(canonical), F.lit("")), source)


def verification(raw: Column, flag: Column) -> Column:
    """What a profile says of its verification, or else ``VERIFIED`` or ``UNVERIFIED`` by its flag."""
    return F.when(has_text(raw), raw).when(flag == 1, "VERIFIED").when(flag == 0, "UNVERIFIED")


def observation(value: Column) -> Column:
    return F.when(value.isNotNull(), "OBSERVED").otherwise("MISSING")


def any_text(*fields: Column) -> Column:
    """Whether one of the fields is not blank."""
    out = F.lit(False)
    for field in fields:
        out = out | has_text(field)
    return out


def strong_conflict(label: Column, p: Column, cutoff: float = 0.9) -> Column:
    """Whether a probability (of ``unrelated``) contradicts the label strongly."""
    return F.coalesce(((label == "related") & (p >= cutoff)) | ((label == "unrelated") & (p <= 1 - cutoff)), F.lit(False))


def without_texts(rows: DataFrame, *texts: str) -> DataFrame:
    """The rows with a digest in place of each raw text."""
    return rows.withColumns({f"{c}_sha256": F.sha2(F.col(c).cast("binary"), 256) for c in texts}).drop(*texts)


def has_residue(model: Column) -> Column:
    """Whether a model text's body is still a Delta document, or the body's mark is missing."""
    mark = f"\n{BODY}\n"
    body = F.regexp_replace(F.substring(model, F.instr(model, mark) + len(mark), F.length(model)), rf"\A{_WS}+", "")
    ops = F.try_variant_get(F.try_parse_json(body), "$.ops", "array<variant>")
    return F.when(model.isNull() | (F.instr(model, mark) == 0), True).otherwise(body.startswith("{") & ops.isNotNull())
