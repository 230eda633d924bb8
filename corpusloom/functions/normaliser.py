"""The full normaliser as one Arrow UDF: what Spark has no function for (NFKC, emoji, case folding, Delta JSON)."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as rules

# Embeds that a structured document may hold without saying anything.
IGNORED_EMBEDS = frozenset({"article-card", "cut-off", "image", "native-image", "video-card"})
SCHEMA = (
    "title string, body string, model_text string, model_sha256 string, exact_sha256 string, status string, reason string, "
    "urls int, topics int, mentions int, emoji int, controls int, inserts int, ignored_embeds int"
)
# How clusters, pictures, horizontal white space, line ends and token-only texts are told.
_url, _topic, _mention = (regex.compile(p) for p in (rules.URL_PATTERN, rules.TOPIC_PATTERN, rules.MENTION_PATTERN))
_cluster, _pictograph, _flat = regex.compile(r"\X"), regex.compile(r"\p{Extended_Pictographic}"), regex.compile(r"[^\S\n]+")
_newline = re.compile("\r\n|[\r\x85  ]")
_unseen = regex.compile(r"[\s\p{Cf}\p{Cc}]*")
_says_ops = re.compile(r"""["']ops["']\s*:""")
_status_rules = [(name, re.compile(pattern, re.IGNORECASE)) for name, pattern in rules.FULL_MATCH_RULES]
_tokens_only = re.compile(r"(?:\[(?:URL|MENTION|EMOJI)\]|\s)+")


def _clean(text: str) -> tuple[str, int]:
    out, gone = [], 0
    for c in text:
        if c == "\n" or not (c.isspace() or c in "︎️" or unicodedata.category(c) in ("Cf", "Cc")):
            out.append(c)
        elif c.isspace():
            out.append(" ")
        else:
            gone += 1
    return "".join(out), gone


def _keeping(pattern: regex.Pattern, token: str, tail: str, text: str) -> tuple[str, int]:
    """Replaces matches by the token but leaves closing marks of ``tail`` behind it."""
    return pattern.subn(lambda m: token + m[0][len(m[0].rstrip(tail)) :], text)


def normalise_field(value: str | None) -> tuple[str, dict[str, int]]:
    text, counts = unicodedata.normalize("NFKC", _newline.sub("\n", value or "")), {}
    text, counts["urls"] = _keeping(_url, rules.URL, ".,!;:", text)
    text, counts["topics"] = _topic.subn(lambda m: rules.TOPIC_OPEN + _flat.sub(" ", m[1].strip()) + rules.TOPIC_CLOSE, text)
    text, counts["mentions"] = _keeping(_mention, rules.MENTION, ".-", text)
    pieces = [rules.EMOJI if _pictograph.search(x) else x for x in _cluster.findall(text)] if not text.isascii() else [text]
    counts["emoji"] = sum(a == rules.EMOJI for a in pieces) if not text.isascii() else 0
    text, counts["controls"] = _clean("".join(pieces))
    text = "\n".join(line.strip() for line in _flat.sub(" ", text).split("\n"))
    return re.sub("\n{3,}", "\n\n", text).strip(), counts


def exact_field(value: str | None) -> str:
    text, _ = _clean(unicodedata.normalize("NFKC", _newline.sub("\n", value or "")))
    return "".join(text.casefold().split())


def _insert(step: object) -> tuple[str | None, str | None]:
    """The text that one step of a Delta document inserts (None for an embed that says nothing), or what is wrong with it."""
    allowed = isinstance(step, dict) and {"insert"} <= step.keys() <= {"insert", "attributes"}
    if not allowed or not isinstance(step.get("attributes", {}), dict):
        return None, "structured_text_operation_invalid"
    held = step["insert"]
    if isinstance(held, str):
        return held, None
    silent = isinstance(held, dict) and len(held) == 1 and set(held) <= IGNORED_EMBEDS
    return None, None if silent else "structured_text_embed_unsupported"


def project_delta(value: str | None) -> tuple[str, str | None, int, int]:
    """(text, what is wrong, text inserts, silent embeds) of a field that may be a Delta document.

    A field that is none comes back as it is. One that is damaged, unsupported
    or without text has no text at all, so that its markup never passes for one.
    """
    raw = value or ""
    document = raw[_unseen.match(raw).end() :]
    if not document.startswith("{"):
        return raw, None, 0, 0
    try:
        found = json.loads(document)
    except (ValueError, RecursionError):
        return ("", "structured_text_malformed", 0, 0) if _says_ops.search(document) else (raw, None, 0, 0)
    if "ops" not in found:
        return raw, None, 0, 0
    if not isinstance(found["ops"], list):
        return "", "structured_text_operations_invalid", 0, 0
    fault, read = None, []
    for text, fault in map(_insert, found["ops"]):
        if fault:
            break
        read.append(text)
    parts = [text for text in read if text is not None]
    if not fault and not _clean("".join(parts))[0].strip():
        fault = "structured_text_no_text"
    return "" if fault else "".join(parts), fault, len(parts), len(read) - len(parts)


def status_of(title: str, body: str, source: str | None) -> tuple[str, str]:
    state, both = (source or "").strip().casefold(), "\n".join(x for x in (title, body) if x)
    if not both:
        return "invalid", "empty_title_and_body"
    if state in rules.INVALID_STATUSES:
        return "invalid", "invalid_source_status"
    for name, pattern in _status_rules:
        if pattern.fullmatch(both):
            return "invalid", name
    if state in rules.UNCERTAIN_STATUSES:
        return "uncertain", "uncertain_source_status"
    return ("uncertain", "replacement_tokens_only") if _tokens_only.fullmatch(both) else ("usable", "structure_usable")


def normalise_post(title: str | None, body: str | None, source: str | None) -> tuple:
    fields = [project_delta(x) for x in (title, body)]
    (head, a), (tail, b) = (normalise_field(text) for text, *_ in fields)
    reason = fields[0][1] or fields[1][1]
    state = ("invalid", reason) if reason else status_of(head, tail, source)
    whole = f"{rules.TITLE}\n{head}\n{rules.BODY}\n{tail}"
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    exact = digest("\x1f".join(f"{mark}:{exact_field(text)}" for mark, (text, *_) in zip("TB", fields))) if state[0] == "usable" else None
    counts = [a[k] + b[k] for k in ("urls", "topics", "mentions", "emoji", "controls")]
    return (head, tail, whole, digest(whole), exact, *state, *counts, fields[0][2] + fields[1][2], fields[0][3] + fields[1][3])


def _normalise(title: pd.Series, body: pd.Series, source: pd.Series) -> pd.DataFrame:
    plain = lambda s: [None if x is None or x != x else x for x in s]
    rows = [normalise_post(*x) for x in zip(plain(title), plain(body), plain(source))]
    return pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")])


def normalised(title: Column, body: Column, source_status: Column) -> Column:
    """The normalised post as a struct; null fields count as empty."""
    return F.pandas_udf(_normalise, SCHEMA)(title, body, source_status)
