"""Quality rules by host: rule failures of a host's documents decide on all of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import SEPARATOR, Words, piece_codes, slices
from .shared import join_by_source, read_table, stage

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True

_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _measure(batches):
    for batch in batches:
        parts = {c: [] for c in _COLUMNS}
        for _, _, data, offsets, _ in slices(batch.column("__text")):
            words = Words(data, offsets)
            parts["n_words"].append(words.n)
            parts["word_chars"].append(_per_text(((data & 0xC0) != 0x80) & ~SEPARATOR[data], offsets))
            parts["n_symbols"].append(_per_text(_SYMBOL[data], offsets))
            dup = []
            raw = data.tobytes()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
                dup.append(len(lines) - len(set(lines)))
            parts["n_dup_lines"].append(np.array(dup, np.int64))
            # Words are numbered by their bytes, windows by their words' numbers, so that equal numbers are equal windows.
            one = np.unique(piece_codes(data, words.start, words.end), return_inverse=True)[1]
            at = np.flatnonzero(words.whole(3))
            key = np.repeat(np.arange(len(words.n)), words.n)[at]
            for k in range(3):
                key = np.unique(key * (len(one) + 1) + one[at + k], return_inverse=True)[1]
            again = at[np.bincount(key)[key] > 1] if len(at) else at
            covered = np.zeros(len(one), bool)
            for k in range(3):
                covered[again + k] = True
            parts["n_repeat_words"].append(_per_text(covered, words.first))
        found = [np.concatenate(parts[c]) if parts[c] else np.zeros(0, np.int64) for c in _COLUMNS]
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*kept, *[pa.array(x, pa.int64()) for x in found]], [*batch.schema.names[:-1], *_COLUMNS])


def measure(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The base figures of every whole text; a null text has none of anything."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("__host"), F.col(text_col).alias("__text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"doc_id {kinds['doc_id']}, __host {kinds['__host']}, " + ", ".join(f"{c} bigint" for c in _COLUMNS)
    return rows.mapInArrow(_measure, schema)


def host_verdicts(base: DataFrame, max_rate: float = 0.5, least: float = 1.0, most: float = 1e6) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate and verdict.

    The prior Beta(m * s, (1 - m) * s) has the mean m of all documents and the
    strength s = m (1 - m) / v - 1, within ``least`` and ``most``, that the
    variance v of the hosts' rates implies. A host's rate is its posterior mean.
    """
    hosts = base.groupBy("__host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    prior = hosts.agg((F.sum("failed") / F.sum("n")).alias("m"), F.var_pop(F.col("failed") / F.col("n")).alias("v"))
    strength = F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(most))
    prior = prior.select("m", F.greatest(F.lit(least), F.least(F.lit(most), strength)).alias("s"))
    rate = (F.col("failed") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s"))
    return hosts.crossJoin(F.broadcast(prior)).select("__host", "n", "failed", rate.alias("rate"), (rate <= max_rate).alias("host_kept"))


def host_quality(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, max_rate: float = 0.5, **columns) -> DataFrame:
    """Judges every document by its own figures and by its host's verdict.

    A document fails the base rules with under ``min_words`` words or with more
    than ``max_repeat_percent`` of its words in repeated 3-word windows. A host
    whose shrunk rate of failures is over ``max_rate`` loses all its documents.
    Returns ``doc_id``, the five figures, ``base_failed, host_rate, kept``.

    Nulls: a null text has no words and fails; the null host is a host of its
    own; a null id stays null. Repeated rows count each. An empty table gives
    an empty result. Other columns are ignored.
    """
    base = measure(docs, **columns).withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent))
    base = stage(base, "quality-base")
    verdicts = stage(host_verdicts(base, max_rate), "quality-hosts").select(F.col("__host").alias("__key"), F.col("rate").alias("host_rate"), "host_kept")
    out = join_by_source(base, "__host", verdicts, "__key", F.col("doc_id"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("__host", "host_kept")


def op5_host_quality(spark, sf_dir: str) -> DataFrame:
    return host_quality(read_table(spark, sf_dir, "documents")).drop("host_rate")


SQL = r"""
with w as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
g as (select doc_id, unnest(generate_series(1, len(words) - 2)) as i, words from w where len(words) > 2),
h as (select doc_id, i, list_slice(words, i, i + 2) as gram from g),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from h) where n > 1),
c as (select doc_id, count(distinct i + k)::bigint as n_repeat_words from r, (values (0), (1), (2)) v(k) group by doc_id),
l as (select doc_id, unnest(string_split(text, chr(10))) as line from w),
u as (select doc_id, (count(*) - count(distinct line))::bigint as n_dup_lines from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
b as (select w.doc_id, w.source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from w left join c using (doc_id) left join u using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b),
o as (select source, count(*) as n, count(*) filter (where base_failed) as failed from f group by source),
p as (select sum(failed) / sum(n) as m, var_pop(failed / n) as v from o),
s as (select m, greatest(1.0, least(1e6, case when v > 0 then m * (1 - m) / v - 1 else 1e6 end)) as s from p),
k as (select source, (failed + m * s) / (n + s) <= 0.5 as host_kept from o, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and host_kept as kept
from f join k on f.source is not distinct from k.source
"""
