"""Exact clusters, and near-duplicate pairs by shared rare n-grams and TF-IDF cosine."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.values import length_ratio_ppm, similarity_ppm
from corpusloom.plans.tables import stage


def exact_clusters(posts: DataFrame, key: str, id_col: str, platform: str) -> DataFrame:
    """Per key: representative (least id), size, and whether it spans platforms."""
    return posts.groupBy(key).agg(
        F.min(id_col).alias("representative"), F.count(F.lit(1)).alias("size"), (F.min(platform) != F.max(platform)).alias("is_cross_platform")
    )


def exact_members(posts: DataFrame, key: str, id_col: str) -> DataFrame:
    """Each row with its cluster's representative (least id) and size; a large cluster is counted before it is shuffled."""
    return posts.join(posts.groupBy(key).agg(F.min(id_col).alias("representative"), F.count(F.lit(1)).alias("size")), key)


def conflicts(rows: DataFrame, key: str, decision: str) -> DataFrame:
    """Keys with more than one decision."""
    return rows.groupBy(key).agg(F.count_distinct(decision).alias("decisions"), F.count(F.lit(1)).alias("rows")).filter("decisions > 1")


def grams(text, sizes=(3, 4, 5)):
    """All n-grams of a text, with repeats."""
    one = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*[one(n) for n in sizes]))


#: Code points of texts that the kernel takes at once (a longer text alone).
SLICE = 1 << 20
#: Shared n-grams up to this many (some 100 MB) are sent to every worker; beyond, texts and n-grams are joined by a shuffle.
BROADCAST_GRAMS = 2_000_000


class Grams:
    """The n-grams of some texts. They are numbered by the number of the one a character shorter and
    their last character, so equal numbers are equal n-grams."""

    def __init__(self, texts: list[str], within_lines: bool):
        joined = "".join(texts)
        self.codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.raw = np.frombuffer(joined.encode(), np.uint8)
        lengths = np.array([len(t) for t in texts])
        self.text = np.repeat(np.arange(len(texts)), lengths)
        place, stops = np.arange(len(self.codes)), np.cumsum(lengths)
        if within_lines:
            stops = np.union1d(stops, np.flatnonzero(self.codes == 10))
        self.room = stops[np.searchsorted(stops, place, "right")] - place  # characters up to the text's or the line's end
        if within_lines:
            self.room[self.codes == 10] = 0
        width = 1 + (self.codes > 0x7F).astype(np.int64) + (self.codes > 0x7FF) + (self.codes > 0xFFFF)
        self.byte = np.concatenate([[0], np.cumsum(width)])

    def by_size(self, sizes: tuple[int, ...]):
        """For each size: the size, the number of the n-gram at each place, and the places that have one."""
        one = np.unique(self.codes, return_inverse=True)[1]
        base, gram = int(one.max(initial=0)) + 1, one
        for n in range(1, max(sizes) + 1):
            if n > 1:
                gram = np.unique(gram[:-1] * base + one[n - 1 :], return_inverse=True)[1] if len(one) >= n else one[:0]
            if n in sizes:
                yield n, gram, np.flatnonzero(self.room[: len(gram)] >= n)

    def strings(self, start: np.ndarray, n: int) -> pa.Array:
        size = self.byte[start + n] - self.byte[start]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.raw[np.repeat(self.byte[start] - ends[:-1], size) + np.arange(ends[-1])]
        return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(data)).cast(pa.string())

    def packed(self, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return _pack([self.codes[start + k] for k in range(n)])

    def distinct(self, gram: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A place and a count for each (text, n-gram)."""
        _, first, times = np.unique(self.text[at] * (int(gram.max(initial=0)) + 1) + gram[at], return_index=True, return_counts=True)
        return at[first], times


def _pack(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Up to six characters as two numbers; equal numbers are equal n-grams."""
    out = []
    for part in (codes[:3], codes[3:]):
        number = np.zeros(len(codes[0]), np.uint64)
        for k in range(3):
            number = (number << np.uint64(21)) | (part[k].astype(np.uint64) + np.uint64(1) if k < len(part) else np.uint64(0))
        out.append(number)
    return out[0], out[1]


def _mixed(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    h = hi * np.uint64(0x9E3779B97F4A7C15) ^ (lo * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _sliced(batches, within_lines: bool):
    """(ids, n-grams) of runs of rows of (id, text). Runs of white space count as one space unless lines part the grams."""
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        if not within_lines:
            texts = [_one_space(t) for t in texts]
        ends = np.cumsum([len(t) for t in texts])
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
            yield batch.column(0).slice(lo, hi - lo), Grams(texts[lo:hi], within_lines)
            lo = hi


def _one_space(text: str) -> str:
    return re.sub(r"\s\s+", " ", text)


def gram_counts(texts: DataFrame, sizes: tuple[int, ...] = (3, 4, 5), within_lines: bool = False) -> DataFrame:
    """(id, gram, n): the distinct n-grams of each text of (id, text), counted within the text."""

    def count(batches):
        for ids, grams in _sliced(batches, within_lines):
            for n, gram, at in grams.by_size(sizes):
                start, times = grams.distinct(gram, at)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(grams.text[start])), grams.strings(start, n), pa.array(times, pa.int64())], ["id", "gram", "n"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(count, f"id {kind}, gram string, n bigint")


def gram_frequencies(texts: DataFrame, sizes: tuple[int, ...] = (3, 4, 5), within_lines: bool = False) -> DataFrame:
    """(gram, df): in how many rows of (id, text) each n-gram is; counted in the kernel before the shuffle."""

    def count(batches):
        for _, grams in _sliced(batches, within_lines):
            for n, gram, at in grams.by_size(sizes):
                start, _ = grams.distinct(gram, at)
                _, first, times = np.unique(gram[start], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([grams.strings(start[first], n), pa.array(times, pa.int64())], ["gram", "n"])

    return texts.select("id", "text").mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("df"))


def _hashed(text: str, sizes: tuple[int, ...], within_lines: bool):
    """For each size: the size, a 64-bit hash of each n-gram of a text, and where it starts."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.concatenate([[0], np.cumsum(codes == 10)]) if within_lines else None
    h = _mixed(codes, np.zeros(len(codes), np.uint64))
    for n in range(1, max(sizes) + 1):
        if n > 1:
            h = _mixed(h[:-1], codes[n - 1 :] + np.uint64(1))
        if n > len(codes):
            return
        if n in sizes:
            at = np.flatnonzero(ends[n:] == ends[:-n]) if within_lines else np.arange(len(h))
            yield n, h[at], at


def _text_terms(text: str, sizes: tuple[int, ...], within_lines: bool) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's n-grams in order, and how often each is in it."""
    h = np.sort(np.concatenate([np.zeros(0, np.uint64), *[h for _, h, _ in _hashed(text, sizes, within_lines)]]))
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(first, append=len(h))


#: Terms that the counting kernel gathers before it sums them up.
PENDING = 1 << 22


def term_frequencies(texts: DataFrame, sizes: tuple[int, ...] = (3, 4, 5), within_lines: bool = False) -> DataFrame:
    """(term, df): in how many rows of (id, text) each n-gram is, by its 64-bit hash; a task sums up what it reads."""

    def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts, first)

    def told(keys: np.ndarray, counts: np.ndarray):
        for k in range(0, len(keys), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 17)].view(np.int64)), pa.array(counts[k : k + (1 << 17)], pa.int64())], ["term", "n"])

    def count(batches):
        keys, counts, pending, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for text in batch.column(1):
                text = text.as_py() or ""
                own, _ = _text_terms(text if within_lines else _one_space(text), sizes, within_lines)
                pending.append(own)
                held += len(own)
                if held >= PENDING:
                    new = np.sort(np.concatenate(pending))
                    first = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]]))
                    keys, counts = summed(np.concatenate([keys, new[first]]), np.concatenate([counts, np.diff(first, append=len(new))]))
                    pending, held = [], 0
                    if len(keys) >= PENDING:
                        yield from told(keys, counts)
                        keys, counts = keys[:0], counts[:0]
        if held:
            new = np.concatenate(pending)
            keys, counts = np.concatenate([keys, new]), np.concatenate([counts, np.ones(len(new), np.int64)])
        if len(keys):
            yield from told(*summed(keys, counts))

    return texts.select("id", "text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def _sorted_terms(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    keys = table.column("term").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table.column(column).to_numpy()[order]


def _found(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes a sorted table has, and where."""
    if not len(keys):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[at] == h, at


def blocking_keys(texts: DataFrame, per_doc: int = 12, ratio_ppm: int = 50_000, cap: int = 200, sizes: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """(id, gram, df): the rarest n-grams (within lines) of each text that other texts share.

    The order is by frequency, longer first, then by code point. The texts are
    read twice: for the frequencies, and to pick from those that are eligible.
    """
    n_docs = texts.count()
    most = max(2, min(cap, n_docs * ratio_ppm // 1_000_000))
    eligible = stage(term_frequencies(texts, sizes, within_lines=True).filter(F.col("df").between(2, most)), "eligible-grams")
    if eligible.count() > BROADCAST_GRAMS:
        eligible = stage(gram_frequencies(texts, sizes, within_lines=True).filter(F.col("df").between(2, most)), "eligible-grams")
        rank = Window.partitionBy("id").orderBy("df", F.desc(F.length("gram")), "gram")
        counts = gram_counts(texts, sizes, within_lines=True).select("id", "gram")
        return counts.join(eligible, "gram").withColumn("k", F.row_number().over(rank)).filter(F.col("k") <= per_doc).select("id", "gram", "df")
    sent = texts.sparkSession.sparkContext.broadcast(_sorted_terms(eligible.toArrow(), "df"))  # bounded by BROADCAST_GRAMS

    def pick(batches):
        keys, frequency = sent.value
        for batch in batches:
            rows, names, dfs = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                text, starts, lengths, df = text or "", [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for n, h, at in _hashed(text, sizes, True):
                    own, first = np.unique(h, return_index=True)
                    hit, place = _found(keys, own)
                    starts.append(at[first[hit]])
                    lengths.append(np.full(len(starts[-1]), n))
                    df.append(frequency[place[hit]])
                start, length, df = np.concatenate(starts), np.concatenate(lengths), np.concatenate(df)
                if len(df) > per_doc:
                    few = np.flatnonzero(df <= np.partition(df, per_doc - 1)[per_doc - 1])
                    start, length, df = start[few], length[few], df[few]
                found = sorted(zip(df.tolist(), (-length).tolist(), [text[i : i + n] for i, n in zip(start.tolist(), length.tolist())]))[:per_doc]  # strings compare by code point
                rows += [row] * len(found)
                names += [x[2] for x in found]
                dfs += [x[0] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(dfs, pa.int64())], ["id", "gram", "df"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(pick, f"id {kind}, gram string, df bigint")


def blocked_pairs(keys: DataFrame) -> DataFrame:
    """Pairs that share keys, and how many; a key's frequency is capped, so its pairs are too."""
    left, right = keys.select(F.col("id").alias("left"), "gram"), keys.select(F.col("id").alias("right"), "gram")
    return left.join(right, "gram").filter("left < right").groupBy("left", "right").agg(F.count(F.lit(1)).alias("shared"))


def tfidf(counts: DataFrame, n_docs: int, min_df: int = 1, max_df: int | None = None, sublinear: bool = False, frequencies: DataFrame | None = None) -> DataFrame:
    """(id, gram, w): term frequency times smooth idf, each text's vector of length one.

    ``frequencies`` (gram, df) may cover more texts than ``counts`` does; without
    it they come from ``counts``. The weights are a staged table.
    """
    df = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df")) if frequencies is None else frequencies
    df = df.filter(F.col("df") >= min_df)
    if max_df is not None:
        df = df.filter(F.col("df") <= max_df)
    idf = df.select("gram", (F.ln((1.0 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))
    tf = 1 + F.ln("n") if sublinear else F.col("n").cast("double")
    raw = stage(counts.join(idf, "gram").select("id", "gram", (tf * F.col("idf")).alias("w")), "term-weights")
    length = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, "id").select("id", "gram", (F.col("w") / F.col("length")).alias("w"))


def _dots(batches):
    for batch in batches:
        out = []
        for ga, wa, gb, wb in zip(batch["ga"], batch["wa"], batch["gb"], batch["wb"]):
            _, i, j = np.intersect1d(ga, gb, assume_unique=True, return_indices=True)
            out.append(float(np.dot(np.asarray(wa)[i], np.asarray(wb)[j])))
        yield pd.DataFrame({"left": batch["left"], "right": batch["right"], "similarity": out})


def pair_cosines(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """(left, right, similarity) of the given pairs: each text's vector meets only its own pairs."""
    kind = pairs.schema["left"].dataType.simpleString()
    needed = pairs.select(F.col("left").alias("id")).union(pairs.select("right")).distinct()
    vector = weights.join(needed, "id", "left_semi").groupBy("id").agg(F.collect_list(F.struct(F.xxhash64("gram").alias("g"), "w")).alias("v"))
    vector = stage(vector.select("id", F.col("v.g").alias("g"), F.col("v.w").alias("w")), "vectors")  # one text's terms in a row
    side = lambda s, c: vector.select(F.col("id").alias(s), F.col("g").alias("g" + c), F.col("w").alias("w" + c))
    met = pairs.select("left", "right").join(side("right", "b"), "right").join(side("left", "a"), "left").select("left", "right", "ga", "wa", "gb", "wb")
    return met.mapInPandas(_dots, f"left {kind}, right {kind}, similarity double")


#: Bits of a vector's sketch, in columns of 64.
BITS = 1024
#: Directions that terms are summed up in before the sketch is taken.
FOLDS = 4096
#: A vector with fewer terms, or a term of a larger share of its squared length, has no sketch: its bits would not behave as random ones.
SKETCH_TERMS, SKETCH_SHARE = 256, 0.01
#: A pair's share of different bits may exceed that of the threshold's angle by so much, 7.3 standard deviations (see :func:`_sketches`).
SLACK = 0.095
#: Weights of up to so many terms (16 bytes each) are sent to every worker; beyond, texts and terms are joined by a shuffle.
BROADCAST_TERMS = 8_000_000
#: Ids of up to so many texts are broadcast.
BROADCAST_IDS = 1_000_000


def _vector(text: str, keys: np.ndarray, idf: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(places in the table of terms, weights) of a text, of length one or empty."""
    h, n = _text_terms(_one_space(text), sizes, False)
    hit, at = _found(keys, h)
    w = (1 + np.log(n[hit])) * idf[at[hit]]
    return at[hit], w / max(np.sqrt(np.dot(w, w)), 1e-300)


def _sketches(texts: DataFrame, sent, sizes: tuple[int, ...]) -> DataFrame:
    """(id, s0, s1, ...): on which side of ``BITS`` random planes each text's vector lies; nulls where it has too few terms to tell.

    Terms are folded with random signs into ``FOLDS`` directions, which are turned
    by random signs and a Hadamard matrix. Of two vectors at the angle a, a share
    of about a / pi of the bits differ, with a standard deviation of
    sqrt(p (1 - p) / BITS), 0.0126 at a cosine of 0.8, and 0.003 from the folding.
    """
    rng = np.random.default_rng(20)
    turn, taken = rng.choice(np.array([-1, 1], np.float32), FOLDS), rng.permutation(FOLDS)[:BITS]
    columns = [f"s{k}" for k in range(BITS // 64)]

    def sketch(batches):
        keys, idf = sent.value
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                folded, told = np.zeros((len(part), FOLDS), np.float32), np.zeros(len(part), bool)
                for row, text in enumerate(part.column(1).to_pylist()):
                    at, w = _vector(text or "", keys, idf, sizes)
                    told[row] = len(w) >= SKETCH_TERMS and np.max(w * w) <= SKETCH_SHARE
                    if told[row]:
                        h = _mixed(keys[at], np.full(len(at), 77, np.uint64))
                        folded[row] = np.bincount((h >> np.uint64(40)).astype(np.int64) % FOLDS, np.where(h >> np.uint64(63), w, -w), FOLDS)
                x, step = folded * turn, 1
                while step < FOLDS:
                    x = x.reshape(len(part), -1, 2, step)
                    x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
                    step *= 2
                bits = np.ascontiguousarray(np.packbits(x.reshape(len(part), FOLDS)[:, taken] > 0, axis=1)).view(np.int64).T.copy()
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(bits[k], mask=~told) for k in range(len(columns))]], ["id", *columns])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(sketch, f"id {kind}, " + ", ".join(f"{c} bigint" for c in columns))


def _text_cosines(pairs: DataFrame, texts: DataFrame, sent, sizes: tuple[int, ...]) -> DataFrame:
    """Adds ``similarity`` to staged pairs (left, right, ...): the exact cosine, worked out from the two texts."""
    ids = stage(pairs.select(F.col("left").alias("id")).union(pairs.select("right")).distinct(), "paired")
    needed = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    side = lambda s, c: needed.select(F.col("id").alias(s), F.col("text").alias(c))
    names = pairs.columns
    met = pairs.join(side("right", "__b"), "right").join(side("left", "__a"), "left").select(*names, "__a", "__b")

    def cosines(batches):
        keys, idf = sent.value
        last, vector = None, None  # a left text's pairs mostly stand side by side
        for batch in batches:
            out = []
            for a, b in zip(batch.column("__a"), batch.column("__b")):
                a, b = a.as_py() or "", b.as_py() or ""
                if vector is None or a != last:
                    last, vector = a, _vector(a, keys, idf, sizes)
                at, w = _vector(b, keys, idf, sizes)
                _, i, j = np.intersect1d(vector[0], at, assume_unique=True, return_indices=True)
                out.append(float(np.dot(vector[1][i], w[j])))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out, pa.float64())], [*names, "similarity"])

    return met.mapInArrow(cosines, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields) + ", similarity double")


def near_pairs(texts: DataFrame, threshold_ppm: int = 800_000, min_ratio_ppm: int = 500_000, min_chars: int = 3, max_df_ratio: float = 0.995) -> DataFrame:
    """Candidate pairs of (id, text) rows: shared rare n-grams, similar length, TF-IDF cosine.

    Returns ``left, right, similarity_ppm, length_ratio_ppm, shared``. Candidates
    never merge anything. Texts under ``min_chars`` code points, line ends
    aside, take no part; null texts count as empty.

    The cosine is worked out from the two texts of a pair, which are brought
    together only where their sketches may belong to a pair at the threshold; the
    chance that such a pair is missed is some 1e-12.
    """
    long_enough = texts.filter(F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) >= min_chars)
    long_enough = stage(long_enough.select("id", "text"), "near-texts")
    n, sizes = long_enough.count(), (3, 4, 5)
    pairs = stage(blocked_pairs(stage(blocking_keys(long_enough, sizes=sizes), "blocking-keys")), "blocked-pairs")
    size = stage(long_enough.select("id", F.length("text").alias("c")), "near-sizes")
    sized = pairs.join(size.withColumnRenamed("id", "left").withColumnRenamed("c", "cl"), "left").join(size.withColumnRenamed("id", "right").withColumnRenamed("c", "cr"), "right")
    sized = stage(sized.select("left", "right", "shared", length_ratio_ppm(F.col("cl"), F.col("cr")).alias("length_ratio_ppm")).filter(F.col("length_ratio_ppm") >= min_ratio_ppm), "sized-pairs", sweep=True)
    most = max(2, int(max_df_ratio * n))
    terms = stage(term_frequencies(long_enough, sizes).filter(F.col("df").between(2, most)).select("term", (F.ln((1.0 + n) / (1 + F.col("df"))) + 1).alias("idf")), "terms")
    if terms.count() > BROADCAST_TERMS:
        paired = stage(sized.select(F.col("left").alias("id")).union(sized.select("right")).distinct(), "paired")
        counts = gram_counts(long_enough.join(paired, "id", "left_semi"))
        weights = tfidf(counts, n, 2, most, sublinear=True, frequencies=gram_frequencies(long_enough))
        scored = pair_cosines(sized, weights).join(sized, ["left", "right"])
    else:
        sent = texts.sparkSession.sparkContext.broadcast(_sorted_terms(terms.toArrow(), "idf"))  # bounded by BROADCAST_TERMS
        apart = float(np.arccos(threshold_ppm / 1e6)) / np.pi + SLACK
        if apart < 0.5:
            sketches = stage(_sketches(long_enough, sent, sizes), "sketches")
            columns = sketches.columns[1:]
            side = lambda s: sketches.select(F.col("id").alias(s), *[F.col(c).alias(s + c) for c in columns])
            differ = sum(F.bit_count(F.col("left" + c).bitwiseXOR(F.col("right" + c))) for c in columns)
            near = sized.join(side("right"), "right").join(side("left"), "left").filter(F.coalesce(differ <= int(apart * BITS), F.lit(True)))
            sized = stage(near.select(*sized.columns), "near-sketches", sweep=True)
        scored = _text_cosines(sized, long_enough, sent, sizes)
    scored = scored.withColumn("similarity_ppm", similarity_ppm(F.col("similarity")))
    return scored.filter(F.col("similarity_ppm") >= threshold_ppm).select("left", "right", "similarity_ppm", "length_ratio_ppm", "shared")


def all_pairs(texts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Every pair of (id, text, hash) rows with equal hashes or a cosine of ``threshold`` or more.

    The inverted join over terms that both texts hold takes the place of the
    comparison of all pairs: a pair without a common term has cosine 0. A text's
    terms are cut to the prefix that could still reach the threshold: with terms
    by falling rarity, a pair at the threshold shares one within it.
    """
    n = texts.count()
    weights = tfidf(stage(gram_counts(texts), "gram-counts"), n)
    df = weights.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rare = Window.partitionBy("id").orderBy("df", "gram")
    # What the terms from here on weigh together bounds the cosine that they can still add.
    rest = 1 - F.sum(F.col("w") * F.col("w")).over(rare.rowsBetween(Window.unboundedPreceding, -1))
    prefix = weights.join(df.filter("df > 1"), "gram").withColumn("rest", F.sqrt(F.greatest(F.lit(0.0), F.coalesce(rest, F.lit(1.0))))).filter(F.col("rest") >= threshold - 1e-9)
    keys = prefix.select("id", "gram")
    pairs = blocked_pairs(keys).select("left", "right")
    same = texts.select("id", "hash")
    equal = same.select(F.col("id").alias("left"), "hash").join(same.select(F.col("id").alias("right"), "hash"), "hash").filter("left < right").select("left", "right", F.lit(True).alias("equal"))
    scored = pair_cosines(stage(pairs, "prefix-pairs"), weights).filter(F.col("similarity") >= threshold)
    both = scored.join(equal, ["left", "right"], "full_outer")
    return both.select("left", "right", F.when(F.col("equal"), "exact_normalized_hash").otherwise("text_similarity").alias("reason"), F.round(F.coalesce("similarity", F.lit(1.0)), 6).alias("similarity"))
