"""Toxicity by a chain of linear models over word and word-part features.

The categories are predicted one after another; each model also sees the
probabilities of the categories before it. For training these come from models
that were fitted without the row's own fold, so that a later model learns how
far it can rely on an earlier one.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, read_table, stage

#: Labelled rows used for fitting (about), features for each category, folds, and the least number of texts with a feature.
SAMPLE, FEATURES, FOLDS, LEAST = 10_000, 600, 5, 5
CACHE = 300_000
#: Stripped from both ends of a word.
MARKS = ".,;:!?#$%&*|<>()[]{}\"'"


def parts(word: str) -> tuple[str, ...]:
    """A word's features: itself, its beginnings and its ends of 4 to 6 characters."""
    word = word.strip(MARKS)
    return ("=" + word, *["^" + word[:n] for n in (4, 5, 6) if len(word) >= n], *[word[-n:] + "$" for n in (4, 5, 6) if len(word) >= n])


class _Parts(dict):
    """Features of each word seen, from a vocabulary if one is given; a full cache starts anew."""

    def __init__(self, known: dict[str, int] | None = None):
        self.known = known

    def __missing__(self, word: str) -> tuple:
        found = parts(word)
        if self.known is not None:
            found = tuple(self.known[x] for x in found if x in self.known)
        if len(self) >= CACHE:
            self.clear()
        self[word] = found
        return found


def features(text: str | None, cache: _Parts) -> set:
    """The features that a whole text has."""
    return set().union(*map(cache.__getitem__, set((text or "").lower().split())))


def _fit(x: np.ndarray, y: np.ndarray, count: np.ndarray, rounds: int = 300, penalty: float = 1e-4) -> np.ndarray:
    """Logistic regression by accelerated gradient steps; the last weight is the bias. A row stands for ``count`` rows."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)
    part = (count / count.sum()).astype(np.float32)
    # Power iteration for the largest curvature gives the step.
    v = np.ones(x.shape[1], np.float32)
    for _ in range(10):
        v = x.T @ (part * (x @ v))
        v /= np.linalg.norm(v) or 1
    step = np.float32(1 / (1.1 * np.linalg.norm(x.T @ (part * (x @ v))) / 4 + penalty))
    old = seen = np.zeros(x.shape[1], np.float32)
    keep = np.full(x.shape[1], penalty, np.float32)
    keep[-1] = 0
    for k in range(rounds):
        p = 1 / (1 + np.exp(-(x @ seen)))
        w = seen - step * (x.T @ (part * (p - y)) + keep * seen)
        seen = w + np.float32(k / (k + 3)) * (w - old)
        old = w
    return old


def _predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    """The fitted chain: a vocabulary, the categories in order and a weight vector for each."""

    def __init__(self, vocabulary: list[str], categories: list[str]):
        self.vocabulary, self.categories, self.weights = vocabulary, categories, []

    def matrix(self, rows: list[set[int]]) -> np.ndarray:
        x = np.zeros((len(rows), len(self.vocabulary)), np.float32)
        for k, own in enumerate(rows):
            x[k, list(own)] = 1
        return x

    def fit(self, x: np.ndarray, labels: np.ndarray, fold: np.ndarray, count: np.ndarray) -> "Chain":
        for k in range(len(self.categories)):
            y = labels[:, k]
            self.weights.append(_fit(x, y, count))
            if k + 1 < len(self.categories):
                out = np.zeros(len(x))
                for f in range(FOLDS):
                    rest, own = fold != f, fold == f
                    if own.any() and rest.any():
                        out[own] = _predict(x[own], _fit(x[rest], y[rest], count[rest]))
                x = np.hstack([x, out[:, None].astype(np.float32)])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = []
        for w in self.weights:
            out.append(_predict(x, w))
            x = np.hstack([x, out[-1][:, None].astype(np.float32)])
        return np.stack(out, axis=1)


def _count_features(n_labels: int):
    def count(batches):
        cache = _Parts()
        for batch in batches:
            seen: Counter = Counter()
            positive = [Counter() for _ in range(n_labels)]
            labels = [batch.column(k + 1).to_pylist() for k in range(n_labels)]
            for i, text in enumerate(batch.column(0).to_pylist()):
                own = features(text, cache)
                seen.update(own)
                for k in range(n_labels):
                    if labels[k][i]:
                        positive[k].update(own)
            names = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[x] for x in names], pa.int64()), *[pa.array([c[x] for x in names], pa.int64()) for c in positive]], ["feature", "n", *[f"n{k}" for k in range(n_labels)]])

    return count


def _shares(sizes: dict[str, int], sample: int) -> dict[str, float]:
    """The share to draw of each stratum: small ones are drawn whole, the others share what is left alike."""
    out, left = {}, float(sample)
    for k, (name, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        taken = min(n, left / (len(sizes) - k))
        left -= taken
        out[name] = taken / n
    return out


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fits a chain on the documents that ``labels`` covers, about ``sample`` of them at most.

    Each combination of labels is drawn by itself, so that rare ones are all
    used; a row counts as many times in the fit as rows of its kind were there for it.

    ``categories``: in the order of the chain, a name and a 0/1 expression over
    the label columns. Rows with a null label are left out. The features are,
    for each category, those with the largest chi-squared value.
    """
    marks = [c.cast("int").alias(f"__y{k}") for k, c in enumerate(categories.values())]
    marked = labels.select(F.col(id_col).alias("__id"), *marks).dropna().dropDuplicates(["__id"])
    unit = F.pmod(F.xxhash64(F.lit("sample"), "__id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    names = [f"__y{k}" for k in range(len(marks))]
    kind = F.concat_ws(",", *names)
    shares = _shares({r[0]: r[1] for r in marked.groupBy(kind).count().collect()}, sample)  # a row per combination of labels
    marked = marked.withColumn("__share", F.create_map(*[F.lit(v) for x in shares.items() for v in x])[kind] if shares else F.lit(1.0))
    picked = stage(marked.filter(unit < F.col("__share")), "toxicity-picked")
    few = picked.count() <= BROADCAST_ROWS
    drawn = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(F.broadcast(picked) if few else picked, F.col("__doc") == F.col("__id"))
    drawn = stage(drawn.select("__text", *names, F.pmod(F.xxhash64(F.lit("fold"), "__id"), F.lit(FOLDS)).cast("int").alias("__fold"), (1 / F.col("__share")).alias("__count")), "toxicity-sample")
    n = drawn.count()
    sums = drawn.agg(*[F.sum(c) for c in names]).first()
    chain = Chain([], list(categories))
    if not n:
        chain.weights = [np.append(np.zeros(k), -30.0) for k in range(len(names))]  # nothing to learn from: nothing is toxic
        return chain
    counted = drawn.select("__text", *names).mapInArrow(_count_features(len(names)), "feature string, n bigint, " + ", ".join(f"n{k} bigint" for k in range(len(names))))
    table = counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *[f"n{k}" for k in range(len(names))])]).filter(F.col("n") >= LEAST)
    table = stage(table, "toxicity-features")
    chosen: dict[str, None] = {}
    for k in range(len(names)):
        p = (sums[k] or 0) / n
        gain = F.pow(F.col(f"n{k}") - F.col("n") * p, 2) / (F.col("n") * (1.0 - F.col("n") / (n + 1)))
        chosen |= dict.fromkeys(r[0] for r in table.select("feature", gain.alias("g")).orderBy(F.desc("g"), "feature").limit(FEATURES).collect())
    chain.vocabulary = sorted(chosen)
    known = {x: i for i, x in enumerate(chain.vocabulary)}

    def look(batches):
        cache = _Parts(known)
        for batch in batches:
            found = [sorted(features(t, cache)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(1, batch.num_columns)], pa.array(found, pa.list_(pa.int32()))], [*names, "fold", "count", "found"])

    rows = drawn.mapInArrow(look, ", ".join(f"{c} int" for c in names) + ", fold int, count double, found array<int>").toArrow()  # bounded by the sample
    x = chain.matrix([set(r) for r in rows.column("found").to_pylist()])
    y = np.stack([rows.column(c).to_numpy() for c in names], axis=1).astype(float)
    return chain.fit(x, y, rows.column("fold").to_numpy(), rows.column("count").to_numpy())


def judge(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Adds each category's probability: ``doc_id`` and ``p_NAME`` columns; with ``carry`` the input's columns instead of the id.

    Every whole text is read. A null text has no feature; a null id stays null;
    repeated rows are judged alike; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast((chain.vocabulary, chain.categories, chain.weights))
    out = [f"p_{c}" for c in chain.categories]
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if carry else [F.col(id_col).alias("doc_id")]
    rows = docs.select(*own, F.col(text_col).alias("__text"))

    def look(batches):
        vocabulary, categories, weights = sent.value
        model = Chain(vocabulary, categories)
        model.weights = weights
        cache = _Parts({x: i for i, x in enumerate(vocabulary)})
        for batch in batches:
            found = [features(t, cache) for t in batch.column(1).to_pylist()]
            p = [model.predict(model.matrix(found[lo : lo + 1000])) for lo in range(0, len(found), 1000)]
            p = np.concatenate(p) if p else np.zeros((0, len(categories)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, k].astype(float)) for k in range(len(categories))]], [batch.schema.names[0], *out])

    first = rows.schema[0]
    schema = type(rows.schema)([first]).add(out[0], "double")
    for c in out[1:]:
        schema = schema.add(c, "double")
    return rows.mapInArrow(look, schema)


def categories() -> dict[str, Column]:
    """The chain over the labels table: low quality first, then toxic."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose probability to be toxic is under ``threshold``, with the input's columns."""
    chain = fit_chain(docs, labels, categories())
    return judge(docs, chain, carry=True).filter(F.col("p_toxic") < threshold).select("__row.*")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    chain = fit_chain(docs, read_table(spark, sf_dir, "labels"), categories())
    return judge(docs, chain).withColumn("toxic", F.col("p_toxic") >= 0.5)
