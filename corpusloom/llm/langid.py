"""Language ID by interpolated Kneser-Ney models of characters, one per language.

The models of all languages share sorted arrays of n-gram hashes, one array per
order, with a row of log-probabilities (a column per language) for each hash.
A language that lacks an n-gram has its backed-off value in that row, so one
binary search per character scores all languages. The answer is the language
with the lowest cross-entropy per character; a text whose value lies above what
its language's own texts reach (a quantile of texts kept out of the fit) is
rejected.
"""

from __future__ import annotations

import io
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import U, mix, slices
from .shared import read_table, stage

ORDER = 4
DISCOUNT = 0.75
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of texts that lie one after another, other runs as one space.

    Each text starts with ORDER - 1 spaces. Returns the codes, the first place of
    each text (and the end), and the number of letters of each.
    """
    parts, sizes, counts = [], [], []
    raw = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        codes = np.frombuffer(raw[a:b].decode().lower().encode("utf-32-le"), np.uint32)
        letter = _is_letter()[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        codes = np.where(letter, codes, 32)[keep]
        parts += [np.full(ORDER - 1, 32, np.uint32), codes.astype(np.uint32)]
        sizes.append(len(codes) + ORDER - 1)
        counts.append(int(letter.sum()))
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), first, np.array(counts, np.int64)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """One hash for each row of characters, as :meth:`Models.cross_entropies` makes them."""
    h = np.zeros(len(codes), U)
    for j in range(codes.shape[1]):
        h = mix(h * U(31) + codes[:, j].astype(U) + U(1))
    return h


def _rows_of(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes sorted keys have, and the rows of values there."""
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return keys[at] == asked, values[at]


class Models:
    """Kneser-Ney models from counts of ORDER-grams: by language, n-gram to count, or an array of n-grams (rows of codes) and one of counts."""

    def __init__(self, counts: dict):
        self.languages = sorted(counts)
        width = len(self.languages)
        held = []
        for language in self.languages:
            own = counts[language]
            if isinstance(own, dict):
                own = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(-1, ORDER), np.fromiter(own.values(), np.int64, len(own))
            held.append(own)
        alphabet = len(np.unique(np.concatenate([np.zeros(0, np.uint32), *[np.unique(codes) for codes, _ in held]])))
        self.unseen = np.float32(np.log(1 / (alphabet + 1)))
        self.arrays = []
        lower = None  # keys and probabilities of the order below
        for n in range(1, ORDER + 1):
            grams, columns = [], []  # by language: different n-grams, and their hashes, shares and contexts
            for codes, times in held:
                # The highest order takes counts; the others the number of different characters before.
                if n == ORDER:
                    own, c = codes, times.astype(np.float64)
                else:
                    longer = codes[:, ORDER - n - 1 :]
                    own = longer[np.unique(_hashes(longer), return_index=True)[1]][:, 1:]
                    _, first, c = np.unique(_hashes(own), return_index=True, return_counts=True)
                    own = own[first]
                contexts, of, kinds = np.unique(_hashes(own[:, :-1]), return_inverse=True, return_counts=True)
                total = np.bincount(of, c, len(contexts))
                grams.append(own)
                columns.append((_hashes(own), (c - DISCOUNT) / total[of], contexts, DISCOUNT * kinds / total))
            own = np.concatenate(grams) if grams else np.zeros((0, n), np.uint32)
            keys, first = np.unique(np.concatenate([np.zeros(0, U), *[x[0] for x in columns]]), return_index=True)
            contexts = np.unique(np.concatenate([np.zeros(0, U), *[x[2] for x in columns]]))
            table, left = np.zeros((len(keys), width)), np.ones((len(contexts), width))
            for k, (h, share, context, mass) in enumerate(columns):
                table[np.searchsorted(keys, h), k] = share
                left[np.searchsorted(contexts, context), k] = mass
            below = np.full((len(keys), width), 1 / (alphabet + 1))
            if lower is not None and len(keys):
                hit, values = _rows_of(*lower, _hashes(own[first][:, 1:]))
                below[hit] = values[hit]
            if len(keys):
                table += left[np.searchsorted(contexts, _hashes(own[first][:, :-1]))] * below
            lower = keys, table
            self.arrays.append((keys, np.log(table).astype(np.float32), contexts, np.log(left).astype(np.float32)))

    def cross_entropies(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Nats per character, a row per text and a column per language (0 for texts without characters)."""
        n = len(codes) - ORDER + 1
        out = np.zeros((len(first) - 1, len(self.languages)))
        if n <= 0:
            return out
        score = np.zeros((n, len(self.languages)), np.float32)
        rest = np.arange(n)  # places that no order has answered yet
        for order in range(ORDER, 0, -1):
            keys, values, contexts, left = self.arrays[order - 1]
            ends = rest + ORDER - 1
            h = np.zeros(len(rest), U)
            for k in range(order):
                if k == order - 1:
                    before = h
                h = mix(h * U(31) + codes[ends - order + 1 + k].astype(U) + U(1))
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            score[rest[hit]] += values[at[hit]]
            rest, before = rest[~hit], before[~hit]
            if not len(rest):
                break
            at = np.minimum(np.searchsorted(contexts, before), len(contexts) - 1)
            known = contexts[at] == before
            score[rest[known]] += left[at[known]]
        score[rest] += self.unseen
        sums = np.zeros((n + 1, len(self.languages)))
        np.cumsum(score, axis=0, dtype=np.float64, out=sums[1:])
        sizes = np.diff(first) - (ORDER - 1)
        total = sums[np.minimum(first[:-1] + sizes, n)] - sums[np.minimum(first[:-1], n)]
        np.divide(-total, sizes[:, None], out=out, where=sizes[:, None] > 0)
        return out

    def dump(self, extra: dict[str, np.ndarray]) -> bytes:
        file = io.BytesIO()
        arrays = {f"{n}_{k}": x for n, a in enumerate(self.arrays) for k, x in enumerate(a)}
        np.savez(file, languages=np.array(self.languages), unseen=self.unseen, **arrays, **extra)
        return file.getvalue()

    @classmethod
    def load(cls, data: bytes) -> tuple["Models", dict[str, np.ndarray]]:
        held = np.load(io.BytesIO(data))
        self = cls.__new__(cls)
        self.languages, self.unseen = held["languages"].tolist(), held["unseen"]
        self.arrays = [tuple(held[f"{n}_{k}"] for k in range(4)) for n in range(ORDER)]
        return self, {k: held[k] for k in ("scale", "limit") if k in held}


def _scored(docs: DataFrame, data: bytes) -> DataFrame:
    """(id, has_letter, cross-entropies) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(data)

    def score(batches):
        models, _ = Models.load(sent.value)
        for batch in batches:
            letters, values = [], []
            for _, _, raw, offsets, _ in slices(batch.column(1)):
                codes, first, n = characters(raw, offsets)
                letters += (n > 0).tolist()
                values += models.cross_entropies(codes, first).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(letters, pa.bool_()), pa.array(values, pa.list_(pa.float64()))], ["id", "has_letter", "nats"])

    return docs.mapInArrow(score, f"id {docs.schema[0].dataType.simpleString()}, has_letter boolean, nats array<double>")


def _count_grams(batches):
    for batch in batches:
        seen: dict[str, Counter] = defaultdict(Counter)
        langs = batch.column(1).to_pylist()
        for lo, _, raw, offsets, _ in slices(batch.column(0)):
            codes, first, _ = characters(raw, offsets)
            text = codes.tobytes().decode("utf-32-le")
            for k in range(len(offsets) - 1):
                own = text[first[k] : first[k + 1]]
                seen[langs[lo + k]].update([own[i : i + ORDER] for i in range(len(own) - ORDER + 1)])
        out = [(lang, gram, n) for lang, own in seen.items() for gram, n in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], ["lang", "gram", "n"])


def fit(docs: DataFrame, learn: Column, sample: int = 300, quantile: float = 0.995, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> bytes:
    """Fits the models on all labelled texts.

    Some ``sample`` texts per language (a hash of the id draws them), a fifth at
    most, give the scale of the score (the one of some with the highest
    likelihood of the right answers) and, per language, the cross-entropy that
    the share ``quantile`` of its texts stays below. All others give the counts,
    of which every one is kept. If no others are left, all give counts. Without
    a labelled text the model is empty.
    """
    learned = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    per = {r[0]: r[1] for r in learned.groupBy(lang_col).count().collect()}  # a row per language
    if not per:
        return b""
    unit = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = F.create_map(*[x for k, v in per.items() for x in (F.lit(k), F.lit(min(1.0, 5 * sample / v)))])
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col(id_col)), F.lit(5))
    texts = learned.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.coalesce((fold == 0) & (unit < share[F.col(lang_col)]), F.lit(False)).alias("held"))
    drawn = stage(texts.filter("held").select("lang", "text"), "langid-sample")
    counted = texts if texts.filter("not held").isEmpty() else texts.filter("not held")
    grams = counted.select("text", "lang").mapInArrow(_count_grams, "lang string, gram string, n bigint")
    grams = stage(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-grams")
    table = grams.toArrow()  # the model's own n-grams, each once: as many as the languages have, not as the texts
    langs = table.column("lang").combine_chunks().dictionary_encode()
    codes = np.frombuffer("".join(table.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
    times, number = table.column("n").to_numpy(), langs.indices.to_numpy()
    counts = {lang: (codes[number == k], times[number == k]) for k, lang in enumerate(langs.dictionary.to_pylist())}
    models = Models(counts)
    plain = models.dump({})
    held = [(r.id, r.nats) for r in _scored(drawn, plain).filter("has_letter").collect()]
    at = {k: i for i, k in enumerate(models.languages)}
    held = [(at[k], np.array(v)) for k, v in held if k in at]
    scales = np.array([1, 2, 4, 8, 16, 32], float)
    likely = [sum(-v[k] * s - np.log(np.exp(-(v - v.min()) * s).sum()) + v.min() * s for k, v in held) for s in scales]
    limit = np.full(len(models.languages), np.inf)
    for k in range(len(limit)):
        own = [v[k] for j, v in held if j == k]
        if len(own) >= 10:
            limit[k] = np.quantile(own, quantile)
    return models.dump({"scale": scales[int(np.argmax(likely))] if held else np.float64(8), "limit": limit})


def identify(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Names the language of every whole text: ``doc_id, lang_pred, score, nats, rejected``.

    ``score`` is the share of the answer among exp(-scale * cross-entropy);
    ``nats`` the answer's cross-entropy per character; ``rejected`` says that it
    lies above the language's limit. A text that is null or has no letter is
    ``und`` with score 0; so is every text if the model is empty. Ties go to the first language by name. A null id stays
    null, repeated rows are answered alike, an empty table gives an empty
    result, and other columns are ignored.
    """
    if not model:
        none = F.lit(None).cast("double")
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), none.alias("nats"), F.lit(True).alias("rejected"))
    models, extra = Models.load(model)
    names = F.array(*[F.lit(x) for x in models.languages])
    scored = _scored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    best = F.array_min("nats")
    at = F.array_position("nats", best).cast("int")
    share = 1 / F.aggregate("nats", F.lit(0.0), lambda a, x: a + F.exp((best - x) * float(extra["scale"])))
    limits = F.array(*[F.lit(float(x)) for x in extra["limit"]])
    return scored.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("has_letter"), F.element_at(names, at)).otherwise("und").alias("lang_pred"),
        F.when(F.col("has_letter"), share).otherwise(0.0).alias("score"),
        F.when(F.col("has_letter"), best).alias("nats"),
        F.when(F.col("has_letter"), best > F.element_at(limits, at)).otherwise(True).alias("rejected"),
    )


def op8_langid(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return identify(docs, fit(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
