"""MinHash near-dedup: a chosen-path set similarity join.

A text's set of word shingles gets ``COORDINATES`` minwise tokens. From the root
of each of several independent trees a text goes down one or two branches per
node: the node's own hash chooses coordinates, and the text's minwise tokens
there name the branches. On average 1 / threshold coordinates are chosen, so
that a pair at the threshold is expected to share one branch per level, while
pairs far below it part soon. Every ``STEP`` levels the nodes are counted, and
those with one text go:

* in every node each text meets the node's head (its least text), which ties
  large groups of copies together with one comparison a text;
* in a node whose texts are not all tied yet, those outside its largest tied
  group are compared exhaustively with all texts of the node. Where these are
  up to ``LEAF``, a node of any size is cut into blocks that the few meet one by
  one, so rows and memory stay in proportion to the texts;
* any other node is branched further, several times independently, so that depth
  costs no recall. What ``ROUNDS`` rounds leave undivided is compared in blocks
  against blocks.

Heads are compared by a 128-bit sketch of the same tokens first; all else, and
what passes the sketch, on the full sets of the whole texts, within the node's
task: no pair becomes a row unless it is a link that ties two groups. Texts with
equal sets are one from the start. The numbers of trees and of repeats follow
from the recall.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.components import connected_components

from .kernel import U, Words, mix, slices
from .shared import read_table, stage, unstage

#: LEAF: texts outside a node's largest tied group that are compared exhaustively.
COORDINATES, STEP, LEAF = 128, 4, 2048
#: Texts, and bytes of whole texts, in a block, about (a longer text is a block of its own).
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: After so many rounds of branching the nodes that are left are compared in blocks, whatever their size.
ROUNDS = 4
#: Bound on the independent repeats of a node's branching, for aims that the trees only just meet.
MOST = 64
#: Key sets of up to so many numbers (some MB) are broadcast; larger ones are shuffled.
BROADCAST_KEYS = 200_000
#: Bits of the sketch that must agree. At a similarity of 0.8, 115 of 128 do on average; 95 is 5.9 deviations below.
AGREE = 95
_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)


def survival(similarity: float, levels: int, q: float = 1.0) -> float:
    """Chance that a pair still shares a node of one tree after some levels: one branch, or two a quarter of the time.

    ``q`` is the chance that a node which they share at the end finds them.
    """
    for _ in range(levels):
        q = 0.75 * similarity * q + 0.25 * (1 - (1 - similarity * q) ** 2)
    return q


def missed(similarity: float, trees: int, repeats: int = 1, rounds: int = 0) -> float:
    """Chance that no tree finds a pair whose nodes are all branched for so many further rounds, ``repeats`` times each.

    All trees see the same coordinates, so it is averaged over how many of them agree.
    """
    out = 0.0
    for k in range(COORDINATES + 1):
        q = 1.0
        for _ in range(rounds):
            q = 1 - (1 - survival(k / COORDINATES, STEP, q)) ** repeats
        out += math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) * (1 - survival(k / COORDINATES, STEP, q)) ** trees
    return out


def trees_for(recall: float, similarity: float) -> int:
    if (1 - similarity) ** COORDINATES >= 1 - recall:
        raise ValueError(f"no number of trees has a recall of {recall} at {similarity}")
    return next(n for n in itertools.count(1) if missed(similarity, n) <= 1 - recall)


def repeats_for(recall: float, similarity: float) -> int:
    """How many times a large node is branched further so that the aim holds after all rounds."""
    trees = trees_for(recall, similarity)
    return next((n for n in range(1, MOST) if missed(similarity, trees, n, ROUNDS) <= 1 - recall), MOST)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """The set of each text: sorted distinct 64-bit hashes of its shingles of ``size`` words."""
    words = Words(data, offsets, lower=True)
    grams = words.grams(size)
    for a, n in zip(words.first[:-1].tolist(), words.n.tolist()):
        if n >= size:
            yield np.unique(grams[a : a + n - size + 1])
        else:  # the whole sequence is its only shingle
            yield mix(np.bitwise_xor.reduce(mix(words.hash[a : a + n] + np.arange(1, n + 1, dtype=U)), keepdims=True)) if n else np.zeros(0, U)


def minwise(found: np.ndarray) -> np.ndarray:
    x = (found >> U(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 4096):
        np.minimum(least, (x[None, lo : lo + 4096] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return least


def sketch(tokens: np.ndarray) -> np.ndarray:
    """128 bits, one of each token, as two numbers. A token's own bits are alike in all coordinates, so they are mixed first."""
    t = tokens ^ (tokens >> np.uint32(16))
    t *= np.uint32(0x85EBCA6B)
    t ^= t >> np.uint32(13)
    t *= np.uint32(0xC2B2AE35)
    t ^= t >> np.uint32(16)
    return np.packbits(t.astype(np.uint8) & 1).view(np.int64)


def branch(keys: np.ndarray, tokens: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Goes ``levels`` down from nodes ``keys``; row i of ``tokens`` goes with key i. Returns keys and rows."""
    rows = np.arange(len(keys))
    for _ in range(levels):
        drawn = mix(keys ^ U(0xA0761D6478BD642F))
        first = (drawn % U(COORDINATES)).astype(np.int64)
        two = (drawn >> U(32)) % U(4) == 0
        second = (first + 1 + ((drawn >> U(40)) % U(COORDINATES - 1)).astype(np.int64)) % COORDINATES
        rows_2, at_2 = rows[two], second[two]
        keys = np.concatenate([mix(keys ^ mix((first.astype(U) << U(32)) | tokens[rows, first])), mix(keys[two] ^ mix((at_2.astype(U) << U(32)) | tokens[rows_2, at_2]))])
        rows = np.concatenate([rows, rows_2])
    return keys, rows


def regrow(keys: np.ndarray, tokens: np.ndarray, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """Goes a step down from nodes ``keys``, ``repeats`` times independently. Returns keys and rows."""
    again = mix(np.concatenate([keys + U(k) for k in range(1, repeats + 1)]))
    of = np.tile(np.arange(len(keys)), repeats)
    keys, rows = branch(again, tokens[of], STEP)
    return keys, of[rows]


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _walk(batches, step, at_once: int = 1000):
    """Rows of (node, row) that ``step`` makes of the tokens of a batch and, if they have one, of their nodes."""
    for batch in batches:
        tokens, row = _tokens(batch.column("tokens")), batch.column("row").to_numpy()
        node = batch.column("node").to_numpy().view(U) if "node" in batch.schema.names else np.zeros(len(row), U)
        for lo in range(0, len(row), at_once):
            keys, rows = step(node[lo : lo + at_once], tokens[lo : lo + at_once])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(row[lo + rows])], ["node", "row"])


def _groups(batches, *keys: str):
    """The rows of one key at a time, as tables; rows come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(len(batch), bool)
        new[0] = last is not None and last != tuple(c[0] for c in columns)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        last = tuple(c[-1] for c in columns)
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(cuts, [*cuts[1:], None]):
            if a or new[0]:  # a key begins at every cut but the first, and there too if the batch before ended with another
                if held:
                    yield pa.Table.from_batches(held)
                held = []
            if b is None or b > a:
                held.append(batch.slice(a, None if b is None else b - a))
    if held:
        yield pa.Table.from_batches(held)


def linked(sets: list[np.ndarray], held: np.ndarray, asks: np.ndarray, tie: np.ndarray, percent: int):
    """Links (i, j) of the sets that ask to the sets held which tie two ties; every such pair of ties gets connected.

    Each set that asks is compared with all that are held, on the full sets.
    """
    root = {t: t for t in tie.tolist()}

    def find(t):
        while root[t] != t:
            root[t] = t = root[root[t]]
        return t

    names = np.flatnonzero(held)
    size = np.array([len(x) for x in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    flat = np.concatenate([number[at[j] : at[j + 1]] for j in names]) if len(names) else number[:0]
    starts = np.concatenate([[0], np.cumsum(size[names])[:-1]])
    has = np.zeros(len(values), bool)
    for i in np.flatnonzero(asks).tolist():
        own = number[at[i] : at[i + 1]]
        has[own] = True
        both = np.add.reduceat(has[flat], starts, dtype=np.int64) if len(names) else names
        has[own] = False
        for j in names[100 * both >= percent * (size[i] + size[names] - both)].tolist():
            a, b = find(tie[i]), find(tie[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                yield i, j


def near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, recall: float = 0.99999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links texts whose shingle sets have a Jaccard similarity of ``threshold`` or more.

    Texts are lower-cased (A-Z) and cut into words; a text with fewer words than
    a shingle is one shingle, and one without words is linked with nothing.
    ``recall`` is the aim for a pair right at the threshold; more similar pairs
    are missed far more rarely. Returns one row per input row: ``doc_id,
    n_shingles, component_id`` (the least id that links lead to), ``kept``.

    Nulls: a null text has no words; a row with a null id is linked by its text
    but names no component unless all its component's ids are null. Rows that
    repeat an id and a text belong together, and all of them with the least id
    are kept. An empty table gives an empty result; other columns are ignored.
    """
    percent = round(threshold * 100)

    def describe(batches):
        for batch in batches:
            out = []
            for lo, _, data, offsets, _ in slices(batch.column(1)):
                raw = data.tobytes()
                for k, found in enumerate(shingle_sets(data, offsets, shingle)):
                    row = {"doc_id": batch.column(0)[lo + k].as_py(), "n_shingles": len(found), "k0": None, "k1": None, "s0": None, "s1": None, "size": int(offsets[k + 1] - offsets[k]), "tokens": None, "blob": None}
                    if len(found):
                        tokens = minwise(found)
                        s0, s1 = sketch(tokens).tolist()
                        k0, k1 = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64).tolist()
                        row |= {"k0": k0, "k1": k1, "s0": s0, "s1": s1, "tokens": tokens.tobytes(), "blob": pa.compress(raw[offsets[k] : offsets[k + 1]], "zstd", asbytes=True)}
                    out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([*[(c, pa.int64()) for c in ("doc_id", "n_shingles", "k0", "k1", "s0", "s1", "size")], ("tokens", pa.binary()), ("blob", pa.binary())]))

    def plant(batches):
        roots = mix(np.arange(1, trees_for(recall, threshold) + 1, dtype=U))

        def step(_, own):
            of = np.tile(np.arange(len(own)), len(roots))
            keys, rows = branch(np.repeat(roots, len(own)), own[of], STEP)
            return keys, of[rows]

        yield from _walk(batches, step)

    def grow(batches):
        repeats = repeats_for(recall, threshold)
        yield from _walk(batches, lambda node, own: regrow(node, own, repeats))

    def confirm(batches):
        for group in _groups(batches, "group", "i", "j"):
            name, tie, sizes = (group.column(c).to_numpy() for c in ("class", "tie", "size"))
            texts = [pa.decompress(b, n, "zstd", asbytes=True) for b, n in zip(group.column("blob").to_pylist(), sizes.tolist())]
            sets = [x for _, _, data, offsets, _ in slices(pa.array(texts, pa.large_binary())) for x in shingle_sets(data, offsets, shingle)]
            found = list(linked(sets, *(group.column(c).to_numpy() for c in ("held", "asks")), tie, percent))
            yield pa.RecordBatch.from_arrays([pa.array([name[k[side]] for k in found], pa.int64()) for side in (0, 1)], ["a", "b"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    described = rows.mapInArrow(describe, "doc_id bigint, n_shingles bigint, k0 bigint, k1 bigint, s0 bigint, s1 bigint, size bigint, tokens binary, blob binary")
    texts = stage(described.withColumn("row", F.monotonically_increasing_id()), "near-texts")
    full = texts.filter("k0 is not null")
    # The least row of each class of equal sets stands for it.
    classes = stage(full.groupBy("k0", "k1").agg(F.min("row").alias("class"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "near-classes")
    copies = full.select("row", "k0", "k1").join(classes.filter("n > 1").select("k0", "k1", "class"), ["k0", "k1"]).filter("row <> class")
    copies = stage(copies.select("row", "class"), "near-copies")
    marks = full.select("row", "s0", "s1", "size").join(copies, "row", "left").withColumn("class", F.coalesce("class", "row"))
    nodes = stage(full.select("row", "tokens").mapInArrow(plant, "node bigint, row bigint"), "near-nodes", "none")
    links, ties = None, None

    def standing(rows: DataFrame, *columns: str) -> DataFrame:
        """Columns of the texts that stand for the classes which a staged table names, each once."""
        few = rows.count() <= BROADCAST_KEYS
        return full.select(F.col("row").alias("class"), *columns).join(F.broadcast(rows) if few else rows, "class", "left_semi")

    def blocks(n: str, size: str, of: int = BLOCK) -> Column:
        return F.ceil(F.greatest(F.col(n) / of, F.col(size) / BLOCK_BYTES, F.lit(1))).cast("int")

    def dealt(count: str) -> Column:
        return F.pmod(F.xxhash64("class"), F.col(count)).cast("int")

    def tie(compared: DataFrame) -> None:
        """Confirms links within groups of rows (group, i, j, class, tie, held, asks) and ties what they link."""
        nonlocal links, ties
        compared = stage(compared, "near-compared")
        needed = stage(compared.select("class").distinct(), "near-needed")
        groups = compared.join(standing(needed, "size", "blob"), "class").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
        sure = stage(groups.mapInArrow(confirm, "a bigint, b bigint"), "near-links", sweep=True)
        unstage(compared, needed)
        if links is None or not sure.isEmpty():
            links = sure if links is None else links.union(sure)
            ties = stage(connected_components(links, "a", "b"), "near-ties")

    for turn in range(ROUNDS + 1):
        # Nodes of one text go before anything else is known of the texts.
        shared = nodes.join(nodes.groupBy("node").count().filter("count > 1").select("node"), "node")
        members = shared.join(marks, "row").groupBy("node", "class").agg(*[F.first(c).alias(c) for c in ("s0", "s1", "size")])
        members = stage(members, "near-members", sweep=True)
        unstage(nodes)
        heads = members.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("class", "s0", "s1")).alias("head")).filter("n > 1")
        agree = F.lit(COORDINATES) - F.bit_count(F.col("s0").bitwiseXOR(F.col("head.s0"))) - F.bit_count(F.col("s1").bitwiseXOR(F.col("head.s1")))
        crowded = stage(members.join(heads, "node").select("node", "class", "size", F.col("head.class").alias("head"), (agree >= AGREE).alias("near")), "near-crowded")
        unstage(members)
        pairs = crowded.filter("near and head <> class").groupBy("head", "class").agg(F.first("size").alias("size"))
        pairs = stage(pairs, "near-pairs")
        per = pairs.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).select("head", blocks("n", "bytes").alias("blocks"))
        answers = pairs.join(per, "head").select("head", dealt("blocks").alias("j"), "class", F.lit(True).alias("held"), F.lit(False).alias("asks"))
        asked = per.select("head", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.col("head").alias("class"), F.lit(False).alias("held"), F.lit(True).alias("asks"))
        tie(answers.union(asked).select(F.col("head").alias("group"), F.lit(0).alias("i"), "j", "class", F.col("class").alias("tie"), "held", "asks"))
        unstage(pairs)

        tied = crowded.join(ties.select(F.col("vertex").alias("class"), F.col("component").alias("tie")), "class", "left").select("node", "class", "size", F.coalesce("tie", "class").alias("tie"))
        groups = tied.groupBy("node", "tie").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("bytes"))
        main = F.max(F.struct("c", "tie", "bytes"))
        shape = groups.groupBy("node").agg(F.sum("c").alias("m"), F.sum("bytes").alias("bytes"), main.alias("main"), F.count(F.lit(1)).alias("ties")).filter("ties > 1")
        shape = shape.withColumns({"others": F.col("m") - F.col("main.c"), "other_bytes": F.col("bytes") - F.col("main.bytes")})
        shape = stage(shape.select("node", F.col("main.tie").alias("main"), "others", blocks("others", "other_bytes", LEAF).alias("across"), blocks("m", "bytes").alias("down")), "near-shape")
        leaf = (F.col("others") <= LEAF) | F.lit(turn == ROUNDS)
        open_ = tied.join(shape.filter(leaf), "node").select(F.col("node").alias("group"), "class", "tie", (F.col("tie") != F.col("main")).alias("other"), "across", "down", dealt("across").alias("own_i"), dealt("down").alias("own_j"))
        # A text is held in its own block, once for each block of those that ask; the others ask in every block.
        held = open_.select("*", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("i"), F.col("own_j").alias("j"), F.lit(True).alias("held"))
        asks = open_.filter("other and down > 1").select("*", F.col("own_i").alias("i"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("j"), F.lit(False).alias("held")).filter("j <> own_j")
        tie(held.union(asks).select("group", "i", "j", "class", "tie", "held", (F.col("other") & (F.col("i") == F.col("own_i"))).alias("asks")))
        if shape.filter(~leaf).isEmpty():
            break
        large = stage(tied.join(shape.filter(~leaf).select("node"), "node", "left_semi").select("node", "class"), "near-large")
        unstage(crowded, shape)
        needed = stage(large.select("class").distinct(), "near-needed")
        grown = large.join(standing(needed, "tokens"), "class").select("node", F.col("class").alias("row"), "tokens")
        nodes = stage(grown.mapInArrow(grow, "node bigint, row bigint"), "near-nodes", "none")
    # A class is named after the least id among all texts of its component; classes of one text keep their own.
    tied = classes.join(ties.select(F.col("vertex").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = tied.groupBy("component").agg(F.min("least").alias("name"), F.sum("n").alias("of")).filter("of > 1")
    names = stage(tied.join(least, "component").select("k0", "k1", "name"), "near-names", sweep=True)
    component = F.coalesce(F.col("name"), F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    named = full.select("doc_id", "n_shingles", "k0", "k1").join(names, ["k0", "k1"], "left").select("doc_id", "n_shingles", "name")
    bare = texts.filter("k0 is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("name"))
    return named.union(bare).select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each group, the one with the least id, with the input's columns.

    Rows with a null id stay. Rows that repeat an id go together.
    """
    gone = stage(near_duplicates(docs, id_col=id_col, **options).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct(), "near-gone")
    few = gone.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(gone) if few else gone, F.col(id_col) == F.col("__gone"), "left_anti")


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=2)
