"""Substring dedup: fixed-block anchors, probed by every rolling window.

The texts are packed into chunks of about a megabyte, sorted by id. Each text is
cut into blocks of ``window // 2`` words; these are the reference blocks. Any
``window`` words hold one whole block, so a repeated window has a block at its
first place and a rolling run equal to it at the other. Three passes:

1. Each chunk sends the fingerprints of all its rolling runs, once each, to
   buckets by the leading bits of their hash, with a flag for reference blocks.
   A bucket answers which runs meet a block of another place.
2. The hits are extended: of the windows with a hit, each chunk sends the 128-bit
   hashes, once each, with the first id. A bucket answers which chunks do not
   hold the first place.
3. Each chunk marks the windows that are not first, joins overlapping ones into
   maximal repeats, and drops their words.

A fingerprint that agrees by chance only costs an answer in pass 1; what is
dropped rests on the windows' own 128-bit hashes. A passage that a third of all
texts share is sent once per chunk, so it makes no large group.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, Words, slices
from .shared import read_table, stage

#: Bytes of text in a chunk (a longer text is a chunk of its own), and words per bucket; a task holds one of either at a time.
CHUNK_BYTES, BUCKET_WORDS = 1 << 20, 250_000
#: Buckets that a task takes, one after another, and tasks of a shuffle at most; beyond, a task takes more. Each task writes a
#: file, and Hadoop without its native library starts a process for each file it makes on a local disk (three per file here),
#: which shows as large as the executor until it runs its own program.
TASK_BUCKETS, TASKS = 32, 1 << 14
_FINGER = 30
_NULL_ID = np.iinfo(np.int64).max


def _pack(batches):
    n = itertools.count(TaskContext.get().partitionId() << 32)
    for batch in batches:
        ids_all = batch.column(0).to_pylist()
        for lo, hi, data, offsets, _ in slices(batch.column(1), CHUNK_BYTES):
            ids = ids_all[lo:hi]
            order = sorted(range(hi - lo), key=lambda i: (ids[i] is None, ids[i] or 0))
            raw = data.tobytes()
            blob = b"".join([raw[offsets[i] : offsets[i + 1]] for i in order])
            lengths = np.diff(offsets)[order]
            words = Words(data, offsets).n.sum()
            yield pa.RecordBatch.from_arrays(
                [pa.array([next(n)], pa.int64()), pa.array([int(words)], pa.int64()), pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([pa.compress(blob, "zstd", asbytes=True)], pa.binary())],
                ["chunk", "words", "ids", "lengths", "blob"],
            )


def _rows(batches):
    """Rows one by one; what Arrow freed of a task's batches goes back, as workers live on."""
    for batch in batches:
        for k in range(len(batch)):
            yield batch.slice(k, 1).to_pylist()[0]
    pa.default_memory_pool().release_unused()


class _Chunk:
    """A chunk's words, rolling runs and, with the answers, its marked windows."""

    def __init__(self, row: dict, window: int, bits: int):
        self.id, self.ids = row["chunk"], row["ids"]
        offsets = np.concatenate([[0], np.cumsum(np.array(row["lengths"], np.int64))]).astype(np.int64)
        self.raw = pa.decompress(row["blob"], int(offsets[-1]), "zstd", asbytes=True) if offsets[-1] else b""
        self.words = Words(np.frombuffer(self.raw, np.uint8), offsets)
        self.window, self.block, self.bits = window, window // 2, bits

    def runs(self):
        """The rolling runs: their places, their distinct fingerprints, and which one each has."""
        hashes, at = self.words.grams(self.block), np.flatnonzero(self.words.whole(self.block))
        found, back, times = np.unique(hashes[at] >> U(64 - self.bits - _FINGER), return_inverse=True, return_counts=True)
        return at, found, back, times

    def probes(self):
        """(bucket, fingerprints): 30 bits, a bit for reference blocks, a bit for runs met twice here."""
        at, found, back, times = self.runs()
        text = np.repeat(np.arange(len(self.words.n)), self.words.n)
        block = np.zeros(len(found), bool)
        block[back[(at - self.words.first[text[at]]) % self.block == 0]] = True
        entries = ((found & U((1 << _FINGER) - 1)) << U(2)) | (block.astype(U) << U(1)) | (times > 1)
        yield from _parts(found >> U(_FINGER), entries.astype(np.uint32))

    def windows(self, answers: dict[int, bytes]):
        """Windows with a hit: their places, distinct hashes (two lanes), the first place of each, and which one each has."""
        at, found, back, _ = self.runs()
        hit = np.zeros(len(self.words.start) + 1, np.int64)
        hit[1:][at] = _unpack(answers, found >> U(_FINGER))[back]
        hits = np.cumsum(hit)
        whole, reach = self.words.whole(self.window), self.window - self.block + 1
        starts = np.arange(len(whole))
        places = np.flatnonzero(whole & (hits[starts + reach] > hits[starts])) if len(whole) else starts
        one, two = (self.words.grams(self.window, lane)[places] if len(places) else np.zeros(0, U) for lane in (0, 1))
        order, new = _runs(one, two)
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        first = order[new]
        return places, one[first], two[first], first, back

    def firsts(self, answers: dict[int, bytes]):
        """(bucket, window hashes in two lanes, ids of their first places)."""
        places, found, second, first, _ = self.windows(answers)
        text = np.searchsorted(self.words.first, places[first], "right") - 1
        ids = np.array([_NULL_ID if i is None else i for i in self.ids], np.int64)[text]
        buckets = found >> U(64 - self.bits)
        for (bucket, one), (_, two), (_, own) in zip(*[_parts(buckets, x) for x in (found, second, ids)]):
            yield bucket, one, two, own

    def removed(self, hits: dict[int, bytes], later: dict[int, bytes]) -> np.ndarray:
        """Which words a window covers that also starts earlier."""
        places, found, _, first, back = self.windows(hits)
        marked = places[(np.arange(len(places)) != first[back]) | _unpack(later, found >> U(64 - self.bits))[back]]
        edges = np.zeros(len(self.words.start) + 1, np.int64)
        np.add.at(edges, marked, 1)
        np.add.at(edges, marked + self.window, -1)
        return np.cumsum(edges[:-1]) > 0


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by the keys, places in order among equals, and where in it new values begin."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, new


def _parts(buckets: np.ndarray, values: np.ndarray):
    """The runs of equal (sorted) bucket numbers."""
    cuts = np.concatenate([[0], np.flatnonzero(buckets[1:] != buckets[:-1]) + 1, [len(buckets)]]) if len(buckets) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(buckets[a]), values[a:b]


def _unpack(answers: dict[int, bytes], buckets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buckets), bool)
    for bucket, bits in answers.items():
        a, b = np.searchsorted(buckets, np.array([bucket, bucket + 1], U))
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    return out


def _answer(bucket: int, chunks: list[int], lengths: list[int], flags: np.ndarray, kind: int):
    out, at = [], 0
    for chunk, n in zip(chunks, lengths):
        own = flags[at : at + n]
        at += n
        if own.any():
            out.append({"chunk": chunk, "kind": kind, "bucket": bucket, "bits": np.packbits(own).tobytes()})
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_ANSWERS)


_ANSWERS = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("bits", pa.binary())])
_ANSWER_DDL = "chunk bigint, kind int, bucket bigint, bits binary"


def _narrow(ids: np.ndarray) -> dict:
    """Ids as the least one and what they exceed it by, in 4 bytes each where that fits, else in 8."""
    over = (ids - ids.min()).view(U)
    return {"base": int(ids.min()), "firsts": over.astype(np.uint32 if over.max() < 1 << 32 else U).tobytes()}


def _widen(base: int, firsts: np.ndarray, n: int) -> np.ndarray:
    return (firsts.view(np.uint32 if len(firsts) == 4 * n else U).astype(U) + U(base & (1 << 64) - 1)).view(np.int64)


def _by_bucket(batches, *columns: tuple[str, np.dtype | None]):
    """The rows of one bucket at a time (they come sorted): bucket, chunks and, per column, an array (or number) per row."""
    bucket, chunks, held = None, [], [[] for _ in columns]
    for batch in batches:
        at = batch.column("bucket").to_numpy()
        chunk = batch.column("chunk").to_numpy()
        for i in range(len(at)):
            if at[i] != bucket:
                if chunks:
                    yield bucket, chunks, held
                bucket, chunks, held = int(at[i]), [], [[] for _ in columns]
            chunks.append(int(chunk[i]))
            for own, (name, kind) in zip(held, columns):
                own.append(np.frombuffer(batch.column(name)[i].as_buffer(), kind) if kind else batch.column(name)[i].as_py())
    if chunks:
        yield bucket, chunks, held
    pa.default_memory_pool().release_unused()


def _meet_blocks(batches):
    """Which of the chunks' fingerprints meet a reference block of another place."""
    for bucket, chunks, (entries,) in _by_bucket(batches, ("entries", np.uint32)):
        lengths = [len(x) for x in entries]
        entries = np.concatenate(entries)
        order = np.argsort(entries >> 2)
        key, sorted_ = (entries >> 2)[order], entries[order]
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        again = np.add.reduceat((sorted_ & 1).astype(np.int64) + 1, cuts) > 1
        block = np.bitwise_or.reduceat(sorted_, cuts) & 2 > 0
        flags = np.empty(len(key), bool)
        flags[order] = np.repeat(again & block, np.diff(np.append(cuts, len(key))))
        yield from _answer(bucket, chunks, lengths, flags, 0)


def _meet_windows(batches):
    """Which of the chunks' windows have their first place in another chunk."""
    for bucket, chunks, (one, two, bases, ids) in _by_bucket(batches, ("one", U), ("two", U), ("base", None), ("firsts", np.uint8)):
        lengths = [len(x) for x in one]
        ids = [_widen(*x) for x in zip(bases, ids, lengths)]
        one, two, ids = np.concatenate(one), np.concatenate(two), np.concatenate(ids)
        order = np.lexsort((np.repeat(np.array(chunks, np.int64), lengths), ids, two, one))
        flags = np.empty(len(order), bool)
        flags[order] = np.concatenate([[False], (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])])
        yield from _answer(bucket, chunks, lengths, flags, 1)


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Drops each word covered by ``window`` words in a row that also start earlier.

    Earlier: in a text of smaller id, or before in the same text. Windows are
    judged on the input. Returns ``doc_id, n_words, n_removed, kept_sha256,
    removed`` (an array of (start, end) word positions, the maximal repeats)
    and, with ``keep_text``, ``kept_text``: the kept words joined by one space.

    Nulls: a null text has no words; a null id counts as larger than any id.
    Rows that repeat an id are texts of their own; which of them is earlier
    follows from the order in which they are read. Texts under ``window`` words
    stay whole. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chunks = stage(rows.mapInArrow(_pack, "chunk bigint, words bigint, ids array<bigint>, lengths array<bigint>, blob binary"), "substring-chunks", "none")
    words = chunks.agg(F.sum("words")).first()[0] or 0
    bits = max(7, math.ceil(math.log2(max(1, words / BUCKET_WORDS))))
    tasks = min(TASKS, max(docs.sparkSession.sparkContext.defaultParallelism, (1 << bits) // TASK_BUCKETS))

    def probe(batches):
        for row in _rows(batches):
            found = [{"bucket": b, "chunk": row["chunk"], "entries": e.tobytes()} for b, e in _Chunk(row, window, bits).probes()]
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("entries", pa.binary())]))

    def extend(batches):
        for row in _rows(batches):
            hits = {x["bucket"]: x["bits"] for x in row["answers"]}
            found = [{"bucket": b, "chunk": row["chunk"], "one": x.tobytes(), "two": y.tobytes()} | _narrow(i) for b, x, y, i in _Chunk(row, window, bits).firsts(hits)]
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("one", pa.binary()), ("two", pa.binary()), ("base", pa.int64()), ("firsts", pa.binary())]))

    def drop(batches):
        for row in _rows(batches):
            chunk = _Chunk(row, window, bits)
            answers = row["answers"] or []
            gone = chunk.removed(*[{x["bucket"]: x["bits"] for x in answers if x["kind"] == k} for k in (0, 1)]) if answers else np.zeros(len(chunk.words.start), bool)
            yield _kept(chunk, gone, keep_text)

    entries = chunks.mapInArrow(probe, "bucket bigint, chunk bigint, entries binary").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    hits = stage(entries.mapInArrow(_meet_blocks, _ANSWER_DDL), "substring-hits", sweep=True)
    per_chunk = F.collect_list(F.struct("kind", "bucket", "bits")).alias("answers")  # a bit per distinct run of one chunk
    firsts = chunks.join(hits.groupBy("chunk").agg(per_chunk), "chunk").mapInArrow(extend, "bucket bigint, chunk bigint, one binary, two binary, base bigint, firsts binary")
    later = stage(firsts.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet_windows, _ANSWER_DDL), "substring-later", sweep=True)
    answered = chunks.join(hits.union(later).groupBy("chunk").agg(per_chunk), "chunk", "left")
    spans = "removed array<struct<start:bigint,end:bigint>>"
    return answered.mapInArrow(drop, f"doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, {spans}" + (", kept_text string" if keep_text else ""))


def _kept(chunk: _Chunk, gone: np.ndarray, keep_text: bool) -> pa.RecordBatch:
    words, n_gone, digests, spans, texts = chunk.words, [], [], [], []
    for d, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        own, off = chunk.raw[words.offsets[d] : words.offsets[d + 1]].split(), gone[a:b]
        n_gone.append(int(off.sum()))
        if n_gone[-1]:
            own = list(itertools.compress(own, (~off).tolist()))
            turn = np.diff(np.concatenate([[0], off.astype(np.int8), [0]]))
            spans.append([{"start": s, "end": e} for s, e in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist())])
        else:
            spans.append([])
        text = b" ".join(own)
        digests.append(hashlib.sha256(text).hexdigest())
        if keep_text:
            texts.append(text.decode())
    columns = [pa.array(chunk.ids, pa.int64()), pa.array(words.n, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"]
    return pa.RecordBatch.from_arrays([*columns, *([pa.array(texts, pa.string())] if keep_text else [])], [*names, *(["kept_text"] if keep_text else [])])


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents")).drop("removed")
