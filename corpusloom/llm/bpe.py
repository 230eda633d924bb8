"""Byte-level BPE encoding and decoding in linear time.

A vocabulary's ranks define which tokens a merge makes (:class:`Vocabulary`).
A piece's bytes, read as Latin-1, go once through an Aho-Corasick automaton that
names the longest token at each position. The encoder takes it if it may stand
behind the token before, or else a shorter one, and steps back where none may;
a position given up is not tried again, so the work is linear. Two tokens may
stand side by side if undoing their merges step by step never meets a pair
that would have merged across the seam first; these answers are memoised. The
sequence in which all neighbours may stand together is the one that the merges
themselves make.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import piece_codes, slices
from .shared import read_table

#: Entries that the caches of a worker hold at most (some 100 MB); full caches start anew.
CACHE = 300_000
_built: dict[str, "Vocabulary"] = {}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        reached = set()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = self._merge(token, rank)
            if len(token) == 1:
                self.split[rank] = (rank, rank)
            elif len(parts) == 2:
                self.split[rank] = pair = (ranks[parts[0]], ranks[parts[1]])
                self.merged[pair] = rank
            else:
                continue  # no merge makes it: it stands for a whole piece only
            reached.add(token)
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        for token in reached:
            self.automaton.add_word(token.decode("latin-1"), (ranks[token], len(token)))
            self.shorter[ranks[token]] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in reached), -1)
        self.automaton.make_automaton()
        self._beside: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self)

    def _merge(self, token: bytes, below: int) -> list[bytes]:
        """The merges of ranks under ``below`` on a token's bytes; leftmost first among equals."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def beside(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` in an encoded piece; memoised."""
        known = self._beside.get((left, right))
        if known is None:
            if len(self._beside) >= CACHE:
                self._beside.clear()
            known = self._beside[left, right] = self._undo(left, right)
        return known

    def _undo(self, a: int, b: int) -> bool:
        # ``limit``: merges from this rank on come after the one that was undone last. A merge
        # of equal rank on the left side comes first, so undoing the right side leaves room for it.
        limit = sys.maxsize
        while self.merged.get((a, b), limit) >= limit:
            a_whole, b_whole = self.split[a] == (a, a), self.split[b] == (b, b)
            if a_whole and b_whole:
                return True
            if b_whole or (not a_whole and a > b):
                limit, a = a, self.split[a][1]
            else:
                limit, b = b + 1, self.split[b][0]
        return False

    def encode(self, piece: bytes) -> list[int]:
        """The ids that merging by rank gives for one piece."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        longest = [-1] * len(piece)
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = token  # ends rise, so the last one is the longest
        size, open_ = self.bytes, bytearray(b"\1" * (len(piece) + 1))
        out: list[int] = []
        at, token = 0, longest[0] if piece else -1
        while at < len(piece):
            while token >= 0 and not (open_[at + len(size[token])] and (not out or self.beside(out[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += len(size[token])
                token = longest[at] if at < len(piece) else -1
            else:
                if not out:
                    raise ValueError("the vocabulary can't make these bytes")
                open_[at] = 0
                token = out.pop()
                at -= len(size[token])
        return out


class _Pieces(dict):
    """Of each piece seen: its ids as text, their number, and the bytes that the ids decode to."""

    def __init__(self, vocabulary: Vocabulary):
        self.of = vocabulary

    def __missing__(self, piece: str) -> tuple[str, int, bytes]:
        ids = self.of.encode(piece.encode())
        found = ",".join(map(str, ids)), len(ids), b"".join([self.of.bytes[i] for i in ids])
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = found
        return found


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def vocabulary(data: bytes) -> Vocabulary:
    """Built once in each worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _built:
        _built[key] = Vocabulary(read_ranks(data))
    return _built[key]


_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The class of each code point that the splitting pattern knows."""
    if not _kinds:
        table = np.full(0x110000, _OTHER, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k in "LN":
                table[c] = _LETTER if k == "L" else _NUMBER
        # The code points with the property White_Space.
        table[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
        _kinds.append(table)
    return _kinds[0]


def piece_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start, by the public pattern, in texts that lie one after another.

    ``first``: where each text starts, and the end. A piece is a run of letters,
    of digits or of other characters, with a space before it if there is one; a
    short form (``'s`` and the like) where an apostrophe starts a piece; or a
    run of white space, less its last character if something follows.
    """
    n = len(codes)
    kind = kinds()[codes]
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    before = np.empty(n, np.uint8)
    before[:1], before[1:] = 0, kind[:-1]
    before[edge[:n]] = 0
    space = kind == _SPACE
    starts = kind != before
    blank = np.zeros(n, bool)  # a space that the next piece takes along
    last = space.copy()  # the last of a run, with something behind it
    last[:-1] &= ~space[1:]
    last[-1:] = False
    last &= ~edge[1:]
    blank = last & (codes == 32)
    starts[1:] &= ~blank[:-1]
    starts |= last
    quote = np.flatnonzero((codes == 39) & starts)
    if len(quote):
        follow = np.zeros((len(quote), 2), codes.dtype)
        for k in (1, 2):
            at = np.minimum(quote + k, n - 1)
            inside = (quote + k < n) & ~edge[np.minimum(quote + 1, n)]
            if k == 2:
                inside &= ~edge[np.minimum(quote + 2, n)]
            follow[:, k - 1] = np.where(inside, codes[at], 0)
        a, b = follow[:, 0], follow[:, 1]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for at, length in ((quote[one], 2), (quote[two], 3)):
            starts[at + 1] = False
            rest = at + length
            rest = rest[rest < n]
            starts[rest[kind[rest] == _LETTER]] = True
    starts[first[:-1][first[:-1] < n]] = True
    return np.flatnonzero(starts)


def encode_texts(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary):
    """For each text: ids joined by commas, number of ids, decoded bytes."""
    text = data.tobytes().decode()
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    first = heads[offsets]
    starts = piece_starts(codes, first)
    ends = np.append(starts[1:], len(codes))[: len(starts)]
    byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    _, one, back = np.unique(piece_codes(data, byte[starts], byte[ends]), return_index=True, return_inverse=True)
    known = [vocab.pieces[text[a:b]] for a, b in zip(starts[one].tolist(), ends[one].tolist())]
    ids, made = np.empty(len(known), object), np.empty(len(known), object)
    ids[:], made[:] = [x[0] for x in known], [x[2] for x in known]
    count = np.zeros(len(back) + 1, np.int64)
    np.cumsum(np.array([x[1] for x in known], np.int64)[back], out=count[1:])
    ids, made = ids[back].tolist(), made[back].tolist()
    bounds = np.searchsorted(starts, first)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield ",".join(ids[a:b]), int(count[b] - count[a]), b"".join(made[a:b])


def bpe_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, decodes the ids again and returns digests.

    ``path``: a rank file (token in base64, rank); the driver reads it and sends
    it to the executors once. Returns ``doc_id, n_tokens, ids_sha256,
    decoded_sha256``.

    Nulls: a null text counts as empty (no token); a null id stays null.
    Repeated rows and ties are rows like any other; an empty table gives an
    empty result; other columns are ignored.
    """
    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def digest(batches):
        vocab = vocabulary(sent.value)
        for batch in batches:
            n, ids, made = [], [], []
            for _, _, data, offsets, _ in slices(batch.column(1)):
                for text, count, decoded in encode_texts(data, offsets, vocab):
                    n.append(count)
                    ids.append(hashlib.sha256(text.encode()).hexdigest())
                    made.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(made, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(digest, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"))
