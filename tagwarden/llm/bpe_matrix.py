"""Byte-level BPE by ranks: encoding on length-bucketed padded matrices, and decoding.

The pattern cuts a text into pieces; equal pieces of a task are encoded once. New pieces are put into
length buckets, each a padded matrix with a row per piece: every round each row finds its
leftmost pair of minimum rank (ranks looked up in an open-addressing hash table of token
pairs), merges it and closes the gap, and rows without a mergeable pair leave. Pieces of over
``MATRIX_BYTES`` bytes (runs without a border) take the same merges from a heap ordered by
(rank, position), as a padded matrix would cost the square of their length. Ids, their decimal
text and the decoded bytes are gathered from flat arrays.

Nulls and odd inputs: a null text is empty: no ids, empty bytes. A lone surrogate cannot occur in a Spark
string. A text of any length is encoded whole; its digests are taken in blocks, so beside its ids only a block is held. Equal
ranks merge at the leftmost pair; repeated rows stay repeated and get equal ids; an empty table gives no rows; columns other
than the text pass through, and the query reads id and text only, so none can clash.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tagwarden.llm.common import table

MATRIX_BYTES = 256
MATRIX_CELLS = 1 << 20  # rows times width of one matrix
BLOCK_IDS = 1 << 18  # ids decoded or written out at a time
KEPT_PIECES = 400_000  # pieces a worker remembers between batches; beyond it starts anew
NONE = np.int32(2**31 - 1)


class Ranks:
    """A rank file as arrays: token bytes, decimal text, and the pair table."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for t, r in ranks.items():
            tokens[r] = t
        self.tokens = tokens
        self.blob, self.at, self.len = _flat(tokens)
        self.text_blob, self.text_at, self.text_len = _flat([b"%d," % i for i in range(size)])
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, merged = [], [], []
        for t, r in ranks.items():
            for cut in range(1, len(t)):
                a = ranks.get(t[:cut])
                b = ranks.get(t[cut:]) if a is not None else None
                if b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(r)
        self._build(np.array(left, np.uint64), np.array(right, np.uint64), np.array(merged, np.int32))

    @staticmethod
    def _slot(key: np.ndarray, shift: np.uint64) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)

    def _build(self, a: np.ndarray, b: np.ndarray, merged: np.ndarray) -> None:
        bits = int(np.ceil(np.log2(max(4, 4 * len(a)))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.vals = np.full(1 << bits, NONE, np.int32)
        key = (a << np.uint64(32)) | b
        slot, todo = self._slot(key, self.shift), np.arange(len(key))
        while todo.size:  # linear probing, all keys at once
            free = todo[self.keys[slot[todo]] == np.uint64(2**64 - 1)]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.vals[slot[put]] = key[put], merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank (= id) of each merged pair, ``NONE`` where the pair does not merge."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = self._slot(key, self.shift)
        got = self.keys[slot]
        out = np.where(got == key, self.vals[slot], NONE)
        open_ = np.flatnonzero((got != key) & (got != np.uint64(2**64 - 1)))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & self.mask
            got = self.keys[slot[open_]]
            out[open_] = np.where(got == key[open_], self.vals[slot[open_]], NONE)
            open_ = open_[(got != key[open_]) & (got != np.uint64(2**64 - 1))]
        return out


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(n) - n, n


def gather(blob: np.ndarray, at: np.ndarray, n: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(the parts of blob named by which, one after the other; where each begins and the end)``."""
    size = n[which]
    ends = np.cumsum(size)
    start = np.concatenate([[0], ends])
    if not size.size or not ends[-1]:
        return blob[:0], start
    index = np.repeat(at[which] - start[:-1], size) + np.arange(ends[-1])
    return blob[index], start


def _merge_matrix(ranks: Ranks, ids: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Ids of each row of the padded ``ids`` (lengths ``n``) after all merges."""
    out: list[np.ndarray] = [None] * len(n)
    rows, width = np.arange(len(n)), ids.shape[1]
    pair = np.full((len(n), width), NONE, np.int32)
    if width > 1:
        r, c = np.nonzero(np.arange(width - 1) < (n[:, None] - 1))
        pair[r, c] = ranks.pair(ids[r, c], ids[r, c + 1])
    while len(rows):
        at = pair.argmin(1)  # the first of equal minima: the leftmost
        line = np.arange(len(rows))
        best = pair[line, at]
        over = best == NONE
        if over.any():
            for i in np.flatnonzero(over):
                out[rows[i]] = ids[i, :n[i]].copy()
            live = ~over
            rows, ids, n, pair, at, best = rows[live], ids[live], n[live], pair[live], at[live], best[live]
            if not len(rows):
                break
            width = int(n.max())
            ids, pair, line = ids[:, :width], pair[:, :width], np.arange(len(rows))
        # close the gap to the right of every merged pair
        if ids.shape[1] > 1:
            src = np.arange(ids.shape[1] - 1) + (np.arange(ids.shape[1] - 1) > at[:, None])
            src_id = np.concatenate([src, np.full((len(rows), 1), ids.shape[1] - 1)], axis=1)
            ids, pair = np.take_along_axis(ids, src_id, 1), np.take_along_axis(pair, src_id, 1)
        n = n - 1
        ids[line, at] = best
        pair[line, n - 1] = NONE  # the last token has no pair
        left = np.flatnonzero(at > 0)
        pair[left, at[left] - 1] = ranks.pair(ids[left, at[left] - 1], ids[left, at[left]])
        right = np.flatnonzero(at < n - 1)
        pair[right, at[right]] = ranks.pair(ids[right, at[right]], ids[right, at[right] + 1])
        beyond = np.flatnonzero(at >= n - 1)
        pair[beyond, at[beyond]] = NONE
    return out


def _merge_long(ranks: Ranks, piece: bytes) -> np.ndarray:
    """The same merges for one long piece: a heap of (rank, position) over a linked list."""
    ids = ranks.byte[np.frombuffer(piece, np.uint8)].tolist()
    n = len(ids)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    first = ranks.pair(np.array(ids[:-1]), np.array(ids[1:]))
    memo: dict[tuple[int, int], int] = {}

    def rank(a: int, b: int) -> int:
        got = memo.get((a, b))
        if got is None:
            got = memo[a, b] = int(ranks.pair(np.array([a]), np.array([b]))[0])
        return got

    heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = nxt[i] if ids[i] == a else n
        if ids[i] != a or j >= n or ids[j] != b:
            continue  # one of the two has been merged since
        ids[i], ids[j] = r, -1
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
            if (q := rank(r, ids[nxt[j]])) != NONE:
                heapq.heappush(heap, (q, i, r, ids[nxt[j]]))
        if prv[i] >= 0 and (q := rank(ids[prv[i]], r)) != NONE:
            heapq.heappush(heap, (q, prv[i], ids[prv[i]], r))
    return np.array([x for x in ids if x >= 0], np.int32)


def encode_pieces(ranks: Ranks, pieces: list[bytes]) -> list[np.ndarray]:
    """Token ids of every piece (non-empty bytes)."""
    out: list[np.ndarray] = [None] * len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    for i in np.flatnonzero(size > MATRIX_BYTES):
        out[i] = _merge_long(ranks, pieces[i])
    short = np.flatnonzero(size <= MATRIX_BYTES)
    order = short[np.argsort(size[short], kind="stable")]
    lo = 0
    while lo < len(order):
        # a bucket: lengths up to a quarter over its shortest, within the matrix size
        cap = size[order[lo]] * 5 // 4 + 1
        hi = int(np.searchsorted(size[order], cap, side="right"))
        hi = min(hi, lo + max(1, MATRIX_CELLS // int(cap)))
        who = order[lo:hi]
        n = size[who]
        ids = np.zeros((len(who), int(n.max())), np.int32)
        ids[np.arange(ids.shape[1]) < n[:, None]] = ranks.byte[np.frombuffer(b"".join(pieces[i] for i in who), np.uint8)]
        for i, v in zip(who, _merge_matrix(ranks, ids, n)):
            out[i] = v
        lo = hi
    return out


class _Numbers(dict):
    """Piece -> its number, given on first sight; ``new`` has those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = k = len(self)
        return k


class Codec:
    """Encoder and decoder of one rank file; pieces seen before are remembered up to a bound."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.split = Ranks(path), regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        """Drops the pieces remembered so far."""
        self.numbers = _Numbers()
        self.ids, self.at, self.len = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids of all texts, starts)``; text i has ``ids[starts[i]:starts[i + 1]]``."""
        if len(self.numbers) > KEPT_PIECES:
            self.forget()
        number, split = self.numbers.__getitem__, self.split
        codes = [np.fromiter(map(number, split(t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        if self.numbers.new:
            fresh = encode_pieces(self.ranks, [p.encode("utf-8") for p in self.numbers.new])
            n = np.fromiter(map(len, fresh), np.int64, len(fresh))
            self.at = np.concatenate([self.at, self.ids.size + np.cumsum(n) - n])
            self.len = np.concatenate([self.len, n])
            self.ids = np.concatenate([self.ids, *fresh])
            self.numbers.new = []
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        ids, starts = gather(self.ids, self.at, self.len, flat)
        return ids, starts[np.concatenate([[0], np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes)))])]

    def decoded(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes of the ids, a block at a time."""
        r = self.ranks
        for lo in range(0, len(ids), BLOCK_IDS):
            yield gather(r.blob, r.at, r.len, ids[lo:lo + BLOCK_IDS])[0].tobytes()

    def written(self, ids: np.ndarray) -> Iterator[bytes]:
        """The ids in decimal, joined by commas, a block at a time."""
        r = self.ranks
        for lo in range(0, len(ids), BLOCK_IDS):
            part = gather(r.text_blob, r.text_at, r.text_len, ids[lo:lo + BLOCK_IDS])[0].tobytes()
            yield part if lo + BLOCK_IDS < len(ids) else part[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.decoded(ids))

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return b"".join(self.written(ids))


def sha256(blocks: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for b in blocks:
        h.update(b)
    return h.hexdigest()


def rank_file(path: str) -> str:
    """``path``, or the place of the public tokenizer file of that name on the machine that asks."""
    if os.path.sep in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _runs(texts: list[str | None], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def tokenize(df: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = False) -> DataFrame:
    """The columns of ``df`` without ``text`` plus ``n_tokens, ids_sha256, decoded_sha256`` and, on
    request, the ids themselves (``array<int>``). Narrow: Arrow batches, about a megabyte of text at a time. ``path`` is the
    rank file, or its name among the public tokenizers, which each worker looks up."""
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file(path), pattern)
        for b in batches:
            texts = b.column(text).to_pylist()
            n, a, d, lists = [], [], [], []
            for lo, hi in _runs(texts):
                got, starts = c.encode(texts[lo:hi])
                for i in range(hi - lo):
                    own = got[starts[i]:starts[i + 1]]
                    n.append(own.size)
                    a.append(sha256(c.written(own)))
                    d.append(sha256(c.decoded(own)))
                    if ids:
                        lists.append(own)
            cols = {k: b.column(k) for k in keep}
            cols |= {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()),
                     "decoded_sha256": pa.array(d, pa.string())}
            if ids:
                cols["ids"] = pa.array(lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    schema = T.StructType([*df.drop(text).schema.fields, T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return df.mapInArrow(run, schema.add("ids", T.ArrayType(T.IntegerType())) if ids else schema)


def op5_bpe_matrix(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"),
                    "byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN)
