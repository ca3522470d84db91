"""Periodic runs of words, by internal pattern matching.

A run of period q is a stretch of consecutive words in which words q apart are identical, that no
neighbouring word extends, whose smallest period is q and whose length is at least
``max(MIN_WORDS, MIN_TIMES * q)``. All runs of a text are found, of every period.

Method. The suffix array of the word ids is built by doubling; its equivalence classes of level k
(equal substrings of 2**k words) are stretches of the suffix array. At each level the text is cut into
dyadic blocks of b = 2**k words. A run of period q (b <= q < 2b, or q < 2b at the lowest level)
of three periods holds a whole block that occurs again q words later, in a
neighbouring window of at most b starting places. The occurrences of a block there are asked of a wavelet tree over the
suffix array by range successor; as block and window are of one length they form a single arithmetic
progression, given by its first member, its step and its count. Each member's distance to the block is a candidate period;
it is extended both ways by comparing the classes of the doubling, so the words themselves decide. Stretches found under
several periods keep the smallest.

Texts are handled in groups of about ``GROUP_WORDS`` words inside a task (one array, word ids
distinct between texts, so nothing crosses a border); a longer text is a group of its own, whole. Nothing is
shuffled. A text of n words takes n log n time and memory (about 8 log2(n) bytes a word).

Nulls and odd inputs: a null or empty text, or one without words, has no words, no runs and an empty collapsed text;
very long texts are read whole; a null id stays null; repeated rows stay repeated; of runs tied for the greatest exponent
the first, then the one of smallest period is ``best``; an empty table gives an empty result; input columns are kept in the struct
``row``, so none can clash.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwarden.llm.common import nested, table

MIN_WORDS, MIN_TIMES = 24, 3
BASE_LEVEL = 3  # blocks of 8 words: a run of 24 words and period <= 8 holds one that occurs again a period later
GROUP_WORDS = 1 << 18
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


# ---------------------------------------------------------------- suffix array and wavelet tree
def suffix_order(ids: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of ``ids`` and, for every level k, each place's class: equal iff the 2**k ids from there on are.

    A class is numbered by its first slot in the suffix array. Only classes of several places are sorted on. Levels end
    where all places differ or where 2**k reaches ``longest``, beyond which no two substrings are equal.
    """
    n = len(ids)
    sa = np.argsort(ids, kind="stable")
    s = ids[sa]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(first, size)
    levels, slots, step = [rank], np.flatnonzero(np.repeat(size > 1, size)), 1
    while slots.size and step < longest:
        pos = sa[slots]
        after = pos + step
        key = rank[pos] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        key, pos = key[order], pos[order]
        sa[slots] = pos
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(pos)))
        rank = rank.copy()
        rank[pos] = np.repeat(slots[first], size)
        levels.append(rank)
        slots = slots[np.repeat(size > 1, size)]
        step *= 2
    return sa, levels


class WaveletTree:
    """Integers below 2**bits, one level of the tree per bit, each with its prefix counts of ones. Queries come as arrays."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b) & 1
            ones = np.zeros(len(values) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, ones, len(values) - int(ones[-1])))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values at slots [lo, hi) are smaller than x (x < 2**bits)."""
        count = np.zeros(len(lo), np.int64)
        for b, ones, zeros in self.levels:
            a, z = ones[lo], ones[hi]
            up = ((x >> b) & 1).astype(bool)
            count += np.where(up, (hi - lo) - (z - a), 0)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + z, hi - z)
        return count

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the values at slots [lo, hi)."""
        out = np.zeros(len(lo), np.int64)
        for b, ones, zeros in self.levels:
            a, z = ones[lo], ones[hi]
            small = (hi - lo) - (z - a)
            up = k >= small
            out |= up.astype(np.int64) << b
            k = np.where(up, k - small, k)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + z, hi - z)
        return out

    def progression(self, lo: np.ndarray, hi: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """Of the values at slots [lo, hi) within [begin, end), which form an arithmetic progression: which queries have
        any, and their first value, step (0 for one value) and count. First and second are range successors."""
        rank = self.below(lo, hi, begin)
        count = self.below(lo, hi, end) - rank
        some = np.flatnonzero(count > 0)
        lo, hi, rank, count = lo[some], hi[some], rank[some], count[some]
        first = self.kth(lo, hi, rank)
        more = count > 1
        step = np.zeros(len(some), np.int64)
        step[more] = self.kth(lo[more], hi[more], rank[more] + 1) - first[more]
        return some, first, step, count


# ---------------------------------------------------------------- runs
def _common_after(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at i < j."""
    n, out = len(levels[0]), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        jj = j + out
        inside = jj < n
        jj = np.where(inside, jj, 0)
        out += (inside & (levels[k][np.where(inside, i + out, 0)] == levels[k][jj])).astype(np.int64) << k
    return out


def _common_before(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common suffix of what stands before i < j."""
    out = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ii = i - out - (1 << k)
        inside = ii >= 0
        ii = np.where(inside, ii, 0)
        out += (inside & (levels[k][ii] == levels[k][np.where(inside, j - out - (1 << k), 0)])).astype(np.int64) << k
    return out


def find_runs(ids: np.ndarray, longest: int | None = None) -> np.ndarray:
    """All runs of ``ids`` as rows (start, length, period), by start, then period. ``longest``: no run is longer."""
    n = len(ids)
    longest = n if longest is None else longest
    none = np.zeros((0, 3), np.int64)
    if longest < MIN_WORDS:
        return none
    sa, levels = suffix_order(np.asarray(ids, np.int64), longest)
    if len(levels) <= BASE_LEVEL:
        return none
    lowest = levels[BASE_LEVEL]
    shared = np.bincount(lowest, minlength=n)[lowest[sa]] > 1  # slots whose class of the lowest level has several places
    if not shared.any():
        return none
    place = np.concatenate([[0], np.cumsum(shared)])  # of a slot, among those
    tree = WaveletTree(sa[shared], n.bit_length())
    found = [none]
    for k in range(BASE_LEVEL, len(levels)):
        b = 1 << k
        if MIN_TIMES * b > max(longest, MIN_WORDS):
            break
        x = np.arange(0, n, b)
        cls, size = levels[k][x], np.bincount(levels[k], minlength=n)
        often = size[cls] > 1
        x, cls, size = x[often], cls[often], size[cls[often]]
        lo, hi = place[cls], place[cls + size]
        windows = [(b, 2 * b)] if k > BASE_LEVEL else [(1, b + 1), (b + 1, 2 * b)]
        for begin, end in windows:
            some, first, step, count = tree.progression(lo, hi, np.minimum(x + begin, n), np.minimum(x + end, n))
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(x[some], count)
            q = np.repeat(first, count) + nth * np.repeat(step, count) - at
            # where the step's own stretch covers block and member, a multiple of the step is not the smallest period
            reach = np.where(step > 0, step + _common_after(levels, x[some], x[some] + np.maximum(step, 1)), 0)
            d = np.repeat(np.maximum(step, 1), count)
            new = (np.repeat(reach, count) < q + b) | (q % d != 0) | (q == d)
            at, q = at[new], q[new]
            start = at - _common_before(levels, at, at + q)
            length = at + q + _common_after(levels, at, at + q) - start
            ok = length >= np.maximum(MIN_WORDS, MIN_TIMES * q)
            found.append(np.unique(np.stack([start, length, q], axis=1)[ok], axis=0))
    rows = np.unique(np.concatenate(found), axis=0)  # by start, length, period
    # one stretch under several periods: the smallest is its period
    rows = rows[np.concatenate([[True], np.any(rows[1:, :2] != rows[:-1, :2], axis=1)])] if len(rows) else rows
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _group(texts: list[list[bytes]]) -> list[tuple[np.ndarray, str]]:
    """Per text (as words) its runs and the collapsed text."""
    sizes = np.array([len(w) for w in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    vocab: dict[bytes, int] = defaultdict(itertools.count().__next__)
    ids = np.fromiter(map(vocab.__getitem__, itertools.chain.from_iterable(texts)), np.int64, int(ends[-1]))
    runs = find_runs(ids + np.repeat(np.arange(len(texts)), sizes) * len(vocab), int(sizes.max()))
    if not len(runs):
        return [(runs, b" ".join(w).decode()) for w in texts]
    gone = np.zeros(len(ids) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(gone)[:-1] == 0
    cut = np.searchsorted(runs[:, 0], np.append(begins, len(ids)))
    out = []
    for t, words in enumerate(texts):
        own = runs[cut[t]:cut[t + 1]] - [int(begins[t]), 0, 0]
        out.append((own, b" ".join(itertools.compress(words, kept[begins[t]:ends[t]]) if len(own) else words).decode()))
    return out


def _best(runs: np.ndarray) -> dict | None:
    rows = runs.tolist()
    if not rows:
        return None
    s, n, q = max(rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    return {"start": s, "length": n, "period": q}


def periodic_runs(docs: DataFrame, text: str = "text", id_col: str = "doc_id",
                  edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``(row, runs, best, collapsed)``: all runs of every whole text, the one of greatest exponent, and the
    text without the words that any run repeats (kept words joined by one space).

    Words are what stands between the ASCII white space characters. ``edit`` may change a document's words first.
    """
    d = nested(docs, text, _id=id_col)
    out = T.StructType([d.schema["row"], T.StructField("runs", T.ArrayType(RUN)), T.StructField("best", RUN),
                        T.StructField("collapsed", T.StringType())])
    arrow = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN.fields]))

    def emit(batch: pa.RecordBatch, lo: int, words: list[list[bytes]]) -> pa.RecordBatch:
        done = _group(words)
        sizes = [len(r) for r, _ in done]
        flat = np.concatenate([r for r, _ in done])
        each = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(arrow.value_type))
        runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), each, type=arrow)
        return pa.RecordBatch.from_arrays([
            batch.column("row").slice(lo, len(words)), runs, pa.array([_best(r) for r, _ in done], arrow.value_type),
            pa.array([c for _, c in done], pa.string())], names=out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, total, lo = [], 0, 0
            ids = batch.column("_id")
            for i, t in enumerate(batch.column("text")):
                words = (t.as_py() or "").encode().split()  # bytes: splits at ASCII white space only
                if edit is not None:
                    words = edit(ids[i].as_py(), words)
                if held and total + len(words) > GROUP_WORDS:
                    yield emit(batch, lo, held)
                    held, total, lo = [], 0, i
                held.append(words)
                total += len(words)
            if held:
                yield emit(batch, lo, held)

    return d.mapInArrow(run, out)


# ---------------------------------------------------------------- the query
def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's edit: in a tenth of the documents (by the CRC of the id) all words from some place on repeat with some period."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a:a + p]
    return words[:a] + (block * ((n - a) // p + 1))[:n - a]


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Every document under the contract's edit (a null id gets none): its runs as digests and the best one."""
    found = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), edit=planted)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best = F.col("best")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
