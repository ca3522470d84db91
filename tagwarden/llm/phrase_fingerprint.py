"""Document fingerprints by locally consistent parsing.

A text is a sequence of names, at first its code points. Each level joins runs of one name, gives
every name a small label by deterministic coin tossing (the lowest bit in which it differs from the name
before, three rounds: 128, 14, then 8 labels), cuts at the local maxima of the labels, and
hashes each phrase into a name of the next level. Where a phrase begins depends only on a few names around
it, so equal substrings have equal interior phrases at any offset. The signature is the set of all
phrase names (32 bits each) from level ``FIRST_LEVEL`` up, and the likeness of two texts is the Jaccard similarity of their whole
signatures. The fingerprint as written out is the ``SKETCH`` smallest names; ``likeness`` takes such sketches
too and estimates the same number from them, with a standard error of at most 0.5 / sqrt(SKETCH) = 0.06.

Neighbours: documents are dealt into ranges of the id (about equal row counts) and sorted in them;
the first row of each range also goes to the end of the range before it, so no task sees more
than its range and one row. An id (or null) that fills several ranges is cut by a hash of the text.

Nulls and odd inputs: a null text is empty, its fingerprint is the empty string; two empty
fingerprints have likeness 1, one empty and one not 0. Null ids come last in the descending
order; rows of equal ids are ordered by a hash of the text, then the text; rows that repeat id and text stand together and are each
other's next; a single row is its own next; very long texts are parsed whole; an empty table gives no rows; only id and text are
read, so no input column can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwarden.llm.common import ranges, table

FIRST_LEVEL, SKETCH = 2, 64
CELLS = 8  # ranges of the id a shuffle partition
CHUNK_CHARS = 1 << 16  # characters at once: arrays of that size stay in a core's cache
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


def _toss_table(size: int) -> np.ndarray:
    """``[label, label before] -> 2 * lowest differing bit + that bit of the label``."""
    a, b = np.arange(size)[:, None], np.arange(size)[None, :]
    d = a ^ b
    bit = np.where(d, np.log2(np.maximum(d & -d, 1)).astype(int), 0)
    return (2 * bit + ((a >> bit) & 1)).astype(np.uint8)


_TOSS = [_toss_table(128).ravel(), _toss_table(16).ravel()]


def labels(names: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Labels under 8 for names of which no two neighbours are equal; ``start``: where texts begin."""
    prev = np.empty_like(names)
    prev[1:] = names[:-1]
    prev[start] = 0
    d = names ^ prev
    bit = np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)) & np.uint8(63)
    out = (bit << np.uint8(1)) | ((names >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    for width, toss in zip((7, 4), _TOSS):
        before = np.empty_like(out)
        before[1:] = out[:-1]
        before[start] = 0
        out = toss[(out.astype(np.uint16) << np.uint16(width)) | before]
    return out


def next_level(names: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(phrase names, where texts begin)`` one level up. Every text has one name at least."""
    n = len(names)
    new = np.empty(n, bool)
    new[1:] = names[1:] != names[:-1]
    new[start] = True
    at = np.flatnonzero(new)
    if len(at) < n:  # runs of one name become one name
        length = np.diff(np.append(at, n))
        names = names[at]
        many = length > 1
        names[many] = _mix(names[many] + length[many].astype(np.uint64) * _K[0])
        start = np.searchsorted(at, start)
        n = len(names)
    lab = labels(names, start)
    cut = np.zeros(n, bool)
    cut[1:-1] = (lab[1:-1] > lab[:-2]) & (lab[1:-1] > lab[2:])
    cut[start[1:] - 1] = False  # the last name of a text opens no phrase
    cut[start] = True
    at = np.flatnonzero(cut)
    length = np.diff(np.append(at, n))
    place = (np.arange(n) - np.repeat(at, length)).astype(np.uint64)
    sums = np.add.reduceat(_mix(names + (place + np.uint64(1)) * _K[0]), at)
    return _mix(sums + length.astype(np.uint64)), np.searchsorted(at, start)


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The signature of every text: its phrase names, sorted (uint32); the first ``SKETCH`` are its fingerprint."""
    out = [np.zeros(0, np.uint32)] * len(texts)
    doc = np.array([i for i, t in enumerate(texts) if t], np.int64)
    if not len(doc):
        return out
    size = np.array([len(texts[i]) for i in doc])
    flat = "".join(texts[i] for i in doc).encode("utf-32-le", "surrogatepass")
    names = np.frombuffer(flat, np.uint32).astype(np.uint64) + np.uint64(1)
    start = np.cumsum(size) - size
    keys, level = [], 0
    while len(doc):
        names, start = next_level(names, start)
        level += 1
        size = np.diff(np.append(start, len(names)))
        root = size == 1
        own = np.repeat(doc, size)
        take = np.repeat(root, size) if level < FIRST_LEVEL else slice(None)  # a text's last name always counts
        keys.append((own[take].astype(np.uint64) << np.uint64(32)) | (names[take] >> np.uint64(32)))
        if root.any():
            keep = ~np.repeat(root, size)
            names, doc, size = names[keep], doc[~root], size[~root]
            start = np.cumsum(size) - size
    key = np.concatenate(keys)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    own, value = (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)
    first = np.searchsorted(own, np.arange(len(texts) + 1))
    return [value[first[i]:first[i + 1]] for i in range(len(texts))]


def text_of(signature: np.ndarray) -> str:
    return signature[:SKETCH].astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, sketch: int | None = None) -> float:
    """Jaccard similarity of two signatures; with ``sketch`` the estimate from their so many smallest names."""
    if not a.size or not b.size:
        return float(a.size == b.size)
    if a.size == b.size and np.array_equal(a, b):
        return 1.0
    if sketch is None:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / (a.size + b.size - both)
    a, b = a[:sketch], b[:sketch]
    least = np.union1d(a, b)
    if a.size >= sketch or b.size >= sketch:
        least = least[:sketch]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= least[-1]) / least.size)


def edited(text: str, nxt: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + nxt[:half]


def fingerprint_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Contract columns for ``docs``: each document against its edited text and its next one."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # several ranges a partition, which evens out how they fall
    low = docs.agg(F.min(id_col)).first()[0]
    below = -1 if low is None else max(low - 1, -(1 << 63))  # a null id stands below all others
    d = ranges(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                           F.coalesce(F.col(id_col).cast("long"), F.lit(below)).alias("key")), "key", CELLS * n, "cell", F.xxhash64("text"))
    # upward as an unsigned number, as the ranges have it
    d = d.withColumn("hash", F.xxhash64("text").bitwiseXOR(F.lit(-(1 << 63))))
    # heads: the first row of each range in descending order, by id and hash; one row a range
    heads = {r["cell"]: r["head"] for r in d.groupBy("cell").agg(F.max(F.struct("key", "hash")).alias("head")).collect()}
    order = sorted(heads)
    to = [(*heads[c], c, order[k + 1] if k + 1 < len(order) else order[0]) for k, c in enumerate(order)]
    head_of = spark.createDataFrame(to, "head_key long, head_hash long, head_cell int, next_cell int")
    # a head's copy goes to the range before it in the order (the next higher ids), after that range's own rows
    d = d.join(F.broadcast(head_of), (F.col("cell") == F.col("head_cell")) & (F.col("key") == F.col("head_key"))
               & (F.col("hash") == F.col("head_hash")), "left")  # at most a few times CELLS * n rows
    d = d.select("doc_id", "text", "key", "hash", F.explode(F.filter(F.array(
        F.struct(F.col("cell").alias("cell"), F.lit(0).alias("guest")),
        F.struct(F.col("next_cell").alias("cell"), F.lit(1).alias("guest"))), lambda x: x["cell"].isNotNull())).alias("to"))
    d = d.select("doc_id", "text", "key", "hash", "to.cell", "to.guest").repartition(n, "cell").sortWithinPartitions(
        "cell", "guest", F.col("key").desc(), F.col("hash").desc(), "text").drop("key", "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # rows not yet answered, in order
        size = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "cell", "guest"))):
                rows.append(r)
                size += len(r[1])
                if size > CHUNK_CHARS and len(rows) > 1:
                    yield from answer(rows)
                    rows, size = [rows[-1]], len(rows[-1][1])
        if rows:
            yield from answer(rows)

    def answer(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Answers every own row whose next row is at hand."""
        own = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i + 1][2] == rows[i][2]]
        texts = [r[1] for r in rows]
        changed = [edited(texts[i], texts[i + 1]) for i in own]
        got = sketches(texts + changed)
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array([rows[i][0] for i in own], pa.int64()),
            "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            "fingerprint": pa.array([text_of(got[i]) for i in own], pa.string()),
            "edited_fingerprint": pa.array([text_of(s) for s in got[len(texts):]], pa.string()),
            "near_edited": pa.array([likeness(got[i], s) for i, s in zip(own, got[len(texts):])], pa.float64()),
            "near_next": pa.array([likeness(got[i], got[i + 1]) for i in own], pa.float64()),
        }, schema=pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                             ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                             ("near_edited", pa.float64()), ("near_next", pa.float64())]))

    return d.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                             "edited_fingerprint string, near_edited double, near_next double")


def op4_phrase_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprint_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
