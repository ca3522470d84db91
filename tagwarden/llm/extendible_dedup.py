"""Exact dedup by an extendible-hash index on shared files.

The index maps a 64-bit hash of a text to its class (equal texts). Its directory has 2**depth slots, one for each value of
the hash's leading bits; several slots may share a bucket. Where a bucket would hold more than ``BUCKET_BYTES`` it splits
in two by one more bit; where it already uses all bits of the directory, the directory doubles. Sizes come from a
histogram of the hashes, so the directory (at most 2**``MAX_DEPTH`` slots) is ready before a text moves.

Each owner has a stretch of neighbouring buckets: a range of keys of about equal bytes. Texts go to the owner of
their bucket in one shuffle; an owner takes one bucket after the other into memory as a table from key to a
chain of entries. Equal keys whose bytes differ are chained, equal bytes are one entry, so no two different texts share a class. The
buckets are written to the shared folder as Parquet, in the order of the directory, which lies beside them; looking
up rows is a join with those files on key and SHA-256.

Hot groups: a task first folds its own equal texts, so a group of copies sends one entry a task (and per ``FOLD_BYTES``
of other text). A bucket that no split can shrink (one key of very many tasks) is folded in pages first, dealt by task, and
the pages' entries meet in the bucket afterwards. The lookup's join is split by Spark where one key is hot.

Nulls and odd inputs: a null text counts as empty; no normalisation takes place; a null id is smaller than any other; of equal texts the row with the
largest id stays, and where that id comes repeatedly with the same text exactly one of those rows; every text is compared whole, however long (a bucket may
then exceed its size by one text); an empty table gives an empty index and no rows; the index has column names of its own and takes only id and text, so none can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwarden.llm.common import new_folder, table, written

BUCKET_BYTES, MAX_DEPTH, FOLD_BYTES, OWNER_BYTES = 8 << 20, 20, 32 << 20, 128 << 20
FINE = 8  # bits by which the histogram grows when buckets need deeper splits
ENTRY = 64  # bytes an entry takes beside its text
ENTRIES = "key long, text binary, n long, top long, n_top long"


# ---------------------------------------------------------------- directory
@dataclass
class Bucket:
    prefix: int  # the leading bits its keys share
    bits: int  # how many they are
    load: int  # bytes


class Directory:
    """2**depth slots over the buckets, in the order of their prefixes."""

    def __init__(self, load: int):
        self.depth, self.buckets = 0, [Bucket(0, 0, load)]

    def split(self, loads: Callable[[int, list[Bucket]], dict[int, int]], capacity: int, max_depth: int) -> None:
        """Splits overfull buckets, doubling the directory where one has used all its bits, until none is left or
        the directory may not double again. ``loads`` tells the bytes under each prefix of so many bits."""
        full = [b for b in self.buckets if b.load > capacity]
        while full and self.depth < max_depth:
            self.depth += 1  # only buckets of the last depth are still overfull: the directory doubles
            halves = loads(self.depth, full)
            split = {(b.prefix, b.bits) for b in full}
            new = [Bucket(2 * b.prefix + h, b.bits + 1, halves.get(2 * b.prefix + h, 0)) for b in full for h in (0, 1)]
            self.buckets = [b for b in self.buckets if (b.prefix, b.bits) not in split] + new
            full = [b for b in new if b.load > capacity]
        self.buckets.sort(key=lambda b: b.prefix << (self.depth - b.bits))

    def slots(self) -> np.ndarray:
        """The bucket's number for every value of a key's leading ``depth`` bits."""
        return np.repeat(np.arange(len(self.buckets), dtype=np.int32), [1 << (self.depth - b.bits) for b in self.buckets])

    def owners(self, size: int) -> np.ndarray:
        """Each bucket's owner: neighbouring buckets of about ``size`` bytes together."""
        before = np.cumsum([0] + [b.load + 1 for b in self.buckets[:-1]])
        return np.unique(before // max(1, size), return_inverse=True)[1].astype(np.int32)


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")


def plan_directory(keys: DataFrame, tasks: int, capacity: int, max_depth: int) -> Directory:
    """The directory for ``keys (key, bytes)``, one row a document. A key counts as often as it can still come after
    the tasks have folded their copies. What reaches the driver is one number per prefix, of at most ``max_depth`` bits."""
    each = keys.groupBy("key").agg(
        ((F.max("bytes") + ENTRY) * F.least(F.count("*"), F.lit(tasks))).alias("bytes"))
    sized = written(each, "dedup-keys")
    held: dict[int, np.ndarray] = {}

    def histogram(bits: int, under: list[Bucket] | None) -> dict[int, int]:
        d = sized
        if under is not None:  # only what lies under overfull buckets (fewer than slots of the directory)
            parents = d.sparkSession.createDataFrame([(b.prefix,) for b in under], "parent long")
            d = d.join(F.broadcast(parents), _prefix(under[0].bits) == F.col("parent"), "left_semi")
        rows = d.groupBy(_prefix(bits).alias("p")).agg(F.sum("bytes").alias("b")).toArrow()
        return dict(zip(rows.column("p").to_pylist(), rows.column("b").to_pylist()))

    total = sized.agg(F.sum("bytes")).first()[0] or 0

    def loads(bits: int, full: list[Bucket]) -> dict[int, int]:
        if bits not in held:
            fine = min(max_depth, bits + FINE)
            at, counts = fine, histogram(fine, full)
            while at >= bits:  # coarser prefixes are sums of finer ones
                held[at] = counts
                up: dict[int, int] = {}
                for p, b in counts.items():
                    up[p >> 1] = up.get(p >> 1, 0) + b
                at, counts = at - 1, up
        return held[bits]

    out = Directory(total)
    out.split(loads, max(capacity, 2 * total >> max_depth), max_depth)  # larger buckets where the directory can't grow
    return out


# ---------------------------------------------------------------- buckets
class Chains:
    """One bucket in memory: key -> chain of entries [text, rows, largest id, rows of that id]; equal bytes are one entry."""

    def __init__(self):
        self.chains: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, text: bytes, n: int, top: int | None, n_top: int) -> None:
        chain = self.chains.get(key)
        if chain is None:
            chain = self.chains[key] = []
        for e in chain:
            if e[0] == text:
                e[1] += n
                if e[2] == top:
                    e[3] += n_top
                elif e[2] is None or top is not None and top > e[2]:
                    e[2], e[3] = top, n_top
                return
        chain.append([text, n, top, n_top])
        self.bytes += len(text) + ENTRY

    def batches(self, more: Callable[[np.ndarray], dict], rows: int = 2048, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
        """The entries as record batches; ``more`` makes further columns from the keys."""
        keys: list[int] = []
        held: list[list] = []
        total = 0

        def batch() -> pa.RecordBatch:
            text, n, top, n_top = zip(*held)
            k = np.array(keys, np.int64)
            return pa.RecordBatch.from_pydict({
                "key": pa.array(k), "text": pa.array(text, pa.binary()), "n": pa.array(n, pa.int64()),
                "top": pa.array(top, pa.int64()), "n_top": pa.array(n_top, pa.int64()), **more(k)})

        for key, chain in self.chains.items():
            for e in chain:
                keys.append(key)
                held.append(e)
                total += len(e[0])
                if len(held) >= rows or total >= size:
                    yield batch()
                    keys, held, total = [], [], 0
        if held:
            yield batch()


def _add_batch(into: Chains, batch: pa.RecordBatch, lo: int = 0, hi: int | None = None) -> None:
    for row in zip(*(batch.column(c).slice(lo, None if hi is None else hi - lo).to_pylist()
                     for c in ("key", "text", "n", "top", "n_top"))):
        into.add(*row)


def _merge(dealt: DataFrame, by: str, schema: str, more: Callable[[np.ndarray], dict]) -> DataFrame:
    """Rows come sorted by ``by``: each value is one bucket, merged in memory and put out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket = None, Chains()
        for batch in batches:
            b = batch.column(by).to_numpy()
            cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if b[lo] != now:
                        yield from bucket.batches(more)
                        now, bucket = int(b[lo]), Chains()
                    _add_batch(bucket, batch, lo, hi)
        yield from bucket.batches(more)

    return dealt.mapInArrow(run, schema)


# ---------------------------------------------------------------- the index
@dataclass
class Index:
    folder: str
    directory: Directory
    buckets: DataFrame  # owner, bucket, key, text, n, top, n_top

    def classes(self) -> DataFrame:
        """``(key, sha, n, top, n_top)`` of every class of equal texts, read from the index files."""
        return self.buckets.select("key", F.sha2("text", 256).alias("sha"), "n", "top", "n_top")


def _keyed(docs: DataFrame, id_col: str, text: str, key_bits: int) -> DataFrame:
    """``(id, text, key)``; fewer ``key_bits`` leave leading bits only, so that keys collide (tests)."""
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    if key_bits < 64:
        key = F.shiftleft(F.shiftright(key, 64 - key_bits), 64 - key_bits)
    return docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), key.alias("key"))


def build_index(docs: DataFrame, folder: str, keys: DataFrame | None = None, id_col: str = "doc_id", text: str = "text",
                bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH, key_bits: int = 64) -> Index:
    """Writes the index of all rows of ``docs`` to ``folder``; the texts are shuffled once. ``keys (key, bytes)`` are the
    rows' keys where the caller has written them already."""
    spark = docs.sparkSession
    d = _keyed(docs, id_col, text, key_bits)
    keys = d.select("key", F.octet_length("text").alias("bytes")) if keys is None else keys
    tasks = max(1, d.select(F.spark_partition_id()).distinct().count())
    plan = plan_directory(keys, tasks, bucket_bytes, max_depth)
    total = sum(b.load for b in plan.buckets)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # several owners a partition even out how they fall; none takes more than about OWNER_BYTES
    owners = plan.owners(min(OWNER_BYTES, -(-total // (4 * n)) or 1))
    spark.createDataFrame([(i, b.prefix, b.bits, b.load, int(o)) for i, (b, o) in enumerate(zip(plan.buckets, owners))],
                          "bucket int, prefix long, bits int, load long, owner int").write.parquet(f"{folder}/directory")
    bucket_bytes = max(bucket_bytes, 2 * total >> max_depth)
    pages = np.array([max(1, -(-b.load // bucket_bytes)) if b.bits == plan.depth == max_depth else 1
                      for b in plan.buckets], np.int64)
    # at most 2**max_depth slots: 8 MB
    sent = spark.sparkContext.broadcast((plan.depth, plan.slots(), owners, pages))

    def place(key: np.ndarray) -> dict:
        depth, slots, owner, _ = sent.value
        at = slots[(key.view(np.uint64) >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(key), np.int64)]
        return {"bucket": pa.array(at), "owner": pa.array(owner[at])}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = TaskContext.get().partitionId(), Chains()

        def out() -> Iterator[pa.RecordBatch]:
            def more(key: np.ndarray) -> dict:
                p = place(key)
                of = sent.value[3][p["bucket"].to_numpy()]
                page = np.where(of > 1, task % of, -1)  # -1: the bucket needs no pages
                return p | {"page": pa.array(page.astype(np.int64))}
            return held.batches(more)

        for batch in batches:
            for key, t, i in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("id").to_pylist()):
                held.add(key, t, 1, i, 1)
                if held.bytes > FOLD_BYTES:
                    yield from out()
                    held = Chains()
        yield from out()

    at = "bucket int, owner int"
    entries = d.mapInArrow(fold, f"{ENTRIES}, {at}, page long")
    if (pages > 1).any():
        entries = written(entries, "dedup-entries")
        paged = entries.where("page >= 0").withColumn("deal", F.col("bucket").cast("long") * F.lit(int(pages.max())) + F.col("page"))
        paged = paged.repartition(n, "deal").sortWithinPartitions("deal")
        merged = _merge(paged.select("key", "text", "n", "top", "n_top", "deal"), "deal", f"{ENTRIES}, {at}", place)
        entries = entries.where("page < 0").drop("page").unionByName(merged)
    else:
        entries = entries.drop("page")
    parts = min(max(n, -(-total // OWNER_BYTES)), int(owners.max()) + 1 if len(owners) else 1)
    dealt = entries.repartition(int(parts), "owner").sortWithinPartitions("bucket")
    # written in the order of the owners, so of the directory
    _merge(dealt, "bucket", f"{ENTRIES}, {at}", place).write.parquet(f"{folder}/buckets")
    return Index(folder, plan, spark.read.parquet(f"{folder}/buckets"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folder: str | None = None, **index) -> DataFrame:
    """``(id, sha, keep_id, group_size, kept)`` for every row: its class in the index, the id that stays, and whether
    this row is the one. Exactly one row of every class is kept."""
    spark = docs.sparkSession
    key_bits = index.get("key_bits", 64)
    rows = written(_keyed(docs, id_col, text, key_bits).select(
        F.monotonically_increasing_id().alias("rid"), "id", "key", F.octet_length("text").alias("bytes"),
        F.sha2("text", 256).alias("sha")), "dedup-rows")
    built = build_index(docs, folder or new_folder(spark, "dedup-index"), rows.select("key", "bytes"), id_col, text, **index)
    found = rows.join(built.classes(), ["key", "sha"])
    largest = F.col("id").eqNullSafe(F.col("top"))
    if built.buckets.where("n_top > 1").isEmpty():
        return found.select("id", "sha", F.col("top").alias("keep_id"), F.col("n").alias("group_size"), largest.alias("kept"))
    # the largest id comes several times with one text: the first of those rows stays
    first = found.where(largest & (F.col("n_top") > 1)).groupBy("key", "sha").agg(F.min("rid").alias("first"))
    return found.join(first, ["key", "sha"], "left").select(
        "id", "sha", F.col("top").alias("keep_id"), F.col("n").alias("group_size"),
        (largest & ((F.col("n_top") == 1) | (F.col("rid") == F.col("first")))).alias("kept"))


def op13_extendible_hash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                                     F.col("sha").alias("text_sha256"))


def oracle() -> str:
    return """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
