"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records by a seeded hash into buckets of about ``BUCKET_BYTES``. Pass 2
takes each bucket into memory, puts it into a canonical order and shuffles it by Fisher-Yates
with a generator seeded by (seed, bucket), so a task that runs again writes the same. The
buckets follow each other to one random order of all records; shard s of S is the
s-th of S stretches of it, whose row counts differ by at most one (the law ``rows``). The
shards are written as Parquet, records whole.

A bucket holds contents whose hashes agree, so ids or texts that hold a third of all rows
spread. Rows that repeat both id and text share a bucket, unless they alone would make one of over
``HEAVY`` times its size: then equal rows are counted, numbered and scattered by their numbers
too. Nulls and odd inputs: a null text counts as 0 bytes and CRC 0, a null id is hashed like a
value; an empty table writes an empty folder; equal ids and texts are ordered by a hash of their whole rows, so the same
table gives the same places in any partitioning; a text larger than a bucket makes one of its own size; input columns ride
in the struct ``row``, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwarden.llm.common import new_folder, table, written

SHARDS, SEED, BUCKET_BYTES, MAX_BUCKETS = 16, 20_240_601, 1 << 20, 1 << 20
PARTITION_BYTES = 128 << 20
HEAVY, RUN = 8, 1_000  # bucket sizes that repeated rows may fill; copies that one row of the count becomes at a time


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of ``range(n)`` by swapping each place, from the last, with one not after it."""
    out = list(range(n))
    draws = rng.integers(0, np.arange(n, 1, -1)) if n > 1 else ()
    for i, j in zip(range(n - 1, 0, -1), (int(x) for x in draws)):
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def _numbered(d: DataFrame, seed: int) -> DataFrame:
    """``d (row, _bytes)`` with every copy of an equal row under a ``_key`` of its own.

    Equal rows are counted (with partial counts, so a hot row moves once a task) and written out
    again in runs of ``RUN`` copies, dealt to all partitions.
    """
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = d.groupBy("row", "_bytes").agg(F.count("*").alias("n"))
    c = c.select("row", "_bytes", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(RUN))).alias("run"))
    c = c.repartition(n, F.xxhash64("row", "run"))
    c = c.select("row", "_bytes", F.explode(F.sequence("run", F.least("n", F.col("run") + RUN) - 1)).alias("copy"))
    return written(c.select("row", F.xxhash64(F.lit(seed), "row", "copy").alias("_key"), "_bytes"), "numbered")


def shuffle_to_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS,
                      seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes ``docs`` to ``folder`` as (row, shard, slot), shuffled, and returns the table read back.

    The texts are shuffled once (pass 1), and thrice where rows repeat beyond a bucket. What reaches the driver is one count per bucket, bounded
    by ``MAX_BUCKETS``; beyond that many, buckets get larger.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("_key"),
                    F.coalesce(F.octet_length(F.col(text)), F.lit(0)).alias("_bytes"))
    sizes = d.agg(F.sum("_bytes").alias("b"), F.count("*").alias("n")).first()
    buckets = max(1, min(MAX_BUCKETS, -(-((sizes["b"] or 0) + 64 * sizes["n"]) // bucket_bytes)))
    bucket = F.pmod(F.xxhash64(F.lit("bucket"), "_key"), F.lit(buckets)).cast("int")
    size, most = F.sum(F.col("_bytes") + 64), HEAVY * bucket_bytes
    found = d.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), size.alias("size")).collect()
    if any(r["size"] > most and r["n"] > 1 for r in found) and \
            not d.groupBy("_key").agg(F.count("*").alias("n"), size.alias("size")) \
                .where((F.col("n") > 1) & (F.col("size") > most)).isEmpty():
        d = _numbered(d, seed)
        found = d.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()
    counts = {r["b"]: r["n"] for r in found}
    begin = np.concatenate([[0], np.cumsum([counts.get(b, 0) for b in range(buckets)])]).astype(np.int64)
    sent = spark.sparkContext.broadcast(begin)
    total = int(begin[-1])
    # a partition takes many buckets one after the other, which evens out how they fall
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(sizes["b"] or 0) // PARTITION_BYTES))
    dealt = d.select("row", "_key", bucket.alias("_bucket")).repartition(int(min(parts, buckets)), "_bucket") \
        .sortWithinPartitions("_bucket", "_key", F.xxhash64("row"))  # rows equal so far differ in other columns, or not at all
    out = T.StructType([*dealt.select("row").schema.fields, T.StructField("shard", T.IntegerType()),
                        T.StructField("slot", T.LongType())])
    first = [-(-s * total // shards) for s in range(shards + 1)]  # shard s begins at the first p with p * S // N = s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(b: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            at = sent.value[b] + np.arange(t.num_rows)
            order = fisher_yates(t.num_rows, np.random.default_rng([seed, b]))
            shard = at * shards // total
            slot = at - np.array(first)[shard]
            for lo in range(0, t.num_rows, 4096):
                yield from pa.table({"row": t.column("row").take(order[lo:lo + 4096]),
                                     "shard": pa.array(shard[lo:lo + 4096], pa.int32()),
                                     "slot": pa.array(slot[lo:lo + 4096], pa.int64())}).combine_chunks().to_batches()

        now, held = None, []
        for batch in batches:
            b = batch.column("_bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if held and b[lo] != now:
                        yield from close(now, held)
                        held = []
                    now = int(b[lo])
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield from close(now, held)

    dealt.mapInArrow(run, out).write.parquet(folder)
    return spark.read.schema(out).parquet(folder)


def op10_external_shuffle(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = shuffle_to_shards(docs, new_folder(spark, "shards"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return back.select(F.col("row.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))
