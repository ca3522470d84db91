"""Packing by optimal length buckets.

Texts are measured in tokens and cut into pieces of at most ``MAX_TOKENS`` (every token is in one
piece). A dynamic program over the global length histogram, which ``MAX_TOKENS`` bounds, chooses
the ``BUCKETS`` boundaries with the least padding: a piece is padded to the smallest boundary
that holds it. Within a bucket, batches of a fixed token budget are filled in the order of
(block of pieces, doc_id, piece, length), so a batch's padded size never passes the budget.

A piece's place in its bucket is its position in one global order (range partitions, their counts, offsets), less the
pieces of the buckets before, which the histogram knows. No task sees a bucket, and neither a bucket nor an id of a third of
all rows fills one: rows equal in the whole order still spread over the ranges.

A token of the registered query is a word, so that SQL can say the same. The pipeline stage packs byte-level BPE tokens and
returns their padded ids.

Equal minimal paddings: the earlier boundary is the smaller one. Nulls and odd inputs: a null
text, or one without tokens, is one piece of length 0; null ids come first; repeated rows are
packed each, and rows of one id in the order of their lengths, so the same table gives the same places in any partitioning;
very long texts become many pieces; an empty table gives no rows; only id and text are read, so no input column can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwarden.llm.bpe_matrix import codec, rank_file
from tagwarden.llm.common import new_folder, shared_folder, table, written
from tagwarden.llm.quality_rules import SPACE, TRIM
from tagwarden.plans.ranks import with_positions

MAX_TOKENS, BUCKETS, BUDGET = 2_048, 16, 65_536
PIECE_BLOCK = 1_024  # pieces of one document that stand together
RANKS, PAD = "byte_bpe_multi_50k.tiktoken", 50_256  # the pipeline's tokenizer, and an id that it leaves free


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """At most ``buckets`` boundaries (the last one the largest length) with the least total padding."""
    if not lengths:
        return []
    order = np.argsort(lengths)
    x, n = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    size = len(x)
    cum, cum_len = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    huge = np.iinfo(np.int64).max // 4
    cost = np.concatenate([[0], np.full(size, huge)])  # no bucket yet: only the empty prefix
    back = []
    for _ in range(min(buckets, size)):
        new, from_ = np.full(size + 1, huge), np.zeros(size + 1, np.int64)
        for j in range(1, size + 1):
            v = cost[:j] + x[j - 1] * (cum[j] - cum[:j]) - (cum_len[j] - cum_len[:j])
            from_[j] = v.argmin()
            new[j] = min(v[from_[j]], huge)
        cost = new
        back.append(from_)
    out, j = [], size
    for from_ in reversed(back):
        out.append(int(x[j - 1]))
        j = int(from_[j])
    return out[::-1]


def word_count(text: str = "text"):
    t = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(TRIM))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE))).cast("long")


def pack(lengths: DataFrame, id_col: str = "doc_id", length: str = "length", max_tokens: int = MAX_TOKENS,
         buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``(doc_id, piece, first_token, n_tokens, bucket, bucket_tokens, batch, slot, padding)`` for
    every piece of every row ``(id, length)``. ``batch`` and ``slot`` count from 0 within the bucket."""
    n = F.col(length)
    last = F.greatest(F.ceil(n / max_tokens) - 1, F.lit(0)).cast("int")
    d = lengths.select(F.col(id_col).alias("doc_id"), n.alias("_n"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece").cast("long") * max_tokens
    return place(d.select("doc_id", "piece", first.alias("first_token"),
                          F.least(F.lit(max_tokens), F.col("_n") - first).cast("int").alias("n_tokens")), buckets, budget)


def place(pieces: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``pieces (doc_id, piece, first_token, n_tokens, ...)`` with their bucket, batch, slot and padding."""
    hist = {r["n_tokens"]: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}  # one row a length
    ends = boundaries(list(hist), list(hist.values()), buckets) or [0]
    size = [sum(c for k, c in hist.items() if (lo is None or k > lo) and k <= hi) for lo, hi in zip([None, *ends], ends)]
    before = [sum(size[:b]) for b in range(len(ends))]
    bucket = sum((F.col("n_tokens") > b).cast("int") for b in ends[:-1]) if len(ends) > 1 else F.lit(0)
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bucket") + 1)
    d = pieces.withColumn("bucket", bucket).withColumn("bucket_tokens", of(ends))
    order = ["bucket", F.floor(F.col("piece") / PIECE_BLOCK), "doc_id", "piece", "n_tokens"]
    d = with_positions(d, order, "_pos", new_folder(pieces.sparkSession, "packing"))
    rank = F.col("_pos") - 1 - of([F.lit(b).cast("long") for b in before])
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1))))
    more = [c for c in pieces.columns if c not in ("doc_id", "piece", "first_token", "n_tokens")]
    return d.select("doc_id", "piece", "first_token", "n_tokens", "bucket", "bucket_tokens",
                    F.floor(rank / rows).alias("batch"), (rank % rows).alias("slot"),
                    (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"), *more)


def token_pieces(docs: DataFrame, ranks: str = RANKS, id_col: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``(doc_id, piece, first_token, n_tokens, ids)``: the byte-level BPE ids of every whole text (null: none) in pieces, as bytes
    of 16-bit numbers where the vocabulary has no larger ones, else of 32-bit numbers. Workers look the rank file up by its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        c = codec(rank_file(ranks), public_tokenizers.PATTERN)
        kind = np.uint16 if len(c.ranks.tokens) <= 1 << 16 else np.int32
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            lo = size = 0
            for i in range(len(ids)):
                size += lengths[i]
                if size >= 1 << 20 or i == len(ids) - 1:  # about a megabyte of text at a time
                    got, starts = c.encode(texts.slice(lo, i + 1 - lo).to_pylist())
                    got = got.astype(kind)
                    rows = [(ids[lo + k], at // max_tokens, at, min(max_tokens, e - s - at), got[s + at:min(e, s + at + max_tokens)].tobytes())
                            for k, (s, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist()))
                            for at in range(0, max(1, e - s), max_tokens)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (
                        pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["doc_id", "piece", "first_token", "n_tokens", "ids"])
                    lo, size = i + 1, 0
        c.forget()  # the worker lives on

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, piece int, first_token long, n_tokens int, ids binary")


def padded(placed: DataFrame, pad: int = PAD, rows: int = 256) -> DataFrame:
    """``placed`` with ``ids`` as numbers, padded to the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                n, size = (part.column(c).to_numpy() for c in ("n_tokens", "bucket_tokens"))
                flat = np.full(int(size.sum()), pad, np.int32)
                starts = np.concatenate([[0], np.cumsum(size)])
                for at, k, ids in zip(starts.tolist(), n.tolist(), part.column("ids").to_pylist()):
                    flat[at:at + k] = np.frombuffer(ids, np.uint16 if len(ids) == 2 * k else np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "ids"), lists],
                                                 names=[*(c for c in part.schema.names if c != "ids"), "ids"])

    rest = [f for f in placed.schema.fields if f.name != "ids"]
    return placed.select(*[f.name for f in rest], "ids").mapInArrow(
        run, T.StructType([*rest, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def op1_length_buckets(spark, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    return pack(docs.select("doc_id", word_count().alias("length")).checkpoint())  # lengths only: each text is read once


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the padded token ids of every piece of every document, by bucket, batch and slot."""
    return padded(place(written(token_pieces(docs), "tokens")))


def oracle() -> str:
    """The same in SQL: one step of the dynamic program a CTE."""
    steps = "".join(f"""
, f{k} AS MATERIALIZED (
  SELECT j, m.c AS c, list_append(m.path, x) AS path FROM (
    SELECT b.j AS j, b.x AS x, arg_min({{'c': a.c + b.x * (b.n - coalesce(h.n, 0)) - (b.s - coalesce(h.s, 0)), 'path': a.path}},
      [a.c + b.x * (b.n - coalesce(h.n, 0)) - (b.s - coalesce(h.s, 0)), a.j]) AS m
    FROM f{k - 1} a JOIN h b ON a.j < b.j LEFT JOIN h ON h.j = a.j GROUP BY b.j, b.x))""" for k in range(1, BUCKETS + 1))
    every = " UNION ALL ".join(f"SELECT {k} AS k, * FROM f{k}" for k in range(1, BUCKETS + 1))
    return rf"""
WITH docs AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents)
, pieces AS (
  SELECT doc_id, CAST(p AS INTEGER) AS piece, CAST(p * {MAX_TOKENS} AS BIGINT) AS first_token,
         CAST(least({MAX_TOKENS}, n - p * {MAX_TOKENS}) AS INTEGER) AS n_tokens
  FROM (SELECT doc_id, n, unnest(range(0, greatest(CAST(ceil(n / {MAX_TOKENS}.0) AS BIGINT), 1))) AS p FROM docs))
, h AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY x) AS j, x, CAST(sum(c) OVER (ORDER BY x) AS BIGINT) AS n,
         CAST(sum(c * x) OVER (ORDER BY x) AS BIGINT) AS s
  FROM (SELECT CAST(n_tokens AS BIGINT) AS x, count(*) AS c FROM pieces GROUP BY 1))
, f0 AS (SELECT CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS c, CAST([] AS BIGINT[]) AS path){steps}
, best AS (
  SELECT path FROM ({every}) WHERE j = (SELECT max(j) FROM h) AND k = (SELECT least({BUCKETS}, max(j)) FROM h))
, put AS (
  SELECT p.*, CAST(len(list_filter(path[:-2], lambda b: p.n_tokens > b)) AS INTEGER) AS bucket, path FROM pieces p, best)
, ranked AS (
  SELECT *, CAST(path[bucket + 1] AS INTEGER) AS bucket_tokens,
         row_number() OVER (PARTITION BY bucket ORDER BY piece // {PIECE_BLOCK}, doc_id NULLS FIRST, piece, n_tokens) - 1 AS r FROM put)
SELECT doc_id, piece, first_token, n_tokens, bucket, bucket_tokens,
       CAST(r // greatest(1, {BUDGET} // greatest(bucket_tokens, 1)) AS BIGINT) AS batch,
       CAST(r % greatest(1, {BUDGET} // greatest(bucket_tokens, 1)) AS BIGINT) AS slot,
       CAST(bucket_tokens - n_tokens AS INTEGER) AS padding
FROM ranked"""
