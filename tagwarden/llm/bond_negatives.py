"""Hard negatives by a BOND scan: vectors stored by dimension, read in each anchor's own order.

The rows are dealt into blocks, and every block is written as one column per dimension with its least and
largest value. Anchors meet the blocks as a stated query set, by a shuffle: a task holds one block and streams the anchors
past it. For one anchor the block's dimensions are read in descending magnitude of the anchor's components, so the products
that matter come first. After every ``STRIDE`` dimensions a candidate's score lies between what it has and
the least and the most that the unread dimensions can add (from the columns' least and largest values); the candidate
bitmap keeps a row only while that range meets a window and could still be among the window's first rows. What is left after
the last dimension has its exact score.

Two scans: the first finds each anchor's best rows of its own label (its positives); each positive's score sets a
window ``[lower, upper]`` of scores, and the second scan finds each window's best rows of other labels. Each
block gives at most as many rows per anchor and window as are asked for; a window function merges them.

Skew: blocks are dealt evenly whatever the ids, labels or vectors are, and no key gathers rows but (anchor, window), with
a few rows a block. The work is anchors x rows x dimensions at worst, as the query set asks.

Nulls and odd inputs: rows with a null label or vector, or a null or non-finite component, take no part; a null id
is never an anchor of the query and sorts last in ties; a vector shorter than others counts as padded with zeros, an empty one as all zeros;
scaled components beyond +-``LIMIT`` are clipped to it, so scores are exact in 64 bits; ties go to the smaller id; repeated rows are rows of their
own (a repeated anchor gives its results once a row, and its copies are among its positives); an anchor without positives, or a window
without negatives, gives no rows; an empty table gives no rows; only the named columns are read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwarden.llm.common import table, written

BLOCK_ROWS, LEAST_ROWS = 1 << 15, 1 << 11  # a block's rows: at most, and at least where there are enough tasks
STRIDE = 8
LIMIT = 1 << 24  # products of 2**48, so 2**14 dimensions fit a score
POSITIVES, NEGATIVES = 5, 10
LOWER, UPPER = 30, 90  # per cent of the positive's score
VERTICAL = ("block int, dim int, least long, most long, column binary, ids array<long>, labels array<int>, "
            "anchors array<struct<at:int,vector:binary>>")
HEAD = -1  # the dim of a block's first row: ids, labels and anchors
LOW, HIGH = -(1 << 62), 1 << 62


# ---------------------------------------------------------------- blocks
def quantized(vectors: list, scale: int) -> np.ndarray:
    """Dimensions x rows: floor(scale * component), padded with zeros."""
    out = np.zeros((max(map(len, vectors), default=0), len(vectors)))
    for i, v in enumerate(vectors):
        out[:len(v), i] = v
    return np.clip(np.floor(out * scale), -LIMIT, LIMIT).astype(np.int32)


def vertical(rows: DataFrame, n_rows: int, scale: int) -> DataFrame:
    """``rows (id, label, vector, anchor)`` as a written vertical table: per block a head and one row per dimension."""
    spark = rows.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n_rows // BLOCK_ROWS), min(-(-n_rows // LEAST_ROWS), tasks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # one block: about BLOCK_ROWS rows
        if not held:
            return
        block = TaskContext.get().partitionId()
        ids, labels, vectors, anchors = (
            [x for b in held for x in b.column(c).to_pylist()] for c in ("id", "label", "vector", "anchor"))
        m = quantized(vectors, scale)
        queries = [{"at": i, "vector": np.ascontiguousarray(m[:, i]).tobytes()} for i, a in enumerate(anchors) if a]
        out = [dict(block=block, dim=HEAD, ids=ids, labels=labels, anchors=queries)]
        out += [dict(block=block, dim=d, least=int(c.min()), most=int(c.max()), column=c.tobytes()) for d, c in enumerate(m)]
        yield from pa.Table.from_pylist(out, schema=arrow).to_batches()

    arrow = pa.schema([("block", pa.int32()), ("dim", pa.int32()), ("least", pa.int64()), ("most", pa.int64()),
                       ("column", pa.binary()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())),
                       ("anchors", pa.list_(pa.struct([("at", pa.int32()), ("vector", pa.binary())])))])
    return written(rows.repartition(blocks).mapInArrow(run, VERTICAL), "vertical")


# ---------------------------------------------------------------- the scan of one block
def bond_scan(columns: np.ndarray, least: np.ndarray, most: np.ndarray, a: np.ndarray, rows: np.ndarray,
              windows: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the candidates ``rows``, those that can be among the ``k`` best of a window (least and largest score), with
    their exact scores. ``columns``: dimensions x rows; ``a``: the anchor."""
    order = np.argsort(-np.abs(a), kind="stable")[:np.count_nonzero(a)]
    low, high = np.minimum(a * least, a * most)[order], np.maximum(a * least, a * most)[order]
    rest_low = np.append(np.cumsum(low[::-1])[::-1], 0)  # what the dimensions from the j-th on can add
    rest_high = np.append(np.cumsum(high[::-1])[::-1], 0)
    score = np.zeros(len(rows), np.int64)
    for begin in range(0, len(order), STRIDE):
        end = min(begin + STRIDE, len(order))
        for d in order[begin:end]:
            score += a[d] * columns[d][rows]
        lo, hi = score + rest_low[end], score + rest_high[end]
        need = np.zeros(len(rows), bool)
        for w_low, w_high in windows:
            reach = (hi >= w_low) & (lo <= w_high)
            sure = lo[(lo >= w_low) & (hi <= w_high)]
            if len(sure) >= k:
                reach &= hi >= np.partition(sure, len(sure) - k)[len(sure) - k]
            need |= reach
        if not need.all():
            rows, score = rows[need], score[need]
            if not len(rows):
                break
    return rows, score


def first_of(score: np.ndarray, ids: np.ndarray, no_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: by score downward, then by id, nulls last."""
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return at[first_of(score[at], ids[at], no_id[at], k)] if len(at) < len(score) else np.lexsort((ids, no_id, -score))[:k]
    return np.lexsort((ids, no_id, -score))[:k]


def _scan(vert: DataFrame, anchors: DataFrame, k: int, share: tuple[int, int] | None = None) -> DataFrame:
    """Every anchor (``anchor, label, vector, scores``) past every block: per block and window at most ``k`` rows
    ``(anchor, nth, id, score)``. Without ``share`` the rows are those of the anchor's label, itself apart; with it those of
    other labels whose score is so many per cent (at least, at most) of the nth of ``scores``."""
    spark = vert.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = vert.where(F.col("dim") == HEAD).select("block")
    none = lambda kind: F.lit(None).cast(kind)
    own = vert.select("block", F.lit(0).alias("kind"), "dim", "least", "most", "column", "ids", "labels",
                      none("long").alias("anchor"), none("int").alias("label"), none("binary").alias("vector"),
                      none("array<long>").alias("scores"))
    # the query set against all blocks: the block numbers ride along as one short list
    numbers = blocks.agg(F.collect_list("block")).scalar()
    sent = anchors.select(F.explode(numbers).alias("block"), F.lit(1).alias("kind"), none("int").alias("dim"), none("long").alias("least"),
                          none("long").alias("most"), none("binary").alias("column"), none("array<long>").alias("ids"),
                          none("array<int>").alias("labels"), "anchor", "label", "vector", "scores")
    dealt = own.unionByName(sent).repartition(n, "block").sortWithinPartitions("block", "kind", "dim", "anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, columns = None, []
        ids = no_id = labels = least = most = matrix = None
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    if r["dim"] == HEAD:
                        block, columns, matrix = r["block"], [], None
                        no_id = np.array([i is None for i in r["ids"]])
                        ids = np.array([i or 0 for i in r["ids"]], np.int64)
                        labels = np.array(r["labels"], np.int32)
                    else:
                        columns.append((r["least"], r["most"], np.frombuffer(r["column"], np.int32)))
                    continue
                if matrix is None:
                    matrix = np.array([c for _, _, c in columns], np.int32).reshape(len(columns), len(ids))
                    least, most = (np.array([c[i] for c in columns], np.int64) for i in (0, 1))
                a = np.frombuffer(r["vector"], np.int32).astype(np.int64)
                a = np.pad(a, (0, max(0, len(least) - len(a))))[:len(least)]  # blocks may differ in width
                rows = np.flatnonzero(labels == r["label"] if share is None else labels != r["label"])
                if share is None and r["anchor"] >> 32 == block:
                    rows = rows[rows != r["anchor"] & 0xFFFFFFFF]
                windows = [(LOW, HIGH)] if share is None else [(-(-share[0] * s // 100), share[1] * s // 100) for s in r["scores"]]
                rows, score = bond_scan(matrix, least, most, a, rows, list(dict.fromkeys(windows)), k)
                for nth, (low, high) in enumerate(windows):
                    at = np.flatnonzero((score >= low) & (score <= high))
                    at = at[first_of(score[at], ids[rows[at]], no_id[rows[at]], k)]
                    out += [(r["anchor"], nth, None if no_id[i] else int(ids[i]), int(s)) for i, s in zip(rows[at], score[at])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor", "nth", "id", "score"])

    return dealt.mapInArrow(run, "anchor long, nth int, id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor", "nth").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, id_col: str, vector: str, label: Column, is_anchor: Column, scale: int = 256,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Scores are inner products of components scaled and rounded down. For each anchor its ``positives`` best rows of its
    label; for each of them the ``negatives`` best rows of other labels whose score is ``lower`` to ``upper`` per cent of the positive's.
    """
    spark = rows.sparkSession
    x = F.col(vector)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    d = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("int").alias("label"),
                    F.transform(x, lambda c: c.cast("double")).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
                    (x.isNotNull() & whole).alias("ok"))
    d = d.where("ok and label is not null").drop("ok")
    vert = vertical(d, rows.count(), scale)
    # an anchor is named by its block and its place in it, so repeated ids stay apart
    heads = vert.where(F.col("dim") == HEAD).select("block", "ids", "labels", F.explode("anchors").alias("a"))
    at = F.col("a.at") + 1
    anchors = heads.select((F.shiftleft(F.col("block").cast("long"), 32) + F.col("a.at")).alias("anchor"),
                           F.element_at("ids", at).alias("anchor_id"), F.element_at("labels", at).alias("label"),
                           F.col("a.vector").alias("vector"))
    best = _ranked(_scan(vert, anchors.withColumn("scores", F.lit(None).cast("array<long>")), positives), positives)
    per_anchor = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("pos"))
    chosen = written(anchors.join(per_anchor, "anchor").withColumn("scores", F.col("pos.score")), "positives")
    found = _ranked(_scan(vert, chosen, negatives, (lower, upper)), negatives)
    pos = chosen.select("anchor", "anchor_id", F.posexplode("pos").alias("nth", "p"))
    return found.join(pos, ["anchor", "nth"]).select(
        "anchor_id", F.col("p.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op11_bond_scan(spark, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    label = F.when(k % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, k % 100 == 0)


def oracle() -> str:
    return """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id AS id,
         CAST(list_sum(list_transform(list_zip(a.q, v.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS a, v WHERE a.vec_id % 100 = 0 AND v.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 10"""
