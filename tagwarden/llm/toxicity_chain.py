"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models over the words and marks a text
holds; each model also gets the probabilities of the categories before it. What a model is trained
with are out-of-fold probabilities: for every earlier category, ``FOLDS`` models, each scoring the
documents it has not seen - so a later model learns how far an earlier one can be trusted on new
texts. Features are selected per model (chi-square) within its own training rows, and each
category's threshold is the best F1 of its out-of-fold probabilities.

Training uses at most ``TRAIN_DOCS`` labelled documents, drawn by a hash of the id (a documented
sample); every text is scored whole. The model sent to the executors is ``CELLS`` weights a category.

Nulls and odd inputs: a null or empty text is scored by the intercepts; a category without labels, or
with one value only, gets its smoothed rate and (below one half) no positive; labels repeated
for an id count as positive if any is; a null label is left out of that category's training; of the
texts that share an id, the one with the smallest hash is trained with, and all are scored; very long texts are scored whole;
of equal chi-squares the smaller cell is selected, of equal F1 the stricter cut; repeated rows are scored alike; an empty table gives no
rows; columns other than the text pass through, and the query reads id and text only, so none can clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwarden.llm.common import table

CELLS, TRAIN_DOCS, FOLDS, SELECTED, L2 = 1 << 20, 8_000, 4, 1_024, 1.0
KEPT_TOKENS = 500_000
_TOKEN = regex.compile(r"[^\W\d_]+|[^\w\s]").findall


class _Cells(dict):
    """Token -> cell, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > KEPT_TOKENS:
            self.clear()
        self[token] = c = zlib.crc32(token.encode("utf-8", "surrogatepass")) & (CELLS - 1)
        return c


_CELLS = _Cells()


def cells(text: str | None) -> np.ndarray:
    """The distinct cells of a text's lower-cased words and marks."""
    found = set(map(_CELLS.__getitem__, set(_TOKEN((text or "").lower()))))
    return np.fromiter(found, np.int32, len(found))


@dataclass
class Linear:
    """One link of the chain: cell weights, weights of earlier probabilities, intercept."""

    cell: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    earlier: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    threshold: float = 0.5


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _solve(x: np.ndarray, y: np.ndarray, l2: float) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each solved by conjugate gradients; the last column is the intercept."""
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-4
    w = np.zeros(x.shape[1])
    kind, square = x.dtype, x * x
    mul = lambda v: (x @ v.astype(kind)).astype(float)  # noqa: E731  no copy of x in another precision
    back = lambda v, m=x: (m.T @ v.astype(kind)).astype(float)
    for _ in range(25):
        p = _sigmoid(mul(w))
        grad = back(p - y) + ridge * w
        if np.abs(grad).max() < 1e-3 * max(1.0, len(y) / 1000):
            break
        s = p * (1 - p) + 1e-9
        scale = 1 / (back(s, square) + ridge)
        step, r = np.zeros_like(w), grad.copy()
        d = scale * r
        rz = r @ d
        stop = 1e-2 * np.sqrt(r @ r)
        for _ in range(40):
            hd = back(s * mul(d)) + ridge * d
            a = rz / (d @ hd)
            step += a * d
            r -= a * hd
            if np.sqrt(r @ r) < stop:
                break
            z = scale * r
            rz, old = r @ z, rz
            d = z + rz / old * d
        value = lambda v: np.logaddexp(0, mul(v)).sum() - y @ mul(v) + 0.5 * (ridge * v * v).sum()
        now, t = value(w), 1.0
        while t > 1e-4 and value(w - t * step) > now - 1e-4 * t * (grad @ step):
            t /= 2
        w = w - t * step
    return w


def _matrix(docs: list[np.ndarray], chosen: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """``[document, chosen cells | earlier probabilities | 1]``."""
    x = np.zeros((len(docs), len(chosen) + earlier.shape[1] + 1), np.float32)
    if len(chosen) and len(docs):
        flat = np.concatenate(docs)
        row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        at = np.searchsorted(chosen, flat)
        at[at == len(chosen)] = 0
        hit = chosen[at] == flat
        x[row[hit], at[hit]] = 1
    x[:, len(chosen):-1] = earlier
    x[:, -1] = 1
    return x


def _select(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The cells in at least three documents with the largest chi-square against the label, sorted."""
    if not docs:
        return np.zeros(0, np.int64)
    flat = np.concatenate(docs).astype(np.int64)
    row_y = np.repeat(y, [len(d) for d in docs])
    n = np.bincount(flat, minlength=CELLS).astype(float)
    pos = np.bincount(flat, weights=row_y, minlength=CELLS)
    rate, total = y.mean(), len(y)
    seen = np.flatnonzero((n >= 3) & (n < total))
    dev = pos[seen] - n[seen] * rate
    chi = dev * dev / (n[seen] * (1 - n[seen] / total) * max(rate * (1 - rate), 1e-9))
    best = np.argsort(-chi, kind="stable")[:SELECTED]
    return np.sort(seen[best])


def _fit(docs: list[np.ndarray], y: np.ndarray, earlier: np.ndarray) -> Linear:
    k = earlier.shape[1]
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        return Linear(earlier=np.zeros(k), intercept=float(np.log(rate / (1 - rate))))
    chosen = _select(docs, y)
    w = _solve(_matrix(docs, chosen, earlier).astype(np.float32), y, L2)
    return Linear(chosen.astype(np.int32), w[:len(chosen)].astype(np.float32), w[len(chosen):-1], float(w[-1]))


def _predict(m: Linear, docs: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
    w = np.concatenate([m.weight, m.earlier, [m.intercept]])
    return _sigmoid(_matrix(docs, m.cell.astype(np.int64), earlier) @ w)


def train_chain(docs: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> tuple[list[Linear], np.ndarray]:
    """``(models, out-of-fold probabilities)`` for ``labels[document, category]`` (nan: unknown)."""
    n, k = labels.shape
    oof = np.zeros((n, k))
    chain = []
    for c in range(k):
        known = ~np.isnan(labels[:, c])
        earlier = oof[:, :c]
        for f in range(FOLDS):
            use, hold = np.flatnonzero(known & (folds != f)), np.flatnonzero(folds == f)
            m = _fit([docs[i] for i in use], labels[use, c], earlier[use])
            oof[hold, c] = _predict(m, [docs[i] for i in hold], earlier[hold])
        use = np.flatnonzero(known)
        m = _fit([docs[i] for i in use], labels[use, c], earlier[use])
        m.threshold = _threshold(oof[use, c], labels[use, c])
        chain.append(m)
    return chain, oof


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 (of equal ones the middle of the widest gap is taken); one half without positives."""
    if len(y) == 0 or y.sum() == 0 or y.sum() == len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    tp = np.cumsum(y[order])
    f1 = 2 * tp / (np.arange(1, len(y) + 1) + y.sum())
    i = int(f1.argmax())
    lower = p[order[i + 1]] if i + 1 < len(y) else 0.0
    return float(np.clip((p[order[i]] + lower) / 2, 0.05, 0.95))


def learn(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, Column]], id_col: str = "doc_id",
          text: str = "text", train_docs: int = TRAIN_DOCS) -> list[Linear]:
    """The chain for ``categories``: (name, 0/1 column over ``labels``), in order."""
    names = [f"c{i}" for i in range(len(categories))]
    lab = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        *[F.max(col.cast("double")).alias(n) for n, (_, col) in zip(names, categories)])
    # a bounded sample of label rows, so the join below broadcasts at most train_docs of them
    pick = lab.orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id").limit(train_docs)
    # one text an id, however many rows repeat it: a partial aggregation, so a map task sends one row an id
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
            .join(F.broadcast(pick), "doc_id").groupBy("doc_id", *names)
            .agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one"))
            .select("doc_id", F.col("one.text").alias("text"), *names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [cells(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()),
                                              "cells": pa.array(got, pa.list_(pa.int32())),
                                              **{n: b.column(n) for n in names}})

    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cells", T.ArrayType(T.IntegerType())),
                        *[T.StructField(n, T.DoubleType()) for n in names]])
    got = rows.mapInArrow(run, out).toArrow().sort_by("doc_id").to_pydict()  # at most train_docs rows
    ids = np.array(got["doc_id"], np.int64)
    folds = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in ids.tolist()], np.int64)
    y = np.array([[np.nan if v is None else v for v in got[n]] for n in names], float).T.reshape(len(ids), len(names))
    return train_chain([np.array(c, np.int32) for c in got["cells"]], y, folds)[0]


def score(df: DataFrame, chain: list[Linear], names: Sequence[str], text: str = "text") -> DataFrame:
    """The columns of ``df`` without ``text`` plus ``<name>_score`` and boolean ``<name>`` per category.

    Narrow: one pass in Arrow batches with the chain as a broadcast (``CELLS`` floats a category).
    """
    dense = np.zeros((CELLS, len(chain)), np.float32)
    for k, m in enumerate(chain):
        dense[m.cell, k] = m.weight
    sent = df.sparkSession.sparkContext.broadcast(
        (dense, [m.earlier for m in chain], [m.intercept for m in chain], [m.threshold for m in chain]))
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, earlier, intercept, cut = sent.value
        for b in batches:
            z = np.array([w[cells(t)].sum(0, dtype=np.float64) for t in b.column(text).to_pylist()]).reshape(-1, w.shape[1])
            p = np.zeros_like(z)
            for k in range(z.shape[1]):
                p[:, k] = _sigmoid(z[:, k] + p[:, :k] @ earlier[k] + intercept[k])
            cols = {c: b.column(c) for c in keep}
            for k, n in enumerate(names):
                cols |= {f"{n}_score": pa.array(p[:, k]), n: pa.array(p[:, k] >= cut[k])}
            yield pa.RecordBatch.from_pydict(cols)

    schema = T.StructType([*df.drop(text).schema.fields, *[x for n in names for x in (
        T.StructField(f"{n}_score", T.DoubleType()), T.StructField(n, T.BooleanType()))]])
    return df.mapInArrow(run, schema)


#: The labelled categories, in chain order: a text's quality first, then its toxicity.
CATEGORIES = (("low_quality", lambda: 1 - F.col("quality")), ("toxic", lambda: F.col("toxic")))


def op3_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = learn(docs, table(spark, sf_dir, "labels"), [(n, c()) for n, c in CATEGORIES])
    return score(docs, chain, [n for n, _ in CATEGORIES])
