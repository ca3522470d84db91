"""Language ID by mixture inference: each text is a mixture of the learned languages.

A language is a distribution over letter trigrams (with word ends), hashed into ``BUCKETS``
cells and smoothed. For one text, expectation-maximisation finds the proportions that make its
trigrams most likely under ``sum_l w_l p_l(gram)``. Which languages take part is chosen by
penalised likelihood (BIC: every language beyond the first costs ``ln(n_grams) / 2``): starting from
all of them, the lightest language is dropped as long as that does not lower the penalised
likelihood. The prediction is the heaviest language left; the score is its proportion times
its posterior against the other languages taken alone.

Training counts come from the ``TRAIN_DOCS`` labelled documents a language with the smallest hash of id and text
(a documented sample in which copies count once; everything else covers all rows). The model is
``BUCKETS * languages`` floats, whose size is checked before it is sent to the executors.

Nulls and odd inputs: a text that is null or has no letter is ``und`` with score 0, and so is every text when
nothing could be learned; equal proportions go to the alphabetically first language; a null
doc_id is never held out nor learned from; very long texts are read whole; repeated rows are predicted alike and learned
from once; an empty table gives no rows; input columns that could clash ride in one struct (pipeline) or are not read (query).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwarden.llm.common import nested, smallest_hashes, table

BUCKETS = 1 << 16
TRAIN_DOCS = 2_000
SMOOTHING = 0.05
EM_ROUNDS, EM_TOLERANCE = 60, 1e-4
CHUNK_CHARS = 1 << 20
MAX_MODEL_BYTES = 256 << 20
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """True for every code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``CHUNK_CHARS`` characters each (one text at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(cells, starts, has_letter)``: the trigram cells of all texts, one after the other.

    Letters are lower-cased, every run of other characters is one word end, and a trigram
    holds at least two letters of one text.
    """
    low = [(t or "").lower() for t in texts]
    buf = np.frombuffer("\0".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))  # each text's closing \0
    letter = _letters()[buf]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    keep[ends] = True
    code = np.where(letter, buf, 0)[keep]
    at = np.cumsum(keep)[ends]  # where each text ends among the kept
    if code.size < 3:
        return np.zeros(0, np.uint16), np.zeros(len(low) + 1, np.int64), np.zeros(len(low), bool)
    a, b, c = code[:-2], code[1:-1], code[2:]
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    good = (b != 0) & ((a != 0) | (c != 0))
    cells = (h >> np.uint32(16)).astype(np.uint16)[good]
    first = np.concatenate([[0], np.cumsum(good)])
    # a gram belongs to the text of its middle character
    starts = np.concatenate([[0], first[np.clip(at - 2, 0, good.size)]])
    n_letters = np.add.reduceat(letter.astype(np.int64), np.concatenate([[0], ends[:-1]]))
    return cells, starts, n_letters > 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
        for lo, hi in _chunks(texts):
            cells, starts, _ = grams(texts[lo:hi])
            for i in range(lo, hi):
                n = sums.setdefault(langs[i], np.zeros(BUCKETS, np.int64))
                n += np.bincount(cells[starts[i - lo]:starts[i - lo + 1]], minlength=BUCKETS)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()),
                                          "cell": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})


def learn(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """``(languages, p)`` from rows ``(doc_id, text, lang)``: ``p[cell, language]``, each column summing to 1."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    most = MAX_MODEL_BYTES // (4 * BUCKETS)
    sizes = rows.groupBy("lang").count().limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages: the model would not fit its broadcast limit")
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32)
    sample = smallest_hashes(rows.select("doc_id", "text", "lang"), "lang", ["doc_id", "text"], train_docs, "train")
    counts = (sample.select("text", "lang").mapInArrow(_count, "lang string, cell int, n long")
              .groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas())  # at most BUCKETS rows a language
    langs = sorted(counts["lang"].unique())
    p = np.full((BUCKETS, len(langs)), SMOOTHING)
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        p[own["cell"].to_numpy(), k] += own["n"].to_numpy()
    return langs, (p / p.sum(0)).astype(np.float32)


def em(p: np.ndarray, n: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log likelihood of ``n`` grams with probabilities ``p[gram, language]``."""
    total, pt = n.sum(), np.ascontiguousarray(p.T)
    for _ in range(EM_ROUNDS):
        new = w * (pt @ (n / (p @ w))) / total
        done = np.abs(new - w).max() < EM_TOLERANCE
        w = new
        if done:
            break
    w = w / w.sum()
    return w, float(n @ np.log(p @ w))


def infer(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(proportions, posterior of each language alone)`` for grams ``n`` under ``p``.

    No mixture is likelier than that of all languages; where even that one does not pay for
    a second language, the best language alone is the answer without any search.
    """
    k = p.shape[1]
    alone = n @ np.log(p)
    best = int(alone.argmax())
    posterior = np.exp(alone - alone[best])
    posterior /= posterior.sum()
    single = np.zeros(k)
    single[best] = 1.0
    price = 0.5 * np.log(max(n.sum(), 2.0))
    if k == 1:
        return single, posterior
    w, value = em(p, n, np.full(k, 1.0 / k))
    if value - alone[best] <= price:
        return single, posterior
    chosen = np.arange(k)
    while len(chosen) > 1:
        rest = np.delete(np.arange(len(chosen)), w.argmin())
        sub = chosen[rest]
        if len(sub) == 1:
            w2, value2 = np.ones(1), float(alone[sub[0]])
        else:
            w2, value2 = em(p[:, sub], n, (w[rest] + 1e-6) / (w[rest] + 1e-6).sum())
        if value2 + price < value:
            break
        chosen, w, value = sub, w2, value2
    if value - price * (len(chosen) - 1) < alone[best]:
        return single, posterior
    full = np.zeros(k)
    full[chosen] = w
    return full, posterior


def explained(p: np.ndarray, n: np.ndarray, w: np.ndarray) -> float:
    """The share of grams ``n`` that the mixture ``w`` accounts for beside a source to which all cells are alike."""
    two = np.stack([p @ w, np.full(len(p), 1.0 / BUCKETS)], axis=1)
    return float(em(two, n, np.full(2, 0.5))[0][0])


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", total: bool = False) -> DataFrame:
    """The columns of ``df`` without ``text`` plus ``lang_pred, score, mixture`` (proportions by language).

    ``total`` adds ``explained``: for a mixture how far its languages explain the text, else the score.
    Narrow: texts go through Arrow batches, memory holds one batch and the model.
    """
    langs, p = model
    sent = df.sparkSession.sparkContext.broadcast((langs, p))
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table_ = sent.value
        table_ = table_.astype(np.float64)
        for b in batches:
            texts = b.column(text).to_pylist()
            preds, scores, mixes = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            totals: dict[int, float] = {}
            for lo, hi in _chunks(texts) if names else ():
                cells, starts, has = grams(texts[lo:hi])
                for i in range(lo, hi):
                    if not has[i - lo]:
                        continue
                    own = np.sort(cells[starts[i - lo]:starts[i - lo + 1]])
                    if own.size:
                        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                        n = np.diff(np.append(at, own.size)).astype(np.float64)
                        w, post = infer(table_[own[at]], n)
                        if total and w.max() < 1:
                            totals[i] = explained(table_[own[at]], n, w)
                    else:  # single letters only: nothing tells the languages apart
                        w = post = np.full(len(names), 1.0 / len(names))
                    k = int(w.argmax())
                    # a language that wins only as a part of the mixture is as sure as its part is large
                    preds[i], scores[i] = names[k], float(w[k] * (post[k] if w[k] >= 1 else 1.0))
                    mixes[i] = [(names[j], float(w[j])) for j in np.flatnonzero(w > 0)]
            cols = {c: b.column(c) for c in keep}
            cols |= {"lang_pred": pa.array(preds, pa.string()), "score": pa.array(scores, pa.float64()),
                     "mixture": pa.array(mixes, pa.map_(pa.string(), pa.float64()))}
            if total:
                cols["explained"] = pa.array([totals.get(i, v) for i, v in enumerate(scores)], pa.float64())
            yield pa.RecordBatch.from_pydict(cols)

    full = T.StructType([*df.drop(text).schema.fields, T.StructField("lang_pred", T.StringType()),
                         T.StructField("score", T.DoubleType()),
                         T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))])
    return df.mapInArrow(run, full.add("explained", T.DoubleType()) if total else full)


def _fold(col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(3))


def _trained(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    return learn(docs.select("doc_id", "text", "lang").where(_fold() != 1))


def op2_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", F.coalesce(_fold() == 1, F.lit(False)).alias("held_out"), "text"),
                   _trained(docs))


MIN_SCORE = 0.5


def keep_known(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops documents without a recognisable language (``und``, or neither one language
    with a score of ``MIN_SCORE`` nor a mixture that explains that share of the text); the rest keep their columns.

    The model is learned from the stage's own input by the rule of ``op2_language_mixture``; where
    nothing could be learned, only documents without a letter go.
    """
    d, model = nested(docs, "text"), _trained(docs)
    if not model[0]:
        return d.where(F.col("text").rlike(r"\p{L}")).select("row.*")
    known = (F.col("score") >= MIN_SCORE) | (F.col("explained") >= MIN_SCORE)
    return predict(d, model, total=True).where((F.col("lang_pred") != UNKNOWN) & known).select("row.*")


__all__ = ["em", "explained", "grams", "infer", "keep_known", "learn", "op2_language_mixture", "predict"]
