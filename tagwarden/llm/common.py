"""Shared helpers: the shared scratch folder, written intermediate tables, nested rows."""

from __future__ import annotations

import contextlib
import itertools
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagwarden.session import checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a plain local session (tests), where nothing is configured, gets a folder of its
    own; a cluster session without one raises.
    """
    try:
        return checkpoint_dir(spark)
    except RuntimeError:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tagwarden-ckpt-"))
        return spark.sparkContext.getCheckpointDir()


_SCRATCH: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(folder)
    return folder


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Folders that ``new_folder`` names inside are deleted at the end, but those taken off the list that it yields. After an
    error they stay."""
    folders: list[str] = []
    _SCRATCH.append(folders)
    try:
        yield folders
    finally:
        _SCRATCH.remove(folders)
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def nested(df: DataFrame, text_col: str = "text", **more) -> DataFrame:
    """``(row, text, **more)``: the input row as one struct, so no input column can clash
    with an operator's own names. ``more`` are input columns (or expressions) kept beside it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text_col).alias("text"),
                     *[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in more.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def smallest_hashes(rows: DataFrame, group: str, by: list[str], k: int, seed: str) -> DataFrame:
    """At most ``k`` rows of every value of ``group``: of its rows that differ in ``by``, those with the smallest 63-bit hash of
    them. Rows equal in ``by`` count once, so a hot id or text adds one row. Written, with the columns of ``rows``.

    A share of the hash range that should hold ``4 * k`` different rows is read first, so a task sends a few rows only; where
    a group got fewer than ``k`` (its size was misjudged), its share grows until it has them or is the whole range. The result is the
    same for any share, and no group that has rows comes out empty.
    """
    cols = rows.columns
    d = rows.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by), 1))
    place = F.col("_h").cast("double") * F.lit(2.0 ** -63)  # in [0, 1]
    found = d.groupBy(group).agg(F.approx_count_distinct("_h", 0.02).alias("n")).collect()
    share = {r[group]: min(1.0, 4 * k / max(1, r["n"])) for r in found}
    w = Window.partitionBy(group).orderBy("_h")

    def of(values: dict, default) -> Column:
        out = F.lit(default)
        for value, x in values.items():
            out = F.when(F.col(group).eqNullSafe(F.lit(value)), F.lit(x)).otherwise(out)
        return out

    while True:
        near = written(d.where(place <= of(share, -1.0)).groupBy(group, "_h").agg(F.min(F.struct(*cols)).alias("row")), "sample")
        # the k-th hash of every group, from the hashes alone
        got = near.select(group, "_h").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k) \
            .groupBy(group).agg(F.max("_h").alias("last"), F.count("*").alias("n")).collect()
        n = {r[group]: r["n"] for r in got}
        short = [g for g, s in share.items() if s < 1 and n.get(g, 0) < k]
        if not short:
            return near.where(F.col("_h") <= of({r[group]: r["last"] for r in got}, -1)).select("row.*")
        share.update({g: min(1.0, 256 * share[g]) for g in short})


MAX_RANGES, PER_RANGE = 1 << 16, 16  # ranges at most, and sampled keys a range: a million numbers on the driver


def ranges(df: DataFrame, key: str, n: int, name: str, spread: Column | None = None) -> DataFrame:
    """``df`` plus an int column ``name``: about ``n`` ranges of the whole number ``key`` (never null) with about equal row
    counts, numbered upward.

    The borders come from a random sample of bounded size, collected from the scan's own tasks; only the balance
    depends on them. A key that fills several ranges gets as many of its own, in which its rows stand by the 64-bit
    hash ``spread``, upward; without ``spread`` it is one range.
    """
    n = max(1, min(n, MAX_RANGES))
    rows = df.count()
    share = min(1.0, PER_RANGE * n / max(1, rows))
    sample = sorted(r[0] for r in df.select(key).sample(share, 17).collect()) if n > 1 else []
    if not sample:
        return df.withColumn(name, F.lit(0))
    cuts = Counter(sample[len(sample) * i // n] for i in range(1, n))
    # borders upward; a key that is several borders has a stretch of its own, cut by the hash
    borders, parts = [-float("inf")], [1]
    for c in sorted(cuts):
        if float(c) > borders[-1]:
            borders.append(float(c))
            parts.append(1)
        if cuts[c] > 1 and spread is not None and abs(c) < 1 << 53:  # beyond that a double may stand for several keys
            parts[-1] = cuts[c]
            borders.append(float(c + 1))
            parts.append(1)
    stretch, at = f"{name}_stretch", f"{name}_as_double"
    d = Bucketizer(splits=[*borders, float("inf")], inputCol=at, outputCol=stretch, handleInvalid="keep") \
        .transform(df.withColumn(at, F.col(key).cast("double"))).drop(at)
    if max(parts) == 1:
        return d.withColumn(name, F.col(stretch).cast("int")).drop(stretch)
    starts = [0, *itertools.accumulate(parts)]
    lookup = df.sparkSession.createDataFrame([(float(i), starts[i], p) for i, p in enumerate(parts)],
                                             f"{stretch} double, _start int, _parts int")  # at most 2 * MAX_RANGES + 1 rows
    place = F.shiftrightunsigned(spread, 11).cast("double") * F.lit(2.0 ** -53)  # in [0, 1)
    own = F.when(F.col("_parts") > 1, F.floor(place * F.col("_parts"))).otherwise(F.lit(0)).cast("int")
    return d.join(F.broadcast(lookup), stretch).withColumn(name, F.col("_start") + own).drop(stretch, "_start", "_parts")
