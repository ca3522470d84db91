"""Positions in a global order without one task seeing all rows.

The rows are range-partitioned on the whole order, sorted and written; the counts of the written ranges (one
number a range, on the driver) give each range's first position. The written copy fixes the ranges, so a task that runs
again gives the same numbers. Rows equal in the whole order are kept apart by their place of reading, so a
value that a third of all rows share still spreads.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwarden.plans.broadcast import literal_lookup
from tagwarden.sources.tables import warehouse_location


def with_positions(df: DataFrame, order: Sequence[str | Column], name: str = "pos", folder: str | None = None) -> DataFrame:
    """``df`` with its rows' positions (from 1) in ``order``, as ``row_number()`` over all rows would give them.

    ``folder`` holds the written copy (by default a new one in the warehouse).
    """
    spark = df.sparkSession
    folder = folder or f"{warehouse_location(spark, 'ranks')}-{uuid.uuid4().hex}"
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("_tie", F.monotonically_increasing_id())
    d = d.repartitionByRange(n, *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    (d.withColumn("_range", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
     .write.parquet(folder))
    rows = spark.read.parquet(folder)
    sizes = sorted(tuple(r) for r in rows.groupBy("_range").agg(F.min("_row"), F.count("*")).collect())  # one row a range
    before, shifts = 0, []
    for part, first, count in sizes:
        shifts.append((part, before + 1 - first))
        before += count
    lookup = literal_lookup(spark, shifts, "_range int, _shift long")
    return rows.join(lookup, "_range").select(*[F.col(f"`{c}`") for c in df.columns],
                                              (F.col("_row") + F.col("_shift")).alias(name))
