"""Broadcast only what has a proven size bound.

* Literal lookups (tag maps, scope -> role tables, templates, group maps) are built
  from Python lists by ``literal_lookup``: their size is known before Spark sees them,
  so they carry a broadcast hint from the start.
* A join keyed on a low-cardinality column (role, scope, group) must not shuffle the
  large side on that key - one role can hold a third of all rows. Its lookup side goes
  through ``broadcast_if_small``: the optimizer's size statistics of its plan (bytes, an upper
  estimate that starts no job) prove the bound, and beyond it the join is left to a shuffle
  join with AQE skew splitting.
* Joins on high-cardinality keys (entity, user, request) are left to the planner:
  Spark's size estimate and AQE's runtime statistics decide, with a shuffle join
  beyond ``spark.sql.(adaptive.)autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Bound, in estimated bytes, for lookup tables we are willing to ship to every executor.
DEFAULT_MAX_BROADCAST_BYTES = 32 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` (no job: files sizes, column pruning, literal rows)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def literal_lookup(spark: SparkSession, rows, schema: str, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """A literal table, hinted for broadcast when its values (counted here) are within the bound.

    The rows go in as an Arrow table, a local relation whose size the planner knows. The hint is set at the
    source; it holds through later projections and filters.
    """
    rows = [tuple(r) if isinstance(r, (tuple, list)) else (r,) for r in rows]
    names = StructType.fromDDL(schema).fieldNames()
    columns = dict(zip(names, zip(*rows)))
    df = spark.createDataFrame(pa.table({k: list(v) for k, v in columns.items()}) if rows else [], schema)
    size = sum(16 + len(str(v)) for row in rows for v in row)
    return F.broadcast(df) if size <= max_bytes else df


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint broadcast when the plan's estimated size is within ``max_bytes``; else leave the join to the planner."""
    return F.broadcast(df) if plan_bytes(df) <= max_bytes else df
