"""The grant sync as a table job: desired and stored grants -> written diff -> written state.

All tables are bucketed on (scope, entity_id), so desired, state and diff meet without a shuffle; only what comes in
(the classification, the first extraction) is shuffled into the buckets, each computed once. Writing the
diff first gives the audit trail (the rows C4 renders), and the counts that the job reports are those of the written rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwarden.operators import grants as C
from tagwarden.sources import tables as A

DIFF_SCHEMA = "scope STRING, op STRING, entity_id STRING"
STATE_SCHEMA = "scope STRING, entity_id STRING"
KEYS = ("scope", "entity_id")


@dataclass
class SyncReport:
    added: int  # rows of the diff as written
    removed: int
    state: DataFrame  # (scope, entity_id) as stored afterwards
    pending: DataFrame  # what a second diff against that state still wants: none after a sync that worked


def sync_grants(spark: SparkSession, desired: DataFrame, existing: DataFrame | None, diff_table: str, state_table: str,
                schema_name: str | None = None, diff_location: str | None = None, state_location: str | None = None,
                desired_table: str | None = None, desired_location: str | None = None, buckets: int | None = None) -> SyncReport:
    """Diff ``desired`` against the stored state (C2), write the diff, apply it (C5), write the new state.

    ``existing`` (an extraction, C1) replaces the stored state first; with None the state that an earlier sync
    left is what the diff is made against. The added and removed counts are read from the written diff (one aggregate, no
    shuffle of its rows), not from an observation, whose metrics come as listener events that Spark may drop. If a write
    fails, the error is raised and there is no report.
    """
    desired_table = desired_table or f"{state_table}_desired"
    if desired_location is None and state_location is not None:
        desired_location = f"{state_location.rstrip('/')}_desired"
    by = (KEYS, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    A.ensure_table(spark, state_table, STATE_SCHEMA, schema_name, state_location, by)
    by = A.bucketing(spark, state_table, schema_name) or by  # the others follow the state that is there
    A.ensure_table(spark, diff_table, DIFF_SCHEMA, schema_name, diff_location, by)
    A.ensure_table(spark, desired_table, STATE_SCHEMA, schema_name, desired_location, by)
    table = lambda name: spark.table(A.qualify(name, schema_name))

    if existing is not None:
        A.reload_rows(spark, state_table, existing.select(*KEYS).distinct(), schema_name)
    A.reload_rows(spark, desired_table, desired.select(*KEYS).distinct(), schema_name)
    A.reload_rows(spark, diff_table, C.diff_stored(table(desired_table), table(state_table)), schema_name)
    seen = table(diff_table).agg(F.count_if(F.col("op") == "add").alias("added"),
                                 F.count_if(F.col("op") == "remove").alias("removed")).first()
    A.reload_rows(spark, state_table, C.apply_stored(table(state_table), table(diff_table)), schema_name)
    return SyncReport(int(seen["added"]), int(seen["removed"]), table(state_table).select(*KEYS),
                      C.diff_stored(table(desired_table), table(state_table)))


def run_grant_sync(spark: SparkSession, desired: DataFrame, existing: DataFrame | None, diff_table: str,
                   state_table: str, schema_name: str | None = None, diff_location: str | None = None,
                   state_location: str | None = None) -> DataFrame:
    """``sync_grants`` as rows: the written state with ``what = 'state'``, and one row per change that a second diff
    still wants (``what = 'add'`` or ``'remove'``) - none after a sync that worked."""
    done = sync_grants(spark, desired, existing, diff_table, state_table, schema_name, diff_location, state_location)
    return done.state.withColumn("what", F.lit("state")).unionByName(
        done.pending.select("scope", "entity_id", F.col("op").alias("what")))
