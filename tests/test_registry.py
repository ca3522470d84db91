"""Every registered query gives, on the smallest scale, exactly the rows of its SQL twin."""
import duckdb
import pytest

import __spark_entry__ as E
from tagwarden.plans.oracle import ORACLE
from tagwarden.plans.queries import QUERIES
from tools.oracle_check import TABLES, rows_of


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["entity_id", "status", "scope", "matched_tags"]
    assert df.count() > 0


def test_every_query_has_a_twin_and_is_registered():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_twin(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df, rel = QUERIES[name](spark, sf_dir), con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    want = rows_of(rel.columns, rel.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want and want


def test_building_a_query_reads_no_rows(spark, sf_dir):
    """Jobs that building starts read Parquet footers only (schema), apart from the table jobs, which write."""
    jobs = ("reload_twice", "ordered_read", "table_count", "table_smoke", "preview_20", "grant_sync", "log_files", "listing_files",
            "tail_files", "retention_files", "ordered_rank", "plan_rank", "teardown_rank", "access_bitmaps", "sync_counts")
    tracker = spark.sparkContext.statusTracker()
    for name, fn in QUERIES.items():
        if name in jobs:
            continue
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        fn(spark, sf_dir)
        stages = [s for j in tracker.getJobIdsForGroup(f"build-{name}") for s in tracker.getJobInfo(j).stageIds]
        assert all(tracker.getStageInfo(s).numTasks == 1 for s in stages if tracker.getStageInfo(s)), name
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
