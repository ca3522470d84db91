import pytest

from tagwarden.sources import tables as A
from tests.conftest import rows

# Smoke-table fixtures: three students, three courses.
STUDENTS = [(1, "Alice", 18), (2, "Bob", 19), (3, "Cindy", 20)]
STUDENT_SCHEMA = "student_id INT, student_name STRING, age INT"
COURSES = [(101, "Workflow Basics", "Dana"), (102, "SQL Intro", "Alice"), (103, "DataFrame Practice", "Bob")]
COURSE_SCHEMA = "course_id INT, course_name STRING, instructor STRING"


def test_ensure_reload_twice_count_ordered(spark):
    A.ensure_table(spark, "students", STUDENT_SCHEMA, schema_name="default")
    A.ensure_table(spark, "students", STUDENT_SCHEMA, schema_name="default")  # no-op when present
    src = A.literal_rows(spark, list(reversed(STUDENTS)), STUDENT_SCHEMA)
    A.reload_rows(spark, "students", src, schema_name="default")
    A.reload_rows(spark, "students", src, schema_name="default")  # twice = once
    assert A.row_count(spark, "students", "default").first()["cnt"] == 3
    got = [tuple(r) for r in A.ordered_select(spark, "students", ["student_id", "student_name", "age"],
                                              ["student_id"], "default").collect()]
    assert got == STUDENTS
    assert A.preview(spark.table("default.students"), 2).count() == 2


def test_reload_from_itself_cuts_lineage(spark):
    A.ensure_table(spark, "courses", COURSE_SCHEMA, schema_name="default")
    A.reload_rows(spark, "courses", A.literal_rows(spark, COURSES, COURSE_SCHEMA), "default")
    A.reload_rows(spark, "courses", spark.table("default.courses").where("course_id > 101"), "default")
    assert rows(spark.table("default.courses"), "course_id") == [(102,), (103,)]


def test_table_job_and_smoke(spark):
    with pytest.raises(ValueError):
        A.table_job(spark, "drop", "courses", COURSE_SCHEMA)
    rep = A.smoke(spark, "courses2", COURSE_SCHEMA, A.literal_rows(spark, COURSES, COURSE_SCHEMA),
                  key=["course_id"], schema_name="default")
    assert [tuple(r) for r in rep.collect()] == [("create", True, None), ("insert", True, 3), ("count", True, 3),
                                                 ("query", True, 3)]
    wrong = A.literal_rows(spark, [(1, "x")], "a int, b string")
    bad = A.smoke(spark, "courses3", COURSE_SCHEMA, wrong, schema_name="default", fail=False)
    assert [tuple(r)[:2] for r in bad.collect()] == [("create", True), ("insert", False)]
    with pytest.raises(RuntimeError) as e:
        A.smoke(spark, "courses3", COURSE_SCHEMA, wrong, schema_name="default")
    assert e.value.__cause__ is not None


def test_failed_reload_leaves_the_old_rows(spark):
    from pyspark.sql import functions as F

    A.ensure_table(spark, "kept_rows", "a INT", schema_name="default")
    A.reload_rows(spark, "kept_rows", spark.range(2).select(F.col("id").cast("int").alias("a")), "default")
    bad = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).cast("int").alias("a"))
    with pytest.raises(Exception, match="boom"):
        A.reload_rows(spark, "kept_rows", bad, "default")
    assert rows(spark.table("default.kept_rows")) == [(0,), (1,)]


def test_table_without_catalog_entry_finds_its_newest_rows(spark, tmp_path):
    for n in (1, 3):
        A.ensure_table(spark, "lost_entry", "id BIGINT", "default", f"{tmp_path}/t")
        A.reload_rows(spark, "lost_entry", spark.range(n), "default")
    spark.sql("DROP TABLE default.lost_entry")
    A.ensure_table(spark, "lost_entry", "id BIGINT", "default", f"{tmp_path}/t")
    assert spark.table("default.lost_entry").count() == 3
