"""Family A: managed Parquet tables - ensure, reload, count, ordered read, smoke check.

Table names are catalog identifiers bound through ``IDENTIFIER(:t)`` (no string-built
SQL for names). A reload writes a new version folder and then moves the table's location to it,
so a failed reload leaves the old rows and readers never see a half-written table.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ACTIONS = ("create", "insert", "query")


def qualify(name: str, schema: str | None = None) -> str:
    """Unqualified names resolve in ``schema`` when given (A9); the session is not switched."""
    return name if schema is None or "." in name else f"{schema}.{name}"


def _ddl(schema: StructType | str) -> str:
    if isinstance(schema, str):
        return schema
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _sql_string(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ensure_table(spark: SparkSession, name: str, schema: StructType | str, schema_name: str | None = None,
                 location: str | None = None, bucketed: tuple[Sequence[str], int] | None = None) -> None:
    """Create a Parquet table with a declared schema if absent; keep it (and its data) if present (A1).

    ``bucketed`` (columns, number) has its rows kept in that many buckets, sorted; joins on those columns between
    tables bucketed alike need no shuffle. ``location`` makes the table point at a folder of the shared warehouse, so a table
    whose catalog entry is gone (a session catalog) finds its files again.
    """
    if location:
        location = _newest_version(spark, location) or location
    loc = f" LOCATION {_sql_string(location)}" if location else ""
    by = ", ".join(f"`{c}`" for c in bucketed[0]) if bucketed else ""
    into = f" CLUSTERED BY ({by}) SORTED BY ({by}) INTO {int(bucketed[1])} BUCKETS" if bucketed else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS IDENTIFIER(:t) ({_ddl(schema)}) USING PARQUET{into}{loc}",
              args={"t": qualify(name, schema_name)})


VERSION = "version-"
KEPT_VERSIONS = 2  # the current one, and the one that readers may still hold


def _newest_version(spark: SparkSession, base: str) -> str | None:
    """The last completely written version folder under ``base``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith(VERSION)
            and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return max((p.toString() for p in done), default=None)


def table_location(spark: SparkSession, name: str, schema_name: str | None = None) -> str:
    rows = spark.sql("DESCRIBE TABLE EXTENDED IDENTIFIER(:t)", args={"t": qualify(name, schema_name)}).collect()
    return next(r["data_type"] for r in rows if r["col_name"] == "Location")


def bucketing(spark: SparkSession, name: str, schema_name: str | None = None) -> tuple[list[str], int] | None:
    """``(columns, number)`` of a bucketed table."""
    rows = spark.sql("DESCRIBE TABLE EXTENDED IDENTIFIER(:t)", args={"t": qualify(name, schema_name)}).collect()
    said = {r["col_name"]: r["data_type"] for r in rows}
    if "Num Buckets" not in said:
        return None
    return [c.strip().strip("`") for c in said["Bucket Columns"].strip("[]").split(",")], int(said["Num Buckets"])


def remove_superseded(spark: SparkSession, name: str, schema_name: str | None = None, keep: int = KEPT_VERSIONS) -> int:
    """Deletes the table's version folders but the newest ``keep`` and the current one; returns how many went."""
    base, _, last = table_location(spark, name, schema_name).rstrip("/").rpartition("/")
    if not last.startswith(VERSION):
        return 0
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    old = sorted((f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith(VERSION)), key=lambda p: p.getName())
    old = [p for p in old[:-keep or None] if p.getName() != last]
    return sum(bool(fs.delete(p, True)) for p in old)


def reload_rows(spark: SparkSession, name: str, df: DataFrame, schema_name: str | None = None) -> None:
    """Replace the table's rows with ``df`` (A2): running twice leaves the rows once.

    Columns are matched by name and cast to the table's types. The rows are written to a new version folder
    beside the current one; only when that write has committed does the table's location move there. ``df`` may read the
    table itself. The version before stays (readers may still hold it); older ones are deleted. The rows of a bucketed table are
    written in its buckets, one file each.
    """
    fq = qualify(name, schema_name)
    fields = spark.table(fq).schema.fields
    src = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])
    base, _, last = table_location(spark, name, schema_name).rstrip("/").rpartition("/")
    if not last.startswith(VERSION):
        base = f"{base}/{last}"
    target = f"{base}/{VERSION}{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    buckets = bucketing(spark, name, schema_name)
    if buckets is not None:
        src = src.repartition(buckets[1], *[F.col(f"`{c}`") for c in buckets[0]])
    if buckets is None:
        src.write.parquet(target)
    else:  # only a table can be written in buckets: one of the moment over the same folder
        by, n = buckets
        moment = qualify(f"tw_moment_{uuid.uuid4().hex}", schema_name)
        src.write.format("parquet").bucketBy(n, *by).sortBy(*by).option("path", target).saveAsTable(moment)
        spark.sql("DROP TABLE IDENTIFIER(:t)", args={"t": moment})  # the files stay
    spark.sql(f"ALTER TABLE IDENTIFIER(:t) SET LOCATION {_sql_string(target)}", args={"t": fq})
    spark.catalog.refreshTable(fq)
    remove_superseded(spark, name, schema_name)


def row_count(spark: SparkSession, name: str, schema_name: str | None = None) -> DataFrame:
    """``cnt`` of the table (A3)."""
    return spark.table(qualify(name, schema_name)).agg(F.count(F.lit(1)).alias("cnt"))


def ordered_select(spark: SparkSession, name: str, cols: Sequence[str], order_by: Sequence[str | Column],
                   schema_name: str | None = None) -> DataFrame:
    """Named columns, ascending by key (nulls first) (A4). The sort is the final sink's."""
    return spark.table(qualify(name, schema_name)).select(*cols).orderBy(*order_by)


def ordered_rank(spark: SparkSession, name: str, cols: Sequence[str], order_by: Sequence[str], schema_name: str | None = None,
                 pos: str = "pos") -> DataFrame:
    """Named columns with each row's place (from 1) in the order of A4, which a table, having no order, keeps."""
    from tagwarden.plans.ranks import with_positions

    return with_positions(spark.table(qualify(name, schema_name)).select(*cols), order_by, pos)


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    """Typed rows from a VALUES-style list (A5)."""
    return spark.createDataFrame(list(rows), schema)


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rows, all columns (A6); show it with ``truncate=False``."""
    return df.limit(n)


def table_job(spark: SparkSession, action: str, name: str, schema: StructType | str, rows: DataFrame | None = None,
              key: Sequence[str] = (), schema_name: str | None = None, location: str | None = None):
    """One step of the table job (A7): ``create`` ensures, ``insert`` reloads and returns the
    count, ``query`` returns the ordered read. Any other action is rejected."""
    if action not in ACTIONS:
        raise ValueError(f"unsupported action {action!r}; expected one of {ACTIONS}")
    if action == "create":
        ensure_table(spark, name, schema, schema_name, location)
        return None
    if action == "insert":
        if rows is None:
            raise ValueError("insert needs rows")
        reload_rows(spark, name, rows, schema_name)
        return row_count(spark, name, schema_name)
    cols = spark.table(qualify(name, schema_name)).columns
    return ordered_select(spark, name, cols, list(key) or cols[:1], schema_name)


def smoke(spark: SparkSession, name: str, schema: StructType | str, rows: DataFrame, key: Sequence[str] = (),
          schema_name: str | None = None, location: str | None = None, fail: bool = True) -> DataFrame:
    """create -> reload -> count -> ordered read, as a report ``(step, ok, rows)``.

    Stops at the first failing step and raises, with the steps so far in the message and the cause
    attached. ``fail=False`` gives the report instead, the failed step with ``ok = false``. The ordered
    read is carried out, sort included.
    """
    report: list[tuple[str, bool, int | None]] = []

    def ordered() -> int:
        table_job(spark, "query", name, schema, key=key, schema_name=schema_name).write.format("noop").mode("overwrite").save()
        return row_count(spark, name, schema_name).first()["cnt"]

    steps = (
        ("create", lambda: table_job(spark, "create", name, schema, schema_name=schema_name, location=location)),
        ("insert", lambda: table_job(spark, "insert", name, schema, rows, schema_name=schema_name).first()["cnt"]),
        ("count", lambda: row_count(spark, name, schema_name).first()["cnt"]),
        ("query", ordered),
    )
    for step, fn in steps:
        try:
            out = fn()
        except Exception as cause:
            report.append((step, False, None))
            if fail:
                raise RuntimeError(f"table smoke check failed for {qualify(name, schema_name)}: {report}") from cause
            break
        report.append((step, True, out if isinstance(out, int) else None))
    return spark.createDataFrame(report, "step string, ok boolean, rows bigint")


def warehouse_location(spark: SparkSession, name: str) -> str:
    """A folder for ``name`` under the session's (shared) warehouse directory."""
    conf = spark.sparkContext.getConf()
    wh = conf.get("spark.sql.warehouse.dir", None)
    if not wh:
        if not conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.sql.warehouse.dir is not set; configure a shared warehouse folder")
        wh = spark.conf.get("spark.sql.warehouse.dir")  # a plain local session: Spark's own default
    wh = wh.rstrip("/")
    return f"{wh}/tagwarden/{name}"
