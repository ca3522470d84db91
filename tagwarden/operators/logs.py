"""Family E: run-log analytics (parse, tail, retention, outcome, auth failure, status).

Log lines look like ``[yyyy-MM-dd HH:mm:ss] [LEVEL] text`` (the level is optional);
daily files are named ``<script>-<env>-<yyyy-MM-dd>.log``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwarden.functions.text import _c
from tagwarden.sources.files import list_files, register

# Levels the managers write, and the log-line / file-name shapes.
LEVELS = ("INFO", "WARN", "ERROR", "DEBUG", "DRYRUN")
STAMP_RE = r"^\[\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\] "
LEVEL_RE = r"^\[(" + "|".join(LEVELS) + r")\] "
FILE_RE = r"^(.+)-([^-]+)-(\d{4}-\d{2}-\d{2})\.log$"
TAIL_LINES = 30
RETENTION_DAYS = 90
AUTH_FAILURE_MARKERS = ("sasl negotiation failure", "gss initiate failed")
PRINCIPAL_MARKER = "principal="
STATUS_RUNNING, STATUS_STOPPED, STATUS_DISABLED = "running", "stopped", "disabled"


# --------------------------------------------------------------------------- E1
def parse_log_lines(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Add ``ts`` (timestamp_ntz), ``level`` (null when absent) and ``message``.

    Lines that do not start with a time stamp (stack traces, wrapped text) are kept
    with a null ``ts`` and the whole line as message.
    """
    v = F.col(value_col)
    stamped = v.rlike(STAMP_RE)  # ``[yyyy-MM-dd HH:mm:ss] ``: 22 characters, the rest starts at the 23rd
    rest = F.expr(f"substring(`{value_col}`, 23)")
    level = F.regexp_extract(rest, LEVEL_RE, 1)
    return df.select(
        "*",
        # text straight to timestamp_ntz: no session time zone takes part
        F.when(stamped, F.substring(v, 2, 19).try_cast("timestamp_ntz")).alias("ts"),
        F.when(stamped, F.nullif(level, F.lit(""))).alias("level"),
        F.when(stamped, F.when(level != "", F.substr(rest, F.length(level) + 4)).otherwise(rest)).otherwise(v)
        .alias("message"),
    )


def read_logs(spark, path: str) -> DataFrame:
    """Read manager log files in parallel; file names give ``script, env, log_date``.

    Splittable text read (no whole-file tasks). ``script``/``env``/``log_date`` are
    derived from the ``_metadata.file_name`` column, so filters on them run inside the
    scan as data filters on that column.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name"))
    fn = F.col("file_name")
    raw = raw.select(
        "value", "file_name",
        F.regexp_extract(fn, FILE_RE, 1).alias("script"),
        F.regexp_extract(fn, FILE_RE, 2).alias("env"),
        F.try_to_timestamp(F.regexp_extract(fn, FILE_RE, 3), F.lit("yyyy-MM-dd")).cast("date").alias("log_date"),
    )
    return parse_log_lines(raw, "value")


def write_logs(lines: DataFrame, path: str, order: Sequence[str], modified: str | None = None) -> None:
    """Rows ``(script, env, log_date, value, ...)`` as the daily files ``<script>-<env>-<date>.log`` under ``path``.

    A file's lines are in the ``order`` of those columns. A daily log is one file, so one task writes it, streaming; a task writes
    many files. ``modified`` names the column whose last value becomes the file's time.
    """
    register(lines.sparkSession)
    name = F.concat_ws("-", "script", "env", F.concat(F.date_format("log_date", "yyyy-MM-dd"), F.lit(".log")))
    when = F.lit(None).cast("timestamp_ntz") if modified is None else F.col(modified).cast("timestamp_ntz")
    out = lines.select(name.alias("name"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], "value", when.alias("modified"))
    (out.repartition("name").sortWithinPartitions("name", *[f"_o{i}" for i in range(len(order))]).select("name", "value", "modified")
     .write.format("log_files").mode("append").save(path))


def file_parts(name) -> list[Column]:
    """``script, env, log_date`` of a file name (null where it has another shape)."""
    n = _c(name)
    part = lambda i: F.nullif(F.regexp_extract(n, FILE_RE, i), F.lit(""))
    return [part(1).alias("script"), part(2).alias("env"), part(3).try_cast("date").alias("log_date")]


# --------------------------------------------------------------------------- E2
def tail_files(spark, path: str, n: int = TAIL_LINES) -> DataFrame:
    """The last ``n`` lines of every log file under ``path``, by their place in the file: ``(name, script, env,
    log_date, rn, value)`` with rn 1 for the last line (E2).

    Each file is read backwards from its end, so the bytes read depend on ``n``, not on its size.
    """
    register(spark)
    name = F.element_at(F.split("file", "/"), -1)
    t = spark.read.format("file_tail").option("lines", n).load(path).select(name.alias("name"), "rn", "value")
    return t.select("name", *file_parts("name"), "rn", "value")


def tail_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = TAIL_LINES) -> DataFrame:
    """The last ``n`` rows per key by ``order`` (give descending columns), with ``rn``.

    ``row_number() <= n`` lets Catalyst insert a window group limit on both sides of
    the shuffle: each map task ships at most ``n`` rows per key, so a hot key stays cheap.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


# --------------------------------------------------------------------------- E3
def age_days(mtime, as_of) -> Column:
    """Whole elapsed 24-hour periods between ``mtime`` and ``as_of`` (find's -mtime rounding)."""
    secs = F.timestamp_diff("SECOND", _c(mtime), _c(as_of))
    return F.floor(secs / F.lit(86400)).cast("bigint")


def retention(files: DataFrame, mtime_col: str, as_of: str, days: int = RETENTION_DAYS,
              name_col: str | None = None, script: str | None = None, env: str | None = None) -> DataFrame:
    """Mark files expired when whole elapsed days exceed ``days`` (i.e. age >= days + 1).

    With ``name_col``/``script``/``env`` only files named ``<script>-<env>-*.log`` are
    considered (the others are filtered out).
    """
    kind = dict(files.dtypes)[mtime_col]
    kind = kind if kind.startswith("timestamp") else "timestamp_ntz"  # instants stay instants
    as_of_c = F.lit(as_of).cast(kind)
    df = files
    if name_col is not None and script is not None and env is not None:
        pat = "^" + re.escape(f"{script}-{env}-") + r".*\.log$"
        df = df.where(F.col(name_col).rlike(pat))
    a = age_days(F.col(mtime_col).cast(kind), as_of_c)
    return df.select("*", a.alias("age_days"), (a > days).alias("expired"))


def retention_files(spark, path: str, as_of: str, days: int = RETENTION_DAYS, script: str | None = None,
                    env: str | None = None) -> DataFrame:
    """The manager log files under ``path`` with their age: ``(path, name, script, env, log_date, modified, bytes, age_days,
    expired)`` (E3), from the file listing alone.

    Only files named ``<script>-<env>-*.log`` count when both are given, else those of the daily files' shape. Ages go by modification
    time, to the instant ``as_of`` (in the session's time zone). ``sources.files.delete_files`` removes what has expired.
    """
    f = list_files(spark, path)
    named = script is not None and env is not None
    f = f if named else f.where(F.col("name").rlike(FILE_RE))
    r = retention(f, "modified", as_of, days, *(("name", script, env) if named else ()))
    return r.select("path", "name", *file_parts("name"), "modified", "bytes", "age_days", "expired")


# --------------------------------------------------------------------------- E4
def run_outcome(df: DataFrame, run_keys: Sequence[str], failed: Column) -> DataFrame:
    """``rc = 1`` for a run with any failed step, else 0 (E4); partial aggregation."""
    return df.groupBy(*run_keys).agg(F.max(F.when(failed, F.lit(1)).otherwise(F.lit(0))).alias("rc"))


# --------------------------------------------------------------------------- E5
def auth_failure(text, url) -> Column:
    """A Kerberos/SASL auth failure worth a retry with a principal: the text mentions one of
    the markers (any case) and the URL has no ``principal=`` (E5)."""
    t = F.lower(_c(text))
    hit = F.lit(False)
    for m in AUTH_FAILURE_MARKERS:
        hit = hit | t.contains(m)
    return F.coalesce(hit & ~F.lower(_c(url)).contains(PRINCIPAL_MARKER), F.lit(False))


# --------------------------------------------------------------------------- E6
def status_rollup(obs: DataFrame, services: DataFrame, env: str | None = None) -> DataFrame:
    """Service status from process observations.

    ``obs(service, source, ord, pid, live)``: source 1 = control tool, 2 = pid file,
    3 = process match. The first live observation in source order wins; of the
    process matches only the *first* (lowest ``ord``) counts, live or not.
    ``services(service, managed)``: unmanaged -> ``disabled``; no live pick -> ``stopped``;
    the pid is ``-`` unless running. With ``env`` the rows carry that environment's name.

    One groupBy(service) of fixed-width min_by aggregates (hash aggregation with
    map-side combine), then a join to the service list.
    """
    live = F.col("live").cast("int")
    o = obs.select("service", "source", "ord", "pid", live.alias("live"))
    agg = o.groupBy("service").agg(
        F.expr("min_by(pid, ord) FILTER (WHERE live = 1 AND source = 1)").alias("p1"),
        F.expr("min_by(pid, ord) FILTER (WHERE live = 1 AND source = 2)").alias("p2"),
        F.expr("min_by(pid, ord) FILTER (WHERE source = 3)").alias("p3"),
        F.expr("min_by(live, ord) FILTER (WHERE source = 3)").alias("l3"),
    )
    picked = agg.select("service", F.coalesce("p1", "p2", F.when(F.col("l3") == 1, F.col("p3"))).alias("pid"))
    j = services.select("service", "managed").join(picked, "service", "left")
    status = (F.when(~F.col("managed"), F.lit(STATUS_DISABLED))
              .when(F.col("pid").isNull(), F.lit(STATUS_STOPPED))
              .otherwise(F.lit(STATUS_RUNNING)))
    pid = F.when(status == STATUS_RUNNING, F.col("pid").cast("string")).otherwise(F.lit("-"))
    named = [] if env is None else [F.lit(env).alias("env")]
    return j.select("service", *named, status.alias("status"), pid.alias("pid"))
