import os
import tempfile

from pyspark.sql import functions as F

from tagwarden.operators import logs as E
from tests.conftest import rows


def test_parse_log_lines(spark):
    df = spark.createDataFrame([
        ("[2025-01-02 03:04:05] [INFO] started",), ("[2025-01-02 03:04:06] no level here",),
        ("Traceback (most recent call last):",), ("[2025-01-02 03:04:07] [ERROR] [x] bracket text",),
        ("[2025-01-02 03:04:08] [lower] text",),
    ], "value string")
    got = [(r["level"], r["message"], r["t"]) for r in E.parse_log_lines(df).select(
        "level", "message", F.date_format("ts", "HH:mm:ss").alias("t")).collect()]
    assert got == [("INFO", "started", "03:04:05"), (None, "no level here", "03:04:06"),
                   (None, "Traceback (most recent call last):", None), ("ERROR", "[x] bracket text", "03:04:07"),
                   (None, "[lower] text", "03:04:08")]


def test_read_logs_file_names(spark):
    d = tempfile.mkdtemp(prefix="tw-logs-", dir="/tmp")
    with open(os.path.join(d, "svc-manager-dev-2025-01-02.log"), "w") as f:
        f.write("[2025-01-02 00:00:01] [INFO] a\n[2025-01-02 00:00:02] [ERROR] b\n")
    with open(os.path.join(d, "worker-prod-2025-01-03.log"), "w") as f:
        f.write("[2025-01-03 00:00:01] [WARN] c\n")
    got = rows(E.read_logs(spark, d), "script", "env", "level")
    assert got == [("svc-manager", "dev", "ERROR"), ("svc-manager", "dev", "INFO"), ("worker", "prod", "WARN")]


def test_tail_retention_outcome(spark):
    df = spark.createDataFrame([("s", i) for i in range(50)] + [("t", 1)], "svc string, line int")
    t = E.tail_per_key(df, ["svc"], [F.col("line").desc()], n=30)
    assert t.where("svc = 's'").agg(F.min("line")).first()[0] == 20 and t.count() == 31
    files = spark.createDataFrame([
        ("m-dev-a.log", "2025-01-01 00:00:00"), ("m-dev-b.log", "2024-10-02 00:00:00"),
        ("m-dev-c.log", "2024-10-03 00:00:01"), ("m-prod-d.log", "2020-01-01 00:00:00"), ("m-dev-e.txt", "2020-01-01 00:00:00"),
    ], "name string, mtime string")
    r = {x["name"]: (x["age_days"], x["expired"]) for x in
         E.retention(files, "mtime", "2025-01-01 00:00:00", name_col="name", script="m", env="dev").collect()}
    # 91 whole days -> expired; 90 days and a bit -> kept; other env / extension not matched
    assert r == {"m-dev-a.log": (0, False), "m-dev-b.log": (91, True), "m-dev-c.log": (89, False)}
    runs = spark.createDataFrame([("r1", "INFO"), ("r1", "ERROR"), ("r2", "INFO")], "run string, level string")
    assert rows(E.run_outcome(runs, ["run"], F.col("level") == "ERROR")) == [("r1", 1), ("r2", 0)]


def test_auth_failure(spark):
    df = spark.createDataFrame([
        ("... SASL Negotiation Failure ...", "jdbc:x://h:1/db"), ("GSS initiate failed", "jdbc:x;Principal=a"),
        ("all good", "jdbc:x"), (None, "jdbc:x"),
    ], "text string, url string")
    assert [r[0] for r in df.select(E.auth_failure("text", "url")).collect()] == [True, False, False, False]


def test_status_rollup(spark):
    obs = spark.createDataFrame([
        ("a", 1, 1, 11, False), ("a", 2, 1, 12, True),                   # dead control tool, live pid file -> 12
        ("b", 3, 1, 21, False), ("b", 3, 2, 22, True),                   # first process match dead -> stopped
        ("c", 3, 5, 31, True), ("c", 3, 9, 32, True),                    # first match live -> 31
        ("e", 2, 1, 51, True),                                           # unmanaged -> disabled
    ], "service string, source int, ord long, pid long, live boolean")
    services = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", True), ("e", False)],
                                     "service string, managed boolean")
    got = rows(E.status_rollup(obs, services))
    assert got == [("a", "running", "12"), ("b", "stopped", "-"), ("c", "running", "31"), ("d", "stopped", "-"),
                   ("e", "disabled", "-")]


def test_time_stamps_do_not_depend_on_the_session_zone(spark):
    lines = ["[2024-03-10 02:30:00] [INFO] a\u2028b", "[2024-03-10 02:30:00] [k] x", "[2024-13-40 02:30:00] bad", "at x()"]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [(str(r.ts), r.level, r.message) for r in E.parse_log_lines(df).select("ts", "level", "message").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [("2024-03-10 02:30:00", "INFO", "a\u2028b"), ("2024-03-10 02:30:00", None, "[k] x"), ("None", None, "bad"),
                   ("None", None, "at x()")]
