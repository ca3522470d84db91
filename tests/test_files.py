"""Numbered lines, tails, listings and named log files against plain file reading."""
import datetime
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tagwarden.operators import logs as E
from tagwarden.operators import members as D
from tagwarden.sources import files as X


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbered_lines_of_split_files(spark, tmp_path, small_splits):
    rng = random.Random(1)
    want = []
    (tmp_path / "in").mkdir()
    for k, n in enumerate([0, 1, 400, 37, 90]):
        lines = ["x" * rng.choice([0, 0, 3, 40, 900]) + str(i) * rng.randint(0, 1) for i in range(n)]
        (tmp_path / "in" / f"f{k}").write_text("".join(x + "\n" for x in lines)[:-1 if k == 3 else None])
        want += [(f"f{k}", i, x) for i, x in enumerate(lines)]
    got = X.numbered_lines(spark, f"{tmp_path}/in", f"{tmp_path}/copy")
    assert spark.read.parquet(f"{tmp_path}/copy/splits").count() > 20  # the files were split
    assert sorted((r.file.rsplit("/", 1)[1], r.pos, r.value) for r in got.collect()) == sorted(want)


def plain_roles(text, username):
    """The first line of the user after the header, and its roles; by the rule, not by streams."""
    for line in text.split("\n")[1:]:
        cols = line.split()
        if cols and (cols[1] if cols[0].isdigit() and len(cols) > 1 else cols[0]) == username:
            inner = line[line.index("[") + 1:] if "[" in line else None
            inner = inner[:inner.rindex("]")] if inner and "]" in inner else inner
            found = ["".join(x.split()).replace("'", "").replace('"', "") for x in (inner or "").split(",")]
            return {x for x in found if x}
    return None


def test_first_line_of_a_user_decides(spark, tmp_path, small_splits):
    rng = random.Random(2)
    users = [f"u{i}" for i in range(40)]
    lines = ["" if rng.random() < .5 else "u1 header ['NOT_A_USER']"]  # the header is line 0, whatever it holds
    for i in range(600):
        u = rng.choice(users)
        roles = rng.choice(["['A', 'B']", '[ "C" , "D e" ]', "[]", "", "['E'] ['F']", "['x'", f"['R{i}']"])
        lines.append(rng.choice(["", " ", f"{i} ", f" {i}\t"]) + f"{u} {u}@x First Last {roles}" if rng.random() < .95 else rng.choice(["", "  ", "77"]))
    text = "\n".join(lines)
    (tmp_path / "listing.txt").write_text(text)
    first = D.first_lines(D.read_listing(spark, f"{tmp_path}/listing.txt", f"{tmp_path}/copy")).collect()
    want = {u: plain_roles(text, u) for u in [*users, "77"]}
    got = {r.username for r in first}
    assert got == {u for u, r in want.items() if r is not None}
    pairs = D.parse_role_list(spark.createDataFrame(first), "line", keep=["username"]).collect()
    assert {(r.username, r.role) for r in pairs} == {(u, x) for u, r in want.items() for x in r or ()}


class Counted(io.BytesIO):
    total = 0

    def read(self, n=-1):
        out = super().read(n)
        self.total += len(out)
        return out


def test_last_lines_are_those_of_the_file():
    rng = random.Random(3)
    for _ in range(400):
        data = b"".join(rng.choice([b"\n", b"\n", b"a", b"bc", b"line" * 9, b"\r"]) for _ in range(rng.randint(0, 60)))
        n, block = rng.choice([0, 1, 2, 5, 30]), rng.choice([1, 3, 8, 64])
        f = Counted(data)
        got, read = X.last_lines(f, len(data), n, block)
        lines = data.split(b"\n")
        lines = lines[:-1] if lines[-1] == b"" else lines
        assert got == (lines[-n:] if n else []) and read == f.total


def test_tail_reads_little_of_a_large_file(spark, tmp_path):
    with open(tmp_path / "svc-dev-2024-01-01.log", "wb") as f:
        for i in range(1600):
            f.write(b"%06d " % i * 9362 + b"\n")  # 64 KB a line, 100 MB
    size = os.path.getsize(tmp_path / "svc-dev-2024-01-01.log")
    assert size > 100_000_000
    with open(tmp_path / "svc-dev-2024-01-01.log", "rb") as f:
        lines, read = X.last_lines(f, size, 30)
    assert [int(x[:6]) for x in lines] == list(range(1570, 1600)) and read < 33 * 65_536
    got = E.tail_files(spark, str(tmp_path), 3)
    assert [(r.rn, r.value[:6]) for r in sorted(got.collect(), key=lambda r: r.rn)] == [(1, "001599"), (2, "001598"), (3, "001597")]


def test_tails_of_odd_files(spark, tmp_path):
    d = tmp_path / "logs" / "sub"
    d.mkdir(parents=True)
    (d / "a-b-dev-2024-01-02.log").write_bytes(b"one\ntwo\nthree")  # no closing line break
    (d / "empty-dev-2024-01-02.log").write_bytes(b"")
    (d / "x-dev-2024-13-99.log").write_bytes(b"\n\n\xff\n")  # no such date; no UTF-8
    (tmp_path / "logs" / "plain.txt").write_text("p\n")
    (tmp_path / "logs" / "_hidden").write_text("h\n")
    t = E.tail_files(spark, f"{tmp_path}/logs", 2)
    day = datetime.date(2024, 1, 2)
    assert rows(t.where("script is not null")) == [
        ("a-b-dev-2024-01-02.log", "a-b", "dev", day, 1, "three"), ("a-b-dev-2024-01-02.log", "a-b", "dev", day, 2, "two"),
        ("x-dev-2024-13-99.log", "x", "dev", None, 1, "�"), ("x-dev-2024-13-99.log", "x", "dev", None, 2, "")]
    assert [r.value for r in t.where("script is null").collect()] == ["p"]
    assert E.tail_files(spark, f"file://{d}/a-b-dev-2024-01-02.log", 1).first().value == "three"  # one file, with its scheme
    os.makedirs(tmp_path / "none")
    assert E.tail_files(spark, f"{tmp_path}/none").collect() == []
    X.register(spark)
    packed = spark.read.format("file_tail").option("lines", 2).option("tasks", 2).load(f"{tmp_path}/logs")
    assert packed.rdd.getNumPartitions() == 2 and packed.count() == t.count()
    with pytest.raises(Exception, match="absent"):
        E.tail_files(spark, f"{tmp_path}/absent").collect()


def _lines(spark, n=200):
    return spark.range(n).select(
        F.concat(F.lit("svc-"), (F.col("id") % 3).cast("string")).alias("script"), F.lit("dev").alias("env"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 5).cast("int")).alias("log_date"), "id",
        F.timestamp_seconds(F.col("id") * 1000 + 1_704_067_200).cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("line é "), F.col("id").cast("string")).alias("value"))


def test_named_log_files(spark, tmp_path):
    E.write_logs(_lines(spark).repartition(7), f"{tmp_path}/logs", ["id"], modified="ts")
    names = sorted(os.listdir(tmp_path / "logs"))
    assert names == sorted(f"svc-{s}-dev-2024-01-0{d}.log" for s in range(3) for d in range(1, 6))
    for name in names:
        s, d = int(name[4]), int(name[-5]) - 1
        ids = [i for i in range(200) if i % 3 == s and i % 5 == d]
        assert (tmp_path / "logs" / name).read_text() == "".join(f"line é {i}\n" for i in ids)
        assert os.path.getmtime(tmp_path / "logs" / name) == ids[-1] * 1000 + 1_704_067_200
    back = E.read_logs(spark, f"{tmp_path}/logs")
    assert back.count() == 200 and back.where("script = 'svc-1' and log_date = date'2024-01-02'").count() == 14


def test_a_failed_job_leaves_no_log_file(spark, tmp_path):
    bad = _lines(spark).withColumn("value", F.when(F.col("id") < 190, F.col("value")).otherwise(F.raise_error(F.lit("boom"))))
    with pytest.raises(Exception, match="boom"):
        E.write_logs(bad, f"{tmp_path}/logs", ["id"])
    assert not os.path.exists(tmp_path / "logs") or os.listdir(tmp_path / "logs") == []
    split = spark.range(4).select(F.lit("one.log").alias("name"), F.lit("v").alias("value"), F.lit(None).cast("timestamp_ntz").alias("modified"))
    X.register(spark)
    with pytest.raises(Exception, match="several tasks"):
        split.repartition(4).write.format("log_files").mode("append").save(f"{tmp_path}/split")
    assert os.listdir(tmp_path / "split") == []


def test_retention_of_listed_files(spark, tmp_path):
    as_of = 1_720_000_000
    ages = {"mgr-dev-2024-01-01.log": 91 * 86400, "mgr-dev-2024-01-02.log": 91 * 86400 - 1, "mgr-dev-x.log": 400 * 86400,
            "mgr-prod-2024-01-01.log": 95 * 86400, "mgr-dev-2024-01-01.txt": 500 * 86400, "mgr.dev-2024-01-01.log": 99 * 86400}
    (tmp_path / "logs" / "sub").mkdir(parents=True)
    for k, (name, age) in enumerate(ages.items()):
        p = tmp_path / "logs" / ("sub" if k % 2 else "") / name
        p.write_text("x" * k)
        os.utime(p, (as_of - age, as_of - age))
    stamp = datetime.datetime.fromtimestamp(as_of, datetime.UTC).strftime("%Y-%m-%d %H:%M:%S")
    of = lambda **kw: E.retention_files(spark, f"{tmp_path}/logs", stamp, **kw)
    assert rows(of(script="mgr", env="dev"), "name", "age_days", "expired", "bytes") == [
        ("mgr-dev-2024-01-01.log", 91, True, 0), ("mgr-dev-2024-01-02.log", 90, False, 1), ("mgr-dev-x.log", 400, True, 2)]
    assert rows(of(), "name", "script", "env", "expired") == [
        ("mgr-dev-2024-01-01.log", "mgr", "dev", True), ("mgr-dev-2024-01-02.log", "mgr", "dev", False),
        ("mgr-prod-2024-01-01.log", "mgr", "prod", True)]
    gone = X.delete_files(of(script="mgr", env="dev").where("expired")).collect()
    assert sorted((os.path.basename(r.path), r.deleted) for r in gone) == [("mgr-dev-2024-01-01.log", True), ("mgr-dev-x.log", True)]
    assert rows(of(script="mgr", env="dev"), "name") == [("mgr-dev-2024-01-02.log",)]


def test_listing_of_many_folders(spark, tmp_path):
    want = []
    for k in range(30):
        d = tmp_path / "in" / f"d{k % 7}" / f"e{k}"
        d.mkdir(parents=True)
        for name in ("a.log", ".hidden", "_b"):
            (d / name).write_text("z" * k)
            want.append((str(d / name), name, k))
    (tmp_path / "in" / "top").write_text("")
    X.register(spark)
    for folders in (1, 10, 1000):
        got = spark.read.format("file_listing").option("folders", folders).load(f"{tmp_path}/in")
        assert rows(got, "path", "name", "bytes") == sorted([*want, (f"{tmp_path}/in/top", "top", 0)])
    assert X.list_files(spark, f"file://{tmp_path}/in").where("name = 'top'").first().path == f"file://{tmp_path}/in/top"
    os.makedirs(tmp_path / "none")
    assert X.list_files(spark, f"{tmp_path}/none").collect() == []
    with pytest.raises(Exception, match="absent"):
        X.list_files(spark, f"{tmp_path}/absent").collect()
