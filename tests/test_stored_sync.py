"""The stored sync, positions, bitmaps, hot tags and table versions."""
import os
import random
import re
import threading
import uuid

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tagwarden.operators import classify as B
from tagwarden.operators import grants as C
from tagwarden.operators import members as D
from tagwarden.plans import sync as S
from tagwarden.plans.ranks import with_positions
from tagwarden.sources import tables as A
from tests.conftest import rows
from tests.test_plans import plan_text

PAIR = "scope string, entity_id string"


def _name(base):
    return f"tw_test_{base}_{uuid.uuid4().hex[:8]}"


def _pairs(rng, n):
    return {(rng.choice(["us", "global", "mx"]), f"e{rng.randrange(300)}") for _ in range(n)}


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# ------------------------------------------------------------------ C2, C3, C5
def test_sync_runs_on_the_stored_state(spark, no_broadcast):
    rng = random.Random(1)
    diff_t, state_t = _name("diff"), _name("state")
    stored = _pairs(rng, 200)
    existing = spark.createDataFrame(sorted(stored) * 2, PAIR)  # an extraction may repeat rows
    for k in range(4):
        wanted = _pairs(rng, 150 + 50 * k) if k < 3 else stored
        report = S.sync_grants(spark, spark.createDataFrame(sorted(wanted) * 2, PAIR), existing, diff_t, state_t, "default")
        assert (report.added, report.removed) == (len(wanted - stored), len(stored - wanted))
        assert rows(report.state) == sorted(wanted) and report.pending.collect() == []
        assert rows(spark.table(f"default.{diff_t}"), "scope", "op", "entity_id") == sorted(
            [(s, "add", e) for s, e in wanted - stored] + [(s, "remove", e) for s, e in stored - wanted])
        stored, existing = wanted, None  # from now on against the state that is stored


def test_stored_tables_meet_without_an_exchange(spark, no_broadcast):
    diff_t, state_t = _name("diff"), _name("state")
    rng = random.Random(2)
    report = S.sync_grants(spark, spark.createDataFrame(sorted(_pairs(rng, 100)), PAIR),
                           spark.createDataFrame(sorted(_pairs(rng, 100)), PAIR), diff_t, state_t, "default")
    state, diff = spark.table(f"default.{state_t}"), spark.table(f"default.{diff_t}")
    for df in (report.pending, C.diff_stored(state, state), C.apply_stored(state, diff)):
        text = plan_text(df)
        assert not re.search(r"(?<![A-Za-z])Exchange", text.split("\n\n")[0]) and "Bucketed: true" in text
    # a diff of fresh rows against the state shuffles the fresh side only
    fresh = spark.createDataFrame(sorted(_pairs(rng, 50)), PAIR).distinct()
    assert len(re.findall(r"(?<![A-Za-z])Exchange", plan_text(C.diff_stored(fresh, state)).split("\n\n")[0])) <= 2


def test_a_failed_write_reports_nothing_and_keeps_the_state(spark):
    diff_t, state_t = _name("diff"), _name("state")
    ok = spark.createDataFrame([("us", "a"), ("us", "b")], PAIR)
    S.sync_grants(spark, ok, spark.createDataFrame([("us", "b")], PAIR), diff_t, state_t, "default")
    bad = ok.withColumn("entity_id", F.when(F.col("entity_id") == "a", F.raise_error(F.lit("boom"))).otherwise(F.col("entity_id")))
    with pytest.raises(Exception, match="boom"):
        S.sync_grants(spark, bad.select("scope", F.col("entity_id").cast("string").alias("entity_id")), None, diff_t, state_t, "default")
    assert rows(spark.table(f"default.{state_t}"), "scope", "entity_id") == [("us", "a"), ("us", "b")]


def test_counts_need_no_listener_events(spark):
    """Spark may drop listener events; the report neither waits for one nor fails without it."""
    deaf = spark.newSession()
    deaf.range(1).observe(Observation(), F.count("*")).collect()  # from now on this session has its own listener ...
    deaf._jsparkSession.listenerManager().clear()  # ... which hears nothing more
    reports = []

    def run():
        for existing in (deaf.createDataFrame([("us", "a"), ("us", "x")], PAIR), None):
            done = S.sync_grants(deaf, deaf.createDataFrame([("us", "a"), ("us", "b"), ("mx", "c")], PAIR), existing, *names, "default")
            reports.append((done.added, done.removed))

    names = (_name("diff"), _name("state"))
    sync = threading.Thread(target=run, daemon=True)
    sync.start()
    sync.join(60)
    assert reports == [(2, 1), (0, 0)]


def test_desired_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    desired = spark.createDataFrame([("us", f"e{i}") for i in range(50)], PAIR).mapInArrow(count, PAIR)
    report = S.sync_grants(spark, desired, spark.createDataFrame([("us", "x")], PAIR), _name("diff"), _name("state"), "default")
    assert report.pending.collect() == [] and report.state.count() == 50
    assert seen.value == 50


def test_superseded_versions_go(spark):
    name = _name("versions")
    A.ensure_table(spark, name, "k long", "default")
    for k in range(5):
        A.reload_rows(spark, name, spark.range(k + 1).select(F.col("id").alias("k")), "default")
    at = A.table_location(spark, name, "default")
    base = os.path.dirname(at.removeprefix("file:"))
    versions = [d for d in os.listdir(base) if d.startswith(A.VERSION)]
    assert len(versions) == 2 and os.path.basename(at) == max(versions)
    assert spark.table(f"default.{name}").count() == 5
    A.reload_rows(spark, name, spark.table(f"default.{name}").where("k > 2"), "default")  # reads the table itself
    assert rows(spark.table(f"default.{name}")) == [(3,), (4,)]


# ------------------------------------------------------------------ A4, C2, D6: order
def test_positions_are_those_of_one_sorted_list(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(40), rng.choice([None, "x"])) for _ in range(700)]
    df = spark.createDataFrame(data, "s string, n int, pos2 string").repartition(5)
    out = with_positions(df, ["s", F.col("n").desc()]).collect()
    assert sorted(r.pos for r in out) == list(range(1, 701))
    got = [(r.s, r.n) for r in sorted(out, key=lambda r: r.pos)]
    assert got == sorted(((s, n) for s, n, _ in data), key=lambda r: (r[0] is not None, r[0] or "", -r[1]))
    assert with_positions(df.limit(0), ["s"]).collect() == []
    assert [r.pos for r in with_positions(df.limit(1), ["s"]).collect()] == [1]


def test_a_value_of_all_rows_spreads_over_the_ranges(spark, tmp_path):
    df = spark.range(4000).select(F.lit("same").alias("s"))
    out = with_positions(df, ["s"], folder=f"{tmp_path}/ranks")
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/ranks").groupBy("_range").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 1200
    assert sorted(r.pos for r in out.collect()) == list(range(1, 4001))


def test_plan_order(spark):
    diff = spark.createDataFrame([("us", "remove", "a"), ("us", "add", "z"), ("global", "remove", "q"), ("us", "add", "b")],
                                 "scope string, op string, entity_id string")
    got = sorted(C.plan_rank(diff).collect(), key=lambda r: r.pos)
    assert [(r.scope, r.op, r.entity_id) for r in got] == [
        ("global", "remove", "q"), ("us", "add", "b"), ("us", "add", "z"), ("us", "remove", "a")]
    targets = spark.createDataFrame([("role", "R"), ("user", "u2"), ("user", "u1")], "kind string, name string")
    got = sorted(D.teardown_rank(D.teardown_plan(targets, targets, True)).collect(), key=lambda r: r.pos)
    assert [r.name for r in got] == ["u1", "u2", "R"]


# ------------------------------------------------------------------ C10
@pytest.mark.parametrize("broadcast", [True, False])
def test_users_of_an_entity_against_all_pairs(spark, broadcast, monkeypatch):
    rng = random.Random(4)
    if not broadcast:
        monkeypatch.setattr(C, "BITMAP_SOURCE_BYTES", 0)
    users, roles, ents = [f"u{i}" for i in range(400)], [f"R{i}" for i in range(12)], [f"e{i}" for i in range(60)]
    held = [(rng.choice(users), rng.choice(roles)) for _ in range(900)] + [(u, "G") for u in users[:7]] + [("u1", "G"), (None, "R1"), ("u2", None)]
    grants = [(rng.choice(roles), rng.choice(["can_create", "can_read"]), f"DAG Run:{rng.choice(ents)}") for _ in range(150)]
    grants += [("G", "can_create", "DAG Runs"), ("R0", "can_read", "DAG Runs"), ("none", "can_create", "DAG Run:e1")]
    out = C.access_bitmaps(spark.createDataFrame([(e,) for e in [*ents, "e1", "lonely", None]], "entity_id string"),
                           spark.createDataFrame(held, "username string, role string"),
                           spark.createDataFrame(grants, "role string, action string, resource string"))
    everywhere = {u for u, r in held if r == "G"}
    want = []
    for e in [*ents, "lonely"]:
        ok = {r for r, a, x in grants if a == "can_create" and x == f"DAG Run:{e}"}
        scoped = {u for u, r in held if r in ok and u is not None} - everywhere
        want.append((e, len(scoped | everywhere), len(scoped)))
    assert rows(out, "entity_id", "n_users", "n_scoped") == sorted(want)


def test_bitmaps_over_several_buckets(spark):
    n = 100_000  # user numbers beyond one bitmap of 32,768
    users = spark.range(n).select(F.concat(F.lit("u"), "id").alias("username"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("role"))
    more = spark.range(n).where("id % 2 = 0").select(F.concat(F.lit("u"), "id").alias("username"), F.lit("C").alias("role"))
    grants = spark.createDataFrame([(r, "can_create", f"DAG Run:{e}") for e, rs in (("x", "A"), ("y", "AC"), ("z", "ABC")) for r in rs],
                                   "role string, action string, resource string")
    out = C.access_bitmaps(spark.createDataFrame([("x",), ("y",), ("z",)], "entity_id string"), users.unionByName(more), grants)
    assert rows(out, "entity_id", "n_users") == [("x", 33_334), ("y", 66_667), ("z", 100_000)]


# ------------------------------------------------------------------ B7
def _wide(spark):
    rng = random.Random(5)
    tags = [(f"e{i % 700}", "HOT" if i % 3 == 0 else f"T{rng.randrange(2500)}") for i in range(12_000)]
    tmap = [(f"T{i}", "us" if i % 2 else "global") for i in range(0, 2500, 2)] + [("T1", "us"), ("T1", "mx"), ("HOT", "us"), ("HOT", "apac")]
    return (spark.createDataFrame([(f"e{i}",) for i in range(720)], "entity_id string"),
            spark.createDataFrame(tags, "entity_id string, tag string").repartition(6), spark.createDataFrame(tmap, "tag string, scope string"))


def test_hot_tags_beyond_the_broadcast_bound(spark, no_broadcast):
    ents, tags, tmap = _wide(spark)
    assert B.hot_tags(tags.select("tag")) == ["HOT"]
    few, many = B.classify(ents, tags, tmap), B.classify(ents, tags, tmap, max_map_bytes=100)
    key = lambda df: sorted((r.entity_id, r.status, r.scope, tuple(r.matched_tags)) for r in df.collect())
    assert key(few) == key(many)
    out = B.match_tags(tags, tmap, 100)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, tags.join(tmap, "tag").select(out.columns).collect()))
    left = B.match_tags(tags, tmap, 100, "left")
    assert left.count() == tags.join(tmap, "tag", "left").count()


def test_no_task_of_the_tag_join_is_far_above_the_median(spark, no_broadcast):
    """The rows that each task of the shuffle join reads, with a tag in a third of all rows and AQE off."""
    ents, tags, tmap = _wide(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hot = B.hot_tags(tags.select("tag"))
        per = tags.where(~F.col("tag").isin(hot)).join(tmap, "tag", "left").groupBy(F.spark_partition_id().alias("p")).count().collect()
        sizes = sorted(r["count"] for r in per)
        assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
        out = B.match_tags(tags, tmap, 100, "left").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        sizes = sorted(r["count"] for r in out)  # tasks of the broadcast and of the shuffle part
        assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_nothing_is_hot_where_tags_are_even(spark):
    even = spark.range(8000).select(F.concat(F.lit("t"), F.col("id") % 2000).alias("tag"))
    assert B.hot_tags(even) == [] and B.hot_tags(even.limit(0)) == []


def test_violations_read_the_tags_once(spark, sf_dir):
    from tagwarden.plans.queries import QUERIES

    text = plan_text(QUERIES["violations"](spark, sf_dir))
    assert len(re.findall(r"Location: InMemoryFileIndex \[[^\]]*lineitem\.parquet", text)) == 1
    assert len(re.findall(r"Arguments: hashpartitioning\(entity_id", text)) <= 2
