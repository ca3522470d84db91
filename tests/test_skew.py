"""Hot keys: one entity / user / service holding a third of all rows, with AQE's
skew handling forced on small data, must give the same answers as brute force."""
import random

import pytest
from pyspark.sql import functions as F

from tagwarden.operators import classify as B
from tagwarden.operators import grants as C
from tagwarden.operators import logs as E
from tagwarden.operators import members as D
from tests.conftest import rows

SKEW_CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture
def skew(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_entity_and_hot_user(skew):
    spark = skew
    rng = random.Random(3)
    n = 3000
    ents = [f"e{i}" for i in range(300)]
    tag_rows = [("hot", rng.choice(["T_US", "T_GL", "X"])) for _ in range(n // 3)]
    tag_rows += [(rng.choice(ents), rng.choice(["T_US", "T_GL", "X", "Y"])) for _ in range(2 * n // 3)]
    e_df = spark.createDataFrame([(e,) for e in ents + ["hot"]], "entity_id string")
    t_df = spark.createDataFrame(tag_rows, "entity_id string, tag string")
    tm = spark.createDataFrame([("T_US", "us"), ("T_GL", "global")], "tag string, scope string")
    got = {r["entity_id"]: r["status"] for r in B.classify(e_df, t_df, tm).collect()}
    scopes = {}
    for e, t in tag_rows:
        if t in ("T_US", "T_GL"):
            scopes.setdefault(e, set()).add(t)
    for e in ents + ["hot"]:
        k = len(scopes.get(e, ()))
        assert got[e] == ("valid" if k == 1 else "conflict" if k > 1 else "missing"), e

    # requests: user u0 sends a third of them; role R0 is shared by most users
    users = [f"u{i}" for i in range(50)]
    req = [(i, "u0" if i % 3 == 0 else rng.choice(users), str(rng.randint(0, 20))) for i in range(n)]
    ur = [(u, "R0") for u in users[:40]] + [("u0", "RG"), ("u7", "R1")]
    grants = [("R0", "can_create", f"DAG Run:{k}") for k in range(0, 21, 2)] + [("RG", "can_create", "DAG Runs"),
                                                                               ("R1", "can_read", "DAG Run:1")]
    out = C.effective_access(spark.createDataFrame(req, "request_id long, username string, entity_id string"),
                             spark.createDataFrame(ur, "username string, role string"),
                             spark.createDataFrame(grants, "role string, action string, resource string"))
    got = {r["request_id"]: (r["allowed"], r["via"]) for r in out.collect()}
    roles = {}
    for u, r in ur:
        roles.setdefault(u, set()).add(r)
    for rid, u, ent in req:
        rs = roles.get(u, set())
        scoped = "R0" in rs and int(ent) % 2 == 0
        glob = "RG" in rs
        assert got[rid] == (scoped or glob, "scoped" if scoped else "global" if glob else None), rid


def test_hot_user_reconcile_and_hot_service_tail(skew):
    spark = skew
    rng = random.Random(5)
    roles = ["Viewer", "AF_RERUN_ALL_NO_TRIGGER", "AF_TRIGGER_SCOPE_US", "AF_TRIGGER_SCOPE_GLOBAL"]
    cur = [("hot", rng.choice(roles)) for _ in range(1000)] + [(f"u{i % 40}", rng.choice(roles)) for i in range(2000)]
    des = [("hot", "Viewer")] * 500 + [(f"u{i % 30}", rng.choice(roles[:2])) for i in range(1000)]
    sch = "username string, role string"
    got = rows(D.reconcile_roles(spark.createDataFrame(cur, sch), spark.createDataFrame(des, sch)))
    c, d = set(cur), set(des)
    du = {u for u, _ in d}
    want = sorted([(u, "add", r) for u, r in d - c] + [(u, "remove", r) for u, r in c - d if u in du])
    assert got == want
    lines = [("hot", i) for i in range(1500)] + [(f"s{i % 20}", i) for i in range(1500)]
    t = E.tail_per_key(spark.createDataFrame(lines, "svc string, line int"), ["svc"], [F.col("line").desc()], n=30)
    got_tail = {}
    for r in t.collect():
        got_tail.setdefault(r["svc"], set()).add(r["line"])
    assert got_tail["hot"] == set(range(1470, 1500))
    assert all(len(v) == 30 for v in got_tail.values())
