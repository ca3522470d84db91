from pyspark.sql import functions as F

from tagwarden.operators import grants as C
from tests.conftest import rows

GSCHEMA = "role string, action string, resource string"


def _grants(spark):
    return spark.createDataFrame([
        ("AF_TRIGGER_SCOPE_US", "can_create", "DAG Run:a"),
        ("AF_TRIGGER_SCOPE_US", "can_create", "DAG Run:b"),
        ("AF_TRIGGER_SCOPE_US", "can_create", "DAG Runs"),     # global resource: not a scoped grant
        ("AF_TRIGGER_SCOPE_US", "can_create", "DAG Run:"),     # empty id
        ("AF_TRIGGER_SCOPE_US", "can_read", "DAG Run:c"),      # other action
        ("AF_TRIGGER_SCOPE_GLOBAL", "can_create", "DAG Run:g"),
        ("AF_TRIGGER_SCOPE_MX", "can_create", "DAG Run:m"),    # unmanaged scope
        ("Viewer", "can_create", "DAG Run:v"),
    ], GSCHEMA)


def test_existing_grants(spark):
    e = rows(C.existing_grants(_grants(spark), ["us", "global"]))
    assert e == [("global", "g"), ("us", "a"), ("us", "b")]


def test_diff_summary_plan_and_apply(spark):
    existing = C.existing_grants(_grants(spark), ["us", "global"])
    desired = spark.createDataFrame([("us", "a"), ("us", "c"), ("global", "h")], "scope string, entity_id string")
    diff = C.diff_grants(desired, existing)
    assert rows(diff) == [("global", "add", "h"), ("global", "remove", "g"), ("us", "add", "c"), ("us", "remove", "b")]
    s = {r["scope"]: (r["added"], r["removed"]) for r in C.diff_summary(diff).collect()}
    assert s == {"us": (1, 1), "global": (1, 1), "total": (2, 2)}
    plan = {(r["scope"], r["entity_id"]): r["command"] for r in C.render_plan(diff).collect()}
    assert plan[("us", "c")] == "[DRY-RUN] ctl roles add-perms AF_TRIGGER_SCOPE_US -a can_create -r 'DAG Run:c'"
    assert plan[("global", "g")].startswith("[DRY-RUN] ctl roles del-perms AF_TRIGGER_SCOPE_GLOBAL")
    ordered = [(r["scope"], r["op"], r["entity_id"]) for r in C.order_plan(diff).collect()]
    assert ordered == [("global", "add", "h"), ("global", "remove", "g"), ("us", "add", "c"), ("us", "remove", "b")]
    new_state = C.apply_diff(existing, diff)
    assert rows(new_state) == rows(desired)
    assert C.diff_grants(desired, new_state).count() == 0  # a second run changes nothing
    assert C.diff_grants(desired, desired).count() == 0


def test_normalize_acl_shapes(spark):
    docs = [
        ("n", None), ("s", '{"R": "can_edit"}'), ("l", '{"R": ["a", "b", "a"]}'),
        ("m", '{"R": {"DAGs": ["a"], " ": ["x"], "DAG Runs": [], " Res ": "y"}}'),
        ("num", '{"R": 5}'), ("bad", "not json"), ("top", '["a"]'), ("e", '{"R": ""}'),
    ]
    df = spark.createDataFrame(docs, "entity_id string, acl_json string")
    got = rows(C.normalize_acl(df), "entity_id", "role", "resource", "action")
    assert got == sorted([
        ("s", "R", "DAGs", "can_edit"), ("l", "R", "DAGs", "a"), ("l", "R", "DAGs", "b"),
        ("m", "R", "DAGs", "a"), ("m", "R", "Res", "y"), ("e", "R", "DAGs", ""),
    ])


def test_merge_replaces_managed_and_target_roles(spark):
    docs = spark.createDataFrame([
        ("e1", '{"Ops":"can_read","AF_TRIGGER_SCOPE_EMEA":["can_edit"],"R_APAC":{"DAGs":["can_delete"]}}'),
        ("e2", '{"Ops":["a"],"Ops":["b"],"Biz":["c"]}'), ("e3", None), ("e4", '["x"]'), ("e5", '{"Own":["can_delete"]}'),
        ("e9", '{"Ops":"can_read"}')], "entity_id string, acl_json string")
    roles = spark.createDataFrame([("apac", "R_APAC"), ("emea", "AF_TRIGGER_SCOPE_EMEA")], "scope string, role string")
    targets = spark.createDataFrame([(e, "R_APAC") for e in ("e1", "e2", "e3", "e4")] + [("e5", "Own")],
                                    "entity_id string, role string")
    new = lambda e, r="R_APAC": [(e, r, "DAG Runs", "can_create"), (e, r, "DAGs", "can_edit")]
    assert rows(C.merge_targets_acl(docs, targets, roles)) == sorted(
        [("e1", "Ops", "DAGs", "can_read"), *new("e1"), *new("e3"), *new("e5", "Own")])
    assert rows(C.acl_rejects(docs)) == [("e2", "unreadable"), ("e4", "not an object")]


def test_acl_actions_are_never_null(spark):
    docs = spark.createDataFrame([("e", '{"R":["a",null,true,12],"S":{" x ":["p"],"x":["q"]},"N":null,"I":5}')],
                                 "entity_id string, acl_json string")
    assert rows(C.normalize_acl(docs)) == sorted(
        [("e", "R", "DAGs", a) for a in ("a", "None", "True", "12")] + [("e", "S", "x", "p"), ("e", "S", "x", "q")])


def test_permission_state_last_op_wins(spark):
    ops = spark.createDataFrame([
        (1, "grant", "R", "can_read", "DAGs"), (2, "revoke", "R", "can_read", "DAGs"),
        (3, "grant", "R", "can_read", "DAGs"), (4, "revoke", "R", "can_edit", "DAGs"),
        (5, "grant", "R", "menu_access", "Browse"), (6, "grant", "R", "menu_access", "Browse"),
    ], "seq long, op string, role string, action string, resource string")
    got = rows(C.permission_state(ops), "action", "last_op")
    assert got == [("can_edit", "revoke"), ("can_read", "grant"), ("menu_access", "grant")]


def test_bypass_and_missing_roles(spark):
    g = spark.createDataFrame([("AF_TRIGGER_SCOPE_US", "can_create", "DAG Runs"),
                               ("AF_TRIGGER_SCOPE_US", "can_create", "DAG Runs"),
                               ("AF_RERUN_ALL_NO_TRIGGER", "can_create", "DAG Runs"),
                               ("AF_TRIGGER_SCOPE_GLOBAL", "can_create", "DAG Run:x")], GSCHEMA)
    b = rows(C.bypass_violations(g, ["AF_TRIGGER_SCOPE_US", "AF_TRIGGER_SCOPE_GLOBAL"]))
    assert b == [("AF_TRIGGER_SCOPE_US", 2)]
    w = spark.createDataFrame([("A",), ("B",), ("B",), ("C",)], "role string")
    p = spark.createDataFrame([("B",)], "role string")
    assert rows(C.missing_roles(w, p)) == [("A",), ("C",)]


def test_effective_access(spark):
    req = spark.createDataFrame([(1, "u1", "a"), (2, "u1", "z"), (3, "u2", "z"), (4, "u3", "a")],
                                "request_id long, username string, entity_id string")
    ur = spark.createDataFrame([("u1", "RA"), ("u2", "RG"), ("u2", "RA")], "username string, role string")
    g = spark.createDataFrame([("RA", "can_create", "DAG Run:a"), ("RG", "can_create", "DAG Runs"),
                               ("RA", "can_read", "DAG Run:z")], GSCHEMA)
    got = rows(C.effective_access(req, ur, g), "request_id", "allowed", "via")
    assert got == [(1, True, "scoped"), (2, False, None), (3, True, "global"), (4, False, None)]


def test_grant_sync_job_is_idempotent(spark):
    from tagwarden.plans.sync import run_grant_sync

    sch = "scope string, entity_id string"
    desired = spark.createDataFrame([("us", "a"), ("us", "c"), ("global", "h")], sch)
    existing = spark.createDataFrame([("us", "a"), ("us", "b")], sch)
    want = sorted((s, e, "state") for s, e in rows(desired))
    assert rows(run_grant_sync(spark, desired, existing, "t_diff", "t_state", "default")) == want
    assert rows(spark.table("default.t_diff"), "op", "entity_id") == [("add", "c"), ("add", "h"), ("remove", "b")]
    # again, from the written state itself: nothing to do
    assert rows(run_grant_sync(spark, desired, spark.table("default.t_state"), "t_diff", "t_state", "default")) == want
    assert spark.table("default.t_diff").count() == 0


def test_policy_acl_only_under_root_and_valid(spark):
    from tagwarden.operators import classify as B

    ents = spark.createDataFrame([("in_ok", "/dags/a.py"), ("in_bad", "/dags/b.py"), ("out_ok", "/other/c.py")],
                                 "entity_id string, path string")
    tags = spark.createDataFrame([("in_ok", "GDTET_US_DAG"), ("in_bad", "GDTET_US_DAG"), ("in_bad", "GDTET_GLOBAL_DAG"),
                                  ("out_ok", "GDTET_US_DAG")], "entity_id string, tag string")
    tm = spark.createDataFrame([("GDTET_US_DAG", "us"), ("GDTET_GLOBAL_DAG", "global")], "tag string, scope string")
    acl = spark.createDataFrame([("in_ok", '{"Ops": "can_read"}'), ("out_ok", '{"Ops": "can_read"}')],
                                "entity_id string, acl_json string")
    got = rows(C.policy_acl(ents, tags, tm, B.scope_role_table(spark), acl, "/dags"))
    assert got == sorted([("in_ok", "Ops", "DAGs", "can_read"), ("in_ok", "AF_TRIGGER_SCOPE_US", "DAGs", "can_edit"),
                          ("in_ok", "AF_TRIGGER_SCOPE_US", "DAG Runs", "can_create")])
