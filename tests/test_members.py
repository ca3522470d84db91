from tagwarden.operators import members as D
from tests.conftest import rows

# The users and roles that a teardown removes.
TEST_USERS = ("rbac_normal", "rbac_us_user", "rbac_nonus_priv", "rbac_us_priv", "rbac_admin_observer")
CUSTOM_ROLES = ("AF_RERUN_ALL_NO_TRIGGER", "AF_ADMIN_OBSERVER_NO_DAG", "AF_TRIGGER_SCOPE_GLOBAL",
                "AF_TRIGGER_SCOPE_NONUS", "AF_TRIGGER_SCOPE_US", "AF_TRIGGER_SCOPE_MX", "AF_TRIGGER_SCOPE_CN")


def test_listing_and_role_lists(spark):
    lines = spark.createDataFrame([
        (0, "id username email first_name last_name roles"),
        (1, "1 bob bob@x B B ['Viewer', 'A']"),
        (2, "carol carol@x C C []"),
        (3, "42"),
        (4, "3 dave dave@x D D [ \"Viewer\" , 'Op' ]"),
        (5, ""),
    ], "pos long, value string")
    users = rows(D.parse_user_listing(lines, pos_col="pos"), "username")
    assert users == [("42",), ("bob",), ("carol",), ("dave",)]
    no_pos = rows(D.parse_user_listing(lines.select("value")), "username")
    assert no_pos == sorted([*users, ("id",)])  # without positions no line is taken for a header
    texts = spark.createDataFrame([("a", "['Viewer', 'A']"), ("b", "[]"), ("c", "Viewer, A"),
                                   ("d", "x [ 'R 1' ,\"R2\"] tail ] end"), ("e", "['A', 'A']")],
                                  "username string, text string")
    got = rows(D.parse_role_list(texts, "text"))
    # first '[' to last ']'; an inner ']' is kept, only whitespace and quotes are removed
    assert got == [("a", "A"), ("a", "Viewer"), ("d", "R1"), ("d", "R2]tail"), ("e", "A")]


def test_reconcile_roles_and_aligned(spark):
    current = spark.createDataFrame([("u1", "Viewer"), ("u1", "X_UNMANAGED"), ("u1", "AF_TRIGGER_SCOPE_US"),
                                     ("u2", "Viewer"), ("u3", "Viewer"), ("u3", "AF_RERUN_ALL_NO_TRIGGER"),
                                     ("u9", "Viewer")], "username string, role string")
    desired = spark.createDataFrame([("u1", "Viewer"), ("u1", "AF_RERUN_ALL_NO_TRIGGER"), ("u2", "Viewer"),
                                     ("u2", "AF_TRIGGER_SCOPE_GLOBAL"), ("u3", "Viewer"),
                                     ("u3", "AF_RERUN_ALL_NO_TRIGGER")], "username string, role string")
    got = rows(D.reconcile_roles(current, desired))
    assert got == [("u1", "add", "AF_RERUN_ALL_NO_TRIGGER"), ("u1", "remove", "AF_TRIGGER_SCOPE_US"),
                   ("u2", "add", "AF_TRIGGER_SCOPE_GLOBAL")]  # u9 is not in desired: untouched
    assert rows(D.aligned_users(current, desired)) == [("u3",)]


def test_role_matrix_normal_and_strict(spark):
    profiles = spark.createDataFrame([(p, p, s) for p in D.PROFILE_ROLES for s in (False, True)],
                                     "username string, profile string, strict boolean")
    got = {}
    for r in D.desired_roles(profiles.selectExpr("username || ':' || cast(strict as string) as username",
                                                 "profile", "strict")).collect():
        got.setdefault(r["username"], set()).add(r["role"])
    assert got["us_priv:false"] == {"Viewer", "AF_TRIGGER_SCOPE_US", "AF_TRIGGER_SCOPE_GLOBAL",
                                    "AF_RERUN_ALL_NO_TRIGGER"}
    assert got["us_priv:true"] == {"Viewer", "AF_TRIGGER_SCOPE_US", "AF_TRIGGER_SCOPE_GLOBAL"}
    assert got["normal:true"] == {"Viewer", "AF_RERUN_ALL_NO_TRIGGER"}  # strict only affects trigger users
    assert got["admin_observer:true"] == {"AF_ADMIN_OBSERVER_NO_DAG"}
    assert got["us_user:true"] == {"Viewer", "AF_TRIGGER_SCOPE_US"}


def test_create_teardown_groups(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("b",)], "username string")
    present = spark.createDataFrame([("b",)], "username string")
    assert rows(D.users_to_create(wanted, present)) == [("a", "Viewer")]
    targets = spark.createDataFrame([("user", u) for u in TEST_USERS] + [("role", r) for r in CUSTOM_ROLES],
                                    "kind string, name string")
    pres = spark.createDataFrame([("user", "rbac_normal"), ("role", "AF_TRIGGER_SCOPE_US")], "kind string, name string")
    plan = {(r["kind"], r["name"]): r["action"] for r in D.teardown_plan(targets, pres).collect()}
    assert plan[("user", "rbac_normal")] == "delete" and plan[("user", "rbac_us_user")] == "skip"
    assert sum(1 for v in plan.values() if v == "delete") == 2 and len(plan) == 12
    dry = D.teardown_plan(targets, pres, dry_run=True)
    assert {r["action"] for r in dry.collect()} == {"delete"}
    ug = spark.createDataFrame([("u1", "G_VIEW"), ("u1", "G_VIEW2"), ("u2", "G_NONE")], "username string, group string")
    m = spark.createDataFrame([("G_VIEW", "Viewer"), ("G_VIEW2", "Viewer"), ("G_VIEW2", "AF_RERUN_ALL_NO_TRIGGER")],
                              "group string, role string")
    assert rows(D.roles_from_groups(ug, m)) == [("u1", "AF_RERUN_ALL_NO_TRIGGER"), ("u1", "Viewer")]


def test_read_listing_file(spark):
    import os
    import tempfile

    d = tempfile.mkdtemp(prefix="tw-listing-", dir="/tmp")
    with open(os.path.join(d, "users.txt"), "w") as f:
        f.write("id username email first_name last_name roles\n"
                "1 bob bob@x B B ['Viewer']\n"
                "carol carol@x C C ['Op', 'Viewer']\n")
    users = D.read_listing(spark, d)
    assert rows(users, "username") == [("bob",), ("carol",)]
    assert rows(D.parse_role_list(users, "line")) == [("bob", "Viewer"), ("carol", "Op"), ("carol", "Viewer")]


def test_user_plan_created_viewer_is_removed_again(spark):
    profiles = spark.createDataFrame([("obs", "admin_observer", False), ("n", "normal", False)],
                                     "username string, profile string, strict boolean")
    desired = D.desired_roles(profiles)
    present = spark.createDataFrame([("n",)], "username string")
    current = spark.createDataFrame([("n", "Viewer"), ("n", "X_UNMANAGED")], "username string, role string")
    got = rows(D.user_plan(current, desired, present))
    assert got == [("n", "add", "AF_RERUN_ALL_NO_TRIGGER"),
                   ("obs", "add", "AF_ADMIN_OBSERVER_NO_DAG"),
                   ("obs", "create", "Viewer"),
                   ("obs", "remove", "Viewer")]


def test_listing_header_is_the_first_line_of_each_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("NAME x\nid i@x\n7 username u@x ['Viewer']\n\n12\n")
    (tmp_path / "b.txt").write_text("id username\nbob b@x \"q\" ['A', 'B']\n")
    got = rows(D.read_listing(spark, str(tmp_path)), "username")
    assert got == [("12",), ("bob",), ("id",), ("username",)]


def test_user_plan_dry_run_lists_everything(spark):
    cur = spark.createDataFrame([("u", "A")], "username string, role string")
    des = spark.createDataFrame([("u", "A"), ("u", "A"), ("v", "B")], "username string, role string")
    got = rows(D.user_plan(cur, des, cur.select("username"), dry_run=True), "username", "op", "role")
    assert got == [("u", "add", "A"), ("u", "create", "Viewer"), ("v", "add", "B"), ("v", "create", "Viewer")]
