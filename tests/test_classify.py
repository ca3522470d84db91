from pyspark.sql import functions as F

from tagwarden.operators import classify as B
from tests.conftest import rows


def test_parse_tag_map_malformed(spark):
    texts = [
        (1, ""), (2, "A"), (3, "=x"), (4, "A="), (5, " A = X "), (6, "A=b=c"), (7, "A=x, A=y"),
        (8, " , =x, nope "), (9, None), (10, "T1=US,bad,T2 = mx, T1 = Global"),
    ]
    df = spark.createDataFrame(texts, "id int, text string")
    got = {}
    for r in B.parse_tag_map(df, "text", keep=["id"]).collect():
        got.setdefault(r["id"], {})[r["tag"]] = (r["scope"], r["origin"])
    defaults = {"GDTET_GLOBAL_DAG": ("global", "default"), "GDTET_US_DAG": ("us", "default")}
    for i in (1, 2, 3, 4, 8, 9):
        assert got[i] == defaults, i
    assert got[5] == {"A": ("x", "parsed")}
    assert got[6] == {"A": ("b=c", "parsed")}
    assert got[7] == {"A": ("y", "parsed")}  # last wins
    assert got[10] == {"T1": ("global", "parsed"), "T2": ("mx", "parsed")}
    rej = rows(B.tag_map_rejects(df, "text", keep=["id"]), "id", "item", "reason")
    assert (2, "A", "missing '='") in rej
    assert (3, "=x", "empty tag/scope") in rej
    assert (10, "bad", "missing '='") in rej
    assert all(r[1] != "" for r in rej)  # blank items are skipped silently


def test_under_root_segments(spark):
    paths = ["/dags", "/dags/a.py", "/dags2/x.py", "/dags/../x.py", "/dags/sub/../b.py", "/dags/", None, "/other"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: r["u"] for r in df.select("path", B.under_root("path", "/dags").alias("u")).collect()}
    assert got == {"/dags": True, "/dags/a.py": True, "/dags2/x.py": False, "/dags/../x.py": False,
                   "/dags/sub/../b.py": True, "/dags/": True, None: False, "/other": False}


def _fixture(spark):
    ents = spark.createDataFrame(
        [("e1", "/dags/camp_us/1.py"), ("e2", "/dags/mdm/2.py"), ("e3", "/dags/global/3.py"),
         ("e4", "/dags/global/4.py"), ("e5", "/dags/5.py"), ("e6", "/dags/6.py"), ("e7", "/elsewhere/7.py"),
         ("e8", "/dags/8.py"), ("e9", "/dags/9.py")], "entity_id string, path string")
    tags = spark.createDataFrame(
        [("e1", "GDTET_US_DAG"), ("e1", "biz"), ("e2", " GDTET_US_DAG "), ("e3", "GDTET_GLOBAL_DAG"),
         ("e4", "GDTET_GLOBAL_DAG"), ("e4", "GDTET_GLOBAL_DAG"), ("e5", "biz"),
         ("e6", "GDTET_US_DAG"), ("e6", "GDTET_GLOBAL_DAG"), ("e7", "GDTET_US_DAG"), ("e7", "GDTET_GLOBAL_DAG"),
         ("e8", "GDTET_MX_DAG"), ("e9", "US2"), ("e9", "GDTET_US_DAG")], "entity_id string, tag string")
    tmap = spark.createDataFrame([("GDTET_US_DAG", "us"), ("GDTET_GLOBAL_DAG", "global"), ("GDTET_MX_DAG", "apac"),
                                  ("US2", "us")], "tag string, scope string")
    return ents, tags, tmap


def test_classify_statuses_and_same_scope_tags(spark):
    ents, tags, tmap = _fixture(spark)
    c = {r["entity_id"]: (r["status"], r["scope"]) for r in B.classify(ents, tags, tmap).collect()}
    assert c["e1"] == ("valid", "us")
    assert c["e2"] == ("valid", "us")  # trimmed in the policy form
    assert c["e5"] == ("missing", None)
    assert c["e6"] == ("conflict", None)
    assert c["e9"] == ("valid", "us")  # two tags, same scope
    raw = {r["entity_id"]: r["status"] for r in B.classify(ents, tags, tmap, trim_tags=False).collect()}
    assert raw["e2"] == "missing"  # the sync form matches raw tags


def test_resolve_role_and_violations(spark):
    ents, tags, tmap = _fixture(spark)
    sr = B.scope_role_table(spark)
    r = {x["entity_id"]: (x["status"], x["role"]) for x in B.resolve_role(B.classify(ents, tags, tmap), sr).collect()}
    assert r["e8"] == ("no_role", None)
    assert r["e1"] == ("valid", "AF_TRIGGER_SCOPE_US")
    v = {x["entity_id"]: x for x in B.violations(ents, tags, tmap, sr, "/dags").collect()}
    assert set(v) == {"e5", "e6", "e8"}  # e7 is outside the root: not judged
    assert v["e6"]["message"] == ("DAG 'e6' has conflicting classification tags ['GDTET_GLOBAL_DAG', 'GDTET_US_DAG']; "
                                  "expected exactly one classification tag.")
    assert v["e5"]["message"] == ("DAG 'e5' is missing required classification tag. Expected one of "
                                  "['GDTET_GLOBAL_DAG', 'GDTET_MX_DAG', 'GDTET_US_DAG', 'US2'], got tags=['biz']")
    assert v["e8"]["message"] == "No trigger role mapping configured for scope 'apac'"


def test_desired_grants_managed_only(spark):
    ents, tags, tmap = _fixture(spark)
    d = rows(B.desired_grants(ents, tags, tmap, ["us", "global"], "/dags"))
    assert d == [("global", "e3"), ("global", "e4"), ("us", "e1"), ("us", "e9")]


def test_one_rule_at_every_map_size(spark):
    ents = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "entity_id string")
    tags = spark.createDataFrame([("a", "T"), ("a", "U"), ("b", "U"), ("c", "two"), ("d", "T"), ("d", "T2"), ("b", "zz")],
                                 "entity_id string, tag string")
    expect = [("a", "valid", "us", ["T"]), ("b", "missing", None, []), ("c", "conflict", None, ["two"]),
              ("d", "valid", "us", ["T", "T2"])]
    for more in (0, 1100, 20_000):
        pairs = [("T", "us"), ("T2", "us"), ("U", None), ("two", "us"), ("two", "global"), (None, "us")]
        tm = spark.createDataFrame(pairs + [(f"m{i}", "apac") for i in range(more)], "tag string, scope string")
        assert rows(B.classify(ents, tags, tm), "entity_id", "status", "scope", "matched_tags") == expect
        paths = ents.select("entity_id", F.lit("/dags/x").alias("path"))
        v = {r.entity_id: r for r in B.violations(paths, tags, tm, B.scope_role_table(spark), "/dags").collect()}
        assert set(v) == {"b", "c"} and v["b"].actual_tags == "['U', 'zz']"
        assert v["c"].expected_tags.count(",") == more + 3


def test_repeated_entities_give_one_grant(spark):
    ents = spark.createDataFrame([("a", "/dags/a"), ("a", "/dags/b")], "entity_id string, path string")
    tags = spark.createDataFrame([("a", "T")], "entity_id string, tag string")
    tm = spark.createDataFrame([("T", "us")], "tag string, scope string")
    assert rows(B.desired_grants(ents, tags, tm, ["us"], "/dags")) == [("us", "a")]


def test_resolve_root_first_usable_value():
    assert B.resolve_root("", None, "/dags") == "/dags"
    assert B.resolve_root(None, "/cfg/dags/", "/dags") == "/cfg/dags"
    assert B.resolve_root("/x/../root", "/cfg", "/dags") == "/root"
