"""Randomised inputs in one DataFrame each, checked against plain-Python versions of
the documented rules (brute force on small fixtures)."""
import posixpath
import random
import re

from pyspark.sql import functions as F

from tagwarden.functions import normalize_scopes
from tagwarden.operators import classify as B
from tagwarden.operators import grants as C
from tagwarden.operators import members as D
from tests.conftest import rows

RNG = random.Random(7)
ALPHA = ["A", "b", "US", "x", "=", ",", " ", "\t", "T1", "T2", "mx", ""]


def py_tag_map(text):
    """One expression per comma part: some non-blank text, the first equals sign, some non-blank text."""
    pairs = re.findall(r"(?:^|(?<=,))\s*([^=,\s](?:[^=,]*[^=,\s])?)\s*=\s*([^,\s](?:[^,]*[^,\s])?)\s*(?=,|$)", text or "")
    return {t: s.lower() for t, s in pairs} or {"GDTET_GLOBAL_DAG": "global", "GDTET_US_DAG": "us"}


def rand_text(n):
    return "".join(RNG.choice(ALPHA) for _ in range(n))


def test_tag_map_parse_matches_rules(spark):
    texts = [(i, rand_text(RNG.randint(0, 25))) for i in range(400)] + [(400, None)]
    df = spark.createDataFrame(texts, "id int, text string")
    got = {}
    for r in B.parse_tag_map(df, "text", keep=["id"]).collect():
        got.setdefault(r["id"], {})[r["tag"]] = r["scope"]
    assert got == {i: py_tag_map(t) for i, t in texts}


def test_scopes_match_rules(spark):
    texts = [(i, rand_text(RNG.randint(0, 15))) for i in range(300)]
    df = spark.createDataFrame(texts, "id int, text string")
    out = df.select("id", normalize_scopes("text").alias("l"), normalize_scopes("text", strict=True).alias("s"))
    for r in out.collect():
        t = texts[r["id"]][1]
        lenient = {x.strip().lower() for x in t.split(",") if x.strip()} | {"global"}
        squeezed = "".join(t.lower().split())
        strict = None if not squeezed else ({x for x in squeezed.split(",") if x} | {"global"})
        assert set(r["l"]) == lenient
        assert (set(r["s"]) if r["s"] is not None else None) == strict


def py_role_list(text):
    """What stands between the first bracket and the last closing one (or the end), without blanks and quotes, by commas."""
    inside = re.search(r"\[(.*)\]|\[([^\]]*)$", text, re.S)
    return re.findall(r"[^,]+", re.sub(r"[\s'\"]", "", next((g for g in inside.groups() if g is not None), ""))) if inside else []


def test_role_list_matches_rules(spark):
    parts = ["[", "]", "'", '"', ",", " ", "Viewer", "A", "x y"]
    texts = [(str(i), "".join(RNG.choice(parts) for _ in range(RNG.randint(0, 12)))) for i in range(300)]
    df = spark.createDataFrame(texts, "username string, text string")
    got = {}
    for r in D.parse_role_list(df, "text").collect():
        got.setdefault(r["username"], set()).add(r["role"])
    want = {u: set(py_role_list(t)) for u, t in texts if py_role_list(t)}
    assert got == want


def test_under_root_matches_rules(spark):
    segs = ["dags", "dags2", "..", ".", "", "a", "b.py"]
    paths = ["/" + "/".join(RNG.choice(segs) for _ in range(RNG.randint(0, 5))) for _ in range(400)]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: r["u"] for r in df.select("path", B.under_root("path", "/dags").alias("u")).collect()}
    for p in paths:
        n = posixpath.normpath("/" + p.lstrip("/"))  # the standard library's lexical rule
        assert got[p] == (n == "/dags" or n.startswith("/dags/")), p


def test_diff_apply_reconcile_properties(spark):
    keys = [("us", str(i)) for i in range(60)] + [("global", str(i)) for i in range(60)]
    desired = set(RNG.sample(keys, 50))
    existing = set(RNG.sample(keys, 50))
    sch = "scope string, entity_id string"
    d, e = spark.createDataFrame(sorted(desired), sch), spark.createDataFrame(sorted(existing), sch)
    diff = C.diff_grants(d, e)
    assert rows(diff) == sorted([(s, "add", i) for s, i in desired - existing] +
                                [(s, "remove", i) for s, i in existing - desired])
    assert rows(C.apply_diff(e, diff)) == sorted(desired)
    users = [f"u{i}" for i in range(12)]
    roles = ["Viewer", "AF_RERUN_ALL_NO_TRIGGER", "AF_TRIGGER_SCOPE_US", "X"]
    cur = {(u, r) for u in users for r in roles if RNG.random() < 0.5}
    des = {(u, r) for u in users[:8] for r in roles[:3] if RNG.random() < 0.5}
    us = "username string, role string"
    got = rows(D.reconcile_roles(spark.createDataFrame(sorted(cur), us), spark.createDataFrame(sorted(des), us)))
    des_users = {u for u, _ in des}
    want = sorted([(u, "add", r) for u, r in des - cur] +
                  [(u, "remove", r) for u, r in cur - des if u in des_users and r in D.MANAGED_TEST_ROLES])
    assert got == want


def test_classify_matches_rules(spark):
    tags_all = [f"T{i:03d}" for i in range(200)]
    scope_of = {t: RNG.choice(["us", "global", "mx"]) for t in tags_all}
    ents = [f"e{i}" for i in range(150)]
    rows_ = [(e, RNG.choice(tags_all + ["other", " T001 "])) for e in ents for _ in range(RNG.randint(0, 4))]
    e_df = spark.createDataFrame([(e,) for e in ents], "entity_id string")
    t_df = spark.createDataFrame(rows_, "entity_id string, tag string")
    m_df = spark.createDataFrame(sorted(scope_of.items()), "tag string, scope string")
    got = {r["entity_id"]: (r["status"], r["scope"], list(r["matched_tags"])) for r in B.classify(e_df, t_df, m_df).collect()}
    for e in ents:
        matched = sorted({t.strip() for x, t in rows_ if x == e} & set(scope_of))
        scopes = {scope_of[t] for t in matched}
        status = "valid" if len(scopes) == 1 else "conflict" if scopes else "missing"
        assert got[e] == (status, next(iter(scopes)) if status == "valid" else None, matched), e
