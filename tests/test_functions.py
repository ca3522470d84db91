from pyspark.sql import functions as F

from tagwarden.functions import (
    first_non_empty, label_from_tag, normalize_path, normalize_scopes, normalize_tags, py_list_repr,
    scope_role_name, shell_quote, tag_from_source,
)

# The source systems of the labelled fixture.
US_SOURCES = ("camp-us", "ucm", "norkom", "mdm")


def one(spark, expr, schema, value):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_normalize_scopes_lenient_and_strict(spark):
    df = spark.createDataFrame([(1, "US, us ,"), (2, ""), (3, "u s,MX"), (4, None)], "id int, t string")
    out = {r["id"]: (sorted(r["l"]) if r["l"] is not None else None, sorted(r["s"]) if r["s"] is not None else None)
           for r in df.select("id", normalize_scopes("t").alias("l"), normalize_scopes("t", strict=True).alias("s"))
           .collect()}
    assert out[1] == (["global", "us"], ["global", "us"])
    assert out[2] == (["global"], None)  # strict rejects empty text
    assert out[3] == (["global", "mx", "u s"], ["global", "mx", "us"])  # strict joins inner spaces
    assert out[4] == (["global"], None)


def test_scope_role_name(spark):
    assert one(spark, scope_role_name("s"), "s string", "us") == "AF_TRIGGER_SCOPE_US"


def test_first_non_empty(spark):
    df = spark.createDataFrame([("", None, "/d"), (None, "/cfg", "/d"), ("/x", "/cfg", "/d")], "a string, b string, c string")
    assert [r[0] for r in df.select(first_non_empty("a", "b", "c")).collect()] == ["/d", "/cfg", "/x"]


def test_normalize_tags_array_string_null(spark):
    df = spark.createDataFrame([([" a ", "a", "", "  ", "b"],), (None,)], "t array<string>")
    got = [sorted(r[0]) for r in df.select(normalize_tags("t")).collect()]
    assert got == [["a", "b"], []]
    s = spark.createDataFrame([(" x ",), ("  ",), (None,)], "t string")
    assert [r[0] for r in s.select(normalize_tags("t", is_string=True)).collect()] == [["x"], [], []]


def test_normalize_path_cases(spark):
    cases = {"/dags": "/dags", "/dags/": "/dags", "/dags/../x": "/x", "/dags//a/./b": "/dags/a/b", "/..": "/",
             "": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r["p"]: r["n"] for r in df.select("p", normalize_path("p").alias("n")).collect()}
    assert got == cases


def test_py_list_repr_and_shell_quote(spark):
    df = spark.createDataFrame([(["b", "a"],), ([],)], "a array<string>")
    assert [r[0] for r in df.select(py_list_repr("a")).collect()] == ["['a', 'b']", "[]"]
    q = spark.createDataFrame([("DAG Run:1",), ("safe_x-1",), ("it's",), ("",)], "s string")
    assert [r[0] for r in q.select(shell_quote("s")).collect()] == ["'DAG Run:1'", "safe_x-1", "'it'\"'\"'s'", "''"]


def test_source_tag_and_label(spark):
    # the five generated entities of the reference: camp-us, mdm -> us; abc, hub -> global; none -> illegal
    df = spark.createDataFrame([("camp-us",), ("mdm",), ("abc",), ("hub",), (None,)], "source string")
    tag = tag_from_source("source", US_SOURCES)
    got = [r[0] for r in df.select(label_from_tag(tag)).collect()]
    assert got == ["us_dag", "us_dag", "global_dag", "global_dag", "illegal_dag"]
    assert [r[0] for r in df.select(tag).collect()] == ["GDTET_US_DAG", "GDTET_US_DAG", "GDTET_GLOBAL_DAG",
                                                        "GDTET_GLOBAL_DAG", None]


def test_quoting_and_python_lists(spark):
    import shlex
    import subprocess

    from tagwarden.functions.text import bash_quote, py_list_repr
    texts = ["a", "", "a b", "x\n", "it's", "DAG Run:x", "$(id)", "a,b", "~x", "#c", "a\tb", "é", "a\\b", "'\"", "*", "k=v;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", shell_quote("t").alias("s"), bash_quote("t").alias("b")).collect():
        assert r.s == shlex.quote(r.t)
        back = subprocess.run(["bash", "-c", f"printf %s {r.b}X"], capture_output=True, text=True).stdout
        assert back == r.t + "X", r
    df = spark.createDataFrame([(texts,)], "a array<string>")
    assert df.select(py_list_repr("a").alias("l")).first().l == repr(sorted(texts))
