"""Entitlement fixtures derived from the driver tables (TPC-H-ish parquet).

The driver tables hold no entitlement data, so each fixture below is a lazy view
over them; every one scans whole tables, so its work grows with the scale factor.
The same definitions are written in SQL in ``tagwarden.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwarden.plans.broadcast import broadcast_if_small, literal_lookup

# Fixed binding parameters of the fixtures (not reference values):
TAG_MAP = (("RF_A", "us"), ("OS_F", "us"), ("RF_R", "global"), ("OS_P", "apac"))
ROOT = "/dags/MACHINERY"
MANAGED_SCOPES = ("us", "global")
US_DOC_SOURCES = ("src0", "src3", "src5", "src7")
AS_OF = "1999-01-01 00:00:00"
FILES_AS_OF = "2024-04-15 12:00:00"  # some of the events' days are over 90 days before, some are not


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark, sf_dir) -> DataFrame:
    """(entity_id, path): every order is an entity filed under its customer's segment."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").cast("string").alias("entity_id"),
        F.concat(F.lit("/dags/"), F.col("c_mktsegment"), F.lit("/"), F.col("o_orderkey").cast("string"),
                 F.lit(".py")).alias("path"),
    )


def entity_tags(spark, sf_dir) -> DataFrame:
    """(entity_id, tag): one tag per return flag of the order's lines, plus its status.

    Kept as a multiset: every consumer treats tags as a set and de-duplicates during
    its own (partial, map-side) aggregation, so a separate distinct would only add a shuffle.
    """
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("entity_id"),
        F.concat(F.lit("RF_"), F.col("l_returnflag")).alias("tag"))
    od = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("entity_id"),
        F.concat(F.lit("OS_"), F.col("o_orderstatus")).alias("tag"))
    # padded, blank, null and unmapped (quote and backslash) forms, by key
    k = F.col("o_orderkey")
    odd = table(spark, sf_dir, "orders").select(
        k.cast("string").alias("entity_id"),
        F.when(k % 4 == 0, F.concat(F.lit("  OS_"), F.col("o_orderstatus"), F.lit(" "))).when(k % 4 == 1, F.lit("  "))
        .when(k % 4 == 2, F.lit("it's a \\ tag")).alias("tag"))
    return li.unionByName(od).unionByName(odd)


def wide_tags(spark, sf_dir) -> DataFrame:
    """(entity_id, tag): one tag per part of the order's lines."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("entity_id"),
        F.concat(F.lit("PART_"), F.col("l_partkey").cast("string")).alias("tag"))


def wide_tag_map(spark, sf_dir) -> DataFrame:
    """(tag, scope): every part's tag has a scope by its size; a seventh of the parts has two."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    tag = F.concat(F.lit("PART_"), F.col("p_partkey").cast("string"))
    one = p.select(tag.alias("tag"), F.when(F.col("p_size") < 45, F.lit("us")).otherwise(F.lit("global")).alias("scope"))
    return one.unionByName(p.where(F.col("p_partkey") % 7 == 0).select(tag.alias("tag"), F.lit("apac").alias("scope")))


REGION_ROLES = (("us", "AF_TRIGGER_SCOPE_US"), ("global", "AF_TRIGGER_SCOPE_GLOBAL"), ("apac", "AF_TRIGGER_SCOPE_APAC"),
                ("emea", "AF_TRIGGER_SCOPE_EMEA"))


def region_roles(spark) -> DataFrame:
    """A scope-role map other than the default one."""
    return literal_lookup(spark, REGION_ROLES, "scope string, role string")


def order_tag_arrays(spark, sf_dir) -> DataFrame:
    """(o_orderkey, tags): padded, blank, null and repeated tags; a null array for every fifth order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    st = F.col("o_orderstatus")
    arr = F.array(F.concat(F.lit(" "), st, F.lit("\t")), st, F.lit("  "), F.lit(None).cast("string"),
                  F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("")).otherwise(st))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, arr).alias("tags"))


def tag_map(spark) -> DataFrame:
    return literal_lookup(spark, TAG_MAP, "tag string, scope string")


def grants(spark, sf_dir) -> DataFrame:
    """(role, action, resource) from orders: priority picks the role, the key the action and resource."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    k = F.col("o_orderkey")
    pri = F.substring("o_orderpriority", 1, 1)
    role = (F.when(pri == "1", F.lit("AF_TRIGGER_SCOPE_US"))
            .when(pri.isin("2", "3"), F.lit("AF_TRIGGER_SCOPE_GLOBAL"))
            .otherwise(F.lit("Viewer")))
    action = F.when(k % 5 == 0, F.lit("can_read")).otherwise(F.lit("can_create"))
    resource = F.when(k % 7 == 0, F.concat(F.lit("DAG:"), k.cast("string"))) \
        .otherwise(F.concat(F.lit("DAG Run:"), k.cast("string")))
    return o.select(role.alias("role"), action.alias("action"), resource.alias("resource"))


# ACL documents by order key: flat and nested maps, none, an old target role, a repeated key, cut text,
# other JSON, odd actions, blank, keys equal after stripping, an empty map.
ACL_DOCS = (
    '{"AF_TRIGGER_SCOPE_US":"can_edit","Ops":["can_read","can_edit"]}',
    '{"Ops":{"DAG Runs":["can_read"]," ":["x"]},"AF_TRIGGER_SCOPE_EMEA":["can_edit"]}',
    None,
    '{"AF_TRIGGER_SCOPE_APAC":["can_delete"],"AF_TRIGGER_SCOPE_US":{"DAGs":["can_delete"]},"Biz":"can_read"}',
    '{"Ops":["can_read"],"Ops":["can_edit"],"Biz":["can_read"]}',
    '{"Ops":["can_read"',
    '["can_edit"]',
    '{"Ops":7,"Biz":null,"Dev":["can_read",null,true,12]}',
    "  ",
    '"can_edit"',
    '{"Ops":{" DAGs ":["can_read"],"DAGs":["can_edit"],"DAG Runs":"can_create","X":{"k1":1,"k2":2},"Y":[]}}',
    "{}",
)


def acl(spark, sf_dir) -> DataFrame:
    """(entity_id, acl_json): one of ``ACL_DOCS`` by order key."""
    k = F.col("o_orderkey")
    docs = F.array(*[F.lit(d).cast("string") for d in ACL_DOCS])
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("entity_id"), F.get(docs, (k % len(ACL_DOCS)).cast("int")).alias("acl_json"))


def permission_ops(spark, sf_dir) -> DataFrame:
    """(seq, op, role, action, resource): every event is a grant or revoke on the user's role."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return e.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("value") > 50, F.lit("revoke")).otherwise(F.lit("grant")).alias("op"),
        F.concat(F.lit("ROLE_"), F.col("user_id").cast("string")).alias("role"),
        F.col("event_type").alias("action"),
        F.lit("DAGs").alias("resource"),
    )


def _user_types(spark, sf_dir) -> DataFrame:
    """Every (user, event type) of all events with the sum of its event ids."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return e.groupBy("user_id", "event_type").agg(F.sum("event_id").alias("s")).select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"), F.col("event_type").alias("role"), "s")


def current_roles(spark, sf_dir) -> DataFrame:
    """(username, role): all but about a fifth of each user's event types."""
    return _user_types(spark, sf_dir).where(F.col("s") % 5 != 0).select("username", "role")


def desired_roles(spark, sf_dir) -> DataFrame:
    """(username, role): all but about a seventh of each user's event types."""
    return _user_types(spark, sf_dir).where(F.col("s") % 7 != 0).select("username", "role")


MANAGED_EVENT_ROLES = ("click", "view", "purchase")


def access_requests(spark, sf_dir) -> DataFrame:
    """(request_id, username, entity_id): every event is a trigger attempt on entity ``props.k``."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "props")
    return e.select(F.col("event_id").alias("request_id"),
                    F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
                    F.get_json_object("props", "$.k").alias("entity_id"))


def access_grants(spark, sf_dir) -> DataFrame:
    """(role, action, resource): a per-entity grant from every event (can_create or can_read), plus one global grant."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    scoped = e.select(F.col("event_type").alias("role"),
                      F.when(F.col("event_id") % 40 == 0, F.lit("can_create")).otherwise(F.lit("can_read")).alias("action"),
                      F.concat(F.lit("DAG Run:"), F.get_json_object("props", "$.k")).alias("resource"))
    glob = literal_lookup(spark, [("signup", "can_create", "DAG Runs")], "role string, action string, resource string")
    return scoped.unionByName(glob).distinct()


def global_grants(spark, sf_dir) -> DataFrame:
    """(role, action, resource) from customers; the role is the scope role of the customer's nation."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # nation is a small dimension keyed on a 25-value column: broadcast it, never shuffle customers on it
    n = broadcast_if_small(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    k = F.col("c_custkey")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    return j.select(
        F.concat(F.lit("AF_TRIGGER_SCOPE_"), F.upper(F.regexp_replace("n_name", " ", "_"))).alias("role"),
        F.when(k % 50 == 0, F.lit("can_create")).otherwise(F.lit("can_read")).alias("action"),
        F.when(k % 3 == 0, F.lit("DAG Runs")).otherwise(F.concat(F.lit("DAG Run:"), k.cast("string"))).alias("resource"),
    )


def managed_nation_roles(spark, sf_dir) -> DataFrame:
    """Scope roles that count as managed: those of the nations in region AMERICA or ASIA."""
    n = table(spark, sf_dir, "nation")
    r = broadcast_if_small(table(spark, sf_dir, "region").where(F.col("r_name").isin("AMERICA", "ASIA")))
    return n.join(r, n.n_regionkey == r.r_regionkey, "left_semi").select(
        F.concat(F.lit("AF_TRIGGER_SCOPE_"), F.upper(F.regexp_replace("n_name", " ", "_"))).alias("role"))


def tag_map_texts(spark, sf_dir) -> DataFrame:
    """(o_orderkey, text): one tag-map text per order, mixing valid, repeated, blank and bad items.

    Every seventh order carries a text with nothing valid in it (so the defaults apply).
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    k = F.col("o_orderkey")
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    items = F.concat_ws(
        ",",
        F.concat(F.lit(" OS_"), st, F.lit(" = "), pr),
        F.when(k % 3 == 0, F.concat(F.lit("OS_"), st, F.lit("=late="), F.col("o_custkey").cast("string"))),
        F.when(k % 4 == 1, F.lit("junk")).otherwise(F.concat(F.lit("="), st)),
        F.lit(" "),
        F.concat(F.lit("P"), F.substring(pr, 1, 1), F.lit("= "), F.upper(st), F.lit(" ")),
    )
    text = F.when(k % 7 == 0, F.lit(" , =x, A= ")).otherwise(items)
    return o.select("o_orderkey", text.alias("text"))


def scope_texts(spark, sf_dir) -> DataFrame:
    """(c_custkey, text): a scope-list text per customer: segment, nation name, blanks, maybe 'Global'."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = broadcast_if_small(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    text = F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" , "), F.lower("n_name"), F.lit(",,"),
                    F.when(F.col("c_custkey") % 2 == 0, F.lit(" Global ")).otherwise(F.lit("")))
    return j.select("c_custkey", text.alias("text"))


def segment_roles(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(wanted, present) role names ``ROLE_<segment>_<nation>``: wanted from all customers,
    present from customers with a negative balance (roles already created)."""
    c = table(spark, sf_dir, "customer")
    role = F.concat(F.lit("ROLE_"), F.col("c_mktsegment"), F.lit("_"), F.col("c_nationkey").cast("string"))
    wanted = c.select(role.alias("role"))
    present = c.where(F.col("c_acctbal") < 0).select(role.alias("role"))
    return wanted, present


SEGMENT_PROFILE = (("AUTOMOBILE", "normal"), ("BUILDING", "us_user"), ("FURNITURE", "nonus_priv"),
                   ("HOUSEHOLD", "us_priv"), ("MACHINERY", "admin_observer"))
PRIORITY_WEIGHTS = (("1-URGENT", 5), ("2-HIGH", 4), ("3-MEDIUM", 3), ("4-NOT SPECIFIED", None))
GROUP_ROLES = (("1-URGENT", "Viewer"), ("2-HIGH", "Viewer"), ("3-MEDIUM", "AF_RERUN_ALL_NO_TRIGGER"))


def customer_profiles(spark, sf_dir) -> DataFrame:
    """(username, profile, strict): every customer gets the profile of its segment; negative balance = strict."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    prof = F.create_map(*[x for s, p in SEGMENT_PROFILE for x in (F.lit(s), F.lit(p))])
    return c.select(F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")).alias("username"),
                    F.element_at(prof, F.col("c_mktsegment")).alias("profile"),
                    (F.col("c_acctbal") < 0).alias("strict"))


def event_users(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(wanted, present) usernames: all event users / those with an event value below 0.5."""
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username")
    return e.select(name), e.where(F.col("value") < 0.5).select(name)


def teardown_targets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(targets, present): suppliers as users and nations as roles; present users have a
    positive balance, present roles are the nations of suppliers in debt."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    uname = F.concat(F.lit("supp_"), F.col("s_suppkey").cast("string"))
    rname = F.concat(F.lit("ROLE_"), F.regexp_replace("n_name", " ", "_"))
    targets = s.select(F.lit("user").alias("kind"), uname.alias("name")).unionByName(
        n.select(F.lit("role").alias("kind"), rname.alias("name")))
    debt = s.where(F.col("s_acctbal") < 0).select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    present = s.where(F.col("s_acctbal") > 0).select(F.lit("user").alias("kind"), uname.alias("name")).unionByName(
        n.join(debt, "n_nationkey", "left_semi").select(F.lit("role").alias("kind"), rname.alias("name")))
    return targets, present


def order_groups(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(user_groups, mapping): each customer is in the group of every priority it ordered with."""
    o = table(spark, sf_dir, "orders")
    ug = o.select(F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("username"),
                  F.col("o_orderpriority").alias("group"))
    mapping = literal_lookup(spark, GROUP_ROLES, "group string, role string")
    return ug, mapping


def role_list_texts(spark, sf_dir) -> DataFrame:
    """(user_id, username, text): each user's sorted event types as a list literal;
    odd users use double quotes and loose spacing."""
    e = table(spark, sf_dir, "events")
    per = e.groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("types"))
    odd = F.col("user_id") % 2 == 1
    sq = F.concat(F.lit("["), F.array_join(F.transform("types", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "),
                  F.lit("]"))
    dq = F.concat(F.lit("[ "), F.array_join(F.transform("types", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " , "),
                  F.lit(" ]"))
    return per.select("user_id", F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
                      F.when(odd, dq).otherwise(sq).alias("text"))


def user_listing_lines(spark, sf_dir) -> DataFrame:
    """(pos, value): a user listing rendered from events - a header, then one line per user;
    even users have a leading numeric id column, odd users do not."""
    r = role_list_texts(spark, sf_dir)
    uname = F.col("username")
    body = F.concat_ws(" ", F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")), uname,
                       F.concat(uname, F.lit("@example.local")), F.lit("First"), F.lit("Last"), F.col("text"))
    lines = r.select((F.col("user_id") + 1).alias("pos"), body.alias("value"))
    header = spark.createDataFrame([(0, LISTING_HEADER)], "pos bigint, value string")
    return header.unionByName(lines)


def listing_file_lines(spark, sf_dir) -> DataFrame:
    """(pos, value): the user lines of ``user_listing_lines`` at even places, and for every third user one more line with
    another role at an odd place, before or after."""
    lines = user_listing_lines(spark, sf_dir).where(F.col("pos") > 0)
    u = F.col("pos") - 1
    more = F.concat(F.lit("user_"), u.cast("string"), F.lit(" more@example.local First Last ['LATE_"), (u % 4).cast("string"), F.lit("']"))
    return lines.select((2 * u).alias("pos"), "value").unionByName(
        lines.where(u % 3 == 0).select((2 * ((31 * u) % 61) + 1).alias("pos"), more.alias("value")))


LISTING_HEADER = "id username email first_name last_name roles"


def log_lines(spark, sf_dir) -> DataFrame:
    """(event_id, value): every event rendered as a manager log line.

    error -> ``[ts] [ERROR] ...``; view -> no level; click -> bracketed text after the
    level; big purchases -> a stack-trace line with no time stamp; others ``[ts] [INFO] ...``.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    ts = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "))
    msg = F.concat(F.col("event_type"), F.lit(" user="), F.col("user_id").cast("string"))
    t = F.col("event_type")
    line = (F.when(t == "error", F.concat(ts, F.lit("[ERROR] "), msg))
            .when(t == "view", F.concat(ts, msg))
            .when(t == "click", F.concat(ts, F.lit("[INFO] [k="), F.get_json_object("props", "$.k"), F.lit("] "), msg))
            .when((t == "purchase") & (F.col("value") > 400),
                  F.concat(F.lit("  at job.step("), F.col("event_id").cast("string"), F.lit(")")))
            .otherwise(F.concat(ts, F.lit("[INFO] "), msg)))
    return e.select("event_id", line.alias("value"))


def log_file_lines(spark, sf_dir) -> DataFrame:
    """(script, env, log_date, event_id, ts, value): the lines of ``log_lines`` in the daily files of 20 services."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    named = e.select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"),
                     F.concat(F.lit("svc-"), (F.col("user_id") % 20).cast("string")).alias("script"),
                     F.when(F.col("user_id") % 2 == 0, F.lit("dev")).otherwise(F.lit("prod")).alias("env"),
                     F.col("ts").cast("date").alias("log_date"))
    return named.join(log_lines(spark, sf_dir), "event_id")


def observations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(obs, services): every event is a process observation of its user's service of that day.

    signup = control tool (1), view = pid file (2), others = process match (3); two thirds are
    live. A service is managed when it has a view or a purchase.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    service = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd"))
    src = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    obs = e.select(service.alias("service"), src.alias("source"), F.col("event_id").alias("ord"),
                   F.col("event_id").alias("pid"), (F.col("event_id") % 3 != 0).alias("live"))
    services = e.groupBy(service.alias("service")).agg(
        F.max(F.col("event_type").isin("purchase", "view")).alias("managed"))
    return obs, services


def auth_pages(spark, sf_dir) -> DataFrame:
    """(page_id, text, url): pages whose text ends in a failure message and whose url has a principal, by key."""
    k = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat("html", F.when(k % 4 == 0, F.lit(" SASL Negotiation failure")).when(k % 4 == 1, F.lit(" gss INITIATE failed"))
                 .otherwise(F.lit(" done"))).alias("text"),
        F.concat("url", F.when(k % 3 == 0, F.lit(";Principal=hive/x")).otherwise(F.lit(""))).alias("url"))


def present_customers(spark, sf_dir) -> DataFrame:
    """Customers that already exist as users: those with a positive balance."""
    c = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0)
    return c.select(F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")).alias("username"))
