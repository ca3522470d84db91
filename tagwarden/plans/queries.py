"""Query registry: each key binds operators to fixture views over the driver tables.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose column
names match the SQL twin in ``tagwarden.plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwarden.functions.tags import label_from_tag, normalize_scopes, normalize_tags, scope_role_name, tag_from_source
from tagwarden.functions.text import explode_rows, first_non_empty
from tagwarden.operators import classify as B
from tagwarden.operators import grants as C
from tagwarden.operators import members as D
from tagwarden.operators import logs as E
from tagwarden.sources import fixtures as fx
from tagwarden.sources import tables as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ------------------------------------------------------------------ family B
@query("classify_status")
def classify_status(spark, sf_dir):
    c = B.classify(fx.entities(spark, sf_dir), fx.entity_tags(spark, sf_dir), fx.tag_map(spark), trim_tags=True)
    return c.select("entity_id", "status", "scope", F.array_join("matched_tags", ",").alias("matched_tags"))


@query("classify_wide")
def classify_wide(spark, sf_dir):
    c = B.classify(fx.entities(spark, sf_dir), fx.wide_tags(spark, sf_dir), fx.wide_tag_map(spark, sf_dir))
    return c.select("entity_id", "status", "scope", F.array_join("matched_tags", ",").alias("matched_tags"))


@query("tags_norm")
def tags_norm(spark, sf_dir):
    t = fx.order_tag_arrays(spark, sf_dir)
    return t.select("o_orderkey", F.array_join(normalize_tags("tags"), "|").alias("tags"))


@query("no_role")
def no_role(spark, sf_dir):
    c = B.classify(fx.entities(spark, sf_dir), fx.entity_tags(spark, sf_dir), fx.tag_map(spark), trim_tags=True)
    r = B.resolve_role(c, B.scope_role_table(spark))
    return r.select("entity_id", "status", "scope", "role")


@query("outside_root")
def outside_root(spark, sf_dir):
    e = fx.entities(spark, sf_dir)
    return e.select("entity_id", "path", B.under_root("path", fx.ROOT).alias("under_root"))


@query("violations")
def violations(spark, sf_dir):
    return B.violations(fx.entities(spark, sf_dir), fx.entity_tags(spark, sf_dir), fx.tag_map(spark),
                        B.scope_role_table(spark), fx.ROOT, trim_tags=True)


@query("desired_grants")
def desired_grants(spark, sf_dir):
    return B.desired_grants(fx.entities(spark, sf_dir), fx.entity_tags(spark, sf_dir), fx.tag_map(spark),
                            fx.MANAGED_SCOPES, fx.ROOT, trim_tags=False)


@query("source_label")
def source_label(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("source")).alias("source"))
    tag = tag_from_source("source", fx.US_DOC_SOURCES)
    return d.select("doc_id", "source", tag.alias("tag"), label_from_tag(tag).alias("label"))


@query("tag_map_parse")
def tag_map_parse(spark, sf_dir):
    return B.parse_tag_map(fx.tag_map_texts(spark, sf_dir), "text", keep=["o_orderkey"])


@query("tag_map_rejects")
def tag_map_rejects(spark, sf_dir):
    return B.tag_map_rejects(fx.tag_map_texts(spark, sf_dir), "text", keep=["o_orderkey"])


@query("scopes_norm")
def scopes_norm(spark, sf_dir):
    t = fx.scope_texts(spark, sf_dir)
    forms = []
    for form, strict in (("lenient", False), ("strict", True)):
        forms.append(explode_rows(t, normalize_scopes("text", strict=strict), "scope", "c_custkey")
                     .select("c_custkey", F.lit(form).alias("form"), "scope"))
    out = forms[0].unionByName(forms[1])
    return out.select("c_custkey", "form", "scope", scope_role_name("scope").alias("role"))


# ------------------------------------------------------------------ family C
def _desired(spark, sf_dir):
    return desired_grants(spark, sf_dir)


def _existing(spark, sf_dir, dedupe=False):
    # the diff kernel de-duplicates in its own partial aggregation: skip the extra distinct
    return C.existing_grants(fx.grants(spark, sf_dir), fx.MANAGED_SCOPES, dedupe=dedupe)


@query("existing_grants")
def existing_grants(spark, sf_dir):
    return _existing(spark, sf_dir, dedupe=True)


@query("grant_diff")
def grant_diff(spark, sf_dir):
    return C.diff_grants(_desired(spark, sf_dir), _existing(spark, sf_dir))


@query("diff_summary")
def diff_summary(spark, sf_dir):
    return C.diff_summary(grant_diff(spark, sf_dir))


@query("grant_plan")
def grant_plan(spark, sf_dir):
    return C.render_plan(grant_diff(spark, sf_dir))


@query("plan_rank")
def plan_rank(spark, sf_dir):
    return C.plan_rank(grant_diff(spark, sf_dir))


@query("apply_diff")
def apply_diff(spark, sf_dir):
    return C.apply_diff(_existing(spark, sf_dir), grant_diff(spark, sf_dir))


@query("acl_normalize")
def acl_normalize(spark, sf_dir):
    return C.normalize_acl(fx.acl(spark, sf_dir))


@query("acl_rejects")
def acl_rejects(spark, sf_dir):
    return C.acl_rejects(fx.acl(spark, sf_dir))


@query("acl_merge")
def acl_merge(spark, sf_dir):
    c = B.classify(fx.entities(spark, sf_dir), fx.entity_tags(spark, sf_dir), fx.tag_map(spark), trim_tags=True)
    roles = fx.region_roles(spark)
    targets = B.resolve_role(c, roles).where(F.col("status") == "valid").select("entity_id", "role")
    return C.merge_targets_acl(fx.acl(spark, sf_dir), targets, roles)


@query("permission_state")
def permission_state(spark, sf_dir):
    return C.permission_state(fx.permission_ops(spark, sf_dir))


@query("bypass_guard")
def bypass_guard(spark, sf_dir):
    return C.bypass_violations(fx.global_grants(spark, sf_dir), fx.managed_nation_roles(spark, sf_dir))


@query("effective_access")
def effective_access(spark, sf_dir):
    return C.effective_access(fx.access_requests(spark, sf_dir), fx.current_roles(spark, sf_dir),
                              fx.access_grants(spark, sf_dir))


@query("access_bitmaps")
def access_bitmaps(spark, sf_dir):
    return C.access_bitmaps(fx.access_requests(spark, sf_dir), fx.current_roles(spark, sf_dir), fx.access_grants(spark, sf_dir))


@query("missing_roles")
def missing_roles(spark, sf_dir):
    wanted, present = fx.segment_roles(spark, sf_dir)
    return C.missing_roles(wanted, present)


# ------------------------------------------------------------------ family D
@query("reconcile_roles")
def reconcile_roles(spark, sf_dir):
    return D.reconcile_roles(fx.current_roles(spark, sf_dir), fx.desired_roles(spark, sf_dir), fx.MANAGED_EVENT_ROLES)


@query("aligned_users")
def aligned_users(spark, sf_dir):
    return D.aligned_users(fx.current_roles(spark, sf_dir), fx.desired_roles(spark, sf_dir), fx.MANAGED_EVENT_ROLES)


@query("role_matrix")
def role_matrix(spark, sf_dir):
    return D.desired_roles(fx.customer_profiles(spark, sf_dir))


@query("users_to_create")
def users_to_create(spark, sf_dir):
    wanted, present = fx.event_users(spark, sf_dir)
    return D.users_to_create(wanted, present)


@query("teardown_plan")
def teardown_plan(spark, sf_dir):
    targets, present = fx.teardown_targets(spark, sf_dir)
    return D.teardown_plan(targets, present).select("kind", "name", "action")


@query("teardown_rank")
def teardown_rank(spark, sf_dir):
    return D.teardown_rank(D.teardown_plan(*fx.teardown_targets(spark, sf_dir)))


@query("group_roles")
def group_roles(spark, sf_dir):
    ug, mapping = fx.order_groups(spark, sf_dir)
    return D.roles_from_groups(ug, mapping)


@query("user_listing")
def user_listing(spark, sf_dir):
    parsed = D.parse_user_listing(fx.user_listing_lines(spark, sf_dir), "value", pos_col="pos", keep=["pos"])
    return D.parse_role_list(D.first_lines(parsed, ["pos"]), "line", keep=["username"])


@query("role_list_parse")
def role_list_parse(spark, sf_dir):
    return D.parse_role_list(fx.role_list_texts(spark, sf_dir), "text", keep=["username"])


# ------------------------------------------------------------------ family E
@query("log_parse")
def log_parse(spark, sf_dir):
    p = E.parse_log_lines(fx.log_lines(spark, sf_dir), "value")
    return p.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "level", "message")


@query("tail_30")
def tail_30(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    t = E.tail_per_key(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], n=30)
    return t.select("user_id", "event_id", F.col("rn").cast("int").alias("rn"))


@query("retention")
def retention(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return E.retention(o, "o_orderdate", fx.AS_OF).select("o_orderkey", "age_days", "expired")


@query("run_outcome")
def run_outcome(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select(
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return E.run_outcome(e, ["user_id", "day"], F.col("event_type") == "error")


@query("auth_failures")
def auth_failures(spark, sf_dir):
    return fx.auth_pages(spark, sf_dir).select("page_id", E.auth_failure("text", "url").alias("auth_failure"))


@query("status_rollup")
def status_rollup(spark, sf_dir):
    obs, services = fx.observations(spark, sf_dir)
    return E.status_rollup(obs, services, env="dev")


def _new_folder(spark, base: str) -> str:
    return f"{A.warehouse_location(spark, base)}-{uuid.uuid4().hex}"


def _log_folder(spark, sf_dir) -> str:
    """The daily log files of all events, in a new folder under the warehouse."""
    folder = _new_folder(spark, "logs")
    E.write_logs(fx.log_file_lines(spark, sf_dir), folder, ["ts", "event_id"], modified="ts")
    return folder


@query("log_files")
def log_files(spark, sf_dir):
    p = E.read_logs(spark, _log_folder(spark, sf_dir))
    return p.select("script", "env", F.date_format("log_date", "yyyy-MM-dd").alias("log_date"),
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "level", "message")


@query("tail_files")
def tail_files(spark, sf_dir):
    t = E.tail_files(spark, _log_folder(spark, sf_dir), 30)
    return t.select("name", "script", "env", F.date_format("log_date", "yyyy-MM-dd").alias("log_date"), "rn", "value")


@query("retention_files")
def retention_files(spark, sf_dir):
    r = E.retention_files(spark, _log_folder(spark, sf_dir), fx.FILES_AS_OF)
    return r.select("name", "script", "env", "bytes", "age_days", "expired")


@query("listing_files")
def listing_files(spark, sf_dir):
    """Users in the order of their places, as many files as tasks, each with its header, read back with line numbers."""
    folder = _new_folder(spark, "user_listing")
    lines = fx.listing_file_lines(spark, sf_dir).repartitionByRange("pos").sortWithinPartitions("pos")
    (lines.select(F.col("value").alias(fx.LISTING_HEADER)).write.option("header", True).option("sep", "\u0001").option("quote", "\u0000")
     .option("escapeQuotes", False).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(f"{folder}/files"))
    first = D.first_lines(D.read_listing(spark, f"{folder}/files", f"{folder}/numbered"))
    return D.parse_role_list(first, "line", keep=["username"])


@query("user_plan_dry")
def user_plan_dry(spark, sf_dir):
    desired = D.desired_roles(fx.customer_profiles(spark, sf_dir))
    return D.user_plan(desired.limit(0), desired, desired.select("username").limit(0), dry_run=True)


# ------------------------------------------------------------------ family A
def _table_name(base: str) -> str:
    return f"tw_{base}_{uuid.uuid4().hex[:12]}"  # every run has tables of its own


def _load_copy(spark, sf_dir, source: str) -> str:
    """Ensure a Parquet copy of a driver table in the warehouse and reload it (A1, A2)."""
    src = fx.table(spark, sf_dir, source)
    name = _table_name(source)
    A.ensure_table(spark, name, src.schema, schema_name="default",
                   location=A.warehouse_location(spark, name))
    A.reload_rows(spark, name, src, schema_name="default")
    return name


@query("reload_twice")
def reload_twice(spark, sf_dir):
    name = _load_copy(spark, sf_dir, "orders")
    A.reload_rows(spark, name, fx.table(spark, sf_dir, "orders"), schema_name="default")
    return spark.table(f"default.{name}").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("ordered_read")
def ordered_read(spark, sf_dir):
    name = _load_copy(spark, sf_dir, "orders")
    return A.ordered_select(spark, name, ["o_orderkey", "o_orderpriority"], ["o_orderkey"], schema_name="default")


@query("ordered_rank")
def ordered_rank(spark, sf_dir):
    name = _load_copy(spark, sf_dir, "orders")
    return A.ordered_rank(spark, name, ["o_orderkey", "o_orderpriority"], ["o_orderpriority", "o_orderkey"], "default")


@query("preview_20")
def preview_20(spark, sf_dir):
    name = _load_copy(spark, sf_dir, "orders")
    return A.preview(A.ordered_select(spark, name, ["o_orderkey", "o_orderpriority"], ["o_orderkey"], "default"), 20)


@query("literal_weights")
def literal_weights(spark, sf_dir):
    """Typed literal rows (A5) met by every order."""
    w = A.literal_rows(spark, fx.PRIORITY_WEIGHTS, "o_orderpriority string, weight int")
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return o.join(F.broadcast(w), "o_orderpriority", "left").select("o_orderkey", "weight")


@query("first_usable")
def first_usable(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    k = F.col("doc_id")
    first = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.col("lang"))
    second = F.when(k % 5 != 0, F.col("source")).otherwise(F.lit(""))
    return d.select("doc_id", first_non_empty(first, second, F.lit("none")).alias("value"))


@query("table_count")
def table_count(spark, sf_dir):
    name = _load_copy(spark, sf_dir, "customer")
    return A.row_count(spark, name, schema_name="default")


@query("table_smoke")
def table_smoke(spark, sf_dir):
    src = fx.table(spark, sf_dir, "supplier")
    name = _table_name("supplier")
    return A.smoke(spark, name, src.schema, src, key=["s_suppkey"], schema_name="default",
                   location=A.warehouse_location(spark, name))


@query("grant_sync")
def grant_sync(spark, sf_dir):
    from tagwarden.plans.sync import run_grant_sync

    diff_t, state_t = _table_name("grant_diff"), _table_name("grant_state")
    return run_grant_sync(spark, _desired(spark, sf_dir), _existing(spark, sf_dir), diff_t, state_t, "default",
                          A.warehouse_location(spark, diff_t), A.warehouse_location(spark, state_t))


@query("sync_counts")
def sync_counts(spark, sf_dir):
    """What two syncs report: the first from the extraction, the second from the state that it left."""
    from tagwarden.plans.sync import sync_grants

    diff_t, state_t = _table_name("grant_diff"), _table_name("grant_state")
    at = ("default", A.warehouse_location(spark, diff_t), A.warehouse_location(spark, state_t))
    desired = _desired(spark, sf_dir)
    reports = [sync_grants(spark, desired, e, diff_t, state_t, *at) for e in (_existing(spark, sf_dir), None)]
    return spark.createDataFrame([(i, r.added, r.removed) for i, r in enumerate(reports, 1)], "run int, added long, removed long")


@query("role_names")
def role_names(spark, sf_dir):
    t = fx.scope_texts(spark, sf_dir)
    s = explode_rows(t, normalize_scopes("text"), "scope")
    return s.select("scope").distinct().select("scope", scope_role_name("scope").alias("role"))


@query("user_plan")
def user_plan(spark, sf_dir):
    present = fx.present_customers(spark, sf_dir)
    ug, mapping = fx.order_groups(spark, sf_dir)
    # current memberships: the group-derived roles of users that exist
    current = D.roles_from_groups(ug, mapping).join(present, "username", "left_semi")
    desired = D.desired_roles(fx.customer_profiles(spark, sf_dir))
    return D.user_plan(current, desired, present)


@query("policy_acl")
def policy_acl(spark, sf_dir):
    return C.policy_acl(fx.entities(spark, sf_dir), fx.entity_tags(spark, sf_dir), fx.tag_map(spark),
                        fx.region_roles(spark), fx.acl(spark, sf_dir), fx.ROOT)
