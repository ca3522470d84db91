"""Family C: grants - extract, diff, merge, audit.

Grant tables are long form ``(role, action, resource)``; per-entity trigger grants
use the resource ``DAG Run:<entity_id>``; the global trigger grant is ``DAG Runs``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwarden.functions.tags import SCOPE_ROLE_PREFIX, scope_role_name
from tagwarden.functions.text import explode_rows, py_strip, shell_quote
from tagwarden.operators.diff import side_flags
from tagwarden.plans.broadcast import DEFAULT_MAX_BROADCAST_BYTES, broadcast_if_small, literal_lookup
from tagwarden.plans.ranks import with_positions

# Fixed values (resource and action names of the permission model):
DAG_RUN_PREFIX = "DAG Run:"
RESOURCE_DAG = "DAGs"
RESOURCE_DAG_RUN = "DAG Runs"
ACTION_CAN_CREATE = "can_create"
ACTION_CAN_EDIT = "can_edit"
# A bitmap takes 4 KB and comes from at least one membership row of 16 bytes: this much of those is 32 MB of bitmaps at most.
BITMAP_SOURCE_BYTES = DEFAULT_MAX_BROADCAST_BYTES // 256
# The trigger template every target role gets (resource, action):
TRIGGER_TEMPLATE = ((RESOURCE_DAG, ACTION_CAN_EDIT), (RESOURCE_DAG_RUN, ACTION_CAN_CREATE))


def _scope_roles(spark, scopes: Iterable[str] | DataFrame, prefix: str) -> DataFrame:
    if isinstance(scopes, DataFrame):
        s = broadcast_if_small(scopes.select("scope").distinct())
    else:
        s = literal_lookup(spark, [(x,) for x in sorted(set(scopes))], "scope string")
    return s.select("scope", scope_role_name("scope", prefix).alias("role"))


# --------------------------------------------------------------------------- C1
def existing_grants(grants: DataFrame, scopes: Iterable[str] | DataFrame,
                    prefix: str = SCOPE_ROLE_PREFIX, dedupe: bool = True) -> DataFrame:
    """Per-entity trigger grants the managed scope roles hold now: ``(scope, entity_id)``.

    Role in the managed scope roles, action ``can_create``, resource starting with
    ``DAG Run:`` and a non-empty id after it (the global ``DAG Runs`` does not match).
    Ids stay strings. The role filter is a broadcast join against the (bounded) scope list.
    ``dedupe=False`` skips the distinct (a shuffle) when the consumer is set-based
    anyway, such as ``diff_grants`` / ``apply_diff``.
    """
    spark = grants.sparkSession
    roles = _scope_roles(spark, scopes, prefix)
    g = grants.where((F.col("action") == ACTION_CAN_CREATE) & F.col("resource").startswith(DAG_RUN_PREFIX))
    g = g.join(roles, "role").select(
        "scope", F.expr(f"substring(resource, {len(DAG_RUN_PREFIX) + 1})").alias("entity_id"))
    g = g.where(F.col("entity_id") != "")
    return g.distinct() if dedupe else g


# --------------------------------------------------------------------------- C2
def diff_grants(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """``add`` = desired - existing, ``remove`` = existing - desired, per (scope, entity).

    One shuffle on (scope, entity_id) - never on scope alone, which has a handful of
    values and would put everything in a few tasks.
    """
    f = side_flags({"d": desired.select("scope", "entity_id"), "e": existing.select("scope", "entity_id")},
                   ["scope", "entity_id"])
    return f.where(F.col("in_d") != F.col("in_e")).select(
        "scope", F.when(F.col("in_d") == 1, F.lit("add")).otherwise(F.lit("remove")).alias("op"), "entity_id")


def order_plan(diff: DataFrame) -> DataFrame:
    """The reference order for a final sink: scope, add before remove, entity id."""
    return diff.orderBy("scope", F.when(F.col("op") == "add", 0).otherwise(1), "entity_id")


def plan_rank(diff: DataFrame) -> DataFrame:
    """``diff`` with ``pos``, each change's place in the plan: scope, add before remove, entity id."""
    return with_positions(diff, ["scope", F.when(F.col("op") == "add", 0).otherwise(1), "entity_id"])


def diff_stored(desired: DataFrame, state: DataFrame) -> DataFrame:
    """``diff_grants`` for two stored tables that hold each (scope, entity_id) once and are bucketed on it alike.

    One full outer join on the buckets' own partitioning: neither side is shuffled or sorted.
    """
    keys = ["scope", "entity_id"]
    j = desired.select(*keys, F.lit(1).alias("_d")).join(state.select(*keys, F.lit(1).alias("_e")), keys, "full_outer")
    return j.where(F.col("_d").isNull() | F.col("_e").isNull()).select(
        "scope", F.when(F.col("_e").isNull(), F.lit("add")).otherwise(F.lit("remove")).alias("op"), "entity_id")


def apply_stored(state: DataFrame, diff: DataFrame) -> DataFrame:
    """``apply_diff`` for a stored state and a stored diff, both bucketed on (scope, entity_id): no exchange."""
    keys = ["scope", "entity_id"]
    j = state.select(*keys, F.lit(1).alias("_e")).join(diff.select(*keys, "op"), keys, "full_outer")
    return j.where(F.col("op").isNull() | (F.col("op") == "add")).select(*keys)


# --------------------------------------------------------------------------- C3
def diff_summary(diff: DataFrame) -> DataFrame:
    """Added/removed counts per scope plus a ``total`` row that is always present.

    The total is a global aggregate over the per-scope rows, so it exists even for an
    empty diff (a rollup would give no row at all), and both branches share one
    per-scope aggregation subtree - Spark reuses its exchange, the diff is computed once.
    """
    per_scope = diff.groupBy("scope").agg(
        F.count_if(F.col("op") == "add").alias("added"),
        F.count_if(F.col("op") == "remove").alias("removed"))
    total = per_scope.agg(
        F.coalesce(F.sum("added"), F.lit(0)).cast("bigint").alias("added"),
        F.coalesce(F.sum("removed"), F.lit(0)).cast("bigint").alias("removed"),
    ).select(F.lit("total").alias("scope"), "added", "removed")
    return per_scope.unionByName(total)


# --------------------------------------------------------------------------- C4
def render_plan(diff: DataFrame, program: str = "ctl", prefix: str = SCOPE_ROLE_PREFIX,
                dry_run: bool = True, quote=shell_quote) -> DataFrame:
    """One shell command per change, nothing applied (C4).

    ``[DRY-RUN] <program> roles add-perms <ROLE> -a can_create -r 'DAG Run:<id>'``;
    every argument is quoted as needed, by ``quote`` (``shell_quote`` or ``bash_quote``).
    """
    role = scope_role_name("scope", prefix)
    verb = F.when(F.col("op") == "add", F.lit("add-perms")).otherwise(F.lit("del-perms"))
    resource = F.concat(F.lit(DAG_RUN_PREFIX), F.col("entity_id"))
    args = [F.lit(program), F.lit("roles"), verb, quote(role), F.lit("-a"), F.lit(ACTION_CAN_CREATE),
            F.lit("-r"), quote(resource)]
    cmd = F.concat_ws(" ", *args)
    if dry_run:
        cmd = F.concat(F.lit("[DRY-RUN] "), cmd)
    return diff.select("scope", "op", "entity_id", cmd.alias("command"))


# --------------------------------------------------------------------------- C5
def apply_diff(existing: DataFrame, diff: DataFrame) -> DataFrame:
    """New grant state = existing - remove + add, as ``(scope, entity_id)``.

    Same one-shuffle flag kernel as C2: applying a diff and diffing again is empty.
    """
    keys = ["scope", "entity_id"]
    f = side_flags({
        "e": existing.select(*keys),
        "r": diff.where(F.col("op") == "remove").select(*keys),
        "a": diff.where(F.col("op") == "add").select(*keys),
    }, keys)
    return f.where(((F.col("in_e") == 1) & (F.col("in_r") == 0)) | (F.col("in_a") == 1)).select(*keys)


# --------------------------------------------------------------------------- C6
def _actions(v: Column) -> Column:
    """Variant -> array of action strings: string -> [s]; array -> elements as Python's ``str`` prints
    scalars (``None``, ``True``, numbers as written by JSON), objects and lists as JSON text;
    object -> its keys (iterating a mapping yields keys); anything else -> []. Never a null action.

    Objects and arrays are recognised with ``try_cast`` (null when the shape differs);
    ``schema_of_variant`` - which walks the whole value - is only asked about scalars.
    """
    arr = v.try_cast("array<variant>")
    obj = v.try_cast("map<string,variant>")
    empty = F.array().cast("array<string>")

    def text(e):
        kind = F.schema_of_variant(e)
        return (F.when(e.isNull() | F.is_variant_null(e), F.lit("None"))
                .when(kind == "BOOLEAN", F.initcap(e.try_cast("string")))
                .otherwise(F.coalesce(e.try_cast("string"), F.to_json(e))))

    return (F.when(v.isNull(), empty)
            .when(arr.isNotNull(), F.transform(arr, text))
            .when(obj.isNotNull(), F.map_keys(obj))
            .when(F.schema_of_variant(v) == "STRING", F.array(F.try_variant_get(v, "$", "string")))
            .otherwise(empty))


def _with_acl_entries(df: DataFrame, acl_col: str, *keep: str) -> DataFrame:
    """``(*keep, _bad, _entries)``: the reject reason of each document, and its distinct
    (role, resource, action) structs. Narrow; the document is parsed once."""
    keep = list(keep)
    text = F.nullif(py_strip(acl_col), F.lit(""))
    d = df.select(*keep, text.isNotNull().alias("_has"), F.try_parse_json(text).alias("_v"))
    d = d.select(*keep, "_has", F.col("_v").isNull().alias("_unread"), F.col("_v").try_cast("map<string,variant>").alias("_m"))
    bad = F.when(F.col("_has") & F.col("_unread"), F.lit(REJECT_UNREADABLE)) \
        .when(F.col("_has") & F.col("_m").isNull(), F.lit(REJECT_NOT_OBJECT))

    def of_role(e):
        res = e["value"].try_cast("map<string,variant>")
        one = lambda r, v: F.transform(_actions(v), lambda a: F.struct(
            e["key"].alias("role"), r.alias("resource"), a.alias("action")))
        nested = F.filter(F.flatten(F.transform(F.map_entries(res), lambda x: one(py_strip(x["key"]), x["value"]))),
                          lambda p: p["resource"] != "")
        return F.when(res.isNotNull(), nested).otherwise(one(F.lit(RESOURCE_DAG), e["value"]))

    return d.select(*keep, bad.alias("_bad"),
                    F.array_distinct(F.flatten(F.transform(F.map_entries("_m"), of_role))).alias("_entries"))


# Reject reasons of ACL documents.
REJECT_UNREADABLE, REJECT_NOT_OBJECT = "unreadable", "not an object"


def normalize_acl(df: DataFrame, acl_col: str = "acl_json", id_col: str = "entity_id") -> DataFrame:
    """ACL JSON text (two shapes) -> rows ``(entity_id, role, resource, action)``.

    Per role: a string is one action, a list its actions - both on resource ``DAGs``;
    a map is resource -> actions with the resource stripped, blank resources dropped
    and resources without actions dropped; null or any other type gives nothing.
    A document that cannot be read gives nothing here and is listed by ``acl_rejects``. Two
    resources that are equal after stripping are merged (union of actions).

    Each document is unpacked inside its own row (variant casts + higher-order
    functions), so the operator is narrow: no shuffle.
    """
    d = _with_acl_entries(df.withColumnRenamed(id_col, "entity_id"), acl_col, "entity_id")
    return explode_rows(d, "_entries", "p", "entity_id").select("entity_id", "p.role", "p.resource", "p.action")


def acl_rejects(df: DataFrame, acl_col: str = "acl_json", id_col: str = "entity_id") -> DataFrame:
    """Documents whose entries are unknown: ``(entity_id, reason)`` - text that is not JSON or repeats a
    key (``unreadable``), or JSON that is not an object. A null or blank text is no document."""
    d = _with_acl_entries(df.withColumnRenamed(id_col, "entity_id"), acl_col, "entity_id")
    return d.where(F.col("_bad").isNotNull()).select("entity_id", F.col("_bad").alias("reason"))


# --------------------------------------------------------------------------- C7
def _template(template: Sequence[tuple[str, str]]) -> Column:
    """The target role's entries, as structs like those of a document."""
    return F.array(*[F.struct(F.col("_target").alias("role"), F.lit(r).alias("resource"), F.lit(a).alias("action"))
                     for r, a in template])


def merge_targets_acl(acl_docs: DataFrame, targets: DataFrame, scope_role: DataFrame, acl_col: str = "acl_json",
                      template: Sequence[tuple[str, str]] = TRIGGER_TEMPLATE) -> DataFrame:
    """Resulting ACL rows ``(entity_id, role, resource, action)`` of each target entity (C6 + C7).

    ``targets(entity_id, role)``: the one managed role each entity must carry. Managed are
    the roles of ``scope_role``; every managed role's old entries go, so do those of the
    target role itself (it is overwritten), other roles stay as they are, and the target role gets
    exactly the template. Entities without a document get the target only; an entity whose document
    is rejected is left out (``acl_rejects`` lists it), so no grant is lost silently.

    One join on ``entity_id``; the merge is an array filter inside the row. The managed roles are a
    scalar subquery (one short array).
    """
    managed = scope_role.where(F.col("role").isNotNull()).agg(F.collect_set("role")).scalar()
    docs = acl_docs.select("entity_id", F.col(acl_col).alias("_acl"))
    t = targets.select("entity_id", F.col("role").alias("_target")).distinct()
    d = _with_acl_entries(t.join(docs, "entity_id", "left"), "_acl", "entity_id", "_target").where(F.col("_bad").isNull())
    d = d.select("entity_id", "_target", "_entries", managed.alias("_managed"))
    kept = F.filter(F.coalesce("_entries", F.array()), lambda e: ~F.array_contains("_managed", e["role"])
                    & (e["role"] != F.col("_target")))
    d = d.select("entity_id", F.concat(kept, _template(template)).alias("_all"))
    return explode_rows(d, "_all", "p", "entity_id").select("entity_id", "p.role", "p.resource", "p.action")


def policy_acl(entities: DataFrame, tags: DataFrame, tag_map: DataFrame, scope_role: DataFrame,
               acl_docs: DataFrame, root: str, acl_col: str = "acl_json") -> DataFrame:
    """The policy pass over a catalogue (B4 -> B7 -> B8 -> C6 -> C7): for every entity under
    ``root`` that classifies to one scope with a role, its resulting ACL rows.

    ``acl_docs(entity_id, <acl_col>)`` holds the raw ACL documents; only those of target
    entities are unpacked. Entities outside the root are left alone (no rows); failing entities
    are reported by ``classify.violations`` instead.
    """
    from tagwarden.operators.classify import classify, resolve_role, under_root

    inside = entities.where(under_root("path", root)).select("entity_id")
    targets = resolve_role(classify(inside, tags, tag_map), scope_role) \
        .where(F.col("status") == "valid").select("entity_id", "role")
    return merge_targets_acl(acl_docs, targets, scope_role, acl_col)


# --------------------------------------------------------------------------- C8
def permission_state(ops: DataFrame) -> DataFrame:
    """Final state of each (role, action, resource) from an ordered grant/revoke list.

    The last operation by ``seq`` decides; revoking what is absent and granting twice
    are both fine. ``max_by`` over an integer op code keeps a hash aggregation with
    partial (map-side) combine, so a hot key does not pile up in one task.
    """
    code = F.when(F.col("op") == "grant", F.lit(1)).otherwise(F.lit(0))
    agg = ops.select("role", "action", "resource", "seq", code.alias("_g")) \
        .groupBy("role", "action", "resource").agg(F.max_by("_g", "seq").alias("_last"))
    return agg.select("role", "action", "resource",
                      F.when(F.col("_last") == 1, F.lit("grant")).otherwise(F.lit("revoke")).alias("last_op"))


# --------------------------------------------------------------------------- C9
def bypass_violations(grants: DataFrame, scope_roles: DataFrame | Iterable[str]) -> DataFrame:
    """Scope roles that hold the global ``DAG Runs`` / ``can_create`` grant (C9): ``(role, grants)``."""
    g = grants.where((F.col("action") == ACTION_CAN_CREATE) & (F.col("resource") == RESOURCE_DAG_RUN))
    if isinstance(scope_roles, DataFrame):
        g = g.join(broadcast_if_small(scope_roles.select("role").distinct()), "role", "left_semi")
    else:
        g = g.where(F.col("role").isin(list(scope_roles)))
    return g.groupBy("role").agg(F.count(F.lit(1)).alias("grants"))


# --------------------------------------------------------------------------- C10
def effective_access(requests: DataFrame, user_roles: DataFrame, grants: DataFrame) -> DataFrame:
    """Decide trigger requests ``(request_id, username, entity_id)`` against role grants.

    A request is allowed ``scoped`` when one of the user's roles holds ``can_create`` on
    ``DAG Run:<entity_id>``, else ``global`` when one holds ``can_create`` on ``DAG Runs``.
    Output: ``request_id, username, entity_id, allowed, via``.

    Plan: decided on distinct (username, entity_id) pairs, not on requests. The global right is one flag
    per user; a scoped right is an equi join of the pair's roles with the grants on (role,
    entity_id). Requests meet the decided pairs once. The user x all-entities pairs a
    global grant implies are never made.
    """
    g = grants.where(F.col("action") == ACTION_CAN_CREATE)
    scoped = g.where(F.col("resource").startswith(DAG_RUN_PREFIX)).select(
        "role", F.expr(f"substring(resource, {len(DAG_RUN_PREFIX) + 1})").alias("entity_id")).distinct()
    glob = broadcast_if_small(g.where(F.col("resource") == RESOURCE_DAG_RUN).select("role").distinct())
    roles = user_roles.select("username", "role").distinct()
    any_global = roles.join(glob, "role", "left_semi").select("username").distinct().withColumn("_g", F.lit(True))
    pairs = requests.select("username", "entity_id").distinct()
    by_scope = (pairs.join(roles, "username").join(scoped, ["role", "entity_id"], "left_semi")
                .select("username", "entity_id").distinct().withColumn("_s", F.lit(True)))
    decided = requests.select("request_id", "username", "entity_id").join(by_scope, ["username", "entity_id"], "left") \
        .join(any_global, "username", "left")
    via = F.when(F.col("_s"), F.lit("scoped")).when(F.col("_g"), F.lit("global"))
    return decided.select("request_id", "username", "entity_id", via.isNotNull().alias("allowed"), via.alias("via"))


def access_bitmaps(entities: DataFrame, user_roles: DataFrame, grants: DataFrame) -> DataFrame:
    """How many users can trigger each entity: ``(entity_id, n_users, n_scoped)`` (C10, the audit by entity).

    Users with a global right reach every entity and count once. The others are numbered, and each role becomes
    a set of bitmaps (one per 32,768 user numbers). An entity's users are the union of its roles' bitmaps, so (user, entity)
    pairs are never made; entities with the same roles share one union. ``n_scoped`` counts the users who reach the entity by
    scoped grants alone. Entities come from ``entities (entity_id)``; an entity without a grant has the global users.

    A role's users and an entity's roles are de-duplicated map-side. The role bitmaps (at most users / 8 bytes a role) are broadcast
    within the size bound, else joined by shuffle, where a role of very many role sets is split.
    """
    g = grants.where(F.col("action") == ACTION_CAN_CREATE)
    everywhere = broadcast_if_small(g.where(F.col("resource") == RESOURCE_DAG_RUN).select("role").distinct())
    members = user_roles.select("username", "role").where("username is not null and role is not null").distinct()
    over_all = members.join(everywhere, "role", "left_semi").select("username").distinct()
    n_global = over_all.agg(F.count("*")).scalar()
    rest = members.join(over_all, "username", "left_anti")
    # a user's number is its position among them: dense, so few bitmaps
    number = with_positions(rest.select("username").distinct(), ["username"], "_n")
    bits = (rest.join(number, "username")
            .groupBy("role", F.bitmap_bucket_number("_n").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_n")).alias("_bits")))
    scoped = g.where(F.col("resource").startswith(DAG_RUN_PREFIX)).select(
        F.expr(f"substring(resource, {len(DAG_RUN_PREFIX) + 1})").alias("entity_id"), "role")
    ids = entities.select("entity_id").where("entity_id is not null").distinct()
    held = ids.join(scoped, "entity_id", "left").groupBy("entity_id").agg(F.sort_array(F.collect_set("role")).alias("_roles"))
    sets = held.select("_roles").distinct()
    counts = (sets.select("_roles", F.explode("_roles").alias("role")).join(broadcast_if_small(bits, BITMAP_SOURCE_BYTES), "role")
              .groupBy("_roles", "_bucket").agg(F.bitmap_count(F.bitmap_or_agg("_bits")).alias("_c"))
              .groupBy("_roles").agg(F.sum("_c").alias("_c")))
    n = F.coalesce(F.col("_c"), F.lit(0)).cast("bigint")
    return held.join(counts, "_roles", "left").select(
        "entity_id", (n + n_global).cast("bigint").alias("n_users"), n.alias("n_scoped"))


# --------------------------------------------------------------------------- C11
def missing_roles(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Wanted role names that do not exist yet - the create list (C11).

    Both sides are de-duplicated first (map-side), so a role repeated in a third of the
    rows never lands in one task of the anti join.
    """
    return wanted.select("role").distinct().join(present.select("role").distinct(), "role", "left_anti")
