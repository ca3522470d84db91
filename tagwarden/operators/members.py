"""Family D: users and role membership.

Tables are long form: ``user_roles(username, role)``. Text listings (one line per user,
roles rendered as a list literal) are parsed with built-in string functions.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwarden.functions.text import _c, explode_rows
from tagwarden.operators.diff import side_flags
from tagwarden.plans.broadcast import broadcast_if_small
from tagwarden.plans.ranks import with_positions
from tagwarden.sources.files import numbered_lines

# Fixed values (role names and the user/role matrix of the test users):
VIEWER = "Viewer"
RERUN_ROLE = "AF_RERUN_ALL_NO_TRIGGER"
OBSERVER_ROLE = "AF_ADMIN_OBSERVER_NO_DAG"
MANAGED_TEST_ROLES = ("Viewer", "AF_RERUN_ALL_NO_TRIGGER", "AF_ADMIN_OBSERVER_NO_DAG", "AF_TRIGGER_SCOPE_GLOBAL",
                      "AF_TRIGGER_SCOPE_NONUS", "AF_TRIGGER_SCOPE_US", "AF_TRIGGER_SCOPE_MX", "AF_TRIGGER_SCOPE_CN")
PROFILE_ROLES = {
    "normal": ("Viewer", "AF_RERUN_ALL_NO_TRIGGER"),
    "us_user": ("Viewer", "AF_TRIGGER_SCOPE_US", "AF_RERUN_ALL_NO_TRIGGER"),
    "nonus_priv": ("Viewer", "AF_TRIGGER_SCOPE_GLOBAL", "AF_RERUN_ALL_NO_TRIGGER"),
    "us_priv": ("Viewer", "AF_TRIGGER_SCOPE_US", "AF_TRIGGER_SCOPE_GLOBAL", "AF_RERUN_ALL_NO_TRIGGER"),
    "admin_observer": ("AF_ADMIN_OBSERVER_NO_DAG",),
}
TRIGGER_PROFILES = ("us_user", "nonus_priv", "us_priv")


# --------------------------------------------------------------------------- D1
def listing_username(line) -> Column:
    """Username of one listing line: column 2 when column 1 is numeric and column 2 is
    present, else column 1 (whitespace-separated columns, leading blanks ignored)."""
    toks = F.split(F.regexp_replace(_c(line), r"^\s+", ""), r"\s+")
    first, second = F.try_element_at(toks, F.lit(1)), F.try_element_at(toks, F.lit(2))
    return F.when(first.rlike("^[0-9]+$") & second.isNotNull() & (second != ""), second).otherwise(first)


def parse_user_listing(lines: DataFrame, value_col: str = "value", pos_col: str | None = None,
                       keep: Iterable[str] = ()) -> DataFrame:
    """User listing lines -> ``(*keep, username, line)``.

    The header is known by its position only, never by its content: with ``pos_col`` the line at
    position 0 is skipped, without it the lines are taken to have no header (``read_listing`` skips
    each file's). Blank lines give no user.
    """
    keep = list(keep)
    df = lines if pos_col is None else lines.where(F.col(pos_col) > 0)
    name = listing_username(value_col)
    return df.select(*keep, name.alias("username"), F.col(value_col).alias("line")) \
        .where(F.col("username").isNotNull() & (F.col("username") != ""))


def read_listing(spark, path: str, folder: str | None = None) -> DataFrame:
    """Listing text files -> ``(file, pos, username, line)``: every user line with its place in its file.

    Line 0 of every file is its header, blank or not. Files are split over many tasks (``numbered_lines``,
    which keeps its copy in ``folder``). A user may have several lines; ``first_lines`` picks the one that counts.
    """
    return parse_user_listing(numbered_lines(spark, path, folder), "value", pos_col="pos", keep=["file", "pos"])


def first_lines(listing: DataFrame, order: Sequence[str] = ("file", "pos")) -> DataFrame:
    """``(username, line)``: of several lines of one user the first counts, by file, then place.

    A partial aggregate: a user with a third of all lines sends one line a task.
    """
    return listing.groupBy("username").agg(F.min_by("line", F.struct(*order)).alias("line"))


# --------------------------------------------------------------------------- D2
def role_list(text) -> Column:
    """Roles of a list literal: text after the first ``[`` up to the last ``]``; no ``[``
    gives no roles; split on ``,``; remove all whitespace and both quote kinds; drop blank."""
    t = _c(text)
    after = F.regexp_extract(t, r"^[^\[]*\[(.*)$", 1)
    blob = F.regexp_replace(after, r"\][^\]]*$", "")
    items = F.transform(F.split(blob, ","), lambda x: F.regexp_replace(x, r"[\s'\"]", ""))
    roles = F.filter(items, lambda x: x != "")
    return F.when(t.contains("["), roles).otherwise(F.array().cast("array<string>"))


def parse_role_list(df: DataFrame, text_col: str, keep: Iterable[str] = ("username",)) -> DataFrame:
    """Rows with a role-list text -> ``(*keep, role)``, one row per distinct role."""
    keep = list(keep)
    return explode_rows(df, F.array_distinct(role_list(text_col)), "role", *keep)


# --------------------------------------------------------------------------- D3
def _role_flags(current: DataFrame, desired: DataFrame, managed: Sequence[str] | DataFrame) -> DataFrame:
    f = side_flags({"c": current.select("username", "role"), "d": desired.select("username", "role")},
                   ["username", "role"])
    if isinstance(managed, DataFrame):
        m = broadcast_if_small(managed.select("role").distinct().withColumn("_m", F.lit(True)))
        f = f.join(m, "role", "left").withColumn("_m", F.coalesce("_m", F.lit(False)))
    else:
        f = f.withColumn("_m", F.col("role").isin(list(managed)))
    # only users named in the desired table are reconciled; their per-user row count is
    # bounded by the number of distinct roles, so this window never sees raw input rows
    in_scope = F.max("in_d").over(Window.partitionBy("username")) == 1
    op = (F.when((F.col("in_d") == 1) & (F.col("in_c") == 0), F.lit("add"))
          .when((F.col("in_c") == 1) & (F.col("in_d") == 0) & F.col("_m"), F.lit("remove")))
    return f.select("username", "role", in_scope.alias("_in"), op.alias("op"))


def reconcile_roles(current: DataFrame, desired: DataFrame,
                    managed: Sequence[str] | DataFrame = MANAGED_TEST_ROLES) -> DataFrame:
    """Membership changes ``(username, op, role)`` (D3).

    add = desired - current; remove = (current and managed) - desired; roles outside
    the managed set are left alone; users absent from ``desired`` are not touched.
    """
    f = _role_flags(current, desired, managed)
    return f.where(F.col("_in") & F.col("op").isNotNull()).select("username", "op", "role")


def aligned_users(current: DataFrame, desired: DataFrame,
                  managed: Sequence[str] | DataFrame = MANAGED_TEST_ROLES) -> DataFrame:
    """Users of ``desired`` whose roles already match: ``(username)`` (D3)."""
    f = _role_flags(current, desired, managed).where(F.col("_in"))
    return f.groupBy("username").agg(F.count("op").alias("_n")).where(F.col("_n") == 0).select("username")


# --------------------------------------------------------------------------- D4
def profile_roles(profile, strict) -> Column:
    """Roles of a profile; strict mode drops the rerun role from trigger profiles only."""
    m = F.create_map(*[x for p, roles in PROFILE_ROLES.items()
                       for x in (F.lit(p), F.array(*[F.lit(r) for r in roles]))])
    roles = F.coalesce(F.element_at(m, _c(profile)), F.array().cast("array<string>"))
    drop = _c(strict) & _c(profile).isin(*TRIGGER_PROFILES)
    return F.when(drop, F.array_remove(roles, RERUN_ROLE)).otherwise(roles)


def desired_roles(profiles: DataFrame, profile_col: str = "profile", strict_col: str = "strict") -> DataFrame:
    """``(username, profile, strict)`` -> ``(username, role)`` (D4); no join, a literal map."""
    return explode_rows(profiles, profile_roles(profile_col, strict_col), "role", "username")


# --------------------------------------------------------------------------- D5
def users_to_create(wanted: DataFrame, present: DataFrame, initial_role: str = VIEWER) -> DataFrame:
    """Users not in the listing yet, each created with ``initial_role``."""
    # both sides de-duplicated map-side: a user repeated in many listing rows stays one row
    w = wanted.select("username").distinct()
    return w.join(present.select("username").distinct(), "username", "left_anti") \
        .select("username", F.lit(initial_role).alias("role"))


def user_plan(current: DataFrame, desired: DataFrame, present_users: DataFrame,
              managed: Sequence[str] | DataFrame = MANAGED_TEST_ROLES, initial_role: str = VIEWER,
              dry_run: bool = False) -> DataFrame:
    """The whole user job: ``(username, op, role)`` with op ``create`` / ``add`` / ``remove``.

    Users of ``desired`` missing from ``present_users`` are created with ``initial_role``
    (D5); reconcile (D3) then runs against the current roles *including* that initial
    role, so a created user whose profile lacks it gets it removed again.

    In a dry run nothing is looked up: every user counts as absent (``create``) and every desired
    role is listed (``add``), without a diff.
    """
    if dry_run:
        wanted = desired.select("username", "role").distinct()
        users = wanted.select("username").distinct().select("username", F.lit("create").alias("op"),
                                                            F.lit(initial_role).alias("role"))
        return users.unionByName(wanted.select("username", F.lit("add").alias("op"), "role"))
    created = users_to_create(desired.select("username"), present_users, initial_role)
    after_create = current.select("username", "role").unionByName(created)
    changes = reconcile_roles(after_create, desired, managed)
    return created.select("username", F.lit("create").alias("op"), "role").unionByName(changes)


# --------------------------------------------------------------------------- D6
def teardown_plan(targets: DataFrame, present: DataFrame, dry_run: bool = False) -> DataFrame:
    """``(kind, name)`` targets -> ``(kind, name, action)`` with action delete/skip.

    Users come before roles (``kind_order``); in a dry run every target counts as present.
    """
    kind_order = F.when(F.col("kind") == "user", F.lit(0)).otherwise(F.lit(1))
    if dry_run:
        return targets.select("kind", "name", F.lit("delete").alias("action"), kind_order.alias("kind_order"))
    p = present.select("kind", "name").distinct().withColumn("_p", F.lit(True))
    j = targets.select("kind", "name").join(p, ["kind", "name"], "left")
    action = F.when(F.col("_p"), F.lit("delete")).otherwise(F.lit("skip"))
    return j.select("kind", "name", action.alias("action"), kind_order.alias("kind_order"))


def teardown_rank(plan: DataFrame) -> DataFrame:
    """``(kind, name, action, pos)``: the plan's rows with their places, users before roles, then by name."""
    return with_positions(plan.select("kind", "name", "action", "kind_order"), ["kind_order", "name"]).drop("kind_order")


# --------------------------------------------------------------------------- D7
def roles_from_groups(user_groups: DataFrame, mapping: DataFrame) -> DataFrame:
    """Directory groups -> roles: ``(username, group)`` x ``(group, role)`` -> distinct
    ``(username, role)``; unmapped groups are ignored (D7). The join key (group) has few
    values, so the mapping is broadcast behind a size check."""
    m = broadcast_if_small(mapping.select("group", "role"))
    return user_groups.select("username", "group").join(m, "group").select("username", "role").distinct()
