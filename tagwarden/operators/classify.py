"""Family B: classify entities by tag into exactly one scope.

Inputs are long-form tables:
  entities(entity_id, path)      one row per entity
  tags(entity_id, tag)           many rows per entity
  tag_map(tag, scope)            small lookup (broadcast behind a size check)
  scope_role(scope, role)        small lookup
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwarden.functions.tags import scope_role_name
from tagwarden.functions.text import explode_rows, normalize_path, normalize_path_text, py_list_repr, py_strip
from tagwarden.plans.broadcast import DEFAULT_MAX_BROADCAST_BYTES, broadcast_if_small, literal_lookup, plan_bytes

# Fixed values (the reference's defaults):
DEFAULT_TAG_MAP = (("GDTET_GLOBAL_DAG", "global"), ("GDTET_US_DAG", "us"))
SCOPE_TO_ROLE = (
    ("global", "AF_TRIGGER_SCOPE_GLOBAL"),
    ("us", "AF_TRIGGER_SCOPE_US"),
    ("mx", "AF_TRIGGER_SCOPE_MX"),
    ("cn", "AF_TRIGGER_SCOPE_CN"),
)
# Message formats of the violation report (fixed values):
MSG_CONFLICT = "DAG '%s' has conflicting classification tags %s; expected exactly one classification tag."
MSG_MISSING = "DAG '%s' is missing required classification tag. Expected one of %s, got tags=%s"
MSG_NO_ROLE = "No trigger role mapping configured for scope '%s'"

STATUS_VALID, STATUS_CONFLICT, STATUS_MISSING, STATUS_NO_ROLE = "valid", "conflict", "missing", "no_role"

# --------------------------------------------------------------------------- B1
def _tag_map_items(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``(*keep, _parsed)``: per text an array of (pos, item, tag, scope, reason) structs.

    Built in stages so that each item is stripped once and split once: lambda bodies get
    no common-subexpression elimination, and a separate projection per stage keeps
    Spark from inlining (and so repeating) the earlier arrays.
    """
    s1 = df.select(*keep, F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), ","),
                                      lambda x: py_strip(x)).alias("_items"))
    s2 = s1.select(*keep, "_items",
                   F.transform("_items", lambda x: py_strip(F.substring_index(x, "=", 1))).alias("_tags"),
                   F.transform("_items", lambda x: F.lower(py_strip(
                       F.substr(x, F.instr(x, "=") + 1)))).alias("_scopes"))

    def one(x, i):
        tag, scope = F.element_at("_tags", i + 1), F.element_at("_scopes", i + 1)
        reason = (F.when(x == "", F.lit("blank"))
                  .when(~x.contains("="), F.lit("missing '='"))
                  .when((tag == "") | (scope == ""), F.lit("empty tag/scope")))
        return F.struct(i.alias("pos"), x.alias("item"), tag.alias("tag"), scope.alias("scope"),
                        reason.alias("reason"))

    return s2.select(*keep, F.transform("_items", one).alias("_parsed"))


def parse_tag_map(df: DataFrame, text_col: str, keep: Iterable[str] = (),
                  defaults: Iterable[tuple[str, str]] = DEFAULT_TAG_MAP) -> DataFrame:
    """Tag-map text ``TAG=scope,...`` -> rows ``(*keep, tag, scope, origin)`` (B1).

    Per text: split on ``,``; strip; drop blank; drop items without ``=``; split at the
    first ``=``; strip the tag, strip+lower the scope; drop if either is empty; a
    repeated tag keeps its *last* value. A text with nothing valid (or blank) yields the
    defaults, with ``origin = 'default'``.

    Each text is parsed inside its own row with higher-order functions, so the operator
    is narrow (no shuffle) however many texts there are.
    """
    keep = list(keep)
    defaults_arr = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(s).alias("scope")) for t, s in defaults])
    parsed = _tag_map_items(df, text_col, keep)
    ok = F.filter("_parsed", lambda x: x["reason"].isNull())
    valid = parsed.select(*keep, F.reverse(F.transform(ok, lambda x: x["tag"])).alias("_rt"),
                          F.reverse(F.transform(ok, lambda x: x["scope"])).alias("_rs"))
    # last wins: in the reversed lists the first position of a tag is its last occurrence
    pairs = F.transform(F.array_distinct("_rt"), lambda t: F.struct(
        t.alias("tag"), F.element_at("_rs", F.array_position("_rt", t).cast("int")).alias("scope")))
    chosen = valid.select(*keep, F.when(F.size("_rt") > 0, pairs).otherwise(defaults_arr).alias("_pairs"),
                          F.when(F.size("_rt") > 0, F.lit("parsed")).otherwise(F.lit("default")).alias("origin"))
    return explode_rows(chosen, "_pairs", "_p", *keep, "origin") \
        .select(*keep, F.col("_p.tag").alias("tag"), F.col("_p.scope").alias("scope"), "origin")


def tag_map_rejects(df: DataFrame, text_col: str, keep: Iterable[str] = ()) -> DataFrame:
    """The items B1 dropped with a warning: ``(*keep, pos, item, reason)`` (blank items are skipped silently)."""
    keep = list(keep)
    bad = _tag_map_items(df, text_col, keep).select(
        *keep, F.filter("_parsed", lambda x: x["reason"].isNotNull() & (x["reason"] != "blank")).alias("_bad"))
    return explode_rows(bad, "_bad", "_r", *keep).select(
        *keep, F.col("_r.pos").alias("pos"), F.col("_r.item").alias("item"), F.col("_r.reason").alias("reason"))


# --------------------------------------------------------------------------- B4
def under_root(path_col, root: str | Column) -> Column:
    """True when the path is the root itself or below it on a segment boundary.

    Both sides are normalised lexically (``.``/``..``/duplicate and trailing slashes);
    ``/dags2/x`` is not under ``/dags``; null or empty paths are not under anything.
    """
    p = normalize_path(path_col)
    if isinstance(root, str):
        r_txt = normalize_path_text(root)
        if r_txt == "/":
            return F.coalesce(p.isNotNull(), F.lit(False))
        return F.coalesce((p == r_txt) | p.startswith(r_txt + "/"), F.lit(False))
    r = normalize_path(root)
    below = F.when(r == "/", F.lit(True)).otherwise(p.startswith(F.concat(r, F.lit("/"))))
    return F.coalesce(p.isNotNull() & ((p == r) | below), F.lit(False))


def resolve_root(explicit: str | None = None, configured: str | None = None, default: str = "/dags") -> str:
    """The managed root (B5): the explicit root, else the configured folder, else the
    default; an empty string counts as unset. Returned lexically normalised."""
    for candidate in (explicit, configured, default):
        if candidate:
            return normalize_path_text(candidate)
    raise ValueError("no managed root given")


# --------------------------------------------------------------------------- B7
def _clean_tags(tags: DataFrame, trim_tags: bool) -> DataFrame:
    t = tags.select("entity_id", (py_strip("tag") if trim_tags else F.col("tag")).alias("tag"))
    return t.where(F.col("entity_id").isNotNull() & F.col("tag").isNotNull() & (F.col("tag") != ""))


def _usable(tag_map: DataFrame) -> DataFrame:
    return tag_map.select("tag", "scope").where(F.col("tag").isNotNull() & F.col("scope").isNotNull())


def _status() -> Column:
    """The status by an entity's least and largest scope."""
    return (F.when(F.col("_lo").isNull(), F.lit(STATUS_MISSING))
            .when(F.col("_lo") == F.col("_hi"), F.lit(STATUS_VALID)).otherwise(F.lit(STATUS_CONFLICT)))


# Share of a mean partition from which a tag counts as hot, and bounds of the sketch that looks for such tags.
HOT_SHARE, MAX_HOT, SKETCHES = 0.25, 10_000, 256


def hot_tags(tags: DataFrame) -> list[str]:
    """The tags of ``tags (tag)`` that would fill ``HOT_SHARE`` of a shuffle partition or more each.

    Found by a frequent-items sketch, merged in two steps (``SKETCHES`` groups of tasks, then those), so no task meets
    more than a few hundred sketches of bounded size; at most ``MAX_HOT`` tags reach the driver.
    """
    n = int(tags.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = max(1, min(MAX_HOT, int(n / HOT_SHARE)))
    tracked = 1 << (4 * k - 1).bit_length()  # the sketch's error stays under a hot tag's count
    parts = tags.select("tag", (F.spark_partition_id() % SKETCHES).alias("_part"))
    some = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.expr(f"approx_top_k_accumulate(tag, {tracked})").alias("_s"))
    row = some.groupBy((F.col("_part") < 0).alias("_all")) \
        .agg(F.sum("_n").alias("n"), F.expr(f"approx_top_k_combine(_s, {tracked})").alias("_s")) \
        .select("n", F.expr(f"approx_top_k_estimate(_s, {k})").alias("top")).first()  # one row, none without tags
    return [t["item"] for t in row["top"] or [] if t["count"] >= HOT_SHARE * row["n"] / n] if row else []


def match_tags(tags: DataFrame, tag_map: DataFrame, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES, how: str = "inner") -> DataFrame:
    """``tags`` joined with their scopes. A map within ``max_bytes`` is broadcast. Beyond it the hot tags' part of the
    map, whose size is checked, is broadcast and the other tags are joined by shuffle, so no tag fills a task."""
    if plan_bytes(tag_map) <= max_bytes:
        return tags.join(F.broadcast(tag_map), "tag", how)
    hot = hot_tags(tags)
    if not hot:
        return tags.join(tag_map, "tag", how)
    lookup = literal_lookup(tags.sparkSession, [(t,) for t in hot], "tag string")
    hot_map = tag_map.join(lookup, "tag", "left_semi")
    size = hot_map.agg(F.sum(F.octet_length("tag") + F.octet_length("scope") + 32)).first()[0] or 0
    hot_map = F.broadcast(hot_map) if size <= max_bytes else hot_map
    is_hot = lookup.withColumn("_hot", F.lit(True))
    marked = tags.join(is_hot, "tag", "left")
    return marked.where("_hot").drop("_hot").join(hot_map, "tag", how).unionByName(
        marked.where("_hot is null").drop("_hot").join(tag_map, "tag", how))


def classify(entities: DataFrame, tags: DataFrame, tag_map: DataFrame, trim_tags: bool = True,
             max_map_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Match each entity's tags to the map and decide its status.

    Output, one row per distinct entity id: ``entity_id, status, scope, matched_tags`` where status
    is ``valid`` (exactly one distinct scope), ``conflict`` (more than one) or ``missing``
    (none); two tags of the same scope are valid, and a tag that the map gives two scopes
    counts for both. ``scope`` is set only when valid; ``matched_tags`` is sorted.

    Tags meet the map first (``match_tags``: a broadcast within the size bound, beyond it hot tags apart from the others),
    so only matched tags of the given entities are shuffled on ``entity_id``; the
    join to the entities and the aggregate share that partitioning.
    """
    ids = entities.select("entity_id").distinct()
    matched = match_tags(_clean_tags(tags, trim_tags), _usable(tag_map), max_map_bytes)
    per = ids.join(matched, "entity_id", "left").groupBy("entity_id").agg(
        F.min("scope").alias("_lo"), F.max("scope").alias("_hi"), F.collect_set("tag").alias("_tags"))
    return per.select("entity_id", _status().alias("status"),
                      F.when(_status() == STATUS_VALID, F.col("_lo")).alias("scope"),
                      F.sort_array("_tags").alias("matched_tags"))


# --------------------------------------------------------------------------- B8
def scope_role_table(spark, pairs: Iterable[tuple[str, str]] = SCOPE_TO_ROLE) -> DataFrame:
    """The scope -> role lookup (one role per scope) as a broadcast literal."""
    return literal_lookup(spark, dict(pairs).items(), "scope string, role string")


def resolve_role(classified: DataFrame, scope_role: DataFrame) -> DataFrame:
    """Attach the role of each valid scope; a valid scope without a role row becomes ``no_role``.

    ``scope_role`` holds one role per scope (``scope_role_table`` guarantees it).
    """
    roles = broadcast_if_small(scope_role.select("scope", "role"))
    j = classified.join(roles, "scope", "left")
    status = F.when((F.col("status") == STATUS_VALID) & F.col("role").isNull(), F.lit(STATUS_NO_ROLE)) \
        .otherwise(F.col("status"))
    extra = [c for c in classified.columns if c not in ("entity_id", "status", "scope", "role")]
    return j.select("entity_id", status.alias("status"), "scope",
                    F.when(F.col("status") == STATUS_VALID, F.col("role")).alias("role"), *extra)


# --------------------------------------------------------------------------- B9
def violations(entities: DataFrame, tags: DataFrame, tag_map: DataFrame, scope_role: DataFrame,
               root: str, trim_tags: bool = True) -> DataFrame:
    """One row per entity under ``root`` that fails the policy (B4 -> B6 -> B7 -> B8 -> B9).

    Output: ``entity_id, reason, matched_tags, expected_tags, actual_tags, message``;
    the tag lists are rendered sorted as list literals. Entities outside the root
    are not judged. The tags are read and shuffled once: all of them, each with its scope if it has one, so the
    same aggregate judges an entity and holds its lists. The expected tags are a
    scalar subquery over the map, whatever its size.
    """
    ids = entities.where(under_root("path", root)).select("entity_id").distinct()
    every = match_tags(_clean_tags(tags, trim_tags), _usable(tag_map), how="left")
    per = ids.join(every, "entity_id", "left").groupBy("entity_id").agg(
        F.min("scope").alias("_lo"), F.max("scope").alias("_hi"), F.collect_set("tag").alias("tags"),
        F.collect_set(F.when(F.col("scope").isNotNull(), F.col("tag"))).alias("matched_tags"))
    judged = per.select("entity_id", _status().alias("status"), F.when(_status() == STATUS_VALID, F.col("_lo")).alias("scope"),
                        "matched_tags", "tags")
    bad = resolve_role(judged, scope_role).where(F.col("status") != STATUS_VALID)
    expected = tag_map.where(F.col("tag").isNotNull()).agg(
        py_list_repr(F.collect_set("tag")).alias("expected")).scalar()
    bad = bad.select("entity_id", "status", "scope", py_list_repr("matched_tags").alias("matched"),
                     py_list_repr("tags").alias("actual"), expected.alias("expected"))
    message = (
        F.when(F.col("status") == STATUS_CONFLICT, F.format_string(MSG_CONFLICT, F.col("entity_id"), F.col("matched")))
        .when(F.col("status") == STATUS_MISSING,
              F.format_string(MSG_MISSING, F.col("entity_id"), F.col("expected"), F.col("actual")))
        .otherwise(F.format_string(MSG_NO_ROLE, F.col("scope")))
    )
    return bad.select("entity_id", F.col("status").alias("reason"), F.col("matched").alias("matched_tags"),
                      F.col("expected").alias("expected_tags"), F.col("actual").alias("actual_tags"),
                      message.alias("message"))


# --------------------------------------------------------------------------- B10
def desired_grants(entities: DataFrame, tags: DataFrame, tag_map: DataFrame, scopes: Iterable[str] | DataFrame,
                   root: str, trim_tags: bool = False) -> DataFrame:
    """Entities each managed scope should be granted: ``(scope, entity_id)``.

    Under the root, exactly one scope, scope in the managed list; the rest are
    dropped silently. The sync form matches tags raw (``trim_tags=False``) and skips
    entities with an empty id or path.
    """
    ents = entities.where(F.col("entity_id").isNotNull() & (F.col("entity_id") != "")
                          & under_root("path", root)).select("entity_id")
    c = classify(ents, tags, tag_map, trim_tags).where(F.col("status") == STATUS_VALID)
    if isinstance(scopes, DataFrame):
        c = c.join(broadcast_if_small(scopes.select("scope").distinct()), "scope", "left_semi")
    else:
        c = c.where(F.col("scope").isin(list(scopes)))
    return c.select("scope", "entity_id")


__all__ = [
    "DEFAULT_TAG_MAP", "SCOPE_TO_ROLE", "classify", "desired_grants", "parse_tag_map", "resolve_role", "resolve_root",
    "scope_role_name", "scope_role_table", "tag_map_rejects", "under_root", "violations",
]
