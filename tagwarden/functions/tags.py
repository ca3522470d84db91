"""Tag, scope and role-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagwarden.functions.text import _c, py_strip

# Fixed values (must equal the reference's conventions):
SCOPE_ROLE_PREFIX = "AF_TRIGGER_SCOPE_"
ALWAYS_SCOPE = "global"
TAG_US = "GDTET_US_DAG"
TAG_GLOBAL = "GDTET_GLOBAL_DAG"
LABEL_US = "us_dag"
LABEL_GLOBAL = "global_dag"
LABEL_ILLEGAL = "illegal_dag"


def scope_role_name(col, prefix: str = SCOPE_ROLE_PREFIX) -> Column:
    """Scope -> role name: prefix + upper(scope)."""
    return F.concat(F.lit(prefix), F.upper(_c(col)))


def normalize_scopes(col, strict: bool = False) -> Column:
    """Scope list text -> distinct array of scopes, ``global`` always included (B2).

    lenient: split on ``,``, strip, lower, drop blank.
    strict : lower, remove *all* whitespace first (so ``u s`` becomes ``us``); empty
             text is rejected (null result) instead of defaulting to ``[global]``.
    """
    c = _c(col)
    if strict:
        squeezed = F.regexp_replace(F.lower(c), r"\s", "")
        items = F.filter(F.split(squeezed, ","), lambda s: s != "")
        out = F.array_union(F.array_distinct(items), F.array(F.lit(ALWAYS_SCOPE)))
        return F.when(c.isNull() | (squeezed == ""), F.lit(None).cast("array<string>")).otherwise(out)
    items = F.filter(
        F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda s: F.lower(py_strip(s))),
        lambda s: s != "",
    )
    return F.array_union(F.array_distinct(items), F.array(F.lit(ALWAYS_SCOPE)))


def normalize_tags(col, is_string: bool = False) -> Column:
    """Tags -> distinct array of stripped, non-blank tags; null -> empty array.

    ``is_string=True`` treats the column as one lone tag string.
    """
    c = _c(col)
    arr = F.array(c) if is_string else c
    cleaned = F.filter(F.transform(arr, lambda t: py_strip(t)), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.array_distinct(cleaned), F.array().cast("array<string>"))


def tag_from_source(col, us_sources, us_tag: str = TAG_US, global_tag: str = TAG_GLOBAL) -> Column:
    """Source label -> classification tag: listed -> US tag, other -> global tag, absent -> null."""
    c = _c(col)
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(c.isin(list(us_sources)), F.lit(us_tag))
        .otherwise(F.lit(global_tag))
    )


def label_from_tag(col, us_tag: str = TAG_US, global_tag: str = TAG_GLOBAL) -> Column:
    """Classification tag -> label ``us_dag`` / ``global_dag`` / ``illegal_dag``."""
    c = _c(col)
    return (
        F.when(c == us_tag, F.lit(LABEL_US))
        .when(c == global_tag, F.lit(LABEL_GLOBAL))
        .otherwise(F.lit(LABEL_ILLEGAL))
    )
