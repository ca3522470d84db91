"""Text helpers expressed as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes (generated from str.isspace, not listed by hand).
WHITESPACE = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())
# Characters that shell quoting leaves bare (everything else forces single quotes).
# ``\z``: only the very end (``$`` would also match before a final line break).
_SHELL_SAFE = r"^[A-Za-z0-9_@%+=:,./-]+\z"
_BASH_SAFE = r"^[A-Za-z0-9_@%+=:./-]+\z"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def explode_rows(df, array_col, alias: str, *keep):
    """``explode`` without the inferred ``size(array) > 0`` pre-filter.

    For a plain ``explode`` the optimizer adds ``size(arr) > 0`` and pushes it down by
    substituting the array's defining expression, so an expensive array (a parse, a
    variant unpack) would be computed twice per row. ``explode_outer`` infers no such
    filter; the null rows it emits for empty arrays are dropped after the generator.
    """
    return df.select(*keep, F.explode_outer(array_col).alias(alias)).where(F.col(alias).isNotNull())


def py_strip(col) -> Column:
    """Strip leading/trailing whitespace of every kind, like Python's ``str.strip()``.

    Spark's ``trim`` only strips spaces; ``btrim`` with the full whitespace set is exact
    and needs no regex. A first/last-character check (a hash-set lookup) skips the trim
    for values that are already clean, the common case.
    """
    c = _c(col)
    ws = list(WHITESPACE)
    edge = F.substring(c, 1, 1).isin(ws) | F.substring(c, -1, 1).isin(ws)
    return F.when(edge, F.btrim(c, F.lit(WHITESPACE))).otherwise(c)


def first_non_empty(*cols) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols])


def py_repr(col) -> Column:
    """A string literal as Python prints it: single quotes, or double quotes when the text has a
    single quote and no double quote; backslash, tab and line breaks escaped (other control
    characters stay as they are)."""
    c = _c(col)
    for raw, esc in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(esc))
    plain = _c(col)
    double = plain.contains("'") & ~plain.contains('"')
    return F.when(double, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'")))


def py_list_repr(arr) -> Column:
    """Render a string array as a sorted list literal, as Python prints it: ``['a', "it's"]``; empty -> ``[]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(_c(arr)), py_repr), ", "), F.lit("]"))


def shell_quote(col) -> Column:
    """Quote one argument the way a POSIX shell needs it (bare when safe, else single quotes)."""
    c = _c(col)
    escaped = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return (
        F.when(c == "", F.lit("''"))
        .when(c.rlike(_SHELL_SAFE), c)
        .otherwise(escaped)
    )


def bash_quote(col) -> Column:
    """Quote one argument the way bash's ``printf %q`` does: a backslash before every character that
    needs one; ``$'..'`` for text with tabs, line breaks or other control characters; ``''`` for nothing.

    Printable characters beyond ASCII are left bare, as bash does in a UTF-8 locale.
    """
    c = _c(col)
    ansi = c
    for raw, esc in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        ansi = F.replace(ansi, F.lit(raw), F.lit(esc))
    slashed = F.regexp_replace(c, r"([^A-Za-z0-9_@%+=:./\-\x80-\x{10FFFF}])", r"\\$1")
    return (F.when(c == "", F.lit("''")).when(c.rlike(r"[\x00-\x1f\x7f]"), F.concat(F.lit("$'"), ansi, F.lit("'")))
            .when(c.rlike(_BASH_SAFE), c).otherwise(slashed))


# A path needs the slow (segment-folding) normalisation only when it holds an empty,
# ``.`` or ``..`` segment, a trailing slash, or does not start with ``/``.
_NEEDS_NORMALISING = r"(^|/)\.{1,2}(/|$)|//|/$"


def normalize_path(col) -> Column:
    """Lexically normalise an absolute path: drop empty and ``.`` segments, fold ``..``.

    Symbolic links are not resolved (a table of paths has no file system behind it).
    Null or empty input gives null. Paths that are already clean take a fast path
    (one regex test) and skip the higher-order functions.
    """
    c = _c(col)
    parts = F.filter(F.split(c, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s)))
        .when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
        .otherwise(acc),
    )
    clean = c.startswith("/") & ~c.rlike(_NEEDS_NORMALISING)
    return (F.when(c.isNull() | (c == ""), F.lit(None).cast("string"))
            .when(clean, c)
            .otherwise(F.concat(F.lit("/"), F.array_join(folded, "/"))))


def normalize_path_text(path: str) -> str:
    """The same normalisation for a Python string (used for literal roots)."""
    out: list[str] = []
    for seg in path.split("/"):
        if seg in ("", "."):
            continue
        if seg == "..":
            if out:
                out.pop()
            continue
        out.append(seg)
    return "/" + "/".join(out)
