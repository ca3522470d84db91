"""Column-level building blocks (all built-in Spark expressions, no UDFs)."""
from tagwarden.functions.text import (
    first_non_empty,
    normalize_path,
    py_list_repr,
    py_strip,
    shell_quote,
)
from tagwarden.functions.tags import (
    label_from_tag,
    normalize_scopes,
    normalize_tags,
    scope_role_name,
    tag_from_source,
)

__all__ = [
    "first_non_empty",
    "label_from_tag",
    "normalize_path",
    "normalize_scopes",
    "normalize_tags",
    "py_list_repr",
    "py_strip",
    "scope_role_name",
    "shell_quote",
    "tag_from_source",
]
