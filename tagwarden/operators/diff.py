"""The set-difference kernel shared by grant sync (C2, C5) and role reconcile (D3).

Instead of two anti joins (two shuffles of both sides), both sides are tagged with a
flag, unioned, and grouped once on the full key: ``max(flag)`` per side tells which
side(s) hold the key. The aggregation is partial (map-side), so a hot key costs one
row per map task in the shuffle, not one row per input row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_flags(sides: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union the sides with one 0/1 flag column per side; group on ``keys``; max per flag.

    Returns ``keys + [in_<side> ...]`` with one row per distinct key.
    """
    names = list(sides)
    parts = []
    for name, df in sides.items():
        flags = [F.lit(1 if n == name else 0).cast("tinyint").alias(f"in_{n}") for n in names]
        parts.append(df.select(*keys, *flags))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(*keys).agg(*[F.max(f"in_{n}").alias(f"in_{n}") for n in names])
