"""Collations as sort keys and comparisons: strength, and digits by value.

Other options (locale, caseFirst) are taken and change nothing: the order is that of code points.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(c: Column, spec: dict[str, Any]) -> Column:
    """A text that sorts and compares as the collation asks: strength 1 ignores case and marks, 2 case only."""
    strength = int(spec.get("strength", 3))
    if spec.get("numericOrdering"):
        # Each run of digits without leading zeros, led by its length, so that runs sort by value.
        runs = F.split(F.regexp_replace(c, r"(\d+)", "\u0001$1\u0001"), "\u0001")

        def padded(x):
            bare = F.regexp_replace(x, r"^0+(?=\d)", "")
            return F.when(x.rlike(r"^\d+$"), F.concat(F.lpad(F.length(bare).cast("string"), 6, "0"), bare)).otherwise(x)

        c = F.array_join(F.transform(runs, padded), "")
    if strength == 1:
        return F.collate(c, "UNICODE_CI_AI")
    return F.collate(c, "UTF8_LCASE") if strength == 2 else c


def equals(a: Column, b: Any, spec: dict[str, Any]) -> Column:
    return key(a, spec) == key(F.lit(b) if not isinstance(b, Column) else b, spec)
