"""Conflict resolution between two versions of a collection, column by column in one join."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandql.operators.update import Update


def _at(clock: Column, node: Column) -> Column:
    return F.coalesce(F.try_element_at(clock, node), F.lit(0))


def dominates(a: Column, b: Column) -> Column:
    """Vector clocks (maps node -> count): a has seen all that b has, and more."""
    nodes = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.forall(nodes, lambda k: _at(a, k) >= _at(b, k)) & F.exists(nodes, lambda k: _at(a, k) > _at(b, k))


def concurrent(a: Column, b: Column) -> Column:
    """Neither clock has seen all of the other's."""
    nodes = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.exists(nodes, lambda k: _at(a, k) > _at(b, k)) & F.exists(nodes, lambda k: _at(a, k) < _at(b, k))


def merged_clock(a: Column, b: Column) -> Column:
    nodes = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    return F.map_from_arrays(nodes, F.transform(nodes, lambda k: F.greatest(_at(a, k), _at(b, k))))


#: Joins of two values that need no winner.
COUNTER: Callable[[Column, Column], Column] = lambda a, b: F.greatest(a, b)
UNION: Callable[[Column, Column], Column] = lambda a, b: F.array_distinct(F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array())))


def remote_wins_by_time(local_ts: Column, remote_ts: Column) -> Column:
    """The later write wins; of writes of one time the remote one. No time is 0."""
    zero = F.lit(0)
    return F.coalesce(remote_ts, zero) >= F.coalesce(local_ts, zero)


def remote_wins_by_clock(local: Column, remote: Column, local_ts: Column, remote_ts: Column, local_doc: Column, remote_doc: Column) -> Column:
    """The version that has seen the other wins; of concurrent ones the one whose latest node is greater, then the later, then the greater document.

    No rule looks at which side is which, so two replicas choose the same version. Without a clock on both sides time decides.
    """
    latest = lambda c: F.coalesce(F.array_max(F.map_keys(c)), F.lit(""))
    zero = F.lit(0)
    early, late = F.coalesce(local_ts, zero), F.coalesce(remote_ts, zero)
    settled = F.when(latest(local) != latest(remote), latest(remote) > latest(local)).when(late != early, late > early).otherwise(remote_doc >= local_doc)
    both = (F.coalesce(F.size(local), F.lit(0)) > 0) & (F.coalesce(F.size(remote), F.lit(0)) > 0)
    by_clock = F.when(dominates(remote, local), F.lit(True)).when(dominates(local, remote), F.lit(False)).otherwise(settled)
    return F.when(both, by_clock).otherwise(remote_wins_by_time(local_ts, remote_ts))


def resolve(local: DataFrame, remote: DataFrame, strategy: str = "lww", key: str = "_id", ts: str = "ts", joins: dict[str, Callable[[Column, Column], Column]] | None = None, clock: str | None = None, changed: str | None = None) -> DataFrame:
    """One version of every document. strategy: lww, local_wins, remote_wins or field_merge; joins: columns that merge.

    clock: a column of vector clocks. changed: a column with the names of the fields that a side has changed, by which
    field_merge takes a field from the side that changed it, from the winner if both did, and from the remote side, as far
    as it has a value, if neither did.
    """
    names, joins = [c for c in local.columns if c in remote.columns], joins or {}
    a = local.select(*[F.col(f"`{c}`").alias(f"l_{c}") for c in names], F.lit(True).alias("l__"))
    b = remote.select(*[F.col(f"`{c}`").alias(f"r_{c}") for c in names], F.lit(True).alias("r__"))
    both = a.join(b, F.col(f"l_{key}") == F.col(f"r_{key}"), "full_outer")
    here, there = F.col("l__").isNotNull(), F.col("r__").isNotNull()
    if strategy == "local_wins":
        newer = F.lit(False)
    elif strategy == "remote_wins":
        newer = F.lit(True)
    elif strategy in ("lww", "field_merge"):
        times = F.col(f"l_{ts}"), F.col(f"r_{ts}")
        newer = remote_wins_by_time(*times)
        if clock:
            plain = [c for c in names if c != clock]
            document = lambda side: F.to_json(F.struct(*[F.col(f"{side}_{c}").alias(c) for c in plain]))
            newer = remote_wins_by_clock(F.col(f"l_{clock}"), F.col(f"r_{clock}"), *times, document("l"), document("r"))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    out = []
    for c in names:
        x, y = F.col(f"l_{c}"), F.col(f"r_{c}")
        if c in joins:
            value = joins[c](x, y)
        elif clock == c:
            value = merged_clock(x, y)
        elif strategy == "field_merge":
            value = F.coalesce(y, x)
            if changed == c:
                value = F.array_union(F.coalesce(x, F.array()), F.coalesce(y, F.array()))
            elif changed:
                mine, theirs = (F.coalesce(F.array_contains(F.col(f"{s}_{changed}"), c), F.lit(False)) for s in "lr")
                value = F.when(mine & theirs, F.when(newer, y).otherwise(x)).when(mine, x).when(theirs, y).otherwise(value)
        else:
            value = F.when(newer, y).otherwise(x)
        out.append(F.when(here & there, value).when(here, x).otherwise(y).alias(c))
    return both.select(*out)


def changed_fields(before: DataFrame, after: DataFrame, key: str = "_id") -> DataFrame:
    """key, changed: the columns whose values differ between two versions."""
    names = [c for c in before.columns if c in after.columns and c != key]
    joined = before.alias("a").join(after.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"))
    marks = F.array_compact(F.array(*[F.when(~F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")), F.lit(c)) for c in names]))
    return joined.select(F.col(f"a.{key}").alias(key), marks.alias("changed"))


# ---- updates that may be taken in any order

# The operators whose updates commute.
COMMUTATIVE = ("$inc", "$push", "$addToSet", "$min", "$max")


def is_commutative(change: Any) -> bool:
    return isinstance(change, dict) and bool(change) and set(change) <= set(COMMUTATIVE)


def merged_change(local: dict[str, Any], remote: dict[str, Any]) -> dict[str, Any]:
    """One update that does what both commutative updates do."""
    if not (is_commutative(local) and is_commutative(remote)):
        raise ValueError("only commutative updates merge")
    items = lambda x: list(x["$each"]) if isinstance(x, dict) and "$each" in x else [x]
    out: dict[str, Any] = {}
    for op in COMMUTATIVE:
        sides = [c[op] for c in (local, remote) if op in c]
        fields: dict[str, Any] = {}
        for path in dict.fromkeys(p for side in sides for p in side):
            values = [side[path] for side in sides if path in side]
            if op == "$inc":
                fields[path] = sum(values)
            elif op in ("$min", "$max"):
                fields[path] = (min if op == "$min" else max)(values)
            else:
                listed = [x for v in values for x in items(v)]
                fields[path] = {"$each": list({json.dumps(x, sort_keys=True, default=str): x for x in reversed(listed)}.values())[::-1] if op == "$addToSet" else listed}
        if fields:
            out[op] = fields
    return out


def reapplied(remote: DataFrame, change: dict[str, Any]) -> DataFrame:
    """The remote documents with a local commutative update done again on top of them."""
    if not is_commutative(change):
        raise ValueError("only commutative updates are done again")
    return Update(change).apply(remote)
