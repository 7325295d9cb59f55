"""Query filters compiled to one boolean column; null counts as false."""

from __future__ import annotations

import datetime as dt
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandql.functions.expr import Expr, inline_flags
from strandql.operators import geo
from strandql.plans.values import TYPE_NUMBERS, Frame, PipelineError, Val, compare, equal, literal, null, rank, resolve, truthy, type_name

MOST_PATTERN = 1024


def no(c: Column) -> Column:
    """Not c, where an unknown counts as false. Elsewhere unknowns stay, so that comparisons reach the scan as they are."""
    return ~F.coalesce(c, F.lit(False))


class Predicate:
    """Compiles filters against a document (a row or an array's element)."""

    def __init__(self, root: Frame | Val, variables: dict[str, Val] | None = None) -> None:
        self.root, self.vars = root, variables or {}

    def __call__(self, query: dict[str, Any]) -> Column:
        if not isinstance(query, dict):
            raise PipelineError("a filter is a document")
        out = None
        for key, cond in query.items():
            test = self.top(key, cond) if key.startswith("$") else self.field(key, cond)
            if test is not None:
                out = test if out is None else out & test
        return F.lit(True) if out is None else out

    def top(self, key: str, cond: Any) -> Column | None:
        if key == "$comment":
            return None
        if key in ("$and", "$or", "$nor"):
            if not isinstance(cond, (list, tuple)) or not all(isinstance(q, dict) for q in cond):
                raise PipelineError(f"{key} takes a list of filters")
            out = None
            for q in cond:
                test = self(q)
                out = test if out is None else (out & test if key == "$and" else out | test)
            if out is None:
                return F.lit(key != "$or")
            return no(out) if key == "$nor" else out
        if key == "$expr":
            return truthy(Expr(self.root, self.vars)(cond))
        if key == "$text":
            return self.text(cond["$search"] if isinstance(cond, dict) else cond)
        raise PipelineError(f"unknown operator {key}")

    def text(self, search: str) -> Column:
        whole = self.root.whole() if isinstance(self.root, Frame) else self.root
        leaves = F.lower(F.concat_ws(" ", *(string_leaves(whole) or [F.lit("")])))
        out = F.lit(True)
        for token in search.lower().split():
            out = out & leaves.contains(token)
        return out

    def field(self, path: str, cond: Any) -> Column:
        v = resolve(self.root, path)
        if isinstance(cond, re.Pattern):
            cond = {"$regex": cond.pattern, "$options": "".join(o for o, f in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if cond.flags & f)}
        if isinstance(cond, dict) and cond and all(k.startswith("$") for k in cond):
            return self.operators(v, cond, path)
        return self.operator(v, "$eq", cond, {})

    def operators(self, v: Val | None, cond: dict[str, Any], path: str = "") -> Column:
        if set(cond) & geo.OPERATORS:
            test = geo.predicate(v, cond, self.root, path)
            cond = {k: x for k, x in cond.items() if k not in geo.OPERATORS and k not in geo.MODIFIERS}
        else:
            test = None
        for op, x in cond.items():
            if op == "$options":
                continue
            one = self.operator(v, op, x, cond)
            test = one if test is None else test & one
        return F.lit(True) if test is None else test

    def operator(self, v: Val | None, op: str, x: Any, cond: dict[str, Any]) -> Column:
        if op == "$exists":
            there = v.col.isNotNull() if v is not None else F.lit(False)
            return there if x else ~there
        if op == "$not":
            return no(self.operators(v, x) if isinstance(x, dict) else self.operator(v, "$regex", x, {}))
        if op in ("$ne", "$nin"):
            return no(self.operator(v, "$eq" if op == "$ne" else "$in", x, cond))
        if op not in OPERATORS:
            raise PipelineError(f"unknown operator {op}")
        if v is None:
            v = null()
        return OPERATORS[op](self, v, x, cond)


def string_leaves(v: Val) -> list[Column]:
    """All strings of a document, at any depth."""
    if v.is_string:
        return [v.col]
    if v.is_struct:
        return [c for f in v.type.fields for c in string_leaves(Val(v.col.getField(f.name), f.dataType))]
    if v.is_array and isinstance(v.type.elementType, T.StringType):
        return [F.concat_ws(" ", v.col)]
    if v.is_array and isinstance(v.type.elementType, T.StructType):
        return [F.concat_ws(" ", F.transform(v.col, lambda x: F.concat_ws(" ", *(string_leaves(Val(x, v.type.elementType)) or [F.lit("")]))))]
    return []


def _eq(p, v, x, cond):
    w = literal(x)
    if x is None:
        return v.col.isNull()
    if v.is_null or rank(v.type) != rank(w.type):
        return F.lit(False)
    # A plain comparison with a literal, so that it can be pushed down to the scan.
    if v.is_date and isinstance(x, (dt.date, dt.datetime)):
        return v.col == w.col.cast(v.type)
    return v.col == w.col if not v.is_struct and not v.is_array else equal(v, w)


def _range(op):
    def test(p, v, x, cond):
        w = literal(x)
        if v.is_null or w.is_null:
            return F.lit(False)
        if rank(v.type) != rank(w.type):
            above = rank(v.type) > rank(w.type)
            return v.col.isNotNull() & F.lit(above == op.startswith("$g"))
        if v.is_struct or v.is_array:
            return v.col.isNotNull() & compare(op, v, w)
        a, b = v.col, w.col.cast(v.type) if v.is_date else w.col
        return {"$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[op]

    return test


def _in(p, v, x, cond):
    if not isinstance(x, (list, tuple)):
        raise PipelineError("$in takes a list")
    patterns = [e for e in x if isinstance(e, re.Pattern)]
    known = [e for e in x if e is not None and not isinstance(e, re.Pattern)]
    element = v.type.elementType if v.is_array else v.type
    fitting = [e for e in known if rank(literal(e).type) == rank(element)]
    out = F.lit(False)
    if v.is_array:
        if fitting:
            out = F.exists(v.col, lambda e: F.coalesce(e.isin(*fitting), F.lit(False)))
        if None in x:
            out = out | v.col.isNull() | F.exists(v.col, lambda e: e.isNull())
    else:
        if fitting:
            out = v.col.isin(*fitting) if not v.is_date else v.col.isin(*[literal(e).col.cast(v.type) for e in fitting])
        if None in x:
            out = out | v.col.isNull()
    for pattern in patterns:
        out = out | p.operator(v, "$regex", pattern, {})
    return out


def _type(p, v, x, cond):
    names = [TYPE_NUMBERS.get(n, n) for n in (x if isinstance(x, (list, tuple)) else [x])]
    own = type_name(v.type)
    hit = own in names or ("number" in names and v.is_number)
    out = v.col.isNotNull() & F.lit(hit)
    return out | v.col.isNull() if "null" in names else out


def _regex(p, v, x, cond):
    if isinstance(x, re.Pattern):
        cond = {"$options": "".join(o for o, f in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if x.flags & f)}
        x = x.pattern
    if len(x) > MOST_PATTERN:
        raise PipelineError("the pattern is too long")
    return v.col.rlike(inline_flags(x, cond.get("$options"))) if v.is_string else F.lit(False)


def _all(p, v, x, cond):
    if not v.is_array:
        return F.lit(False)
    out = v.col.isNotNull()
    for e in x:
        if isinstance(e, dict) and "$elemMatch" in e:
            out = out & _elem_match(p, v, e["$elemMatch"], cond)
        else:
            out = out & F.exists(v.col, _equals(v.type.elementType, e))
    return out


def _equals(kind, x):
    return lambda y: equal(Val(y, kind), literal(x))


def _elem_match(p, v, x, cond):
    if not v.is_array:
        return F.lit(False)
    kind = v.type.elementType
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.exists(v.col, lambda e: Predicate(Val(e, kind), p.vars)(x))
    ops = x.get("value", x)
    ops = ops if isinstance(ops, dict) else {"$eq": ops}
    return F.exists(v.col, lambda e: Predicate(Val(e, kind), p.vars).operators(Val(e, kind), ops))


def _size(p, v, x, cond):
    return F.size(v.col) == x if v.is_array else F.lit(False)


def _mod(p, v, x, cond):
    divisor, rest = (int(e) for e in x)
    if divisor == 0:
        raise PipelineError("$mod by zero")
    return v.col.cast("long") % F.lit(divisor).cast("long") == rest if v.is_number else F.lit(False)


def _bits(name):
    def test(p, v, x, cond):
        mask = sum(1 << b for b in x) if isinstance(x, (list, tuple)) else int(x)
        if not v.is_number:
            return F.lit(False)
        mask = F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long")
        own = v.col.cast("long").bitwiseAND(mask)
        return {"$bitsAllSet": own == mask, "$bitsAnySet": own != 0, "$bitsAllClear": own == 0, "$bitsAnyClear": own != mask}[name]

    return test


OPERATORS = {
    "$eq": _eq, "$in": _in, "$type": _type, "$regex": _regex, "$all": _all, "$elemMatch": _elem_match, "$size": _size, "$mod": _mod,
    **{k: _range(k) for k in ("$gt", "$gte", "$lt", "$lte")},
    **{k: _bits(k) for k in ("$bitsAllSet", "$bitsAnySet", "$bitsAllClear", "$bitsAnyClear")},
}
