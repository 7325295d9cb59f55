"""Update documents compiled to replacement columns."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandql.operators.predicate import Predicate, no
from strandql.plans.context import Context, frame
from strandql.plans.values import PipelineError, Val, cast, common_type, equal, literal, null, put, resolve, without

# The order in which the operators of one document apply.
ORDER = ("$set", "$setOnInsert", "$unset", "$inc", "$mul", "$min", "$max", "$currentDate", "$rename", "$addToSet", "$push", "$pull", "$pop", "$bit")
PIPELINE = {"$set", "$addFields", "$unset", "$project", "$replaceRoot", "$replaceWith"}


def seed(query: dict[str, Any], schema: T.StructType) -> dict[str, Any]:
    """The document that an upsert begins with: the filter's equalities on its columns."""
    out = {}
    for k, v in query.items():
        if isinstance(v, dict) and set(v) == {"$eq"}:
            v = v["$eq"]
        if not k.startswith("$") and "." not in k and k in schema.names and not (isinstance(v, dict) and any(x.startswith("$") for x in v)):
            out[k] = v
    return {n: out.get(n) for n in schema.names}


def _wide(a: Val, b: Val) -> tuple[Column, Column, T.DataType]:
    kind = common_type([a.type, b.type])
    return cast(a, kind).col, cast(b, kind).col, kind


def _set(old: Val, x: Any) -> Val:
    new = literal(x)
    if new.is_null and not old.is_null:
        return Val(F.lit(None).cast(old.type), old.type)
    if not old.is_null and not new.is_struct:
        kind = common_type([old.type, new.type])
        return cast(new, kind)
    return new


def _inc(old: Val, x: Any) -> Val:
    new = literal(x)
    if old.is_null:
        return new
    a, b, kind = _wide(old, new)
    return Val(F.coalesce(a, F.lit(0).cast(kind)) + b, kind)


def _mul(old: Val, x: Any) -> Val:
    new = literal(x)
    if old.is_null:
        return Val(F.lit(0).cast(new.type), new.type)
    a, b, kind = _wide(old, new)
    return Val(F.coalesce(a * b, F.lit(0).cast(kind)), kind)


def _extreme(f):
    def change(old: Val, x: Any) -> Val:
        new = literal(x)
        if old.is_null:
            return new
        a, b, kind = _wide(old, new)
        return Val(f(a, b), kind)

    return change


def _elements(old: Val, items: list[Any]) -> tuple[Column, Column, T.ArrayType]:
    """(the array, never null; the new items), in one type."""
    new = literal(list(items))
    kind = common_type([old.type, new.type]) if old.is_array else new.type
    have = cast(old, kind).col if old.is_array else F.lit(None).cast(kind)
    return F.coalesce(have, F.array().cast(kind)), cast(new, kind).col, kind


def _push(old: Val, x: Any) -> Val:
    spec = x if isinstance(x, dict) and "$each" in x else {"$each": [x]}
    have, new, kind = _elements(old, spec["$each"])
    at = spec.get("$position")
    if at is None:
        out = F.concat(have, new)
    else:
        place = F.least(F.lit(at), F.size(have)) if at >= 0 else F.greatest(F.size(have) + at, F.lit(0))
        out = F.concat(F.slice(have, F.lit(1), place), new, F.slice(have, place + 1, F.size(have)))
    if "$sort" in spec:
        keys = spec["$sort"]
        if isinstance(keys, dict):
            def before(a, b):
                test = F.when(F.lit(False), F.lit(0))
                for k, d in keys.items():
                    p, q = (resolve(Val(e, kind.elementType), k).col for e in (a, b))
                    test = test.when(F.coalesce(p < q, p.isNull() & q.isNotNull()), F.lit(-d)).when(F.coalesce(p > q, p.isNotNull() & q.isNull()), F.lit(d))
                return test.otherwise(F.lit(0))

            out = F.array_sort(out, before)
        else:
            out = F.sort_array(out, asc=keys == 1)
    if "$slice" in spec:
        n = spec["$slice"]
        out = F.slice(out, F.lit(1), F.lit(n)) if n >= 0 else F.slice(out, F.greatest(F.size(out) + n, F.lit(0)) + 1, F.lit(-n))
    return Val(out, kind)


def _add_to_set(old: Val, x: Any) -> Val:
    items = x["$each"] if isinstance(x, dict) and "$each" in x else [x]
    have, new, kind = _elements(old, items)
    # What is there stays as it is, repeats too; new items come behind, each once.
    fresh = F.filter(F.array_distinct(new), lambda e: ~F.exists(have, lambda h: h.eqNullSafe(e)))
    return Val(F.concat(have, fresh), kind)


def _pull(old: Val, x: Any) -> Val:
    if not old.is_array:
        return old
    kind = old.type.elementType

    def goes(e: Column) -> Column:
        v = Val(e, kind)
        if isinstance(x, dict) and x and all(k.startswith("$") for k in x):
            return Predicate(v).operators(v, x)
        if isinstance(x, dict) and v.is_struct:
            return Predicate(v)(x)
        return equal(v, literal(x))

    return Val(F.filter(old.col, lambda e: no(goes(e))), old.type)


def _pop(old: Val, x: Any) -> Val:
    if not old.is_array:
        return old
    size = F.size(old.col)
    kept = F.greatest(size - 1, F.lit(0))
    return Val(F.slice(old.col, F.lit(2) if x == -1 else F.lit(1), kept), old.type)


def _current_date(old: Val, x: Any) -> Val:
    return Val(F.localtimestamp(), T.TimestampNTZType())


def _bit(old: Val, x: dict[str, int]) -> Val:
    out = F.coalesce(old.col.cast("long"), F.lit(0).cast("long")) if not old.is_null else F.lit(0).cast("long")
    for op, n in x.items():
        out = {"and": out.bitwiseAND, "or": out.bitwiseOR, "xor": out.bitwiseXOR}[op](F.lit(n).cast("long"))
    return Val(out, T.LongType()) if old.is_null else Val(out.cast(old.type), old.type)


CHANGES = {"$set": _set, "$setOnInsert": _set, "$inc": _inc, "$mul": _mul, "$min": _extreme(F.least), "$max": _extreme(F.greatest), "$currentDate": _current_date, "$addToSet": _add_to_set, "$push": _push, "$pull": _pull, "$pop": _pop, "$bit": _bit}


class Update:
    """An update document or pipeline. query and array_filters name the elements that $ and $[name] stand for."""

    def __init__(self, spec: Any, array_filters: list[dict[str, Any]] | None = None, query: dict[str, Any] | None = None, inserting: bool = False) -> None:
        self.spec, self.query, self.inserting = spec, query or {}, inserting
        self.filters: dict[str, dict[str, Any]] = {}
        for f in array_filters or []:
            for k, cond in f.items():
                name, _, path = k.partition(".")
                self.filters.setdefault(name, {})[path] = cond
        if isinstance(spec, list):
            if bad := [k for s in spec for k in s if k not in PIPELINE]:
                raise PipelineError(f"not for updates: {bad}")
        elif bad := [k for k in spec if k not in ORDER]:
            raise PipelineError(f"unknown update operators {bad}" if all(b.startswith("$") for b in bad) else "an update has operators; use replace for whole documents")

    def apply(self, df: DataFrame) -> DataFrame:
        if isinstance(self.spec, list):
            from strandql.plans.pipeline import run

            return run(df, self.spec, Context(df.sparkSession))
        columns = {f.name: Val(F.col(f"`{f.name}`"), f.dataType) for f in frame(df).fields}
        for op in ORDER:
            if op not in self.spec or op == "$setOnInsert" and not self.inserting:
                continue
            for path, x in self.spec[op].items():
                if op == "$rename":
                    self._rename(columns, path, x)
                elif op == "$unset":
                    self._change(columns, path.split("."), lambda old: null() if old.is_null else Val(F.lit(None).cast(old.type), old.type))
                else:
                    self._change(columns, path.split("."), lambda old, op=op, x=x: CHANGES[op](old, x))
        return df.select(*[v.col.alias(k) for k, v in columns.items()])

    def _rename(self, columns: dict[str, Val], path: str, to: str) -> None:
        head, *below = path.split(".")
        v: Val | None = columns.get(head)
        for part in below:
            v = Val(v.col.getField(part), v.type[part].dataType) if v is not None and v.is_struct and part in v.type.names else None
        if v is None:
            return
        if below:
            columns[head] = without(columns[head], below)
        else:
            del columns[head]
        new, *rest = to.split(".")
        columns[new] = put(columns.get(new), rest, v)

    def _change(self, columns: dict[str, Val], path: list[str], change) -> None:
        head = path[0]
        columns[head] = self._at(columns.get(head) or null(), path[1:], change, head)

    def _at(self, v: Val, path: list[str], change, seen: str) -> Val:
        if not path:
            return change(v)
        name, rest = path[0], path[1:]
        every = re.fullmatch(r"\$\[(\w*)\]", name)
        if every or name == "$" or (name.isdigit() and v.is_array):
            if not v.is_array:
                return v
            kind = v.type.elementType
            made = self._at(Val(F.get(v.col, F.lit(0)), kind), rest, change, seen)
            new = common_type([kind, made.type])
            first = self._first(v, seen) if name == "$" else None

            def one(e: Column, i: Column) -> Column:
                own = Val(e, kind)
                changed = cast(self._at(own, rest, change, seen), new).col
                if name == "$":
                    test = i == first
                elif every and every[1]:
                    test = self._named(every[1], own)
                elif every:
                    test = F.lit(True)
                else:
                    test = i == int(name)
                return F.when(test, changed).otherwise(cast(own, new).col)

            return Val(F.transform(v.col, one), T.ArrayType(new))
        fields = {f.name: Val(v.col.getField(f.name), f.dataType) for f in v.type.fields} if v.is_struct else {}
        value = self._at(fields.get(name, null()), rest, change, f"{seen}.{name}")
        return put(v if v.is_struct else None, [name], value)

    def _named(self, name: str, e: Val) -> Column:
        if name not in self.filters:
            raise PipelineError(f"no array filter for {name}")
        test = F.lit(True)
        for path, cond in self.filters[name].items():
            p = Predicate(e)
            test = test & (p.field(path, cond) if path else p.operators(e, cond if isinstance(cond, dict) else {"$eq": cond}))
        return test

    def _first(self, v: Val, path: str) -> Column:
        """The place of the first element that the query's condition on this array fits."""
        kind, test = v.type.elementType, None

        def fits(e: Column) -> Column:
            own, out = Val(e, kind), F.lit(True)
            for k, cond in self.query.items():
                if k == path:
                    cond = cond.get("$elemMatch", cond) if isinstance(cond, dict) else {"$eq": cond}
                    plain = isinstance(cond, dict) and all(x.startswith("$") for x in cond)
                    out = out & (Predicate(own).operators(own, cond) if plain else Predicate(own)(cond))
                elif k.startswith(path + "."):
                    out = out & Predicate(own).field(k[len(path) + 1 :], cond)
            return out

        del test
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(v.col) - 1, F.lit(0))), lambda i: fits(F.get(v.col, i)))
        return F.get(places, F.lit(0))
