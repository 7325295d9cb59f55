"""Aggregation expressions compiled to native columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandql.plans.values import Frame, PipelineError, Val, array_of, cast, common_type, compare, equal, literal, null, number, resolve, step, struct_of, truthy, type_name, unify

LONG, INT, DOUBLE, STRING, BOOL, STAMP = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.TimestampNTZType()
REGISTRY: dict[str, Callable[[Expr, Any], Val]] = {}

# Conversion letters of strftime and the letters of Spark's date patterns.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%L": "SSS", "%j": "DDD", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "E", "%A": "EEEE", "%p": "a", "%I": "hh", "%f": "SSSSSS", "%%": "%"}


def op(*names: str):
    def keep(f):
        for n in names:
            REGISTRY[n] = f
        return f

    return keep


class Expr:
    """Compiles expressions against a document and the variables in scope."""

    def __init__(self, root: Frame | Val, variables: dict[str, Val] | None = None, meta: dict[str, str] | None = None) -> None:
        self.root, self.vars, self.meta = root, variables or {}, meta or {}

    def bind(self, **variables: Val) -> Expr:
        return Expr(self.root, {**self.vars, **variables}, self.meta)

    def whole(self) -> Val:
        return self.root.whole() if isinstance(self.root, Frame) else self.root

    def __call__(self, e: Any) -> Val:
        if isinstance(e, str) and e.startswith("$$"):
            name, *rest = e[2:].split(".")
            if name in ("ROOT", "CURRENT"):
                return (resolve(self.root, ".".join(rest)) or null()) if rest else self.whole()
            if name == "REMOVE":
                return null()
            if name == "NOW":
                return Val(F.localtimestamp(), STAMP)
            if name not in self.vars:
                raise PipelineError(f"undefined variable $${name}")
            at: Val | None = self.vars[name]
            for part in rest:
                at = at and step(at, part)
            return at or null()
        if isinstance(e, str) and e.startswith("$"):
            return resolve(self.root, e[1:]) or null()
        if isinstance(e, dict):
            if len(e) == 1 and (name := next(iter(e))).startswith("$"):
                if name not in REGISTRY:
                    raise PipelineError(f"unknown expression {name}")
                return REGISTRY[name](self, e[name])
            if bad := [k for k in e if k.startswith("$")]:
                raise PipelineError(f"an expression has one operator, not {bad}")
            return struct_of({k: self(v) for k, v in e.items()})
        if isinstance(e, (list, tuple)):
            return array_of([self(v) for v in e])
        return literal(e)

    def args(self, a: Any, low: int, high: int | None = None, name: str = "expression") -> list[Val]:
        items = list(a) if isinstance(a, (list, tuple)) else [a]
        if not low <= len(items) <= (high if high is not None else low):
            raise PipelineError(f"{name} takes {low} to {high or low} arguments, not {len(items)}")
        return [self(x) for x in items]

    def one(self, a: Any) -> Val:
        return self(a[0]) if isinstance(a, (list, tuple)) and len(a) == 1 else self(a)


def _nulls(v: Val, kind: T.DataType) -> Val:
    return Val(F.lit(None).cast(kind), kind)


def _is_whole(v: Val) -> bool:
    return isinstance(v.type, T.IntegralType)


@op("$literal")
def _(c, a):
    return literal(a)


@op("$add")
def _(c, a):
    return _fold(c, a, lambda x, y: x + y)


@op("$multiply")
def _(c, a):
    return _fold(c, a, lambda x, y: x * y)


def _fold(c, a, f):
    items = [c(x) for x in (a if isinstance(a, (list, tuple)) else [a])]
    if any(not v.is_number for v in items):
        return _nulls(null(), DOUBLE)
    kind = LONG if all(map(_is_whole, items)) else DOUBLE
    out = items[0].col.cast(kind)
    for v in items[1:]:
        out = f(out, v.col.cast(kind))
    return Val(out, kind)


@op("$subtract")
def _(c, a):
    x, y = c.args(a, 2, name="$subtract")
    if x.is_date and y.is_date:
        return Val(F.unix_millis(x.col.cast("timestamp")) - F.unix_millis(y.col.cast("timestamp")), LONG)
    x, y = number(x), number(y)
    kind = LONG if _is_whole(x) and _is_whole(y) else DOUBLE
    return Val(x.col.cast(kind) - y.col.cast(kind), kind)


@op("$divide")
def _(c, a):
    x, y = map(number, c.args(a, 2, name="$divide"))
    return Val(F.try_divide(x.col.cast("double"), y.col.cast("double")), DOUBLE)


@op("$mod")
def _(c, a):
    x, y = map(number, c.args(a, 2, name="$mod"))
    kind = LONG if _is_whole(x) and _is_whole(y) else DOUBLE
    return Val(F.try_mod(x.col.cast(kind), y.col.cast(kind)), kind)


@op("$abs")
def _(c, a):
    v = number(c.one(a))
    return Val(F.abs(v.col), v.type)


@op("$ceil")
def _(c, a):
    return Val(F.ceil(number(c.one(a)).col).cast("double"), DOUBLE)


@op("$floor")
def _(c, a):
    return Val(F.floor(number(c.one(a)).col).cast("double"), DOUBLE)


@op("$round")
def _(c, a):
    items = list(a) if isinstance(a, (list, tuple)) else [a]
    v = number(c(items[0]))
    places = items[1] if len(items) > 1 else 0
    if isinstance(places, int):
        return Val(F.round(v.col, places), v.type)
    scale = F.pow(F.lit(10.0), number(c(places)).col)
    return Val(F.round(v.col * scale) / scale, DOUBLE)


@op("$trunc")
def _(c, a):
    items = list(a) if isinstance(a, (list, tuple)) else [a]
    v = number(c(items[0]))
    scale = F.pow(F.lit(10.0), number(c(items[1])).col) if len(items) > 1 else F.lit(1.0)
    return Val(F.signum(v.col) * F.floor(F.abs(v.col) * scale).cast("double") / scale, DOUBLE)


def _guarded(name, f, holds):
    @op(name)
    def _(c, a):
        x = number(c.one(a)).col.cast("double")
        return Val(F.when(holds(x), f(x)), DOUBLE)


_guarded("$sqrt", F.sqrt, lambda x: x >= 0)
_guarded("$exp", F.exp, lambda x: x.isNotNull())
_guarded("$ln", F.log, lambda x: x > 0)
_guarded("$log10", F.log10, lambda x: x > 0)


@op("$log")
def _(c, a):
    x, b = (number(v).col.cast("double") for v in c.args(a, 2, name="$log"))
    return Val(F.when((x > 0) & (b > 0) & (b != 1), F.log(x) / F.log(b)), DOUBLE)


@op("$pow")
def _(c, a):
    x, y = map(number, c.args(a, 2, name="$pow"))
    out = F.pow(x.col.cast("double"), y.col.cast("double"))
    if _is_whole(x) and _is_whole(y) and isinstance(a[1], int) and a[1] >= 0:
        return Val(out.cast("long"), LONG)
    return Val(F.when(~F.isnan(out), out), DOUBLE)


@op("$sum")
def _(c, a):
    items = [c(x) for x in (a if isinstance(a, (list, tuple)) else [a])]
    if len(items) == 1 and items[0].is_array:
        v = items[0]
        if not isinstance(v.type.elementType, T.NumericType):
            return literal(0)
        kind = LONG if isinstance(v.type.elementType, T.IntegralType) else DOUBLE
        return Val(F.coalesce(F.aggregate(v.col, F.lit(0).cast(kind), lambda s, x: s + F.coalesce(x.cast(kind), F.lit(0).cast(kind))), F.lit(0).cast(kind)), kind)
    items = [v for v in items if v.is_number]
    kind = LONG if all(map(_is_whole, items)) else DOUBLE
    out = F.lit(0).cast(kind)
    for v in items:
        out = out + F.coalesce(v.col.cast(kind), F.lit(0).cast(kind))
    return Val(out, kind)


@op("$eq")
def _(c, a):
    return Val(equal(*c.args(a, 2, name="$eq")), BOOL)


@op("$ne")
def _(c, a):
    return Val(~equal(*c.args(a, 2, name="$ne")), BOOL)


def _ordering(name):
    @op(name)
    def _(c, a):
        return Val(compare(name, *c.args(a, 2, name=name)), BOOL)


for _name in ("$gt", "$gte", "$lt", "$lte"):
    _ordering(_name)


@op("$and")
def _(c, a):
    out = F.lit(True)
    for x in a if isinstance(a, (list, tuple)) else [a]:
        out = out & truthy(c(x))
    return Val(out, BOOL)


@op("$or")
def _(c, a):
    out = F.lit(False)
    for x in a if isinstance(a, (list, tuple)) else [a]:
        out = out | truthy(c(x))
    return Val(out, BOOL)


@op("$not")
def _(c, a):
    return Val(~truthy(c.one(a)), BOOL)


@op("$cond")
def _(c, a):
    test, yes, no = (a["if"], a["then"], a["else"]) if isinstance(a, dict) else a
    (y, n), kind = unify([c(yes), c(no)])
    return Val(F.when(truthy(c(test)), y.col).otherwise(n.col), kind)


@op("$ifNull")
def _(c, a):
    items, kind = unify([c(x) for x in a])
    return Val(F.coalesce(*[v.col for v in items]), kind)


@op("$switch")
def _(c, a):
    values, kind = unify([*(c(b["then"]) for b in a["branches"]), c(a.get("default"))])
    out = None
    for b, v in zip(a["branches"], values):
        test = truthy(c(b["case"]))
        out = F.when(test, v.col) if out is None else out.when(test, v.col)
    return Val(out.otherwise(values[-1].col), kind)


# ---- strings


def _text(v: Val) -> Column:
    return v.col if v.is_string else F.lit(None).cast("string")


@op("$concat")
def _(c, a):
    return Val(F.concat(*[_text(c(x)) for x in a]), STRING)


@op("$substrCP")
def _(c, a):
    s, start, size = c.args(a, 3, name="$substrCP")
    text = s.col if s.is_string else s.col.cast("string")
    size = F.when(size.col < 0, F.char_length(text)).otherwise(size.col).cast("int")
    return Val(F.coalesce(F.substring(text, (start.col + 1).cast("int"), size), F.lit("")), STRING)


@op("$substr", "$substrBytes")
def _(c, a):
    """By bytes; a character cut in two is shown as one that cannot be read."""
    s, start, size = c.args(a, 3, name="$substr")
    data = (s.col if s.is_string else s.col.cast("string")).cast("binary")
    size = F.when(size.col < 0, F.octet_length(data)).otherwise(size.col).cast("int")
    return Val(F.coalesce(F.substring(data, (start.col + 1).cast("int"), size).cast("string"), F.lit("")), STRING)


@op("$toUpper")
def _(c, a):
    return Val(F.upper(c.one(a).col.cast("string")), STRING)


@op("$toLower")
def _(c, a):
    return Val(F.lower(c.one(a).col.cast("string")), STRING)


@op("$strLenCP", "$strLenBytes")
def _(c, a):
    return Val(F.char_length(_text(c.one(a))), INT)


def _trimmer(name, f):
    @op(name)
    def _(c, a):
        s = _text(c(a["input"]))
        return Val(f(s, c(a["chars"]).col) if a.get("chars") is not None else f(s, F.lit(" \t\n\r\f\x0b")), STRING)


_trimmer("$trim", F.btrim)
_trimmer("$ltrim", F.ltrim)
_trimmer("$rtrim", F.rtrim)


@op("$split")
def _(c, a):
    s, sep = c.args(a, 2, name="$split")
    pattern = F.lit(re.sub(r"([^\w\s])", r"\\\1", a[1])) if isinstance(a[1], str) and not a[1].startswith("$") else F.regexp_replace(_text(sep), r"([^\w\s])", r"\\$1")
    return Val(F.split(_text(s), pattern), T.ArrayType(STRING))


@op("$indexOfCP", "$indexOfBytes")
def _(c, a):
    items = c.args(a, 2, 4, "$indexOfCP")
    s, sub = _text(items[0]), _text(items[1])
    start = items[2].col.cast("int") if len(items) > 2 else F.lit(0)
    if len(items) > 3:
        s = F.substring(s, F.lit(1), items[3].col.cast("int"))
    return Val(F.call_function("locate", sub, s, start + 1) - 1, INT)


@op("$replaceAll")
def _(c, a):
    return Val(F.replace(_text(c(a["input"])), _text(c(a["find"])), _text(c(a["replacement"]))), STRING)


@op("$replaceOne")
def _(c, a):
    s, find, new = (_text(c(a[k])) for k in ("input", "find", "replacement"))
    at = F.call_function("locate", find, s, F.lit(1))
    rest = F.substring(s, at + F.char_length(find), F.char_length(s))
    return Val(F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), new, rest)).otherwise(F.when(new.isNotNull() & find.isNotNull(), s)), STRING)


def inline_flags(pattern: str, options: str | None) -> str:
    """The pattern with its options as flags in front."""
    flags = "".join(o for o in (options or "") if o in "imsx")
    return f"(?{flags}){pattern}" if flags else pattern


def _regex(c, a) -> tuple[Column, str]:
    pattern = a["regex"]
    if not isinstance(pattern, str) or pattern.startswith("$"):
        raise PipelineError("a regex is a literal pattern")
    return _text(c(a["input"])), inline_flags(pattern, a.get("options"))


@op("$regexMatch")
def _(c, a):
    s, p = _regex(c, a)
    return Val(F.coalesce(s.rlike(p), F.lit(False)), BOOL)


def _groups(p: str) -> int:
    return re.compile(p).groups


@op("$regexFind")
def _(c, a):
    s, p = _regex(c, a)
    kind = T.StructType([T.StructField("match", STRING), T.StructField("idx", INT), T.StructField("captures", T.ArrayType(STRING))])
    caught = F.array(*[F.regexp_extract(s, p, k + 1) for k in range(_groups(p))]).cast(T.ArrayType(STRING))
    made = F.struct(F.regexp_extract(s, p, 0).alias("match"), _first_place(s, p).alias("idx"), caught.alias("captures"))
    return Val(F.when(s.rlike(p), made), kind)


def _first_place(s: Column, p: str) -> Column:
    """Characters before the first match."""
    return F.char_length(F.regexp_extract(s, f"(?s)^(.*?)(?:{p})", 1))


@op("$regexFindAll")
def _(c, a):
    s, p = _regex(c, a)
    n = _groups(p)
    kind = T.StructType([T.StructField("match", STRING), T.StructField("idx", INT), T.StructField("captures", T.ArrayType(STRING))])
    matches = F.regexp_extract_all(s, F.lit(p), F.lit(0))
    groups = F.array(*[F.regexp_extract_all(s, F.lit(p), F.lit(k + 1)) for k in range(n)]) if n else None
    # The text between matches gives their places: lengths of what stands before each, summed.
    gaps = F.split(s, p)

    def one(m, i):
        before = F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda t, x: t + F.char_length(x)) + F.aggregate(F.slice(matches, F.lit(1), i), F.lit(0), lambda t, x: t + F.char_length(x))
        caught = F.transform(groups, lambda g: F.get(g, i)) if groups is not None else F.array().cast(T.ArrayType(STRING))
        return F.struct(m.alias("match"), before.alias("idx"), caught.alias("captures"))

    return Val(F.coalesce(F.transform(matches, one), F.array().cast(T.ArrayType(kind))), T.ArrayType(kind))


# ---- types and conversions


@op("$type")
def _(c, a):
    v = c.one(a)
    return Val(F.when(v.col.isNull(), F.lit("null")).otherwise(F.lit(type_name(v.type))), STRING)


@op("$isArray")
def _(c, a):
    v = c.one(a)
    return Val(v.col.isNotNull() & F.lit(v.is_array), BOOL)


@op("$isNumber")
def _(c, a):
    v = c.one(a)
    return Val(v.col.isNotNull() & F.lit(v.is_number), BOOL)


@op("$toString")
def _(c, a):
    return cast(c.one(a), STRING)


def to_int(v: Val, kind: T.DataType = INT) -> Val:
    if v.is_string:
        return Val(F.trim(v.col).try_cast("double").try_cast(kind), kind)
    if v.is_number or v.is_bool:
        return Val(v.col.try_cast(kind), kind)
    return _nulls(v, kind)


def to_double(v: Val) -> Val:
    return Val(F.trim(v.col).try_cast("double") if v.is_string else v.col.cast("double"), DOUBLE) if v.is_string or v.is_number or v.is_bool else _nulls(v, DOUBLE)


def to_bool(v: Val) -> Val:
    return Val(F.when(v.col.isNotNull(), truthy(v)), BOOL)


def to_date(v: Val) -> Val:
    if v.is_date:
        return Val(v.col.cast(STAMP), STAMP)
    if v.is_number:
        return Val(F.timestamp_millis(v.col.cast("long")).cast(STAMP), STAMP)
    if v.is_string:
        return Val(F.coalesce(v.col.try_cast("timestamp_ntz"), v.col.try_cast("timestamp").cast(STAMP)), STAMP)
    return _nulls(v, STAMP)


@op("$toInt")
def _(c, a):
    return to_int(c.one(a))


@op("$toLong")
def _(c, a):
    return to_int(c.one(a), LONG)


@op("$toDouble", "$toDecimal")
def _(c, a):
    return to_double(c.one(a))


@op("$toBool")
def _(c, a):
    return to_bool(c.one(a))


@op("$toDate")
def _(c, a):
    return to_date(c.one(a))


@op("$convert")
def _(c, a):
    v = c(a["input"])
    to = a["to"]["type"] if isinstance(a["to"], dict) else a["to"]
    makers = {"string": lambda: cast(v, STRING), "int": lambda: to_int(v), "long": lambda: to_int(v, LONG), "double": lambda: to_double(v), "decimal": lambda: to_double(v), "bool": lambda: to_bool(v), "date": lambda: to_date(v)}
    if to not in makers:
        raise PipelineError(f"no conversion to {to}")
    made = makers[to]()
    if "onError" in a:
        bad = cast(c(a["onError"]), made.type)
        made = Val(F.when(made.col.isNull() & v.col.isNotNull(), bad.col).otherwise(made.col), made.type)
    if "onNull" in a:
        made = Val(F.when(v.col.isNull(), cast(c(a["onNull"]), made.type).col).otherwise(made.col), made.type)
    return made


@op("$dateFromString")
def _(c, a):
    v = c(a["dateString"])
    made = to_date(v) if "format" not in a else Val(F.try_to_timestamp(_text(v), F.lit(java_format(a["format"]))).cast(STAMP), STAMP)
    if "onError" in a:
        made = Val(F.when(made.col.isNull() & v.col.isNotNull(), to_date(c(a["onError"])).col).otherwise(made.col), STAMP)
    return made


def java_format(pattern: str) -> str:
    """A strftime pattern in the letters of Spark's date patterns."""
    out = []
    for part in re.findall(r"%.|[^%]+", pattern):
        if part.startswith("%"):
            if part not in STRFTIME:
                raise PipelineError(f"unknown date conversion {part}")
            out.append(STRFTIME[part])
        else:
            out.append("'" + part.replace("'", "''") + "'" if re.search(r"[A-Za-z']", part) else part)
    return "".join(out)


@op("$dateToString")
def _(c, a):
    v = to_date(c(a["date"]))
    made = F.date_format(v.col, java_format(a.get("format", "%Y-%m-%dT%H:%M:%S.%LZ")))
    return Val(F.coalesce(made, _text(c(a["onNull"]))) if "onNull" in a else made, STRING)


def _date_part(name, f):
    @op(name)
    def _(c, a):
        v = c(a["date"]) if isinstance(a, dict) and "date" in a else c.one(a)
        return Val(f(v.col) if v.is_date else F.lit(None).cast("int"), INT)


for _name, _f in (("$year", F.year), ("$month", F.month), ("$dayOfMonth", F.dayofmonth), ("$hour", F.hour), ("$minute", F.minute), ("$second", F.second), ("$dayOfWeek", F.dayofweek), ("$dayOfYear", F.dayofyear)):
    _date_part(_name, _f)


# ---- arrays


def _array(v: Val) -> Val:
    return v if v.is_array else Val(F.lit(None).cast(T.ArrayType(STRING)), T.ArrayType(STRING))


@op("$arrayElemAt")
def _(c, a):
    v, i = c.args(a, 2, name="$arrayElemAt")
    v, i = _array(v), i.col.cast("int")
    return Val(F.get(v.col, F.when(i < 0, F.size(v.col) + i).otherwise(i)), v.type.elementType)


@op("$first")
def _(c, a):
    v = _array(c.one(a))
    return Val(F.get(v.col, F.lit(0)), v.type.elementType)


@op("$last")
def _(c, a):
    v = _array(c.one(a))
    return Val(F.get(v.col, F.size(v.col) - 1), v.type.elementType)


@op("$size")
def _(c, a):
    v = _array(c.one(a))
    return Val(F.when(v.col.isNotNull(), F.size(v.col)), INT)


@op("$slice")
def _(c, a):
    items = c.args(a, 2, 3, "$slice")
    v = _array(items[0])
    size = F.size(v.col)
    if len(items) == 2:
        n = items[1].col.cast("int")
        start, take = F.when(n < 0, F.greatest(size + n, F.lit(0))).otherwise(F.lit(0)), F.least(F.abs(n), size)
    else:
        p, n = items[1].col.cast("int"), items[2].col.cast("int")
        start, take = F.when(p < 0, F.greatest(size + p, F.lit(0))).otherwise(F.least(p, size)), F.greatest(n, F.lit(0))
    return Val(F.slice(v.col, start + 1, take), v.type)


@op("$reverseArray")
def _(c, a):
    v = _array(c.one(a))
    return Val(F.reverse(v.col), v.type)


@op("$concatArrays")
def _(c, a):
    items, kind = unify([_array(c(x)) for x in a])
    return Val(F.concat(*[v.col for v in items]), kind)


@op("$in")
def _(c, a):
    x, v = c.args(a, 2, name="$in")
    v = _array(v)
    return Val(F.coalesce(F.exists(v.col, lambda e: equal(Val(e, v.type.elementType), x)), F.lit(False)), BOOL)


@op("$indexOfArray")
def _(c, a):
    items = c.args(a, 2, 4, "$indexOfArray")
    v = _array(items[0])
    start = items[2].col.cast("int") if len(items) > 2 else F.lit(0)
    end = items[3].col.cast("int") if len(items) > 3 else F.size(v.col)
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(v.col) - 1, F.lit(0))), lambda i: (i >= start) & (i < end) & equal(Val(F.get(v.col, i), v.type.elementType), items[1]))
    return Val(F.when(v.col.isNotNull(), F.coalesce(F.get(places, F.lit(0)), F.lit(-1))), INT)


@op("$range")
def _(c, a):
    items = c.args(a, 2, 3, "$range")
    lo, hi = (v.col.cast("int") for v in items[:2])
    by = items[2].col.cast("int") if len(items) > 2 else F.lit(1)
    by = F.when(by == 0, F.lit(1)).otherwise(by)
    some = ((by > 0) & (lo < hi)) | ((by < 0) & (lo > hi))
    last = F.when(by > 0, hi - 1).otherwise(hi + 1)
    return Val(F.when(some, F.sequence(lo, last, by)).otherwise(F.when(lo.isNotNull() & hi.isNotNull(), F.array().cast("array<int>"))), T.ArrayType(INT))


@op("$zip")
def _(c, a):
    items = [_array(c(x)) for x in a["inputs"]]
    kind = common_type([v.type.elementType for v in items])
    sizes = [F.size(v.col) for v in items]
    longest = a.get("useLongestLength", False)
    n = sizes[0] if len(sizes) == 1 else (F.greatest if longest else F.least)(*sizes)
    fill = [cast(c(x), kind).col for x in a["defaults"]] if a.get("defaults") else [F.lit(None).cast(kind)] * len(items)
    place = lambda i: F.array(*[F.when(i < s, cast(Val(F.get(v.col, i), v.type.elementType), kind).col).otherwise(f) for v, s, f in zip(items, sizes, fill)])
    known = items[0].col.isNotNull()
    for v in items[1:]:
        known = known & v.col.isNotNull()
    empty = F.array().cast(T.ArrayType(T.ArrayType(kind)))
    return Val(F.when(known, F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), place)).otherwise(empty)), T.ArrayType(T.ArrayType(kind)))


@op("$map")
def _(c, a):
    v, name, got = _array(c(a["input"])), a.get("as", "this"), []

    def one(x):
        got.append(c.bind(**{name: Val(x, v.type.elementType)})(a["in"]))
        return got[-1].col

    out = F.transform(v.col, one)
    return Val(out, T.ArrayType(got[-1].type))


@op("$filter")
def _(c, a):
    v, name = _array(c(a["input"])), a.get("as", "this")
    out = F.filter(v.col, lambda x: truthy(c.bind(**{name: Val(x, v.type.elementType)})(a["cond"])))
    if a.get("limit") is not None:
        out = F.slice(out, F.lit(1), c(a["limit"]).col.cast("int"))
    return Val(out, v.type)


@op("$reduce")
def _(c, a):
    v, start = _array(c(a["input"])), c(a["initialValue"])
    kinds: list[T.DataType] = []

    def merged(kind):
        def one(s, x):
            made = c.bind(value=Val(s, kind), this=Val(x, v.type.elementType))(a["in"])
            kinds.append(made.type)
            return cast(made, kind).col

        return one

    kind = start.type
    for _ in range(3):  # the result's type may be wider than the initial value's
        out = F.aggregate(v.col, cast(start, kind).col if not start.is_null else F.lit(None).cast(kind), merged(kind))
        if (wider := common_type([kind, kinds[-1]])) == kind:
            break
        kind = wider
    return Val(out, kind)


@op("$let")
def _(c, a):
    return c.bind(**{k: c(v) for k, v in a["vars"].items()})(a["in"])


# ---- objects


@op("$mergeObjects")
def _(c, a):
    items = [c(x) for x in (a if isinstance(a, (list, tuple)) else [a])]
    return merge_structs([v for v in items if v.is_struct])


def merge_structs(items: list[Val]) -> Val:
    """Documents merged field by field; where a later document is null, its fields don't count."""
    if not items:
        return struct_of({})
    fields: dict[str, Val] = {}
    for v in items:
        for f in v.type.fields:
            new = Val(v.col.getField(f.name), f.dataType)
            if f.name in fields:
                (old, new), kind = unify([fields[f.name], new])
                new = Val(F.when(v.col.isNotNull(), new.col).otherwise(old.col), kind)
            fields[f.name] = new
    return struct_of(fields)


@op("$objectToArray")
def _(c, a):
    v = c.one(a)
    if isinstance(v.type, T.MapType):
        pairs = F.transform(F.map_entries(v.col), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
        return Val(pairs, T.ArrayType(T.StructType([T.StructField("k", STRING), T.StructField("v", v.type.valueType)])))
    if not v.is_struct or not v.type.fields:
        return Val(F.lit(None).cast("array<struct<k:string,v:string>>"), T.ArrayType(T.StructType([T.StructField("k", STRING), T.StructField("v", STRING)])))
    kind = common_type([f.dataType for f in v.type.fields])
    pairs = F.array(*[F.struct(F.lit(f.name).alias("k"), cast(Val(v.col.getField(f.name), f.dataType), kind).col.alias("v")) for f in v.type.fields])
    return Val(F.when(v.col.isNotNull(), pairs), T.ArrayType(T.StructType([T.StructField("k", STRING), T.StructField("v", kind)])))


@op("$arrayToObject")
def _(c, a):
    v = _array(c.one(a))
    kind = v.type.elementType
    if isinstance(kind, T.StructType) and {"k", "v"} <= set(kind.names):
        key, value, of = (lambda e: e.getField("k")), (lambda e: e.getField("v")), kind["v"].dataType
    elif isinstance(kind, T.ArrayType):
        key, value, of = (lambda e: F.get(e, F.lit(0)).cast("string")), (lambda e: F.get(e, F.lit(1))), kind.elementType
    else:
        raise PipelineError("$arrayToObject takes {k, v} documents or pairs")
    # The last of equal keys wins.
    entries = F.transform(v.col, lambda e: F.struct(key(e).alias("key"), value(e).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return Val(F.map_from_entries(last), T.MapType(STRING, of))


@op("$getField")
def _(c, a):
    name, v = (a, c.whole()) if isinstance(a, str) else (a["field"], c(a.get("input", "$$CURRENT")))
    return step(v, name) or null()


@op("$setField")
def _(c, a):
    v, new = c(a.get("input", "$$CURRENT")), a["value"]
    fields = {f.name: Val(v.col.getField(f.name), f.dataType) for f in v.type.fields}
    if new == "$$REMOVE":
        fields.pop(a["field"], None)
    else:
        fields[a["field"]] = c(new)
    made = struct_of(fields)
    return Val(F.when(v.col.isNotNull(), made.col), made.type)


def bson_bytes(v: Val) -> Column:
    """Encoded bytes of a value, without its name and type byte."""
    if v.is_struct:
        out = F.lit(5)
        for f in v.type.fields:
            own = Val(v.col.getField(f.name), f.dataType)
            out = out + F.lit(2 + len(f.name.encode())) + bson_bytes(own)
        return F.when(v.col.isNotNull(), out).otherwise(F.lit(0))
    if v.is_array:
        items = F.transform(v.col, lambda x, i: F.lit(2) + F.char_length(i.cast("string")) + bson_bytes(Val(x, v.type.elementType)))
        return F.coalesce(F.aggregate(items, F.lit(5), lambda s, x: s + x), F.lit(0))
    if v.is_string:
        return F.coalesce(F.octet_length(v.col) + 5, F.lit(0))
    if isinstance(v.type, T.BinaryType):
        return F.coalesce(F.octet_length(v.col) + 5, F.lit(0))
    size = {"bool": 1, "int": 4, "decimal": 16, "null": 0}.get(type_name(v.type), 8)
    return F.when(v.col.isNotNull(), F.lit(size)).otherwise(F.lit(0))


@op("$bsonSize")
def _(c, a):
    v = c.one(a)
    return Val(F.when(v.col.isNotNull(), bson_bytes(v)) if v.is_struct else F.lit(None).cast("int"), INT)


@op("$meta")
def _(c, a):
    name = {"vectorSearchScore": "_vectorScore", "searchScore": "_vectorScore", "textScore": "_textScore", "geoNearDistance": "dist"}.get(a)
    if name is None:
        raise PipelineError(f"unknown $meta {a}")
    return resolve(c.root, c.meta.get(a, name)) or null()
