"""Typed columns: every compiled expression is a Column together with its Spark type."""

from __future__ import annotations

import datetime as dt
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PipelineError(ValueError):
    """A pipeline, filter, update or schema that cannot be compiled."""


class Val(NamedTuple):
    col: Column
    type: T.DataType

    @property
    def is_null(self) -> bool:
        return isinstance(self.type, T.NullType)

    @property
    def is_array(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def is_struct(self) -> bool:
        return isinstance(self.type, T.StructType)

    @property
    def is_number(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def is_string(self) -> bool:
        return isinstance(self.type, T.StringType)

    @property
    def is_bool(self) -> bool:
        return isinstance(self.type, T.BooleanType)

    @property
    def is_date(self) -> bool:
        return isinstance(self.type, (T.TimestampType, T.TimestampNTZType, T.DateType))


def null() -> Val:
    return Val(F.lit(None), T.NullType())

# The order of types in comparisons and the names of types.
RANKS = ((T.NullType, 0), (T.NumericType, 1), (T.StringType, 2), (T.StructType, 3), (T.MapType, 3), (T.ArrayType, 4), (T.BinaryType, 5), (T.BooleanType, 7), (T.TimestampType, 8), (T.TimestampNTZType, 8), (T.DateType, 8))
TYPE_NAMES = ((T.NullType, "null"), (T.DecimalType, "decimal"), (T.DoubleType, "double"), (T.FloatType, "double"), (T.LongType, "long"), (T.IntegralType, "int"), (T.StringType, "string"), (T.StructType, "object"), (T.MapType, "object"), (T.ArrayType, "array"), (T.BinaryType, "binData"), (T.BooleanType, "bool"), (T.TimestampType, "date"), (T.TimestampNTZType, "date"), (T.DateType, "date"))
TYPE_NUMBERS = {1: "double", 2: "string", 3: "object", 4: "array", 5: "binData", 7: "objectId", 8: "bool", 9: "date", 10: "null", 11: "regex", 16: "int", 18: "long", 19: "decimal"}


def rank(kind: T.DataType) -> int:
    return next((r for k, r in RANKS if isinstance(kind, k)), 9)


def type_name(kind: T.DataType) -> str:
    return next((n for k, n in TYPE_NAMES if isinstance(kind, k)), "object")


def literal(x: Any) -> Val:
    """A plain Python value as a typed literal; dicts become structs, lists arrays of their common type."""
    if isinstance(x, Val):
        return x
    if x is None:
        return null()
    if isinstance(x, bool):
        return Val(F.lit(x), T.BooleanType())
    if isinstance(x, int):
        return Val(F.lit(x), T.IntegerType() if -(2**31) <= x < 2**31 else T.LongType())
    if isinstance(x, float):
        return Val(F.lit(x), T.DoubleType())
    if isinstance(x, str):
        return Val(F.lit(x), T.StringType())
    if isinstance(x, bytes):
        return Val(F.lit(x), T.BinaryType())
    if isinstance(x, dt.datetime):
        if x.tzinfo:
            x = x.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return Val(F.to_timestamp_ntz(F.lit(x.isoformat(sep=" "))), T.TimestampNTZType())
    if isinstance(x, dt.date):
        return Val(F.lit(x), T.DateType())
    if isinstance(x, dict):
        return struct_of({k: literal(v) for k, v in x.items()})
    if isinstance(x, (list, tuple)):
        return array_of([literal(v) for v in x])
    raise PipelineError(f"no column for a value of type {type(x).__name__}")


def struct_of(fields: dict[str, Val]) -> Val:
    if not fields:
        return Val(F.struct(), T.StructType([]))
    kind = T.StructType([T.StructField(k, v.type) for k, v in fields.items()])
    return Val(F.struct(*[v.col.alias(k) for k, v in fields.items()]), kind)


def array_of(items: list[Val]) -> Val:
    kind = common_type([v.type for v in items])
    if not items:
        return Val(F.array().cast(T.ArrayType(T.StringType())), T.ArrayType(T.StringType()))
    return Val(F.array(*[cast(v, kind).col for v in items]), T.ArrayType(kind))


def common_type(kinds: list[T.DataType]) -> T.DataType:
    """The type that values of all these types are brought to; text if nothing else holds them all."""
    out: T.DataType = T.NullType()
    for kind in kinds:
        if isinstance(kind, T.NullType) or kind == out:
            continue
        if isinstance(out, T.NullType):
            out = kind
        elif isinstance(kind, T.NumericType) and isinstance(out, T.NumericType):
            whole = isinstance(kind, T.IntegralType) and isinstance(out, T.IntegralType)
            out = T.LongType() if whole else T.DoubleType()
        elif rank(kind) == rank(out) == 8:
            out = T.TimestampNTZType()
        elif isinstance(kind, T.ArrayType) and isinstance(out, T.ArrayType):
            out = T.ArrayType(common_type([kind.elementType, out.elementType]))
        elif isinstance(kind, T.StructType) and isinstance(out, T.StructType):
            names = list(dict.fromkeys([*out.names, *kind.names]))
            out = T.StructType([T.StructField(n, common_type([s[n].dataType for s in (out, kind) if n in s.names])) for n in names])
        else:
            return T.StringType()
    return out


def cast(v: Val, kind: T.DataType) -> Val:
    """v as this type; structs field by field, so that added fields are null."""
    if v.type == kind:
        return v
    if isinstance(kind, T.NullType):
        return v
    if isinstance(kind, T.StringType) and (v.is_array or v.is_struct or isinstance(v.type, T.MapType)):
        return Val(F.to_json(v.col), kind)
    if isinstance(kind, T.StructType) and v.is_struct and v.type.names != kind.names:
        fields = [(cast(Val(v.col.getField(f.name), v.type[f.name].dataType), f.dataType).col if f.name in v.type.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields]
        return Val(F.when(v.col.isNotNull(), F.struct(*fields)), kind)
    return Val(v.col.cast(kind), kind)


def unify(values: list[Val]) -> tuple[list[Val], T.DataType]:
    kind = common_type([v.type for v in values])
    return [cast(v, kind) for v in values], kind


def truthy(v: Val) -> Column:
    """False for null, 0, "" and false; true for anything else."""
    if v.is_null:
        return F.lit(False)
    if v.is_bool:
        return F.coalesce(v.col, F.lit(False))
    if v.is_number:
        return F.coalesce(v.col != 0, F.lit(False))
    if v.is_string:
        return F.coalesce(v.col != "", F.lit(False))
    return v.col.isNotNull()


def number(v: Val) -> Val:
    """v if it is a number, else null."""
    return v if v.is_number else Val(F.lit(None).cast("double"), T.DoubleType())


def equal(a: Val, b: Val) -> Column:
    """Null-safe equality; values of different kinds are never equal."""
    if a.is_null or b.is_null:
        return a.col.isNull() if b.is_null else b.col.isNull()
    if rank(a.type) != rank(b.type):
        return F.lit(False) | (a.col.isNull() & b.col.isNull())
    (a, b), kind = unify([a, b])
    return a.col.eqNullSafe(b.col)


def compare(op: str, a: Val, b: Val) -> Column:
    """$gt, $gte, $lt, $lte in the order null < number < string < object < array < bool < date; never null."""
    if op in ("$gte", "$lte"):
        return ~compare("$lt" if op == "$gte" else "$gt", a, b)
    if op == "$lt":
        return compare("$gt", b, a)
    if a.is_null:
        return F.lit(False)
    if b.is_null:
        return a.col.isNotNull()
    if rank(a.type) != rank(b.type):
        both = F.lit(rank(a.type) > rank(b.type))
    else:
        (x, y), kind = unify([a, b])
        both = F.lit(False) if isinstance(kind, (T.StructType, T.MapType)) else F.coalesce(x.col > y.col, F.lit(False))
    return F.when(a.col.isNull(), F.lit(False)).when(b.col.isNull(), F.lit(True)).otherwise(both)


# ---- paths


class Frame(NamedTuple):
    """The document of the current row: all columns of a DataFrame but the hidden ones."""

    fields: tuple[T.StructField, ...]

    @classmethod
    def of(cls, df: DataFrame, hidden: tuple[str, ...] = ()) -> Frame:
        return cls(tuple(f for f in df.schema.fields if f.name not in hidden))

    def get(self, name: str) -> Val | None:
        return next((Val(F.col(f"`{f.name}`"), f.dataType) for f in self.fields if f.name == name), None)

    def whole(self) -> Val:
        return struct_of({f.name: Val(F.col(f"`{f.name}`"), f.dataType) for f in self.fields})


def step(v: Val, name: str) -> Val | None:
    """The field, key or array place of this name in v."""
    if v.is_struct:
        return Val(v.col.getField(name), v.type[name].dataType) if name in v.type.names else None
    if isinstance(v.type, T.MapType):
        return Val(F.try_element_at(v.col, F.lit(name)), v.type.valueType)
    if v.is_array and name.isdigit():
        return Val(F.get(v.col, F.lit(int(name))), v.type.elementType)
    if isinstance(v.type, T.VariantType):
        return Val(F.try_variant_get(v.col, f"$.{name}", "variant"), v.type)
    return None


def resolve(root: Frame | Val, path: str) -> Val | None:
    """The value at a dotted path; None if the schema has no such path."""
    if isinstance(root, Frame) and (whole := root.get(path)):
        return whole
    head, *rest = path.split(".")
    at = root.get(head) if isinstance(root, Frame) else step(root, head)
    for name in rest:
        at = at and step(at, name)
    return at


def fan_out(root: Frame | Val, path: str) -> Val | None:
    """Like resolve, but a name under an array of documents gives the array of their fields (flattened)."""
    parts = path.split(".")
    at = root.get(parts[0]) if isinstance(root, Frame) else step(root, parts[0])
    for name in parts[1:]:
        if at is None:
            return None
        if at.is_array and not name.isdigit() and isinstance(at.type.elementType, T.StructType) and name in at.type.elementType.names:
            inner = at.type.elementType[name].dataType
            got = F.transform(at.col, _field(name))
            at = Val(F.flatten(got), inner) if isinstance(inner, T.ArrayType) else Val(got, T.ArrayType(inner))
        else:
            at = step(at, name)
    return at


def _field(name: str):
    return lambda x: x.getField(name)


def put(v: Val | None, path: list[str], new: Val) -> Val:
    """v with new at the path below it; documents on the way are made where there are none."""
    if not path:
        return new
    fields = {f.name: Val(v.col.getField(f.name), f.dataType) for f in v.type.fields} if v is not None and v.is_struct else {}
    fields[path[0]] = put(fields.get(path[0]), path[1:], new)
    return struct_of(fields)


def without(v: Val, path: list[str]) -> Val:
    """v without the field at the path below it."""
    if not v.is_struct or path[0] not in v.type.names:
        return v
    fields = {f.name: Val(v.col.getField(f.name), f.dataType) for f in v.type.fields}
    if len(path) == 1:
        del fields[path[0]]
    else:
        fields[path[0]] = without(fields[path[0]], path[1:])
    made = struct_of(fields)
    return Val(F.when(v.col.isNotNull(), made.col), made.type)
