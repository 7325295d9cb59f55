"""A subset of JSON Schema as boolean columns, with the first failure's message."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandql.plans.context import frame
from strandql.plans.values import PipelineError, Val, equal, literal, type_name

MOST_DEPTH = 100
# Names of JSON types for those of documents.
ALIASES = {"boolean": "bool", "integer": "int", "number": "number"}


def _of_type(v: Val, names: Any) -> Column:
    names = [ALIASES.get(n, n) for n in (names if isinstance(names, (list, tuple)) else [names])]
    own = type_name(v.type)
    hit = own in names or ("number" in names and v.is_number) or ("int" in names and isinstance(v.type, T.IntegralType) and "integer" in names)
    return F.when(v.col.isNull(), F.lit("null" in names)).otherwise(F.lit(hit))


class Schema:
    """Rules of a schema; a null value counts as a missing field, as columns cannot tell the two apart."""

    def __init__(self, spec: dict[str, Any]) -> None:
        self.spec = spec

    def rules(self, v: Val, spec: dict[str, Any] | None = None, path: str = "", depth: int = 0) -> list[tuple[str, Column]]:
        """(message, holds) in the order in which they are checked."""
        spec = self.spec if spec is None else spec
        if depth > MOST_DEPTH:
            raise PipelineError("the schema is nested too deeply")
        at, out = path or "document", []
        for key in ("bsonType", "type"):
            if key in spec and path:
                out.append((f"{at}: not of type {spec[key]}", _of_type(v, spec[key])))
        if "enum" in spec:
            test = F.lit(False)
            for x in spec["enum"]:
                test = test | equal(v, literal(x))
            out.append((f"{at}: not one of the values", test))
        if v.is_struct:
            fields = {f.name: Val(v.col.getField(f.name), f.dataType) for f in v.type.fields}
            for name in spec.get("required", []):
                out.append((f"{at}: {name} is missing", fields[name].col.isNotNull() if name in fields else F.lit(False)))
            for name, inner in spec.get("properties", {}).items():
                if name in fields:
                    below = f"{path}.{name}" if path else name
                    out += [(m, F.when(fields[name].col.isNull(), F.lit(True)).otherwise(c)) for m, c in self.rules(fields[name], inner, below, depth + 1)]
            known = set(spec.get("properties", {})) | {"_id"}
            if spec.get("additionalProperties") is False:
                for name in fields:
                    if name not in known:
                        out.append((f"{at}: {name} is not allowed", fields[name].col.isNull()))
            there = sum((f.col.isNotNull().cast("int") for f in fields.values()), F.lit(0))
            for key, test in (("minProperties", lambda n: there >= n), ("maxProperties", lambda n: there <= n)):
                if key in spec:
                    out.append((f"{at}: {key}", test(spec[key])))
        if v.is_number:
            for key, test in (("minimum", lambda n: v.col >= n), ("maximum", lambda n: v.col <= n), ("exclusiveMinimum", lambda n: v.col > n), ("exclusiveMaximum", lambda n: v.col < n)):
                if isinstance(spec.get(key), (int, float)) and not isinstance(spec.get(key), bool):
                    out.append((f"{at}: {key}", test(spec[key])))
        if v.is_string:
            for key, test in (("minLength", lambda n: F.octet_length(v.col) >= n), ("maxLength", lambda n: F.octet_length(v.col) <= n), ("pattern", lambda p: v.col.rlike(p))):
                if key in spec:
                    out.append((f"{at}: {key}", test(spec[key])))
        if v.is_array:
            size = F.size(v.col)
            for key, test in (("minItems", lambda n: size >= n), ("maxItems", lambda n: size <= n)):
                if key in spec:
                    out.append((f"{at}: {key}", test(spec[key])))
            if spec.get("uniqueItems"):
                out.append((f"{at}: uniqueItems", F.size(F.array_distinct(v.col)) == size))
            if "items" in spec:
                kind = v.type.elementType
                out.append((f"{at}: items", F.forall(v.col, lambda e: self.holds(Val(e, kind), spec["items"], f"{at}[]", depth + 1))))
        for key, inner in (("allOf", None), ("anyOf", None), ("oneOf", None)):
            if key in spec:
                each = [self.holds(v, s, path, depth + 1) for s in spec[key]]
                count = sum((c.cast("int") for c in each), F.lit(0))
                out.append((f"{at}: {key}", {"allOf": count == len(each), "anyOf": count >= 1, "oneOf": count == 1}[key]))
        if "not" in spec:
            out.append((f"{at}: not", ~self.holds(v, spec["not"], path, depth + 1)))
        return [(m, F.coalesce(c, F.lit(True))) for m, c in out]

    def holds(self, v: Val, spec: dict[str, Any] | None = None, path: str = "", depth: int = 0) -> Column:
        out = F.lit(True)
        for _, c in self.rules(v, spec, path, depth):
            out = out & c
        return out

    def check(self, df: DataFrame) -> DataFrame:
        """df with is_valid and violation (the first failure's message)."""
        found = F.lit(None).cast("string")
        for message, c in reversed(self.rules(frame(df).whole())):
            found = F.when(~c, F.lit(message)).otherwise(found)
        return df.withColumn("violation", found).withColumn("is_valid", F.col("violation").isNull())

    def violations(self, df: DataFrame) -> DataFrame:
        return self.check(df).filter(~F.col("is_valid"))
