"""Pipeline stages over one input: each takes (df, spec, ctx) and returns the next DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandql.functions.accum import FIRST_FEW, accumulate, first_few, needs_order, split
from strandql.functions.expr import Expr
from strandql.operators import geo, vector
from strandql.operators.predicate import Predicate
from strandql.plans.context import POS, Context, frame, select, visible, with_pos, without_pos
from strandql.plans.values import PipelineError, Val, null, put, resolve, struct_of, truthy, without
from strandql.sources.tables import cut

STAGES: dict[str, Callable[[DataFrame, Any, Context], DataFrame]] = {}


def stage(*names: str):
    def keep(f):
        for n in names:
            STAGES[n] = f
        return f

    return keep


def expr(df: DataFrame, ctx: Context) -> Expr:
    return Expr(frame(df), ctx.variables)


@stage("$match")
def match(df, spec, ctx):
    return df.filter(Predicate(frame(df), ctx.variables)(spec))


def _flat(v: Any) -> bool | None:
    """True for an inclusion, False for an exclusion, None for anything computed."""
    return bool(v) if isinstance(v, (bool, int, float)) else None


def _paths(spec: dict[str, Any], prefix: str = "") -> dict[str, Any]:
    """A projection with nested documents spelled as dotted paths."""
    out = {}
    for k, v in spec.items():
        if isinstance(v, dict) and v and not any(x.startswith("$") for x in v):
            out.update(_paths(v, f"{prefix}{k}."))
        else:
            out[prefix + k] = v
    return out


@stage("$project")
def project(df, spec, ctx):
    if not spec:
        raise PipelineError("$project needs a field")
    spec = _paths(spec)
    kinds = {k: _flat(v) for k, v in spec.items()}
    rest = {k: x for k, x in kinds.items() if k != "_id"}
    if rest and all(x is False for x in rest.values()) or not rest and kinds.get("_id") is False:
        return unset(df, [k for k, x in kinds.items() if x is False], ctx)
    c, root, out = expr(df, ctx), frame(df), {}
    if "_id" in visible(df) and kinds.get("_id") is not False and "_id" not in spec:
        out["_id"] = root.get("_id")
    for path, v in spec.items():
        if kinds[path] is False:
            continue
        value = resolve(root, path) if kinds[path] else c(v)
        if value is None:
            if kinds[path]:
                continue
            value = null()
        head, *below = path.split(".")
        out[head] = put(out.get(head), below, value)
    # A field that no document has gives documents without it; a DataFrame keeps one column at least.
    return select(df, {k: v.col for k, v in out.items()} or {"_id": F.lit(None).cast("string")})


@stage("$addFields", "$set")
def add_fields(df, spec, ctx):
    c, root = expr(df, ctx), frame(df)
    columns: dict[str, Val] = {}
    for path, v in _paths(spec).items():
        head, *below = path.split(".")
        value = c(v)
        columns[head] = put(columns.get(head) or root.get(head), below, value)
    return df.withColumns({k: v.col for k, v in columns.items()})


@stage("$unset")
def unset(df, spec, ctx):
    columns = {f.name: Val(F.col(f"`{f.name}`"), f.dataType) for f in frame(df).fields}
    for path in [spec] if isinstance(spec, str) else spec:
        head, *below = path.split(".")
        if not below:
            columns.pop(head, None)
        elif head in columns:
            columns[head] = without(columns[head], below)
    return select(df, {k: v.col for k, v in columns.items()})


@stage("$replaceRoot")
def replace_root(df, spec, ctx):
    v = expr(df, ctx)(spec["newRoot"])
    if not v.is_struct:
        raise PipelineError("the new root is not a document")
    new = "__root"
    made = df.withColumn(new, F.when(v.col.isNull(), F.raise_error(F.lit("the new root is not a document"))).otherwise(v.col))
    if not v.type.fields:
        return select(made, {"_id": F.lit(None).cast("string")})
    return select(made, {n: F.col(new).getField(n) for n in v.type.names})


@stage("$replaceWith")
def replace_with(df, spec, ctx):
    return replace_root(df, {"newRoot": spec}, ctx)


@stage("$unwind")
def unwind(df, spec, ctx):
    spec = {"path": spec} if isinstance(spec, str) else spec
    path, keep, index = spec["path"].removeprefix("$"), spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
    root = frame(df)
    v = resolve(root, path)
    if v is None:
        out = df if keep else df.limit(0)
        return out.withColumn(index, F.lit(None).cast("long")) if index else out
    if not v.is_array:
        out = df if keep else df.filter(v.col.isNotNull())
        return out.withColumn(index, F.lit(None).cast("long")) if index else out
    at, item = "__at", "__item"
    columns = [F.col(f"`{c}`") for c in df.columns]
    if index or POS in df.columns:
        made = df.select(*columns, (F.posexplode_outer if keep else F.posexplode)(v.col).alias(at, item))
    else:
        made = df.select(*columns, (F.explode_outer if keep else F.explode)(v.col).alias(item))
    head, *below = path.split(".")
    value = put(root.get(head), below, Val(F.col(item), v.type.elementType))
    made = made.withColumn(head, value.col)
    if index:
        made = made.withColumn(index, F.col(at).cast("long"))
    if POS in df.columns:
        made = made.withColumn(POS, F.struct(F.col(POS), F.col(at)))
    return made.drop(at, item)


@stage("$limit")
def limit(df, spec, ctx):
    if not isinstance(spec, int) or spec <= 0:
        raise PipelineError("$limit takes a positive number")
    return _numbered(df, ctx).filter(F.col("__rn") <= spec).drop("__rn") if ctx.parts else df.limit(spec)


def _numbered(df: DataFrame, ctx: Context) -> DataFrame:
    """Rows numbered within each binding of a correlated pipeline."""
    df = with_pos(df)
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*ctx.part_columns()).orderBy(POS)))


@stage("$skip")
def skip(df, spec, ctx):
    if not isinstance(spec, int) or spec < 0:
        raise PipelineError("$skip takes a number from 0")
    return _numbered(df, ctx).filter(F.col("__rn") > spec).drop("__rn") if ctx.parts else df.offset(spec)


def sort_columns(root, keys: dict[str, Any]) -> list[Column]:
    out = []
    for path, d in keys.items():
        if isinstance(d, dict) and "$meta" in d:
            v, d = Expr(root)(d), -1
        else:
            v = resolve(root, path)
        if v is not None and not v.is_null:
            out.append(v.col.desc_nulls_last() if d == -1 else v.col.asc_nulls_first())
    return out


@stage("$sort")
def sort(df, spec, ctx):
    keys = sort_columns(frame(df), spec)
    if not keys:
        return df
    if ctx.parts:
        before = [F.col(POS)] if POS in df.columns else []
        return df.withColumn(POS, F.row_number().over(Window.partitionBy(*ctx.part_columns()).orderBy(*keys, *before)).cast("long"))
    return without_pos(df).orderBy(*keys)


@stage("$count")
def count(df, spec, ctx):
    if not isinstance(spec, str) or not spec or spec.startswith("$"):
        raise PipelineError("$count takes a name")
    made = F.count(F.lit(1)).alias(spec)
    return df.groupBy(*ctx.part_columns()).agg(made) if ctx.parts else df.agg(made)


# ---- grouping


def _pos_for(df: DataFrame, outputs: dict[str, Any]) -> tuple[DataFrame, Column]:
    if any(needs_order(o) or split(o)[0] in ("$top", "$bottom", "$topN", "$bottomN") for o in outputs.values()):
        df = with_pos(df)
        return df, F.col(POS)
    return df, F.lit(None).cast("long")


def aggregates(c: Expr, outputs: dict[str, Any], pos: Column, made: dict[str, Val] | None = None) -> list[Column]:
    return [(made[name] if made and name in made else accumulate(c, o, pos)).col.alias(name) for name, o in outputs.items()]


def grouped(df: DataFrame, c: Expr, outputs: dict[str, Any], keys: dict[str, Column], pos: Column, *more: Column) -> DataFrame:
    """The groups of the keys (by the names of their columns) with their outputs, and more aggregates before these."""
    made: dict[str, Val] = {}
    if any(split(o)[0] in FIRST_FEW for o in outputs.values()):
        df = df.withColumns(keys)
        keys = {k: F.col(k) for k in keys}
        df, made = first_few(df, c, outputs, list(keys.values()), pos)
    aggs = [*more, *aggregates(c, outputs, pos, made)]
    return df.groupBy(*[v.alias(k) for k, v in keys.items()]).agg(*(aggs or [F.count(F.lit(1)).alias("__n")]))


@stage("$group")
def group(df, spec, ctx):
    if "_id" not in spec:
        raise PipelineError("$group needs an _id")
    outputs = {k: v for k, v in spec.items() if k != "_id"}
    df, pos = _pos_for(df, outputs)
    c = expr(df, ctx)
    key = c(spec["_id"])
    parts = {p: F.col(p) for p in ctx.parts}
    own = [F.col(f"`{k}`") for k in outputs]
    if key.is_null and parts:
        return grouped(df, c, outputs, parts, pos).select(F.lit(None).cast("string").alias("_id"), *own, *parts)
    if key.is_null:
        # A plain aggregate has a row even without input; a group has none.
        made = grouped(df, c, outputs, {}, pos, F.count(F.lit(1)).alias("__n")).filter("__n > 0")
        return made.select(F.lit(None).cast("string").alias("_id"), *own)
    if key.is_struct and isinstance(spec["_id"], dict) and not any(k.startswith("$") for k in spec["_id"]) and spec["_id"]:
        # Grouped by the fields themselves, so that each can be pruned and hashed as what it is.
        keys = {f"__k{i}": c(e).col for i, e in enumerate(spec["_id"].values())}
        made = grouped(df, c, outputs, {**parts, **keys}, pos)
        made = made.withColumn("_id", F.struct(*[F.col(k).alias(n) for k, n in zip(keys, spec["_id"])]))
        return made.select("_id", *own, *parts)
    return grouped(df, c, outputs, {**parts, "__key": key.col}, pos).select(F.col("__key").alias("_id"), *own, *parts)


@stage("$sortByCount")
def sort_by_count(df, spec, ctx):
    made = df.groupBy(*ctx.part_columns(), expr(df, ctx)(spec).col.alias("_id")).agg(F.count(F.lit(1)).alias("count"))
    return sort(made, {"count": -1, "_id": 1}, ctx) if ctx.parts else made.orderBy(F.col("count").desc(), F.col("_id").asc_nulls_first())


@stage("$bucket")
def bucket(df, spec, ctx):
    bounds, outputs = list(spec["boundaries"]), spec.get("output") or {"count": {"$sum": 1}}
    if len(bounds) < 2 or bounds != sorted(bounds):
        raise PipelineError("$bucket needs two ascending boundaries at least")
    df, pos = _pos_for(df, outputs)
    c = expr(df, ctx)
    v = c(spec["groupBy"])
    fits = v.is_number
    x = v.col.cast("double") if fits else F.lit(None).cast("double")
    place = F.lit(None).cast("int")
    for i in range(len(bounds) - 2, -1, -1):
        place = F.when((x >= bounds[i]) & (x < bounds[i + 1]), F.lit(i)).otherwise(place)
    df = df.withColumn("__b", place if "default" not in spec else F.coalesce(place, F.lit(-1)))
    made = grouped(df.filter(F.col("__b").isNotNull()), c, outputs, {"__b": F.col("__b")}, pos)
    # Buckets without rows are there, with what the accumulators give for no row.
    nothing = without_pos(df).limit(0).withColumn(POS, F.lit(0).cast("long")).agg(*aggregates(c, outputs, F.col(POS)))
    names = list(outputs)
    every = ctx.spark.range(len(bounds) - 1).select(F.col("id").cast("int").alias("__b"))
    some = every.join(made, "__b", "left_anti").crossJoin(F.broadcast(nothing))  # fewer rows than boundaries
    out = made.unionByName(some)
    ids = F.element_at(F.array(*[F.lit(float(b)) for b in bounds[:-1]]), F.greatest(F.col("__b"), F.lit(0)) + 1)
    default = spec.get("default")
    if isinstance(default, str):
        ids = F.when(F.col("__b") == -1, F.lit(default)).otherwise(ids.cast("string"))
    elif default is not None:
        ids = F.when(F.col("__b") == -1, F.lit(float(default))).otherwise(ids)
    rank = F.when(F.col("__b") == -1, F.lit(len(bounds))).otherwise(F.col("__b"))
    return out.orderBy(rank).select(ids.alias("_id"), *[F.col(f"`{n}`") for n in names])


@stage("$bucketAuto")
def bucket_auto(df, spec, ctx):
    buckets, outputs = spec["buckets"], spec.get("output") or {"count": {"$sum": 1}}
    if not isinstance(buckets, int) or buckets < 1:
        raise PipelineError("$bucketAuto takes a positive number of buckets")
    df = with_pos(df)
    named = named_fields([spec["groupBy"], outputs])
    if named is not None:
        df = df.select(*[F.col(f"`{n}`") for n in df.columns if n in named or n not in visible(df)])
    v = expr(df, ctx)(spec["groupBy"])
    if not v.is_number:
        v = Val(F.lit(None).cast("double"), T.DoubleType())
    df = df.withColumn("__v", v.col).filter(F.col("__v").isNotNull())
    # Ranks of a global order without one task for all rows. The sorted rows are written once with their places: were
    # they planned twice, two sorts could cut their ranges apart.
    ranked, total = ranked_rows(df, [F.col("__v"), F.col(POS)])
    ranked = ranked.withColumn("__b", F.floor((F.col("__rank") - 1) / F.lit(max(1, -(-total // buckets)))))
    c = expr(df.drop("__v"), ctx)
    made = grouped(ranked, c, outputs, {"__b": F.col("__b")}, F.col(POS), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    after = Window.orderBy("__b")
    ids = F.struct(F.col("__lo").cast("double").alias("min"), F.coalesce(F.lead("__lo").over(after), F.col("__hi")).cast("double").alias("max"))
    return made.withColumn("_id", ids).orderBy("__b").select("_id", *[F.col(f"`{n}`") for n in outputs])


def named_fields(spec: Any) -> set[str] | None:
    """The fields that expressions name, by their first part; None if they take the whole document."""
    if isinstance(spec, dict):
        # The keys of $top and its like are fields too.
        found: list[set[str] | None] = [{k.split(".")[0] for k in spec.get("sortBy") or {}} if isinstance(spec.get("sortBy"), dict) else set()]
        found += [named_fields(v) for v in spec.values()]
    elif isinstance(spec, (list, tuple)):
        found = [named_fields(v) for v in spec]
    elif isinstance(spec, str) and spec.startswith("$$"):
        return None if spec.split(".")[0] in ("$$ROOT", "$$CURRENT") else set()
    else:
        return {spec[1:].split(".")[0]} if isinstance(spec, str) and spec.startswith("$") else set()
    return None if any(x is None for x in found) else set().union(*found)


def sorted_ranges(df: DataFrame, keys: list[Column]) -> DataFrame:
    """df sorted, written once, with __p (the number of the range that a row is in, ascending) and __i (its place there, from 1)."""
    number = "__number"
    stored = cut(df.orderBy(*keys).withColumn(number, F.monotonically_increasing_id()), "sorted")
    # The number is the partition's, shifted by 33 bits, and the row's in it.
    return stored.withColumn("__p", F.shiftright(number, 33)).withColumn("__i", F.col(number).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(number)


def ranked_rows(df: DataFrame, keys: list[Column]) -> tuple[DataFrame, int]:
    """(df with __rank, the place of each row in the order of all, from 1; the number of rows)."""
    rows = sorted_ranges(df, keys)
    sizes = sorted((r["__p"], r["n"]) for r in rows.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    before = [0]
    for _, n in sizes:
        before.append(before[-1] + n)
    base = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "__p long, __base long")
    ranked = rows.join(F.broadcast(base), "__p").withColumn("__rank", F.col("__base") + F.col("__i"))
    return ranked.drop("__p", "__i", "__base"), before[-1]


@stage("$sample")
def sample(df, spec, ctx):
    return df.orderBy(F.rand(spec.get("seed"))).limit(int(spec["size"]))


@stage("$redact")
def redact(df, spec, ctx):
    def verdict(e: Any, at: Expr) -> Column:
        """1 keep, 2 descend, 0 prune."""
        if isinstance(e, str) and e in ("$$KEEP", "$$PRUNE", "$$DESCEND"):
            return F.lit({"$$PRUNE": 0, "$$KEEP": 1, "$$DESCEND": 2}[e])
        if isinstance(e, dict) and len(e) == 1:
            name, a = next(iter(e.items()))
            if name == "$cond":
                test, yes, no = (a["if"], a["then"], a["else"]) if isinstance(a, dict) else a
                return F.when(truthy(at(test)), verdict(yes, at)).otherwise(verdict(no, at))
            if name == "$switch":
                out = F.when(F.lit(False), F.lit(0))
                for b in a["branches"]:
                    out = out.when(truthy(at(b["case"])), verdict(b["then"], at))
                return out.otherwise(verdict(a["default"], at))
            if name == "$let":
                return verdict(a["in"], at.bind(**{k: at(v) for k, v in a["vars"].items()}))
        raise PipelineError("$redact ends in $$KEEP, $$PRUNE or $$DESCEND")

    def descend(v: Val) -> Val:
        """v with what its inner documents keep."""
        if v.is_struct:
            made = struct_of({f.name: inner(Val(v.col.getField(f.name), f.dataType)) for f in v.type.fields})
            return Val(F.when(v.col.isNotNull(), made.col), v.type)
        return v

    def inner(v: Val) -> Val:
        if v.is_struct and v.type.fields:
            kept = verdict(spec, Expr(v, ctx.variables))
            return Val(F.when(kept == 1, v.col).when(kept == 2, descend(v).col), v.type)
        if v.is_array and isinstance(v.type.elementType, T.StructType):
            out = F.transform(v.col, lambda x: inner(Val(x, v.type.elementType)).col)
            return Val(F.filter(out, lambda x: x.isNotNull()), v.type)
        return v

    own = verdict(spec, expr(df, ctx))
    df = df.withColumn("__verdict", own).filter("__verdict > 0")
    columns = {}
    for f in frame(df.drop("__verdict")).fields:
        v = Val(F.col(f"`{f.name}`"), f.dataType)
        deep = f.dataType if isinstance(f.dataType, T.StructType) else getattr(f.dataType, "elementType", None)
        columns[f.name] = F.when(F.col("__verdict") == 2, inner(v).col).otherwise(v.col) if isinstance(deep, T.StructType) else v.col
    return select(df, columns)




# ---- search and places


@stage("$vectorSearch")
def vector_search(df, spec, ctx):
    if "filter" in spec and spec["filter"]:
        df = match(df, spec["filter"], ctx)
    v = resolve(frame(df), spec["path"])
    if v is None or not v.is_array:
        raise PipelineError(f"no vector at {spec['path']}")
    return vector.top(df, v.col, spec["queryVector"], spec.get("metric", spec.get("similarity", "cosine")), int(spec.get("limit", 10)), spec.get("scoreField", "_vectorScore"))


@stage("$geoNear")
def geo_near(df, spec, ctx):
    if spec.get("spherical") is False:
        raise PipelineError("$geoNear is spherical")
    if spec.get("query"):
        df = match(df, spec["query"], ctx)
    at, root = geo.point_of(spec["near"]), frame(df)
    v = resolve(root, spec.get("key", "location"))
    place = geo.lon_lat(v)
    if place is None:
        return df.limit(0)
    least, most = float(spec.get("minDistance", 0.0)), spec.get("maxDistance")
    if most is not None:
        df = df.filter(F.coalesce(geo.box(*place, at, float(most)), F.lit(False)))
    df = df.withColumn("__d", geo.haversine(*place, at)).filter(F.col("__d") >= least)
    if most is not None:
        df = df.filter(F.col("__d") <= float(most))
    df = df.orderBy("__d")
    if spec.get("limit"):
        df = df.limit(int(spec["limit"]))
    out = add_value(df, spec["distanceField"], Val(F.col("__d") * float(spec.get("distanceMultiplier", 1.0)), T.DoubleType()))
    if spec.get("includeLocs"):
        out = add_value(out, spec["includeLocs"], v)
    return out.drop("__d")


def add_value(df: DataFrame, path: str, value: Val) -> DataFrame:
    head, *below = path.split(".")
    return df.withColumn(head, put(frame(df).get(head), below, value).col)

