"""Stages over several collections: nested joins, correlated pipelines, unions, facets and graph search."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandql.functions.expr import Expr
from strandql.operators.predicate import Predicate
from strandql.operators.stages import add_value, expr, stage
from strandql.plans.context import PART, POS, Context, frame, visible, with_pos
from strandql.plans.values import null, PipelineError, Val, cast, common_type, resolve
from strandql.sources.tables import cut, folder_bytes

#: A stored array of so many bytes at most is broadcast.
BROADCAST_BYTES = 64 << 20


def document(df: DataFrame) -> Column:
    """The row's document as one struct."""
    return F.struct(*[F.col(f"`{c}`") for c in visible(df)])


def document_type(df: DataFrame) -> T.StructType:
    return T.StructType(list(frame(df).fields))


def nested(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """The documents of each group as an array, in the rows' order where there is one."""
    if POS in df.columns:
        items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(POS).alias("o"), document(df).alias("d")))), lambda p: p["d"])
    else:
        items = F.collect_list(document(df))
    return df.groupBy(*keys).agg(items.alias(name))


def matched_keys(left: Val | None, right: Val | None) -> tuple[Column, Column, T.DataType]:
    """Both sides' keys in one type; a path that a side lacks is null there."""
    a, b = left or null(), right or null()
    kind = common_type([a.type, b.type])
    if isinstance(kind, T.NullType):
        kind = T.StringType()
    return (a.col.cast(kind) if a.is_null else cast(a, kind).col), (b.col.cast(kind) if b.is_null else cast(b, kind).col), kind


@stage("$lookup")
def lookup(df, spec, ctx):
    if "pipeline" in spec:
        return pipeline_lookup(df, spec, ctx)
    foreign = ctx.collection(spec["from"])
    here, there, _ = matched_keys(resolve(frame(df), spec["localField"]), resolve(frame(foreign), spec["foreignField"]))
    # Grouped before the join, so that the left side keeps its rows and the join needs no second grouping.
    side = nested(foreign, [there.alias("__f")], "__as")
    joined = df.withColumn("__l", here).join(side, F.col("__l").eqNullSafe(F.col("__f")), "left")
    return _attach(joined, spec["as"], document_type(foreign)).drop("__l", "__f", "__as")


def _attach(joined: DataFrame, path: str, kind: T.DataType) -> DataFrame:
    whole = T.ArrayType(kind)
    return add_value(joined, path, Val(F.coalesce(F.col("__as"), F.array().cast(whole)), whole))


def join_lookup(df: DataFrame, spec: dict[str, Any], ctx: Context, how: str, fields: set[str] | None = None) -> DataFrame:
    """A $lookup whose array is unwound at once, tested for emptiness or counted: a plain join, without building the arrays.

    fields: those of the foreign document that later stages look at; None: all of them.
    """
    foreign = ctx.collection(spec["from"])
    here, there, _ = matched_keys(resolve(frame(df), spec["localField"]), resolve(frame(foreign), spec["foreignField"]))
    if how in ("left_semi", "left_anti"):
        side = foreign.select(there.alias("__f")).distinct()
        return df.withColumn("__l", here).join(side, F.col("__l").eqNullSafe(F.col("__f")), how).drop("__l")
    if how == "count":
        side = foreign.groupBy(there.alias("__f")).agg(F.count(F.lit(1)).cast("int").alias("__as"))
        joined = df.withColumn("__l", here).join(side, F.col("__l").eqNullSafe(F.col("__f")), "left")
        return add_value(joined, spec["as"], Val(F.coalesce("__as", F.lit(0)), T.IntegerType())).drop("__l", "__f", "__as")
    side = foreign.withColumn("__f", there)
    if fields is not None:
        # The key's field stays, so that a document is never without any.
        kept = fields | {spec["foreignField"].split(".")[0]}
        foreign = foreign.select(*[F.col(f"`{c}`") for c in foreign.columns if c in kept]) if set(foreign.columns) & kept else foreign
    side = side.select("__f", document(foreign).alias("__as"))
    joined = df.withColumn("__l", here).join(side, F.col("__l").eqNullSafe(F.col("__f")), how)
    return add_value(joined, spec["as"], Val(F.col("__as"), document_type(foreign))).drop("__l", "__f", "__as")


def equalities(condition: Any, names: set[str]) -> list[tuple[str, Any]]:
    """(path of the foreign document, outer expression) of the equalities that an $expr demands."""
    if not isinstance(condition, dict):
        return []
    if set(condition) == {"$and"}:
        return [e for c in condition["$and"] for e in equalities(c, names)]
    if set(condition) == {"$eq"}:
        a, b = condition["$eq"]
        for x, y in ((a, b), (b, a)):
            field = isinstance(x, str) and x.startswith("$") and not x.startswith("$$")
            if field and isinstance(y, str) and y.startswith("$$") and y[2:].split(".")[0] in names:
                return [(x[1:], y)]
    return []


def _names_variables(stage: Any, names: set[str]) -> bool:
    if isinstance(stage, dict):
        return any(_names_variables(v, names) for v in stage.values())
    if isinstance(stage, (list, tuple)):
        return any(_names_variables(v, names) for v in stage)
    return isinstance(stage, str) and stage.startswith("$$") and stage[2:].split(".")[0] in names


def uncorrelated(df: DataFrame, made: DataFrame, name: str) -> DataFrame:
    """Every row of df with the same array of all documents of made, which goes to the executors if it is small enough."""
    kind, one = document_type(made), cut(nested(made, [], "__as"), "lookup")  # a single row
    small = folder_bytes(one) <= BROADCAST_BYTES
    return _attach(df.crossJoin(F.broadcast(one) if small else one), name, kind).drop("__as")


def pipeline_lookup(df: DataFrame, spec: dict[str, Any], ctx: Context) -> DataFrame:
    """A sub-pipeline for every row: run once for every distinct binding of its variables, all bindings at once."""
    from strandql.plans.pipeline import run

    foreign, stages = ctx.collection(spec["from"]), list(spec["pipeline"])
    outer = expr(df, ctx)
    let = {k: outer(v) for k, v in (spec.get("let") or {}).items()}
    if "localField" in spec:
        let["__local"] = resolve(frame(df), spec["localField"]) or null()
        stages.insert(0, {"$match": {"$expr": {"$eq": ["$" + spec["foreignField"], "$$__local"]}}})
    free = len(stages) if not let else next((i for i, s in enumerate(stages) if _names_variables(s, set(let))), len(stages))
    if free == len(stages):
        return uncorrelated(df, run(foreign, stages, ctx, keep_order=True), spec["as"])
    if free:
        # What no variable is named in runs once, for all bindings.
        foreign, stages = run(foreign, stages[:free], ctx, keep_order=True), stages[free:]
    let = {k: Val(v.col.cast("string"), T.StringType()) if v.is_null else v for k, v in let.items()}
    parts = tuple(f"{PART}{i}" for i in range(len(let)))
    bound = {k: Val(F.col(p), v.type) for (k, v), p in zip(let.items(), parts)}
    bindings = df.select(*[v.col.alias(p) for v, p in zip(let.values(), parts)]).distinct()
    inner = ctx.bind(bound, parts)
    first = stages[0].get("$match") if stages else None
    root = frame(foreign)
    if first is not None:
        test = Predicate(root, inner.variables)(first)
        keyed = None
        for path, e in equalities(first.get("$expr"), set(bound)):
            a, b, _ = matched_keys(resolve(root, path), Expr(root, inner.variables)(e))
            keyed = a.eqNullSafe(b) if keyed is None else keyed & a.eqNullSafe(b)
        joined = foreign.join(bindings, test if keyed is None else keyed & test)
        stages = stages[1:]
    else:
        joined = foreign.crossJoin(bindings)
    made = run(joined, stages, inner)
    side = nested(made, [F.col(p) for p in parts], "__as")
    mark = [f"__mark{i}" for i in range(len(parts))]
    out = df.withColumns({m: v.col for m, v in zip(mark, let.values())})
    on = None
    for m, p in zip(mark, parts):
        test = F.col(m).eqNullSafe(F.col(p))
        on = test if on is None else on & test
    return _attach(out.join(side, on, "left"), spec["as"], document_type(made)).drop(*mark, *parts, "__as")


@stage("$unionWith")
def union_with(df, spec, ctx):
    from strandql.plans.pipeline import run

    spec = {"coll": spec} if isinstance(spec, str) else spec
    other = run(ctx.collection(spec["coll"]), spec.get("pipeline") or [], ctx)
    left, right = frame(df), frame(other)
    names = list(dict.fromkeys([*(f.name for f in left.fields), *(f.name for f in right.fields)]))
    kinds = {n: common_type([v.type for v in (left.get(n), right.get(n)) if v is not None]) for n in names}

    def shaped(one: DataFrame, root) -> DataFrame:
        return one.select(*[(cast(v, kinds[n]).col if (v := root.get(n)) is not None else F.lit(None).cast(kinds[n])).alias(n) for n in names])

    return shaped(df, left).unionByName(shaped(other, right))


def costly(df: DataFrame) -> bool:
    """Whether df is more than a scan with filters and columns of it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(f"{word} " in plan for word in ("Join", "Aggregate", "Sort", "Window", "Generate", "Union", "Deduplicate"))


@stage("$facet")
def facet(df, spec, ctx):
    from strandql.plans.pipeline import run

    out = None
    if len(spec) > 1 and costly(df):
        df = cut(with_pos(df), "facet")  # made once for all
    for name, stages in spec.items():
        made = with_pos(run(df, stages, ctx, keep_order=True))
        one = nested(made, [], name)  # an aggregate without keys: one row
        out = one if out is None else out.crossJoin(F.broadcast(one))
    if out is None:
        raise PipelineError("$facet needs a pipeline")
    return out


@stage("$graphLookup")
def graph_lookup(df, spec, ctx):
    """Breadth-first search from every distinct start; each document once per start, at its least depth."""
    foreign = ctx.collection(spec["from"])
    if spec.get("restrictSearchWithMatch"):
        foreign = foreign.filter(Predicate(frame(foreign), ctx.variables)(spec["restrictSearchWithMatch"]))
    kind = document_type(foreign)
    to, onward = resolve(frame(foreign), spec["connectToField"]), resolve(frame(foreign), spec["connectFromField"])
    if to is None:
        raise PipelineError(f"no field {spec['connectToField']}")
    onward = onward or Val(F.lit(None).cast("string"), T.StringType())
    key = to.type.elementType if to.is_array else to.type
    values = lambda v: v.col.cast(T.ArrayType(key)) if v.is_array else F.array(v.col.cast(key))
    start = expr(df, ctx)(spec["startWith"])
    nodes = cut(foreign.select(F.monotonically_increasing_id().alias("node"), values(to).alias("to"), values(onward).alias("next"), document(foreign).alias("doc")), "graph")
    edges = nodes.select("node", "next", F.explode("to").alias("value")).filter("value is not null")
    starts = df.select(start.col.alias("start")).distinct()
    frontier = starts.select("start", F.explode(values(Val(F.col("start"), start.type))).alias("value")).filter("value is not null").distinct()
    most, depth, seen = spec.get("maxDepth"), 0, None
    while most is None or depth <= most:
        reached = frontier.join(edges, "value").select("start", "node", "next").dropDuplicates(["start", "node"])
        if seen is not None:
            known = seen.select(F.col("start").alias("s"), F.col("node").alias("n"))
            reached = reached.join(known, F.col("start").eqNullSafe(F.col("s")) & (F.col("node") == F.col("n")), "left_anti")
        reached = cut(reached.withColumn("depth", F.lit(depth).cast("long")), "graph")
        if reached.isEmpty():
            break
        seen = reached if seen is None else seen.unionByName(reached)
        frontier = reached.select("start", F.explode("next").alias("value")).filter("value is not null").distinct()
        depth += 1
    if seen is None:
        seen = reached
    item = {f.name: Val(F.col("doc").getField(f.name), f.dataType) for f in kind.fields}
    if spec.get("depthField"):
        item[spec["depthField"]] = Val(F.col("depth"), T.LongType())
    found = seen.drop("next").join(nodes.select("node", "doc"), "node")
    whole = T.StructType([T.StructField(k, v.type) for k, v in item.items()])
    items = F.collect_list(F.struct(F.col("depth").alias("d"), F.col("node").alias("n"), F.struct(*[v.col.alias(k) for k, v in item.items()]).alias("doc")))
    side = found.groupBy("start").agg(items.alias("__pairs"))
    side = side.select(F.col("start").alias("__f"), F.transform(F.array_sort("__pairs", lambda a, b: F.when(a["d"] != b["d"], (a["d"] - b["d"]).cast("int")).when(a["n"] < b["n"], F.lit(-1)).when(a["n"] > b["n"], F.lit(1)).otherwise(F.lit(0))), lambda p: p["doc"]).alias("__as"))
    joined = df.withColumn("__l", start.col).join(side, F.col("__l").eqNullSafe(F.col("__f")), "left")
    return _attach(joined, spec["as"], whole).drop("__l", "__f", "__as")
