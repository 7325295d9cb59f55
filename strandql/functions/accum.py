"""Accumulators of $group, $bucket, $bucketAuto and $setWindowFields as aggregate columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandql.functions.expr import DOUBLE, INT, LONG, Expr
from strandql.plans.values import PipelineError, Val, literal, number

#: These see the rows of a group in their order.
ORDERED = {"$first", "$last", "$push", "$addToSet", "$mergeObjects", "$firstN", "$lastN"}
SORTING = {"$top", "$bottom", "$topN", "$bottomN"}
NAMES = ORDERED | SORTING | {"$countDistinct", "$sum", "$avg", "$count", "$min", "$max", "$stdDevPop", "$stdDevSamp"}


def split(spec: Any) -> tuple[str, Any]:
    if not isinstance(spec, dict) or len(spec) != 1:
        raise PipelineError(f"an accumulator is a document with one operator: {spec!r}")
    name, arg = next(iter(spec.items()))
    if name not in NAMES:
        raise PipelineError(f"unknown accumulator {name}")
    return name, arg


def needs_order(spec: Any) -> bool:
    return split(spec)[0] in ORDERED


def in_order(v: Val, pos: Column, over=lambda c: c) -> Column:
    """The values of all rows in order, nulls too (a bare collect_list drops them)."""
    pairs = F.array_sort(over(F.collect_list(F.struct(pos.alias("o"), v.col.alias("v")))))
    return F.transform(pairs, lambda p: p["v"])


def order_key(c: Expr, sort_by: dict[str, Any], pos: Column) -> Column | None:
    """A struct whose ascending order is that of sortBy (nulls as in a sort), ties by place; None if a key cannot be turned round."""
    parts = []
    for k, d in sort_by.items():
        v = c(f"${k}")
        if int(d) == 1:
            parts.append(v.col)
            continue
        if isinstance(v.type, T.IntegralType):
            turned = F.bitwise_not(v.col)  # descends as the number ascends, and never overflows
        elif v.is_number:
            turned = -v.col
        elif v.is_bool:
            turned = ~v.col
        elif isinstance(v.type, T.DateType):
            turned = F.bitwise_not(F.unix_date(v.col))
        elif v.is_date:
            turned = F.bitwise_not(F.unix_micros(v.col.cast("timestamp")))
        else:
            return None
        parts += [v.col.isNull(), turned]
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate([*parts, pos])])


def sorted_pairs(c: Expr, arg: dict[str, Any], pos: Column, over) -> tuple[Column, T.DataType]:
    """{k: sort keys, v: output} of all rows in the order of sortBy; ties in the rows' order."""
    keys = [(c(f"${k}"), int(d)) for k, d in arg["sortBy"].items()]
    out = c(arg["output"])
    items = over(F.collect_list(F.struct(F.struct(*[v.col.alias(f"k{i}") for i, (v, _) in enumerate(keys)]).alias("k"), pos.alias("o"), out.col.alias("v"))))

    def before(a, b):
        test = F.when(F.lit(False), F.lit(0))
        for i, (_, d) in enumerate(keys):
            x, y = a["k"][f"k{i}"], b["k"][f"k{i}"]
            less = F.coalesce(x < y, x.isNull() & y.isNotNull())
            more = F.coalesce(x > y, x.isNotNull() & y.isNull())
            test = test.when(less, F.lit(-d)).when(more, F.lit(d))
        return test.when(a["o"] < b["o"], F.lit(-1)).when(a["o"] > b["o"], F.lit(1)).otherwise(F.lit(0))

    return F.array_sort(items, before), out.type


#: These keep some rows of a group only.
FIRST_FEW = ("$topN", "$bottomN", "$firstN", "$lastN")


def first_few(df: DataFrame, c: Expr, outputs: dict[str, Any], keys: list[Column], pos: Column) -> tuple[DataFrame, dict[str, Val]]:
    """(df with the rank of each row within its group for each such output, the outputs as aggregates of the first ranks).

    A group is ranked by a sort, which spills, and only n of its rows are gathered.
    """
    made = {}
    for i, (name, spec) in enumerate(outputs.items()):
        op, arg = split(spec)
        if op not in FIRST_FEW:
            continue
        last, n, rank = op in ("$bottomN", "$lastN"), int(arg["n"]), f"__rank{i}"
        v = c(arg["output"] if "sortBy" in arg else arg["input"])
        order = [(c(f"${k}").col, (int(d) == 1) != last) for k, d in arg.get("sortBy", {}).items()] + [(pos, not last)]
        w = Window.partitionBy(*keys).orderBy(*[x.asc_nulls_first() if up else x.desc_nulls_last() for x, up in order])
        df = df.withColumn(rank, F.row_number().over(w))
        few = F.collect_list(F.when(F.col(rank) <= n, F.struct(F.col(rank).alias("o"), v.col.alias("v"))))
        items = F.transform(F.array_sort(few), _field("v"))
        made[name] = Val(F.reverse(items) if op == "$lastN" else items, T.ArrayType(v.type))
    return df, made


def _field(name: str):
    return lambda x: x.getField(name)


def accumulate(c: Expr, spec: Any, pos: Column, over=lambda x: x) -> Val:
    """The accumulator as a column; over: puts an aggregate over a window."""
    name, arg = split(spec)
    if name == "$count" or (name == "$sum" and arg == 1):
        return Val(over(F.count(F.lit(1))).cast("long"), LONG)
    if name in ("$top", "$bottom") and (key := order_key(c, arg["sortBy"], pos)) is not None:
        v = c(arg["output"])
        return Val(over((F.min_by if name == "$top" else F.max_by)(F.struct(v.col.alias("v")), key))["v"], v.type)
    if name in SORTING:
        pairs, kind = sorted_pairs(c, arg, pos, over)
        n = int(arg.get("n", 1))
        if name == "$top":
            return Val(F.get(pairs, F.lit(0))["v"], kind)
        if name == "$bottom":
            return Val(F.get(pairs, F.size(pairs) - 1)["v"], kind)
        # The last n come worst first.
        pairs = F.slice(pairs, 1, n) if name == "$topN" else F.slice(F.reverse(pairs), 1, n)
        return Val(F.transform(pairs, lambda p: p["v"]), T.ArrayType(kind))
    if name in ("$firstN", "$lastN"):
        v, n = c(arg["input"]), int(arg["n"])
        items = in_order(v, pos, over)
        got = F.slice(items, F.lit(1), F.lit(n)) if name == "$firstN" else F.slice(items, F.greatest(F.size(items) - n, F.lit(0)) + 1, F.lit(n))
        return Val(got, T.ArrayType(v.type))
    v = c(arg)
    if name == "$countDistinct":  # made by a rewrite of {$size: {$addToSet}}: a null is a member too
        return Val((F.count_distinct(v.col) + F.coalesce(F.max(v.col.isNull().cast("int")), F.lit(0))).cast("int"), INT)
    if name == "$sum":
        v = number(v)
        kind = LONG if isinstance(v.type, T.IntegralType) else DOUBLE
        return Val(F.coalesce(over(F.sum(v.col.cast(kind))), F.lit(0).cast(kind)), kind)
    if name == "$avg":
        return Val(over(F.avg(number(v).col.cast("double"))), DOUBLE)
    if name in ("$min", "$max"):
        return Val(over((F.min if name == "$min" else F.max)(v.col)), v.type)
    if name in ("$stdDevPop", "$stdDevSamp"):
        return Val(over((F.stddev_pop if name == "$stdDevPop" else F.stddev_samp)(number(v).col.cast("double"))), DOUBLE)
    if name in ("$first", "$last"):
        pair = over((F.min_by if name == "$first" else F.max_by)(F.struct(v.col.alias("v")), pos))
        return Val(pair["v"], v.type)
    if name == "$push":
        return Val(in_order(v, pos, over), T.ArrayType(v.type))
    if name == "$addToSet":
        return Val(F.array_distinct(in_order(v, pos, over)), T.ArrayType(v.type))
    assert name == "$mergeObjects"
    if not v.is_struct:
        return literal({})
    fields = [F.filter(in_order(Val(v.col, v.type), pos, over), lambda x: x.isNotNull())]
    merged = {}
    for f in v.type.fields:
        known = F.filter(F.transform(fields[0], _field(f.name)), lambda x: x.isNotNull())
        merged[f.name] = Val(F.get(known, F.size(known) - 1), f.dataType)
    return Val(F.struct(*[x.col.alias(k) for k, x in merged.items()]), v.type)


