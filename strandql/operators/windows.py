"""$setWindowFields: window functions with row and range frames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from strandql.functions.accum import ORDERED, SORTING, accumulate
from strandql.functions.expr import Expr
from strandql.operators.stages import expr, sort_columns, sorted_ranges, stage
from strandql.plans.context import POS, frame, with_pos
from strandql.plans.values import PipelineError, number, resolve

RANKS = {"$rank": F.rank, "$denseRank": F.dense_rank, "$documentNumber": F.row_number}
# Seconds of the units of a range.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def _bound(x: Any) -> int:
    if x == "unbounded":
        return None
    return 0 if x == "current" else x


def _framed(w: WindowSpec, spec: dict[str, Any] | None, ordered: bool, keys: list, root, sort_by) -> WindowSpec:
    if not spec or "documents" not in spec and "range" not in spec:
        return w.orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if "documents" in spec:
        lo, hi = map(_bound, spec["documents"])
        return w.orderBy(*keys).rowsBetween(Window.unboundedPreceding if lo is None else lo, Window.unboundedFollowing if hi is None else hi)
    if not sort_by or len(sort_by) != 1:
        raise PipelineError("a range window is sorted by one field")
    path, d = next(iter(sort_by.items()))
    v = resolve(root, path)
    unit = spec.get("unit")
    key = F.unix_timestamp(v.col.cast("timestamp")) if unit else v.col
    lo, hi = map(_bound, spec["range"])
    scale = UNITS[unit] if unit else 1
    return w.orderBy(key.desc() if d == -1 else key.asc()).rangeBetween(Window.unboundedPreceding if lo is None else lo * scale, Window.unboundedFollowing if hi is None else hi * scale)


def needs_order(o: dict[str, Any]) -> bool:
    return any(k in ORDERED | SORTING and k not in ("$first", "$last") for k in o)


def _plain(o: dict[str, Any]) -> dict[str, Any]:
    op = next(k for k in o if k != "window")
    return {op: {} if op == "$count" else o[op]}


# ---- windows over all rows

#: Accumulators of a whole that follows from those of its parts.
TOTALS = ("$sum", "$count", "$avg", "$min", "$max", "$stdDevPop", "$stdDevSamp")
WHOLE, UP_TO_HERE = ({}, {"documents": ["unbounded", "unbounded"]}), {"documents": ["unbounded", "current"]}


def running(df: DataFrame, order: list[Column], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with __rank, the place of each row in the order of all, and each value's sum, min or max over all rows up to it.

    The rows are sorted into ranges and written once; a window within each range, and what the ranges before it have
    together (as many rows as there are ranges), give the same as one window over all rows.
    """
    rows = sorted_ranges(df, order)
    rows = rows.withColumns({f"__v_{n}": v for n, (_, v) in values.items()}) if values else rows
    f = {"sum": F.sum, "min": F.min, "max": F.max}
    ranges = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"), *[f[k](f"__v_{n}").alias(f"__w_{n}") for n, (k, _) in values.items()])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = [F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"), *[f[k](f"__w_{n}").over(before).alias(f"__b_{n}") for n, (k, _) in values.items()]]
    joined = rows.join(F.broadcast(ranges.select("__p", *base)), "__p")
    here = Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = {"__rank": F.col("__base") + F.col("__i")}
    for n, (k, _) in values.items():
        old, new = F.col(f"__b_{n}"), f[k](f"__v_{n}").over(here)
        made[n] = F.coalesce(old + new, old, new) if k == "sum" else (F.least if k == "min" else F.greatest)(old, new)
    return joined.withColumns(made).drop("__p", "__i", "__base", *[f"__{x}_{n}" for n in values for x in "vb"])


def ranged(df: DataFrame, c: Expr, sort_by: dict[str, Any], outputs: dict[str, Any]) -> DataFrame | None:
    """Window fields over all rows without one task for them; None if an output needs more than ranks, totals and running sums."""
    root, kinds = frame(df), {}
    ties = {f"__t{i}": (resolve(root, k), d) for i, (k, d) in enumerate(sort_by.items())}
    if any(v is None or d not in (1, -1) for v, d in ties.values()):
        return None
    for name, o in outputs.items():
        op, window = next((k for k in o if k != "window"), None), o.get("window") or {}
        if op in RANKS:
            kinds[name] = "number" if op == "$documentNumber" or not ties else "rank"
        elif op in TOTALS and window in WHOLE:
            kinds[name] = "total"
        elif op in ("$sum", "$count", "$avg", "$min", "$max") and window == UP_TO_HERE:
            kinds[name] = "running"
        else:
            return None
    order = sort_columns(root, sort_by)
    made: dict[str, Column] = {}
    totals = [accumulate(c, _plain(outputs[n]), F.lit(0)).col.alias(f"__total_{n}") for n, k in kinds.items() if k == "total"]
    total = df.agg(*totals) if totals else None
    if "rank" in kinds.values():
        # A rank is told by how many rows have smaller keys: sums over the different keys.
        same = df.groupBy(*[v.col.alias(t) for t, (v, _) in ties.items()]).agg(F.count(F.lit(1)).alias("__n"))
        same = running(same, [F.col(t).asc_nulls_first() if d == 1 else F.col(t).desc_nulls_last() for t, (_, d) in ties.items()], {"__upto": ("sum", F.col("__n"))})
        same = same.select(*[F.col(t).alias(f"{t}_") for t in ties], (F.col("__upto") - F.col("__n") + 1).cast("int").alias("__of_rank"), F.col("__rank").cast("int").alias("__of_dense"))
        test = F.lit(True)
        for t, (v, _) in ties.items():
            test = test & v.col.eqNullSafe(F.col(f"{t}_"))
        df = df.join(same, test, "left").drop(*[f"{t}_" for t in ties])
    if set(kinds.values()) & {"number", "running"}:
        values: dict[str, tuple[str, Column]] = {}
        for n, k in kinds.items():
            op, arg = next(iter(_plain(outputs[n]).items()))
            if k != "running" or op == "$count":
                continue
            v = c(arg)
            if op in ("$min", "$max"):
                values[f"__r_{n}"] = (op[1:], v.col)
                made[n] = F.col(f"__r_{n}")
            else:
                kind = accumulate(c, {"$sum": arg}, F.lit(0)).type if op == "$sum" else T.DoubleType()
                values[f"__r_{n}"] = ("sum", number(v).col.cast(kind))
                values[f"__n_{n}"] = ("sum", number(v).col.isNotNull().cast("long"))
                made[n] = F.coalesce(F.col(f"__r_{n}"), F.lit(0).cast(kind)) if op == "$sum" else F.when(F.col(f"__n_{n}") > 0, F.col(f"__r_{n}") / F.col(f"__n_{n}"))
        df = running(df, [*order, F.col(POS)], values)
    for n, k in kinds.items():
        op = next(iter(_plain(outputs[n])))
        if k == "rank":
            made[n] = F.col("__of_rank" if op == "$rank" else "__of_dense")
        elif k == "number":
            made[n] = F.col("__rank").cast("int")
        elif k == "running" and op == "$count":
            made[n] = F.col("__rank")
        elif k == "total":
            made[n] = F.col(f"__total_{n}")
    if total is not None:
        df = df.crossJoin(F.broadcast(total))  # a single row
    kept = [x for x in df.columns if not x.startswith(("__of_", "__total_", "__r_", "__n_")) and x != "__rank" and x not in made]
    return df.select(*[F.col(f"`{x}`") for x in kept], *[made[n].alias(n) for n in outputs])


@stage("$setWindowFields")
def set_window_fields(df, spec, ctx):
    sort_by, outputs = spec.get("sortBy") or {}, spec["output"]
    df = with_pos(df)
    root = frame(df)
    c: Expr = expr(df, ctx)
    key = c(spec["partitionBy"]) if spec.get("partitionBy") is not None else None
    w = Window.partitionBy(key.col) if key is not None else Window.partitionBy()
    keys = sort_columns(root, sort_by)
    order = [*keys, F.col(POS)]
    if key is None and not ctx.parts and (made := ranged(df, c, sort_by, outputs)) is not None:
        return made.orderBy(*sort_columns(frame(made), sort_by)) if sort_by else made
    # Accumulators that see an order see that of the window.
    if any(needs_order(o) for o in outputs.values()):
        df = df.withColumn("__wpos", F.row_number().over(w.orderBy(*order)))
    columns = {}
    for name, o in outputs.items():
        ops = [k for k in o if k != "window"]
        if len(ops) != 1:
            raise PipelineError(f"one operator for {name}, not {ops}")
        op, arg = ops[0], o[ops[0]]
        if op in RANKS:
            # Ranks see ties; numbers of documents are told apart by the rows' order.
            columns[name] = RANKS[op]().over(w.orderBy(*(order if op == "$documentNumber" else keys or order))).cast("int")
        elif op == "$shift":
            v, by, default = c(arg["output"]), int(arg["by"]), c(arg.get("default"))
            fill = None if default.is_null else default.col.cast(v.type)
            shifted = (F.lead if by >= 0 else F.lag)(v.col, abs(by)).over(w.orderBy(*order))
            inside = F.row_number().over(w.orderBy(*order)) + by
            columns[name] = shifted if fill is None else F.when((inside >= 1) & (inside <= F.count(F.lit(1)).over(w)), shifted).otherwise(fill)
        else:
            own = _framed(w, o.get("window"), bool(sort_by), order, root, sort_by)
            v = accumulate(c, _plain(o), F.col("__wpos") if needs_order(o) else F.lit(0), lambda x, own=own: x.over(own)) if op not in ("$first", "$last") else None
            columns[name] = v.col if v is not None else (F.first if op == "$first" else F.last)(c(arg).col).over(own)
    paths = {}
    for name, col in columns.items():
        paths[name] = col
    out = df.withColumns(paths).drop("__wpos")
    return out.orderBy(*([key.col.asc_nulls_first()] if key is not None and not sort_by else []), *keys) if sort_by else out
