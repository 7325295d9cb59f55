"""Compiles a pipeline (a list of stage documents) into one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame

from strandql.operators import joins, stages, windows  # noqa: F401 - they register their stages
from strandql.operators.stages import STAGES
from strandql.plans.context import MOST_STAGES, Context, is_hidden, with_pos, without_pos
from strandql.plans.rewrite import needs_positions, rewrite, subfields
from strandql.plans.values import PipelineError

WRITES = ("$out", "$merge")


def validated(pipeline: list[dict[str, Any]], nested: bool = False) -> list[dict[str, Any]]:
    if not isinstance(pipeline, (list, tuple)):
        raise PipelineError("a pipeline is a list of stages")
    if len(pipeline) > MOST_STAGES:
        raise PipelineError(f"a pipeline has {MOST_STAGES} stages at most")
    for i, s in enumerate(pipeline):
        if not isinstance(s, dict) or len(s) != 1:
            raise PipelineError(f"a stage is a document with one operator: {s!r}")
        name = next(iter(s))
        if name in WRITES and (nested or i != len(pipeline) - 1):
            raise PipelineError(f"{name} is the last stage")
        if name in ("$vectorSearch", "$geoNear") and i:
            raise PipelineError(f"{name} is the first stage")
        if name not in STAGES and name not in WRITES:
            raise PipelineError(f"unknown stage {name}")
    return list(pipeline)


def run(df: DataFrame, pipeline: list[dict[str, Any]], ctx: Context, keep_order: bool = False) -> DataFrame:
    """The stages over df; hidden columns of the input go on, a position column only if keep_order."""
    todo = rewrite(validated(pipeline, nested=True))
    for i, s in enumerate(todo):
        name, spec = next(iter(s.items()))
        if name == "$joinLookup":
            df = joins.join_lookup(df, spec["spec"], ctx, spec["how"], subfields(todo[i + 1 :], spec["spec"]["as"]))
            continue
        df = STAGES[name](df, spec, ctx)
        rest = todo[i + 1 :]
        if name == "$sort" and not ctx.parts and (needs_positions(rest) or keep_order and not any(next(iter(x)) in ("$group", "$sort") for x in rest)):
            df = with_pos(df)
    return df


def aggregate(df: DataFrame, pipeline: list[dict[str, Any]], resolver: Callable[[str], DataFrame] | Mapping[str, DataFrame] | None = None, writer: Any = None) -> DataFrame:
    """Run a pipeline over df. resolver gives other collections by name; writer takes $out and $merge."""
    if isinstance(resolver, Mapping):
        known = resolver
        resolver = lambda name: known[name]
    ctx = Context(df.sparkSession, resolver, {}, writer)
    todo = validated(pipeline)
    write = todo.pop() if todo and next(iter(todo[-1])) in WRITES else None
    out = run(df, todo, ctx)
    out = without_pos(out).drop(*[c for c in out.columns if is_hidden(c)])
    if write is None:
        return out
    if writer is None:
        raise PipelineError("$out and $merge need a database to write to")
    return writer.write(out, write)
