"""What a pipeline needs besides its input: other collections, and how rows are ordered and told apart so far."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandql.plans.values import Frame, PipelineError, Val

#: A hidden column: the position of a row in the order that a $sort (or the scan) gave it.
POS = "__pos"
#: Hidden columns of a correlated sub-pipeline: what the outer row bound, by which every stage works apart.
PART = "__part_"
MOST_STAGES = 50


@dataclass(frozen=True)
class Context:
    spark: SparkSession
    resolver: Callable[[str], DataFrame] | None = None
    variables: dict[str, Val] = field(default_factory=dict)
    writer: Any = None
    parts: tuple[str, ...] = ()

    def collection(self, name: str) -> DataFrame:
        if self.resolver is None:
            raise PipelineError(f"no collection {name!r}: the pipeline has no resolver")
        return self.resolver(name)

    def bind(self, variables: dict[str, Val], parts: tuple[str, ...] = ()) -> Context:
        return replace(self, variables={**self.variables, **variables}, parts=parts)

    def part_columns(self) -> list[Column]:
        return [F.col(p) for p in self.parts]


def is_hidden(name: str) -> bool:
    return name == POS or name.startswith(PART)


def frame(df: DataFrame) -> Frame:
    return Frame.of(df, tuple(c for c in df.columns if is_hidden(c)))


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not is_hidden(c)]


def with_pos(df: DataFrame) -> DataFrame:
    """df with the position column; after a global sort its partitions are ranges in order, so the ids ascend."""
    return df if POS in df.columns else df.withColumn(POS, F.monotonically_increasing_id())


def without_pos(df: DataFrame) -> DataFrame:
    return df.drop(POS) if POS in df.columns else df


def select(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """These columns, and the hidden ones that are there."""
    kept = [F.col(c) for c in df.columns if is_hidden(c)]
    return df.select(*[c.alias(n) for n, c in columns.items()], *kept)


def own_columns(df: DataFrame) -> dict[str, Column]:
    return {c: F.col(f"`{c}`") for c in visible(df)}
