"""Quality rules as a learned decision list. DataFrame operations only.

Every whole text gets counts (words, symbols, repeated lines, words in repeated 8-word windows, capitals, ...) and
rates made of them. From labelled rows the rates' quantiles give candidate thresholds, and one grouped aggregation
gives the number of good and bad rows in every cell of binned rates. Sequential covering then grows conjunctions of
thresholds that single out bad rows (by FOIL gain on the growing part), prunes them on the pruning part, keeps those
whose pruned precision holds, removes what they cover and goes on. The list comes out as one ordered CASE WHEN.

Cells are collected from at most TRAIN_ROWS labelled rows. Defined cases: null texts have no words; empty and short
texts fail the base rule; labels that are null, not 0/1 or without a document are ignored; a document labelled twice
counts twice; repeated rows are judged one by one; without labels (or bad ones) the list is empty and every row that
passes the base rule is kept; of conditions of equal gain the first rate and the lowest threshold win; very long texts
are counted whole; rows of one labelled id beyond common.ROWS_OF_ID are thinned to about so many; an empty table gives
an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandql.llm import common

WINDOW = 8
TRAIN_ROWS = 20_000
#: Quantiles of a rate that become thresholds.
QUANTILES = [k / 24 for k in range(1, 24)]
MOST_RULES, MOST_CONDITIONS, LEAST_PRECISION = 12, 4, 0.95
RATES = ("symbol_rate", "mean_word", "upper_rate", "mark_rate", "repeat_rate", "line_rate", "variety")


def text_counts(rows: DataFrame, *carried: str) -> DataFrame:
    """The carried columns, the contract's counts and the rates of every row's whole text (column text)."""
    text = rows.select(*carried, F.coalesce("text", F.lit("")).alias("text"))
    parts = text.select(*carried, "text", F.array_remove(F.split("text", f"[{common.SPACE}]+"), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{common.SPACE}]")).alias("lines"))
    parts = parts.withColumn("n_words", F.size("words").cast("long")).withColumn("wins", F.expr(f"if(n_words < {WINDOW}, array(), transform(sequence(1, cast(n_words as int) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))))"))
    # Most texts repeat no window; for the others the windows are sorted once, and places with an equal neighbour count.
    repeats = f"""
      CASE WHEN size(array_distinct(wins)) = size(wins) THEN 0L ELSE
        transform(array(sort_array(transform(wins, (h, i) -> named_struct('h', h, 'i', i)))), s ->
          aggregate(sort_array(transform(filter(s, (x, k) -> get(s, k - 1).h <=> x.h OR get(s, k + 1).h <=> x.h), x -> x.i)),
            named_struct('n', 0L, 'to', 0),
            (a, p) -> named_struct('n', a.n + p + {WINDOW} - greatest(p, a.to), 'to', p + {WINDOW}), a -> a.n))[0] END"""
    counts = parts.select(
        *carried,
        "n_words",
        F.expr("cast(length(concat_ws('', words)) as bigint)").alias("word_chars"),
        F.expr("cast(regexp_count(text, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr(repeats).cast("long").alias("n_repeat_words"),
        F.expr("size(lines)").alias("n_lines"),
        F.expr("regexp_count(text, '\\\\p{Lu}')").alias("n_upper"),
        F.expr("length(text) - length(replace(text, '!', ''))").alias("n_marks"),
        F.expr("size(array_distinct(words))").alias("n_distinct"),
    )
    rate = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counts.select(
        *carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rate("n_symbols", "n_words").alias("symbol_rate"), rate("word_chars", "n_words").alias("mean_word"), rate("n_upper", "word_chars").alias("upper_rate"), rate("n_marks", "n_words").alias("mark_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"), rate("n_dup_lines", "n_lines").alias("line_rate"), rate("n_distinct", "n_words").alias("variety"),
    )


@dataclass(frozen=True)
class Condition:
    """rate > threshold or rate <= threshold; bin: how many thresholds lie below a value that is just above this one."""

    rate: int
    above: bool
    bin: int

    def holds(self, cell: tuple[int, ...]) -> bool:
        return (cell[self.rate] >= self.bin) == self.above


Cells = list[tuple[tuple[int, ...], int, int]]


def _tally(cells: Cells, rule: list[Condition]) -> tuple[int, int]:
    """(bad, good) rows that the rule covers."""
    bad = good = 0
    for cell, b, g in cells:
        if all(c.holds(cell) for c in rule):
            bad, good = bad + b, good + g
    return bad, good


def _best_condition(cells: Cells, rule: list[Condition], bins: list[int]) -> Condition | None:
    """The condition with the largest FOIL gain, found from one pass over the covered cells."""
    by: list[dict[int, list[int]]] = [defaultdict(lambda: [0, 0]) for _ in bins]
    for cell, b, g in cells:
        if all(c.holds(cell) for c in rule):
            for k, v in enumerate(cell):
                by[k][v][0] += b
                by[k][v][1] += g
    bad, good = (sum(x[j] for x in by[0].values()) for j in (0, 1))
    if not bad or not good:
        return None
    before, best = math.log2(bad / (bad + good)), (1e-9, None)
    for k, n in enumerate(bins):
        b = g = 0
        for edge in range(1, n + 1):
            b, g = b + by[k][edge - 1][0], g + by[k][edge - 1][1]
            for above, p, q in ((False, b, g), (True, bad - b, good - g)):
                if p and (gain := p * (math.log2(p / (p + q)) - before)) > best[0]:
                    best = (gain, Condition(k, above, edge))
    return best[1]


def learn_list(grow: Cells, prune: Cells, bins: list[int], most_rules: int = MOST_RULES, least_precision: float = LEAST_PRECISION) -> list[list[Condition]]:
    """Conjunctions that reject, in order. grow, prune: (bins of a cell, bad rows, good rows)."""
    rules: list[list[Condition]] = []
    while len(rules) < most_rules:
        rule: list[Condition] = []
        while len(rule) < MOST_CONDITIONS and (found := _best_condition(grow, rule, bins)):
            rule.append(found)
        if not rule:
            break
        worth = lambda r: (lambda b, g: (b - g) / (b + g) if b + g else -1.0)(*_tally(prune, r))
        while len(rule) > 1:
            shorter = max(([c for c in rule if c is not x] for x in rule), key=worth)
            if worth(shorter) < worth(rule):
                break
            rule = shorter
        b, g = (x + y for x, y in zip(_tally(grow, rule), _tally(prune, rule)))
        if b < 2 or b / (b + g) < least_precision:
            break
        rules.append(rule)
        covered = lambda cell: all(c.holds(cell) for c in rule)  # noqa: E731, B023
        grow, prune = [x for x in grow if not covered(x[0])], [x for x in prune if not covered(x[0])]
    return rules


def list_column(rules: list[list[Condition]], edges: list[list[float]]) -> Column:
    """The list as an ordered conditional expression: true keeps the row."""
    out = None
    for rule in rules:
        test = None
        for c in rule:
            edge = F.lit(edges[c.rate][c.bin - 1])
            one = F.col(RATES[c.rate]) > edge if c.above else F.col(RATES[c.rate]) <= edge
            test = one if test is None else test & one
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out_fold: int | None = 0) -> tuple[list[list[Condition]], list[list[float]]]:
    """(the rules in order, the thresholds of each rate) from the labelled rows of docs; rows of the held-out fold are not used."""
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    own = own.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).withColumn("fold", common.fold_of(F.col("doc_id")))
    if held_out_fold is not None:
        own = own.where(F.col("fold") != held_out_fold)
    chosen = common.bounded_sample(own, TRAIN_ROWS, "doc_id", "label")
    src = common.labelled_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), chosen)
    known = common.materialize(text_counts(src, "label", "fold").select("label", "fold", *RATES), "labelled")
    edges = known.agg(*[F.percentile_approx(r, QUANTILES, 10_000).alias(r) for r in RATES]).first()
    edges = [sorted(set(edges[r] or [])) for r in RATES]
    binned = [sum((F.col(r) > F.lit(e)).cast("int") for e in own) if own else F.lit(0) for r, own in zip(RATES, edges)]
    cells = known.select((F.col("fold") == 4).alias("prune"), "label", *[b.cast("int").alias(r) for r, b in zip(RATES, binned)])
    cells = cells.groupBy("prune", *RATES).agg(F.sum(1 - F.col("label")).alias("bad"), F.sum("label").alias("good")).collect()  # TRAIN_ROWS at most
    made: tuple[Cells, Cells] = ([], [])
    for row in cells:
        made[row["prune"]].append((tuple(row[r] for r in RATES), row["bad"], row["good"]))
    common.discard(known)
    return learn_list(made[0], made[1], [len(e) for e in edges]), edges


def base_rule(least_words: int = 20, most_repeats: int = 30) -> Column:
    """True where a text is too short or repeats itself too much."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row; but for the labelled rows' statistics nothing is shuffled."""
    verdict = list_column(*learn(docs, labels, id_col, text_col, label_col))
    counts = text_counts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_rule().alias("base_failed"), (~base_rule() & verdict).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """docs without the rows that the rules reject, all columns kept."""
    verdict = list_column(*learn(docs, labels, id_col, text_col, label_col))
    counts = text_counts(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(text_col).alias("text")), "row")
    # A filter on computed columns would be pushed below them, and arrays that are made once a text be made again for
    # every element of a window. It cannot pass a column that is not deterministic, here the number of the row.
    number = counts.withColumn("number", F.monotonically_increasing_id())
    return number.where((F.col("number") >= 0) & ~base_rule() & verdict).select("row.*")


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
