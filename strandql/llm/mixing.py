"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame operations only.

Sources weigh 1, 2, 3, repeating, in code-point order (null last); each one's target is its share of all words, at
most MOST_EPOCHS times its own, the excess shared again by weight. Slot t of the mix takes the golden-ratio point
t * STEP mod POINTS and belongs to the source whose interval of cumulated targets holds it. Slots are ranked within
their source; slot k of a source takes block k of its words: the source's documents in the order of their hash, read
over and over, cut into blocks of equal size. So the points alone decide how many words a source gives: a block for
each of its slots, its target but for the discrepancy of the points, a few blocks; a slot whose source has been read
MOST_EPOCHS times stays empty. In any run of slots the sources stand in the ratio of their targets.

Ranks and positions are prefix sums in two levels (sums of chunks, then within a chunk), so a source with a third of
all rows is spread over many tasks; only the table of sources is ever handled as a whole. Defined cases: null and
empty texts have size 0 and are never taken; a null source is a source, the last; equal ids are ordered by size and
repeated rows take what falls on each; a null id counts as the empty text in the order; a very long text is many
pieces, each a row of four numbers; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandql.llm import common

BLOCK_WORDS, LEAST_SLOTS = 256, 1 << 16
MOST_EPOCHS = 3
#: Points are whole numbers below POINTS: slot t has t times the golden ratio's share of POINTS, a whole odd number.
POINTS, STEP = 1 << 31, 1327217885
#: Cells of the points by which they meet the sources' intervals.
CELLS = 4096
CHUNK_SLOTS = 1 << 14
#: Documents that one step of a prefix sum should meet.
CHUNK_DOCS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_no, source_size, target, words (the target in whole words), one row a source."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    own = own.withColumn("source_no", F.row_number().over(by_name))
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int")).cast("long"))
    own = own.withColumn("most", most * F.col("source_size"))
    # Sources in the order in which a rising level meets their limit: those before the final level are at their limit.
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    before, after = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after)
    own = own.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("most"))
    final = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), F.col("source_no"), F.col("level")))).over(everything)
    own = own.withColumn("final", final["level"])
    target = F.coalesce(F.least(F.col("final") * F.col("weight"), F.col("most").cast("double")), F.col("most").cast("double"))
    own = own.withColumn("target", target)
    return own.select("source", "source_no", "source_size", "target", F.least(F.round("target").cast("long"), F.col("most")).alias("words"))


def block_words(total: int) -> int:
    """Words of a block: BLOCK_WORDS, or fewer where the mix would not have LEAST_SLOTS slots."""
    return max(1, min(BLOCK_WORDS, total // LEAST_SLOTS))


def slot_schedule(sources: DataFrame, total: int, block: int) -> DataFrame:
    """source_no, rank (from 0), slot: every slot of the mix, ranked within the source that its point falls to."""
    spark = sources.sparkSession
    slots = -(-total // block)
    edges = Window.orderBy("source_no")
    own = sources.where("words > 0").withColumn("hi", F.sum("words").over(edges)).withColumn("all", F.sum("words").over(Window.partitionBy()))
    edge = lambda c: F.floor(c / F.col("all") * POINTS).cast("long")
    own = own.select("source_no", edge(F.col("hi") - F.col("words")).alias("lo"), edge(F.col("hi")).alias("hi")).where("lo < hi")
    cell = lambda c: F.floor(c / (POINTS // CELLS)).cast("int")
    cells = own.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    points = spark.range(slots, numPartitions=max(1, min(common.shuffle_width(spark), slots // CHUNK_SLOTS + 1))).withColumnRenamed("id", "slot")
    points = points.withColumn("point", (F.col("slot") % POINTS) * STEP % POINTS).withColumn("cell", cell(F.col("point")))
    dealt = points.join(cells, "cell").where("lo <= point and point < hi").select("source_no", "slot", F.floor(F.col("slot") / CHUNK_SLOTS).alias("chunk"))
    sums = dealt.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    inside = Window.partitionBy("source_no", "chunk").orderBy("slot")
    ranked = dealt.join(sums.select("source_no", "chunk", "base"), ["source_no", "chunk"])
    return ranked.select("source_no", (F.col("base") + F.row_number().over(inside) - 1).alias("rank"), "slot")


def mix_pieces(docs: DataFrame, *, block: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, sources, pieces): sizes has row, doc_id, source, size, mark (of the text); pieces has slot, row, epoch, first_word, words."""
    text = F.col(text_col)
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), common.word_count(text).alias("size"), F.xxhash64(text).alias("mark"))
    sizes = common.materialize(sizes.withColumn("row", F.monotonically_increasing_id()), "sizes")
    sources = common.materialize(source_targets(sizes), "sources")
    tally = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    block = block or block_words(tally["total"])
    slots = common.materialize(slot_schedule(sources, tally["total"], block), "slots")
    # What a source gives: a block for each of its slots, read over MOST_EPOCHS times at most.
    got = slots.groupBy("source_no").agg((F.max("rank") + 1).alias("slots"))
    given = sources.join(got, "source_no").select(F.col("source").alias("of"), "source_no", "source_size", F.least(F.col("slots") * block, MOST_EPOCHS * F.col("source_size")).alias("limit"))
    digits = 0
    while tally["n"] > CHUNK_DOCS * 16**digits:
        digits += 1
    placed = sizes.join(given, F.col("source").eqNullSafe(F.col("of"))).where("size > 0")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    placed = placed.select("row", "source_no", "size", "source_size", "limit", key.alias("key"), F.substring(key, 1, digits).alias("chunk"))
    sums = placed.groupBy("source_no", "chunk").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_no", "chunk").orderBy("key", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(sums, ["source_no", "chunk"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # Where each document stands when its source is read over and over.
    epochs = F.sequence(F.lit(0), F.lit(MOST_EPOCHS - 1))
    placed = placed.withColumn("epoch", F.explode(epochs)).withColumn("lo", F.col("epoch") * F.col("source_size") + F.col("start"))
    placed = placed.where("lo < limit").withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("limit")))
    placed = placed.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    begin = F.greatest(F.col("lo"), F.col("rank") * block)
    placed = placed.select("row", "source_no", "rank", "epoch", (begin - F.col("lo")).alias("first_word"), (F.least(F.col("hi"), (F.col("rank") + 1) * block) - begin).alias("words"))
    return sizes, sources, placed.join(slots, ["source_no", "rank"]).select("slot", "row", "epoch", "first_word", "words")


def taken_words(docs: DataFrame, *, block: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words of the row that the mix takes, repeats counted), first_slot, n_slots (in which they stand)."""
    sizes, sources, pieces = mix_pieces(docs, block=block, id_col=id_col, text_col=text_col, source_col=source_col)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    out = sizes.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).join(taken, "row", "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), "first_slot", F.coalesce("n_slots", none).alias("n_slots"))


def mixed_documents(docs: DataFrame, *, block: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs in the order of the schedule, all columns kept.

    A row comes once for each reading of its source in which the mix takes at least half of its words, at the first
    slot that holds one of them. Rows of the same id, source and text count as one, which comes if it does for half of them.
    """
    sizes, _, pieces = mix_pieces(docs, block=block, id_col=id_col, text_col=text_col, source_col=source_col)
    read = pieces.groupBy("row", "epoch").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    read = read.join(sizes.select("row", "doc_id", "source", "mark", "size"), "row")
    whole = F.col("words") * 2 >= F.col("size")
    same = ["doc_id", "source", "mark"]
    times = read.groupBy(*same, "epoch").agg(F.sum(whole.cast("long")).alias("n"), F.min("slot").alias("slot")).where("n > 0")
    rows = sizes.where("size > 0").groupBy(*same).agg(F.count("*").alias("rows")).where("rows > 1").toDF("of_id", "of_source", "of_mark", "rows")
    equal = F.col("doc_id").eqNullSafe(F.col("of_id")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("mark") == F.col("of_mark"))
    few = times.join(rows, equal, "left").where("rows is null or 2 * n >= rows").select(*same, "slot")
    names = {c: common.free_name(docs, f"__{c}") for c in (*same, "slot")}
    few = common.materialize(few.toDF(*names.values()), "mixed")
    joined = docs.join(few, docs[id_col].cast("long").eqNullSafe(F.col(names["doc_id"])) & docs[source_col].cast("string").eqNullSafe(F.col(names["source"])) & (F.xxhash64(docs[text_col]) == F.col(names["mark"])))
    order = [F.col(names[c]) for c in ("slot", "doc_id", "mark")]
    return joined.repartitionByRange(common.shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order).select(*[docs[c] for c in docs.columns])


def op8_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(common.table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), own AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_no FROM sizes GROUP BY source
), weighed AS (
  SELECT *, (source_no - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM own
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce((sum(most) OVER (ORDER BY most / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))
    / (sum(weight) OVER (ORDER BY most / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM weighed
), final AS (
  SELECT arg_min(level, {'a': most / weight, 'b': source_no}) FILTER (WHERE level * weight <= most) AS level FROM levels
), targets AS (
  SELECT source, source_no, source_size, coalesce(least(f.level * weight, most::DOUBLE), most::DOUBLE) AS target, most FROM levels, final f
), goals AS (
  SELECT *, least(round(target)::BIGINT, most) AS words FROM targets
), grid AS (
  SELECT greatest(1, least(256, sum(source_size) // 65536))::BIGINT AS block, sum(source_size)::BIGINT AS total FROM goals
), summed AS (
  SELECT source_no, words, (sum(words) OVER (ORDER BY source_no))::BIGINT AS upto, (sum(words) OVER ())::BIGINT AS all_words FROM goals WHERE words > 0
), edges AS (
  SELECT source_no, floor((upto - words) / all_words * 2147483648)::BIGINT AS lo, floor(upto / all_words * 2147483648)::BIGINT AS hi FROM summed
), points AS (
  SELECT t AS slot, t % 2147483648 * 1327217885 % 2147483648 AS point FROM (SELECT unnest(range((total + block - 1) // block)) AS t FROM grid)
), slots AS (
  SELECT source_no, slot, row_number() OVER (PARTITION BY source_no ORDER BY slot) - 1 AS rnk FROM points JOIN edges ON lo <= point AND point < hi
), given AS (
  SELECT g.*, block, least(coalesce(n, 0) * block, most) AS quota
  FROM goals g CROSS JOIN grid LEFT JOIN (SELECT source_no, count(*) AS n FROM slots GROUP BY source_no) c ON g.source_no = c.source_no
), placed AS (
  SELECT row_number() OVER () AS id, s.doc_id, s.source, s.size, g.source_no, g.source_size, g.target, g.quota, g.block,
    coalesce((sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS start
  FROM sizes s JOIN given g ON s.source IS NOT DISTINCT FROM g.source
), readings AS (
  SELECT id, source_no, block, epoch * source_size + start AS lo, least(epoch * source_size + start + size, quota) AS hi
  FROM placed, (VALUES (0), (1), (2)) e(epoch) WHERE size > 0 AND epoch * source_size + start < quota
), pieces AS (
  SELECT id, source_no, rnk, least(hi, (rnk + 1) * block) - greatest(lo, rnk * block) AS words
  FROM (SELECT *, unnest(range(lo // block, (hi - 1) // block + 1)) AS rnk FROM readings)
), taken AS (
  SELECT id, sum(words)::BIGINT AS taken, min(slot) AS first_slot, count(*) AS n_slots FROM pieces JOIN slots USING (source_no, rnk) GROUP BY id
)
SELECT doc_id, source, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot::BIGINT AS first_slot, coalesce(n_slots, 0)::BIGINT AS n_slots
FROM placed LEFT JOIN taken USING (id)
"""
