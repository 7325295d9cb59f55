"""A training corpus from raw documents: quality rules, near-dedup, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet in the shared folder
and read again as the next stage's docs. All stages but the last return the columns of documents, others that docs has
included, whatever their names.

Defined cases, stage by stage: a null, empty or short text fails the quality rules' base and goes. Rows of one id are
judged one by one, until near-dedup leaves one row of an id that stands on several and one text of a group, that of the
smallest id; rows without an id stay as they are there, and a group that has one with an id and one without keeps both.
A text of any length is read whole by every stage. Ties: of equal texts the smallest id stays; equal slots of the mix are
ordered by id and text. A document that the mix takes twice comes twice, a null id first among the token ids. An empty
table of documents, labels or benchmark items gives the empty or the unfiltered result of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandql.llm import common, decision_list, decontaminate, huffman, jaccard, mixing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list rejects go."""
    return decision_list.good_documents(docs, common.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: trees over SimHash fingerprints first, an exact Jaccard similarity of 0.8 or more of five-word shingles throughout."""
    return jaccard.keep_one(docs, least=0.8, shingle=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of benchmark go."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its schedule."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token-id files, and what is read back from them."""
    return huffman.encode_documents(spark, docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontaminated), ("mixing", mixed), ("token ids", token_ids)]

#: Learned rules, near-duplicate groups and a tokenizer are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what they store goes as soon as the next stage's rows are written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with common.scratch(spark) as made:
            docs = common.materialize(stage(spark, docs, sf_dir), "stage")
            made.remove(docs.folder)
        if before is not None:
            common.discard(before)
        before = docs
    return docs
