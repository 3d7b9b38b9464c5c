"""The corpus pipeline: toxicity, line dedup, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, written as
Parquet and read again. All but the last return the columns of ``documents``; other columns of
their input are left out, whatever their names. Defined results of every stage: nulls in any
column are kept as they are (a null text is scored, split, matched and packed as an empty one);
very long texts are read whole; repeated rows are rows of their own but for the near copies, of
which one stays; ties go to the smaller id; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import drop_stored, standing, stored, table
from glyphmill.llm.jaccard import near_duplicates
from glyphmill.llm.lines import line_dedup
from glyphmill.llm.packing import pack
from glyphmill.llm.queries import TOXIC, held_out, word_bpe
from glyphmill.llm.suffix import remove_repeats
from glyphmill.llm.toxicity import fit_toxicity, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars following the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the model learns from the labels that aren't held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    score = toxicity(F.col("text"), fit_toxicity(docs, labels), spark)["score"]
    return docs.select(*COLUMNS).where(score < TOXIC)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all; documents stay, and so does a null text."""
    kept = line_dedup(docs.select(*COLUMNS), min_docs=10, min_chars=1)
    return _documents(kept)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that of the smallest id, then of the smallest hash of its text, any one of rows that repeat both. Rows without an id or words stay."""
    rows = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    key = ["doc_id", "text_hash"]
    groups = near_duplicates(docs.select("doc_id", "text"), size=5, percent=80).where("doc_id is not null and component_no is not null")
    # a table, as what follows reads it four times
    members = stored(groups.groupBy(*key).agg(F.min("component_no").alias("component_no"), F.count("*").alias("n")), "pipeline-members")
    kept = members.groupBy("component_no").agg(F.min(F.struct(*key, "n")).alias("k")).select("k.*")
    gone = members.select(*key).join(kept.select(*key), key, "left_anti")
    twice = kept.where("n > 1").select(*key)
    once = rows.join(gone, key, "left_anti").join(twice, key, "left_anti")
    return once.unionByName(rows.join(twice, key, "left_semi").dropDuplicates(key)).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that also start earlier go; documents stay, if need be empty."""
    return _documents(remove_repeats(docs.select(*COLUMNS), length=100))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row for each piece of a document. The workers also hold what earlier stages left, hence the smaller table."""
    pieces = pack(docs.select("doc_id", "text"), word_bpe(), capacity=2048, words_kept=400_000)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_common_lines),
    ("near_duplicates", without_near_copies),
    ("suffix_dedup", without_repeats),
    ("packing", packed),
]

#: A learnt model and a tokenizer can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before it wrote; what a stage leaves behind goes once it is written."""
    docs, before = table(spark, sf_dir, "documents"), standing()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
            drop_stored(spark, before, keep=docs)
    return docs
