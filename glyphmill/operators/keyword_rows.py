"""Keyword steps as relations over rows (id, keyword, score, pos): joins and windows instead of arrays.

Partitioning by id alone serves the dedupe and the top-n windows with one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stop_exact(rows: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Anti-join on equality; Spark broadcasts the list if it is small enough, else both sides are shuffled."""
    return rows.join(stopwords.select(F.col("word").alias("keyword")).distinct(), "keyword", "left_anti")


def stop_contains(rows: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Rows whose keyword holds no stopword. Every substring of a keyword is looked up by equality, so no pair of tables is crossed.

    Keywords are short; their distinct substrings number at most length * (length + 1) / 2.
    """
    words = rows.select("keyword").distinct()
    part = words.select("keyword", F.expr("explode(flatten(transform(sequence(1, greatest(length(keyword), 1)), i -> transform(sequence(1, greatest(length(keyword) - i + 1, 1)), n -> substring(keyword, i, n))))) as word"))
    hit = part.join(stopwords.select("word").distinct(), "word", "left_semi").select("keyword").distinct()
    return rows.join(hit, "keyword", "left_anti")


def keep_first(rows: DataFrame) -> DataFrame:
    """The highest score of each keyword and id, the earliest among equals."""
    w = Window.partitionBy("id", "keyword").orderBy(F.desc("score"), "pos")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_n(rows: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc("score"), "pos")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
