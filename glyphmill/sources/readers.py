"""Sources and sinks: CSV comments, JSON lines, items, stopword lists, category names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import strip
from ..functions.jsonx import mended

#: Column names in order of choice, and what counts as missing in a CSV.
COMMENT_COLUMNS = ["Comment", "comment", "text"]
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def comment_column(df: DataFrame) -> DataFrame:
    """The first present comment column as ``comment``, missing values dropped; an empty table if there is none. Names are told apart by case."""
    name = next((c for c in COMMENT_COLUMNS if c in df.columns), None)
    if name is None:
        return df.sparkSession.createDataFrame([], "comment string")
    renamed = df.toDF(*(f"c{k}" for k in range(len(df.columns))))  # exact names even where the session ignores case
    col = F.col(f"c{df.columns.index(name)}").cast("string")
    return renamed.select(F.when(~col.isin(MISSING), col).alias("comment")).where("comment is not null")


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    return comment_column(spark.read.csv(path, header=True, multiLine=True, escape='"'))


def json_lines(lines: DataFrame, lenient: bool = False) -> DataFrame:
    """(value) -> value: stripped lines that are JSON; blank and bad ones go. Lines with repeated keys or NaN stay, as plain JSON, if ``lenient``."""
    value = strip(F.col("value"))
    found = lines.select(value.alias("value")).where(F.col("value") != "")
    return found.select(mended(F.col("value")).alias("value")).where("value is not null") if lenient else found.where(F.try_parse_json("value").isNotNull())


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark.read.text(path), lenient=True)


def item_text(describe: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(describe, F.lit("")), text, F.lit(""))


def item_id(id_: Column) -> Column:
    return F.coalesce(id_.cast("string"), F.lit("unknown"))


def stopwords(lines: DataFrame) -> DataFrame:
    """(value) -> word: stripped, without blanks and comments, each once."""
    return lines.select(strip(F.col("value")).alias("word")).where((F.col("word") != "") & ~F.startswith("word", F.lit("#"))).distinct()


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    return stopwords(spark.read.text(path))


def category_name(path: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line, nulls kept."""
    df.write.option("ignoreNullFields", "false").json(path)
