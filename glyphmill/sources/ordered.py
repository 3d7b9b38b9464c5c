"""Files read in parallel that keep their order: every row knows its file, its place there and its place in all.

A scan deals parts of files (splits) to tasks. A split's rows stay together and in order in its
task, and hidden file columns tell which split a row is from. So one small row for each split, with
how many rows it gave and where its task's numbering stood, turns a task's numbering into places in
the file; no row moves, and no file is one task's. What is filtered before isn't counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cleaning import strip
from ..operators.datasets import indexed
from .readers import COMMENT_COLUMNS, MISSING, category_name


def in_file_order(scan: DataFrame) -> DataFrame:
    """A scan of files (after filters and projections that keep ``_metadata``, or a plain one) and ``file`` (its path), ``line`` (the row's place in it) and ``position`` (its place in all files, in order of their paths), from 0."""
    columns = [c for c in scan.columns if c != "_metadata"]
    rows = scan.select(
        *(F.col(f"`{c}`") for c in columns), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__at")
    )
    splits = rows.groupBy("file", "__split").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = lambda *keys: F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("file", "__split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each split of the input, like the list of splits that the driver itself holds
    starts = splits.select("file", "__split", (before("file") - F.col("__first")).alias("__line"), (before(F.lit(0)) - F.col("__first")).alias("__position"))
    placed = rows.join(starts, ["file", "__split"])
    return placed.select(*(F.col(f"`{c}`") for c in columns), "file", (F.col("__at") + F.col("__line")).alias("line"), (F.col("__at") + F.col("__position")).alias("position"))


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """value, file, line, position of each line."""
    return in_file_order(spark.read.text(list(paths)))


def read_samples(spark: SparkSession, *paths: str, n: int | None = None) -> DataFrame:
    """value, file, line, position of the JSON lines, blank and bad ones not counted; the first n, in order of files and lines, if n is given."""
    lines = spark.read.text(list(paths)).select(strip(F.col("value")).alias("value"), "_metadata")
    found = in_file_order(lines.where((F.col("value") != "") & F.try_parse_json("value").isNotNull()))
    return found.where(F.col("position") < n) if n else found


#: Up to so many files their choices of a column (about a hundred bytes each) are sent to the tasks.
SENT = 100_000


def read_category_comments(spark: SparkSession, *paths: str, most_columns: int = 64) -> DataFrame:
    """category, file, index (from 0 in each file), comment of all CSV files in one plan, whatever columns each has.

    A file's header is its first row; it chooses the file's own comment column. Missing comments
    are not counted; a file without such a column gives no row. A header of more than ``most_columns``
    names (127 at most) raises an error, which says so.
    """
    names = [f"c{k}" for k in range(most_columns + 1)]
    scan = spark.read.csv(list(paths), schema=", ".join(f"{c} string" for c in names), header=False, multiLine=True, escape='"')
    heads = _chosen_columns(scan, names)
    seen = heads.agg(F.collect_set("pick").alias("picks"), F.coalesce(F.bool_or("wide"), F.lit(False)).alias("wide"), F.count("pick").alias("n")).first()  # at most most_columns numbers
    if seen["wide"]:
        raise ValueError(f"a header has more than {most_columns} columns: give a larger most_columns")
    # only the columns that some file chooses are parsed from here on
    picks = sorted(seen["picks"])
    value = F.coalesce(*(F.when(F.col("pick") == k, F.col(names[k])) for k in picks), F.lit(None).cast("string"))
    there = F.col("comment").isNotNull() & ~F.col("comment").isin(MISSING)
    rows = scan.select(*(names[k] for k in picks), "_metadata")
    picked = heads.where("pick is not null").select(F.col("file").alias("of"), "pick")
    if seen["n"] <= SENT:
        # rows stay in their tasks; the header, whose name is no missing value, is row 0 of its file
        kept = rows.join(F.broadcast(picked), F.col("_metadata.file_path") == F.col("of")).withColumn("comment", value).where(there).select("comment", "_metadata")
        found = in_file_order(kept).where("line > 0").withColumn("index", F.col("line") - 1)
    else:
        placed = in_file_order(rows).where("line > 0")
        found = indexed(placed.join(picked, F.col("file") == F.col("of")).withColumn("comment", value).where(there).select("file", "line", "comment"), "line", "file")
    return found.select(category_name(decoded_path(F.col("file"))).alias("category"), "file", "index", "comment")


def _chosen_columns(scan: DataFrame, names: list[str]) -> DataFrame:
    """file, pick (the place of the comment column, null without one), wide (whether the last name is used too): from the first row of each file."""
    rows = scan.select(*names, F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    pick = F.lit(None).cast("long")
    named = F.array(*(F.coalesce(F.ltrim(c, F.lit("\ufeff")), F.lit("")) for c in names))
    for wanted in reversed(COMMENT_COLUMNS):  # names are told apart by case
        pick = F.when(F.array_position(named, wanted) > 0, F.array_position(named, wanted) - 1).otherwise(pick)
    # one number holds a row and its choice, so that each task sums up a file in three numbers
    firsts = rows.groupBy("file").agg(F.min("at").alias("first"), F.min(F.col("at") * 128 + pick).alias("best"), F.min(F.when(F.col(names[-1]).isNotNull(), F.col("at"))).alias("wide"))
    own = F.when(F.shiftright("best", 7) == F.col("first"), (F.col("best") % 128).cast("int"))
    return firsts.select("file", own.alias("pick"), F.coalesce(F.col("wide") == F.col("first"), F.lit(False)).alias("wide"))


def decoded_path(path: Column) -> Column:
    """A path as it is named on disk; the scan gives it as a URI."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))

