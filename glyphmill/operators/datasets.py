"""Training sets from conversations and comments: SFT, DPO and GRPO rows, samples and envelopes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import preprocess_training
from ..functions.jsonx import parse_dpo, parse_first_last_brace
from ..functions.prompts import dpo_prompt, keyword_prompt
from .extraction import Client
from .inflight import answered, one_each
from .tables import settled

MESSAGE = "struct<role:string,content:string>"


def sft_to_grpo(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, messages (system, user), original_response: the last text of each role; conversations without a user text go."""
    last = lambda r: F.coalesce(F.max_by("text", F.when(F.col("role") == r, F.col("turn"))), F.lit(""))
    roles = turns.where(F.col("role").isin("system", "user", "assistant")).groupBy("conv_id").agg(*(last(r).alias(r) for r in ("system", "user", "assistant")))
    messages = F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("content")) for r in ("system", "user")))
    return roles.where("user <> ''").select("conv_id", messages.alias("messages"), F.col("assistant").alias("original_response"))


def sample_to_grpo(df: DataFrame, column: str) -> DataFrame:
    """messages (system, user) and original_response of JSON samples {messages: [{role, content}]}: the last content of each role; samples without a user's text go."""
    messages = F.from_json(column, f"messages array<{MESSAGE}>")["messages"]
    last = lambda r: F.coalesce(F.get(F.reverse(F.filter(messages, lambda m: m["role"] == r)), F.lit(0))["content"], F.lit(""))
    roles = df.select(*(last(r).alias(r) for r in ("system", "user", "assistant"))).where("user <> ''")
    made = F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("content")) for r in ("system", "user")))
    return roles.select(made.alias("messages"), F.col("assistant").alias("original_response"))


def first_n(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n rows in the given order, all for none or 0."""
    return df.orderBy(order).limit(n) if n else df


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for the same seed on every engine: the lowest md5 of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def category_sample(df: DataFrame, special: dict[str, int] | None = None, n: int = 100, seed: int = 42) -> DataFrame:
    """(category, index, comment) -> the same of n rows of each category without replacement, numbered anew in the order in which they were drawn; categories whose name holds a part named in ``special`` give that many.

    Drawn by the lowest md5 of seed, category and index, cut to n within each task before rows are exchanged.
    """
    size = F.lit(n)
    for part, own in (special or {}).items():
        size = F.when(F.contains("category", F.lit(part)), own).otherwise(size)
    drawn = F.md5(F.concat_ws("-", F.lit(str(seed)), "category", F.col("index").cast("string")).cast("binary"))
    most = max([n, *(special or {}).values()])
    place = F.row_number().over(Window.partitionBy("category").orderBy("drawn", "index"))
    few = df.select("category", "index", "comment", drawn.alias("drawn")).withColumn("place", place).where(F.col("place") <= most)
    return few.where(F.col("place") <= size).select("category", (F.col("place") - 1).cast("long").alias("index"), "comment")


def sample_size(name: str) -> int:
    """Files of the special data set give more rows."""
    return 1000 if "special_dataset" in name else 100


def indexed(df: DataFrame, order: str, *partition: str) -> DataFrame:
    """A 0-based ``index`` in the given order, within the partition columns if there are any.

    Rows are sorted by range over all tasks; an index is a row's place in its task's part of its
    group and the counts of the parts before, one small row for each. No group is one task's.
    """
    keys = [*partition, order]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = settled(df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part = [F.shiftright("__at", 33).alias("__part")]
    counts = sorted_.select(*partition, *part, "__at").groupBy(*partition, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*partition).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    there = F.lit(True)
    left, right = sorted_.select("*", *part).alias("l"), starts.alias("r")
    for c in [*partition, "__part"]:
        there &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    index = (F.col("l.__at") - F.col("r.__first") + F.col("r.__before")).cast("long").alias("index")
    return left.join(right, there).select(*(F.col(f"l.`{c}`") for c in df.columns), index)


def sft_record(index: Column, comment: Column, clean: Column, raw: Column, keywords: Column) -> Column:
    return F.struct(index.alias("index"), comment.alias("original_comment"), clean.alias("preprocessed_comment"), raw.alias("raw_response"), keywords.alias("keywords"))


def dpo_record(index: Column, comment: Column, clean: Column, raw: Column, parsed: Column) -> Column:
    return F.struct(index.alias("index"), comment.alias("original_comment"), clean.alias("preprocessed_comment"), raw.alias("raw_response"), parsed.alias("parsed_result"))


def generated(df: DataFrame, client_factory: Callable[[], Client], kind: str = "dpo", store: Callable[[DataFrame], DataFrame] | None = None, workers: int = 15) -> DataFrame:
    """(index, comment) -> index, record: clean, drop what is empty then, prompt, call, parse; without an answer the record has nulls. ``kind`` is dpo or sft.

    A task has ``workers`` calls under way. Answers are written before they are parsed (``store``, else a table in the shared folder), so none is asked for twice.
    """
    clean = df.select("index", F.col("comment").cast("string").alias("comment"), preprocess_training(F.col("comment")).alias("clean"))
    system, user = (dpo_prompt if kind == "dpo" else keyword_prompt)(F.col("clean"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = one_each(client_factory)
        # what is empty goes here: a filter before this would be pushed below the cleaning, so that each comment is cleaned twice
        some = (frame[frame["clean"].map(lambda c: c.strip() != "").astype(bool)] for frame in frames)
        for frame, raw in answered(some, ["system", "user"], lambda s, u: client()(s, u, {}), workers):
            yield frame[["index", "comment", "clean"]].assign(raw=pd.Series(raw, index=frame.index, dtype=object))

    asked = clean.select("index", "comment", "clean", system.alias("system"), user.alias("user"))
    asked = (store or settled)(asked.mapInPandas(run, f"index {dict(df.dtypes)['index']}, comment string, clean string, raw string"))
    columns = [F.col(c) for c in ("index", "comment", "clean", "raw")]
    record = dpo_record(*columns, parse_dpo(F.col("raw"))) if kind == "dpo" else sft_record(*columns, F.get_json_object(parse_first_last_brace(F.col("raw")), "$.keywords"))
    return asked.select("index", record.alias("record"))


def envelope_lines(df: DataFrame, category: str, record: Column, index: str, count_name: str) -> DataFrame:
    """category, at, line: the lines of one JSON text for each category, {category, count, results in order of index}; a record is a line.

    Records stay rows; only a category's count and last index are put together.
    """
    rows = df.select(F.col(category).alias("category"), F.col(index).cast("long").alias("at"), F.to_json(record, {"ignoreNullFields": "false"}).alias("line"))
    ends = rows.groupBy("category").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    lines = rows.alias("l").join(ends.alias("r"), F.col("l.category").eqNullSafe(F.col("r.category"))).select("l.category", "at", F.concat("line", F.when(F.col("at") < F.col("last"), ",").otherwise("")).alias("line"))
    name = F.to_json(F.array("category"), {"ignoreNullFields": "false"})
    head = ends.select("category", (F.col("first") - 1).alias("at"), F.concat(F.lit('{"category":'), F.substr(name, F.lit(2), F.length(name) - 2), F.lit(f',"{count_name}":'), F.col("n").cast("string"), F.lit(',"results":[')).alias("line"))
    return lines.union(head).union(ends.select("category", (F.col("last") + 1).alias("at"), F.lit("]}").alias("line")))

