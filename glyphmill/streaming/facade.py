"""The row-wise operators over streams: stateless, no watermark and no state needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import cleaning, jsonx, keywords


def read_items(spark: SparkSession, folder: str, schema: str = "id string, describe string, text string, raw string") -> DataFrame:
    """A stream of JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema).json(folder)


def keyword_stream(items: DataFrame, n: int = 8) -> DataFrame:
    """id, keywords of items that carry a raw answer: the array forms, which need no window over the stream."""
    text = cleaning.preprocess_inference(F.coalesce(F.nullif(F.col("describe"), F.lit("")), F.col("text")), udf=False)
    obj = jsonx.parse_response(F.col("raw"), ["keywords"])
    rows = items.select("id", text.alias("text"), keywords.normalize(jsonx.keyword_items(obj, ("keywords",))).alias("kws"))
    return rows.select("id", keywords.words_only(keywords.post_process("kws", "text", stopwords=keywords.STOPWORDS, n=n)).alias("keywords"))


def run_available(out: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Work off what has arrived, exactly once, and stop."""
    return out.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
