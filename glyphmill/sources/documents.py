"""One JSON document for each category: {category, count, results in order of index}.

Writing has two steps. A data source writer lets each task write its rows' part of each category
under a name of its own; what the task reports (a commit message) says which parts it wrote, and the
commit puts the messages of the tasks that succeeded into one manifest. Parts of attempts that failed or lost a
race are in no message, so nobody reads them. Then one task for each category streams its parts, in
order, under one head and foot into a new file and renames that to the document's name: readers see
a whole document or none. Memory is bounded by a copy buffer. A category is one file, so it has one
writer at the end; the parts, where the work is, are written by range, whatever a category's size.

Paths are URIs that Arrow's file systems know (local or shared folders, object stores, HDFS).
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.tables import settled
from .ordered import in_file_order

COPY = 1 << 20


def file_system(path: str) -> tuple[FileSystem, str]:
    """The file system of a path and the path in it; Hadoop's file:/x is file:///x."""
    return FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path)) if re.match(r"^\w+:/", path) else FileSystem.from_uri(os.path.abspath(path))


def file_name(category: str | None, suffix: str) -> str:
    """A category's file: marks that would be a path, and the escape itself, are escaped."""
    return "%null" + suffix if category is None else re.sub(r"[/\\\x00-\x1f%]|^\.", lambda m: f"%{ord(m[0]):02X}", category) + suffix


@dataclass
class Parts(WriterCommitMessage):
    """What a task wrote: (category, index of the first record, records, file)."""

    parts: list[tuple[str | None, int, int, str]]


class PartWriter(DataSourceArrowWriter):
    """Rows (category, at, line), sorted within the task: a file for each category that the task holds."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        fs, folder = file_system(self.folder)
        fs.create_dir(folder, recursive=True)
        attempt, done, out, now = uuid.uuid4().hex, [], None, None
        try:
            for batch in iterator:
                for category, at, line in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if out is None or category != now:
                        if out:
                            out.close()
                        now = category
                        done.append([category, at, 0, f"{folder}/{attempt}-{len(done)}"])
                        out = fs.open_output_stream(done[-1][3])
                    else:
                        out.write(b",\n")
                    out.write(line.encode())
                    done[-1][2] += 1
        finally:
            if out:
                out.close()
        return Parts([tuple(d) for d in done])

    def commit(self, messages: list[Parts | None]) -> None:
        fs, folder = file_system(self.folder)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/manifest.new") as out:
            for m in messages:
                for part in m.parts if m else []:
                    out.write((json.dumps(part) + "\n").encode())
        fs.move(f"{folder}/manifest.new", f"{folder}/manifest")

    def abort(self, messages: list[Parts | None]) -> None:
        fs, folder = file_system(self.folder)
        for m in messages:
            for _, _, _, path in m.parts if m else []:
                if fs.get_file_info(path).is_file:
                    fs.delete_file(path)


class JsonParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_parts"

    def writer(self, schema, overwrite: bool) -> PartWriter:
        return PartWriter(self.options["path"])


def joined(folder: str, category: str | None, parts: list[tuple[int, int, str]], count_name: str, suffix: str) -> tuple[str, int]:
    """Stream a category's parts (index, records, file) under one head and foot; the file's name and its number of records."""
    fs, folder = file_system(folder)
    n = sum(p[1] for p in parts)
    final = f"{folder}/{file_name(category, suffix)}"
    made = f"{folder}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(made) as out:
        out.write(f'{{"category": {json.dumps(category, ensure_ascii=False)}, "{count_name}": {n}, "results": [\n'.encode())
        for k, (_, _, path) in enumerate(sorted(parts)):
            out.write(b",\n" if k else b"")
            with fs.open_input_stream(path) as part:
                while block := part.read(COPY):
                    out.write(block)
        out.write(b"\n]}\n")
    fs.move(made, final)
    return final, n


def write_documents(df: DataFrame, path: str, *, category: str, index: str, record: Column, count_name: str = "total_count", suffix: str = ".json") -> DataFrame:
    """Write a JSON document for each category; returns category, file, n of what was written, a row for each (a table that stands until ``tables.release``)."""
    spark = df.sparkSession
    spark.dataSource.register(JsonParts)
    rows = df.select(F.col(category).cast("string").alias("category"), F.col(index).cast("long").alias("at"), F.to_json(record, {"ignoreNullFields": "false"}).alias("line"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    staging = f"{path}/.parts-{uuid.uuid4().hex}"
    rows.repartitionByRange(tasks, "category", "at").sortWithinPartitions("category", "at").write.format("json_parts").mode("append").option("path", staging).save()

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [(json.loads(c), *joined(path, json.loads(c), [(p["at"], p["n"], p["file"]) for p in parts], count_name, suffix)) for c, parts in zip(frame["category"], frame["parts"], strict=True)]
            yield pd.DataFrame(done, columns=["category", "file", "n"])

    # a category's parts are as many as the tasks that met it
    part = F.from_json("value", "array<string>")
    found = spark.read.text(f"{staging}/manifest").select(F.to_json(F.array(part[0]), {"ignoreNullFields": "false"}).alias("c"), F.struct(part[1].cast("long").alias("at"), part[2].cast("long").alias("n"), part[3].alias("file")).alias("p"))
    found = found.groupBy(F.expr("substr(c, 2, length(c) - 2)").alias("category")).agg(F.collect_list("p").alias("parts")).repartition(tasks, "category")
    written = settled(found.mapInPandas(join, "category string, file string, n long"), "documents-written")
    fs, at = file_system(staging)
    fs.delete_dir(at)
    return written


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """category, count, at (from 0), record (JSON) of documents that ``write_documents`` wrote: lines are read in parallel, whatever a document's size."""
    lines = in_file_order(spark.read.text(path))
    head = F.regexp_replace("value", r"\[$", "[]}")
    heads = lines.where("line = 0").select("file", F.get_json_object(head, "$.category").alias("category"), F.regexp_extract("value", r'": (\d+), "results": \[$', 1).cast("long").alias("count"))
    records = lines.where((F.col("line") > 0) & (F.col("value") != "]}") & (F.col("value") != "")).select("file", (F.col("line") - 1).alias("at"), F.regexp_replace("value", ",$", "").alias("record"))
    return records.join(heads, "file").select("category", "count", "at", "record")


def listed(path: str) -> list[str]:
    """The documents of a folder."""
    fs, folder = file_system(path)
    return sorted(i.path for i in fs.get_file_info(FileSelector(folder)) if i.is_file and not i.base_name.startswith("."))
