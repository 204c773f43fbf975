"""Collections of records: one JSON object per file, JSON lines (strict and tolerant), CSV ratings, keyed tables, binary files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every *.json below a folder; in path order when sorted by path."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def relative_files(spark: SparkSession, uri: str) -> DataFrame:
    """path below the folder, text of every file there."""
    files = spark.read.option("recursiveFileLookup", True).text(uri, wholetext=True)
    whole = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:///")
    return files.select(F.replace(whole, F.lit(uri.rstrip("/") + "/"), F.lit("")).alias("path"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType, tolerant: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all strings; a byte-order mark before the first name is dropped."""
    df = spark.read.option("header", True).csv(path)
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


def keyed_rows(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """{"rows": {row_id: {...}}} as one row per row_id."""
    kind = T.StructType([T.StructField("rows", T.MapType(T.StringType(), row))])
    return spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("rows").alias("row_id", "r")).select("row_id", "r.*")


def hashed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes, sha256, content of each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def events_of(text: str) -> Iterator[tuple[int, str]]:
    """Number and body of the events of a stream: data lines of a block joined by newlines; comments, event, id and retry skipped; [DONE] dropped; other lines are errors."""
    seq, lines = 0, []
    for line in [*text.splitlines(), ""]:
        if not line.strip():
            body = "\n".join(lines)
            if lines and body != "[DONE]":
                yield seq, body
                seq += 1
            lines = []
        elif line.startswith("data:"):
            lines.append(line[5:].lstrip())
        elif not line.startswith((":", "event:", "id:", "retry:")):
            raise ValueError("invalid event-stream line")


@F.udtf(returnType=T.StructType([T.StructField("seq", T.IntegerType()), T.StructField("body", T.StringType())]))
class ParseEvents:
    """Server-sent events of a text, a row each; a null has none."""

    def eval(self, text: str):
        yield from events_of(text or "")
