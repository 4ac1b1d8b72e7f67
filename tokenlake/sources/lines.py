"""Session logs as lines: (source_file, line_no, byte_offset, value), and whether files are complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Non-blank lines of whole files; a log file is a session's, and fits a task."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")
    every = files.select("source_file", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return with_offsets(every)


def with_offsets(every: DataFrame) -> DataFrame:
    """The non-blank ones of all lines of files (source_file, line_no, value), with ``byte_offset``."""
    w = Window.partitionBy("source_file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("byte_offset", F.coalesce(F.sum(F.octet_length("value") + 1).over(w), F.lit(0)).cast("long"))
    return every.where(F.trim("value") != "").select("source_file", "line_no", "byte_offset", "value")


def file_status(rows: DataFrame) -> DataFrame:
    """(source_file, complete): every line parses."""
    return rows.groupBy("source_file").agg(F.bool_and(F.try_parse_json("value").isNotNull()).alias("complete"))


def field(path: str, kind: str | None = None) -> Column:
    """A JSON field of ``value``; with a kind, null where it doesn't fit."""
    out = F.get_json_object("value", path)
    return out.try_cast(kind) if kind else out


def in_file(*order: str):
    return Window.partitionBy("source_file").orderBy(*(order or ("line_no",)))


def so_far(*order: str):
    return in_file(*order).rowsBetween(Window.unboundedPreceding, 0)


def before(*order: str):
    return in_file(*order).rowsBetween(Window.unboundedPreceding, -1)


def with_origin_key(rows: DataFrame, event_id: str, slot: Column | int = 0) -> DataFrame:
    """``origin_key``: event id if not empty, else byte offset; then the slot."""
    slot = F.lit(slot) if isinstance(slot, int) else slot
    name = F.coalesce(F.concat(F.lit("event:"), F.nullif(F.col(event_id), F.lit(""))), F.concat(F.lit("offset:"), F.col("byte_offset").cast("string")))
    return with_distinct_key(rows, F.concat(name, F.lit(":slot:"), slot.cast("string")))


def with_distinct_key(rows: DataFrame, base: Column) -> DataFrame:
    """``origin_key`` from a file's base keys; repeats get :duplicate:n, past keys that are literally so."""
    keyed = rows.withColumn("_base", base)
    n = F.row_number().over(Window.partitionBy("source_file", "_base").orderBy("line_no")) - 1
    keyed = keyed.withColumn("_n", n).withColumn("origin_key", F.when(F.col("_n") == 0, F.col("_base")).otherwise(F.concat("_base", F.lit(":duplicate:"), F.col("_n").cast("string"))))
    # a second pass for made keys that equal another line's
    again = F.row_number().over(Window.partitionBy("source_file", "origin_key").orderBy(F.col("_n").desc(), "line_no")) - 1
    return keyed.withColumn("_m", again).withColumn("origin_key", F.when(F.col("_m") == 0, F.col("origin_key")).otherwise(F.concat("origin_key", F.lit(":duplicate:"), F.col("_m").cast("string")))).drop("_base", "_n", "_m")
