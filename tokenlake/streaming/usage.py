"""Streams: log files to usage snapshots, and hourly totals with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import display_input, display_output
from ..functions.storage import removed, stored
from ..operators.incremental import changed_files, reconcile, snapshot
from ..sources.lines import file_status, lines, with_offsets

Decoder = Callable[[DataFrame], DataFrame]


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of arriving log files, blank ones too, for ingest(); files must not change once they are there, see follow()."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", "true").load(path)
    return files.select(F.col("_metadata.file_path").alias("source_file"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))


BUCKETS = 64
#: The name beside a table under which its files are known.
FILES = "{}_files"


def _bucket():
    return F.pmod(F.xxhash64("source_file"), F.lit(BUCKETS)).cast("int")


def _apply(spark: SparkSession, made: DataFrame, decode: Decoder, table: str, gone: DataFrame | None = None) -> None:
    """Reconcile the table's buckets of the files of ``made`` (lines) with what these decode to; files that are gone lose their rows.

    The same lines applied again leave the table as it is.
    """
    new = decode(made)
    status = file_status(made)
    status = status if gone is None else status.unionByName(gone.select("source_file", F.lit(True).alias("complete")))
    first = not spark.catalog.tableExists(table)
    mine = sorted(r["b"] for r in status.select(_bucket().alias("b")).distinct().collect())  # BUCKETS at most
    old = new.limit(0) if first else spark.table(table).where(F.col("file_bucket").isin(mine)).select(*new.columns)
    after = stored(snapshot(reconcile(old, new, status)).select(*new.columns, _bucket().alias("file_bucket")), "usage")
    if first:  # the option stays with the table
        after.write.partitionBy("file_bucket").option("partitionOverwriteMode", "dynamic").saveAsTable(table)
    else:
        after.write.insertInto(table, overwrite=True)
        # a bucket that lost all its rows is not overwritten: it goes
        left = {r["b"] for r in after.select(F.col("file_bucket").alias("b")).distinct().collect()}
        there = {int(r[0].rpartition("=")[2]) for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}
        for b in sorted((set(mine) - left) & there):
            spark.sql(f"ALTER TABLE {table} DROP PARTITION (file_bucket = {b})")
    removed(after)


def ingest(lines: DataFrame, decode: Decoder, table: str, checkpoint: str) -> StreamingQuery:
    """Decode each batch of lines and reconcile it with the usage table, which is parted by buckets of files: a batch reads and rewrites its files' only."""

    def batch(rows: DataFrame, _: int) -> None:
        made = stored(with_offsets(rows), "lines")
        _apply(rows.sparkSession, made, decode, table)
        removed(made)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """A table that streams write in sessions of their own, as it is now."""
    spark.catalog.refreshTable(table)
    return spark.table(table)


def files_now(spark: SparkSession, path: str) -> DataFrame:
    """(path, mtime, size) of the files in a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def sync(spark: SparkSession, path: str, decode: Decoder, table: str, batch: int | None = None) -> int:
    """Bring the table up to a folder whose files grow, shrink, come and go; how many files were read or went.

    Known files stand in FILES with size, time and the last applied batch. Only
    files that differ are read, whole, since a session's records depend on all
    its lines. The known files are written last: what fails before is done again with the
    same result, and a batch that was applied is not applied again.
    """
    name = FILES.format(table)
    known = spark.table(name) if spark.catalog.tableExists(name) else None
    if batch is not None and known is not None:
        last = known.agg(F.max("batch")).first()[0]
        if last is not None and last >= batch:
            return 0
    now = stored(files_now(spark, path), "files")
    old = now.limit(0) if known is None else known.where("path is not null").select("path", "mtime", "size")
    changed = changed_files(now, old)
    gone = old.join(now, "path", "left_anti")
    todo = [r["path"] for r in changed.select("path").collect()]  # the names of files that changed since the last call
    lost = gone.count()
    if todo or lost:
        read = lines(spark, todo) if todo else lines(spark, path).where("false")
        # files without lines are complete and have no records
        made = stored(read, "lines")
        bare = changed.select(F.col("path").alias("source_file")).join(made.select("source_file").distinct(), "source_file", "left_anti")
        _apply(spark, made, decode, table, bare.unionByName(gone.select(F.col("path").alias("source_file"))))
        removed(made)
    mark = F.lit(batch).cast("long").alias("batch")
    # a row without a path keeps the batch of an empty folder
    after = stored(now.select("*", mark).unionByName(spark.range(1).select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("timestamp").alias("mtime"), F.lit(None).cast("long").alias("size"), mark)), "known")
    after.write.mode("overwrite").saveAsTable(name)
    removed(now, after)
    return len(todo) + lost


def follow(spark: SparkSession, path: str, decode: Decoder, table: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """sync() as a stream: once, or at an interval (``1 minute``)."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    out = ticks.writeStream.foreachBatch(lambda rows, i: sync(rows.sparkSession, path, decode, table, i)).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(once=True)).start()


def hourly_totals(usage: DataFrame, late: str = "2 hours") -> DataFrame:
    """(hour, source, tokens, records) of a stream or a table of usage; on a stream, hours close once late rows can't come."""
    rows = usage.withColumn("tokens", display_input() + display_output())
    rows = rows.withWatermark("ts", late) if usage.isStreaming else rows
    out = rows.groupBy(F.window("ts", "1 hour").alias("w"), "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"))
    return out.select(F.col("w.start").alias("hour"), "source", "tokens", "records")


def closed_hours(usage: DataFrame, into: str, checkpoint: str, late: str = "2 hours") -> StreamingQuery:
    """Append the hours of a stream of usage that are closed to a Parquet folder; rows later than ``late`` behind the batch before are dropped."""
    return hourly_totals(usage, late).writeStream.format("parquet").outputMode("append").option("path", into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
