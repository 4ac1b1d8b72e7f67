"""All sources of a machine decoded together: one that is missing or broken costs only its own records."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decoders, lines

#: Decoders of folders of log files.
DECODERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "claude": decoders.decode_claude, "codex": decoders.decode_codex, "copilot-cli": decoders.decode_event_files,
    "pi-agent": lambda rows: decoders.decode_pi(rows).unionByName(decoders.decode_pi_plugin(rows)),
}


def _messages(spark: SparkSession, path: str) -> DataFrame:
    return decoders.decode_messages(*[spark.read.parquet(f"{path}/{t}.parquet") for t in ("message", "session", "project")])


def collect(spark: SparkSession, folders: dict[str, str | list[str]]) -> tuple[DataFrame, DataFrame]:
    """(usage records, status) of sources and their folders; opencode is a folder of tables.

    status: (source, state, files, incomplete, detail) with state ok, missing
    (no such folder), failed (what is there can't be read as such a source)
    or unknown (no such source). Files that vanish or break off while they are
    read count as they are; incomplete ones keep the records of their valid lines.
    """
    records, status = spark.createDataFrame([], decoders.USAGE), []
    files = "source string, files long, incomplete long"
    seen = spark.createDataFrame([], files)
    for source, path in folders.items():
        try:
            if source == "opencode":
                made = _messages(spark, path)
                seen = seen.unionByName(spark.createDataFrame([(source, None, None)], files))
            elif source in DECODERS:
                logs = lines.lines(spark, path)
                made = DECODERS[source](logs)
                counts = lines.file_status(logs).agg(F.count("*").alias("files"), F.count_if(~F.col("complete")).alias("incomplete"))
                seen = seen.unionByName(counts.select(F.lit(source).alias("source"), "files", "incomplete"))
            else:
                status.append((source, "unknown", None))
                continue
            records = records.unionByName(made)
            status.append((source, "ok", None))
        except (PySparkException, Py4JJavaError) as e:  # a broken footer comes as the JVM's own error
            detail = e.getCondition() if isinstance(e, PySparkException) else e.java_exception.getClass().getSimpleName()
            status.append((source, "missing" if detail == "PATH_NOT_FOUND" else "failed", detail))
    states = spark.createDataFrame(status, "source string, state string, detail string")
    return records, states.join(seen, "source", "left").select("source", "state", "files", "incomplete", "detail")
