"""Incremental ingest: changed files and snapshot reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_files(now: DataFrame, known: DataFrame) -> DataFrame:
    """Files of (path, mtime, size) that are new or differ from what is known."""
    return now.join(known, ["path", "mtime", "size"], "left_anti")


def reconcile(old: DataFrame, new: DataFrame, status: DataFrame) -> DataFrame:
    """Rows of old and new with ``op``: insert, update, delete or unchanged.

    Only complete files are compared, by origin_key; the rows of incomplete and
    unseen files stay as they are. Deleted rows carry their old values.
    A null or repeated key in the new snapshot is an error.
    """
    keys = ["source_file", "origin_key"]
    columns = [c for c in old.columns if c not in keys]
    bad = new.where(F.col("origin_key").isNull() | (F.col("origin_key") == "")).select(F.lit("empty").alias("what")).union(new.groupBy(*keys).count().where("count > 1").select(F.lit("repeated").alias("what")))
    found = bad.limit(1).collect()
    if found:
        raise ValueError(f"{found[0]['what']} origin_key in the new snapshot")
    ok = status.where("complete").select(F.col("source_file").alias("_f")).distinct()
    mark = lambda df: df.join(ok, F.col("source_file") == F.col("_f"), "left").withColumn("_ok", F.col("_f").isNotNull()).drop("_f")
    a = mark(old).select(*keys, F.struct(*columns).alias("_old"), F.col("_ok").alias("_ok_old"))
    b = mark(new).where("_ok").select(*keys, F.struct(*columns).alias("_new"))
    both = a.join(b, keys, "full_outer")
    op = (
        F.when(F.col("_old").isNull(), "insert").when(~F.col("_ok_old"), "unchanged").when(F.col("_new").isNull(), "delete")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("update")
    )
    value = F.coalesce("_new", "_old")
    return both.select(*keys, *[value[c].alias(c) for c in columns], op.alias("op"))


def snapshot(reconciled: DataFrame) -> DataFrame:
    return reconciled.where("op <> 'delete'").drop("op")
