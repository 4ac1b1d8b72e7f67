"""Price history, family routes and pricing files, read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.report import project_unit

FIELDS = ("input", "output", "reasoning", "cache_read", "cache_write", "input_audio", "output_audio")
CHANGES = ("op", "ts", "commit_sha", "sequence", "provider", "model", *FIELDS)


def _normal(name: str) -> Column:
    return F.lower(F.trim(name)).alias(name)


def read_price_events(spark: SparkSession, path: str) -> DataFrame:
    """Upserts of a change stream; blank input, output and cache_read are 0, other blanks null; an unknown op is an error."""
    rows = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in CHANGES))
    op = F.when(F.col("op").isin("upsert", "delete"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
    price = lambda c: F.col(c).cast("decimal(18,9)")
    return rows.withColumn("op", op).where(F.col("op") == "upsert").select(
        "op", F.to_timestamp("ts").alias("ts"), "commit_sha", F.col("sequence").cast("long").alias("sequence"), _normal("provider"), _normal("model"),
        *[F.coalesce(price(c), F.lit(0).cast("decimal(18,9)")).alias(c) for c in ("input", "output", "cache_read")], *[price(c).alias(c) for c in ("reasoning", "cache_write")],
    )


def read_families(spark: SparkSession, path: str) -> DataFrame:
    """(provider, canonical_name, model, position); rows without a canonical name go."""
    rows = spark.read.csv(path, header=True, schema="provider string, model string, canonical_name string, family string, release_date string")
    rows = rows.withColumn("position", F.monotonically_increasing_id())
    return rows.where(F.trim("canonical_name") != "").select(_normal("provider"), _normal("canonical_name"), _normal("model"), "position")


def write_changes(changes: DataFrame, path: str) -> None:
    """The change stream in order, blanks for what is absent."""
    have = set(changes.columns)
    cols = [(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in CHANGES]
    changes.orderBy("sequence").select(*cols).write.csv(path, header=True, nullValue="", emptyValue="")


def write_snapshots(daily: DataFrame, path: str) -> None:
    """One folder for each day."""
    daily.repartition("date").sortWithinPartitions("provider", "model").write.partitionBy("date").csv(path, header=True, nullValue="")


def write_latest(latest: DataFrame, path: str) -> None:
    """Active routes in order, over as many files as ranges of them."""
    latest.orderBy("provider", "model").write.csv(path, header=True, nullValue="", emptyValue="")


def write_families(families: DataFrame, path: str) -> None:
    families.orderBy("provider", "model").write.csv(path, header=True, nullValue="")


def report_json(agg: DataFrame, unit: str = "tokens", split_input: bool = False) -> DataFrame:
    """A JSON line for each report row: keys as a struct, then the measures in a unit; an empty ``cost_per`` is left out."""
    agg = project_unit(agg, unit, split_input)
    if "cost_per" in agg.columns:
        agg = agg.withColumn("cost_per", F.when(F.size("cost_per") > 0, F.col("cost_per")))
    keys = [c for c in agg.columns if c.startswith("key_")]
    struct = F.struct(F.struct(*[F.col(k).alias(k[4:]) for k in keys]).alias("keys"), *[c for c in agg.columns if c not in keys])
    return agg.select(F.to_json(struct, {"ignoreNullFields": "true"}).alias("value"))
