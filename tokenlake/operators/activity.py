"""Gap-filled activity series, quantile levels, streaks and the calendar grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import display_input, display_output


def value_of(unit: str) -> tuple[Column, Column]:
    """(value, estimated) of a record in tokens, bytes or cost."""
    tokens = F.col("input_estimated") | F.col("output_estimated")
    if unit == "bytes":
        return F.col("input_bytes") + F.col("output_bytes"), F.col("input_bytes_estimated") | F.col("output_bytes_estimated")
    if unit == "cost":
        return F.coalesce("cost", F.lit(0)), tokens
    return display_input() + display_output(), tokens


def daily(usage: DataFrame, start: str, end: str, unit: str = "tokens", tz: str = "UTC") -> DataFrame:
    """(date, value, estimated) for every local date from start to end; estimated only where there is a value."""
    value, estimated = value_of(unit)
    local = F.to_date(F.from_utc_timestamp("ts", tz))
    sums = usage.select(local.alias("date"), value.alias("v"), estimated.alias("e")).where(F.col("date").between(start, end)).groupBy("date").agg(F.sum("v").alias("v"), F.bool_or("e").alias("e"))
    calendar = usage.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    out = calendar.join(sums, "date", "left")
    return out.select("date", F.coalesce("v", F.lit(0)).alias("value"), (F.coalesce("e", F.lit(False)) & (F.coalesce("v", F.lit(0)) > 0)).alias("estimated"))


def hourly(usage: DataFrame, start: str, hours: int, unit: str = "tokens", tz: str = "UTC") -> DataFrame:
    """(bucket, at, value, estimated): elapsed hours from the local hour of start, so repeated local hours stay apart."""
    value, estimated = value_of(unit)
    at = F.lit(start).cast("timestamp")
    # local and UTC clock differ by the zone's offset at that time
    first = at - (F.from_utc_timestamp(at, tz) - F.date_trunc("hour", F.from_utc_timestamp(at, tz)))
    bucket = F.floor((F.unix_micros("ts") - F.unix_micros(first)) / F.lit(3_600_000_000)).cast("long")
    sums = usage.select(bucket.alias("bucket"), value.alias("v"), estimated.alias("e")).where(F.col("bucket").between(0, hours - 1)).groupBy("bucket").agg(F.sum("v").alias("v"), F.bool_or("e").alias("e"))
    out = usage.sparkSession.range(hours).withColumnRenamed("id", "bucket").join(sums, "bucket", "left")
    return out.select(
        "bucket", F.timestamp_micros(F.unix_micros(first) + F.col("bucket") * 3_600_000_000).alias("at"), F.coalesce("v", F.lit(0)).alias("value"),
        (F.coalesce("e", F.lit(False)) & (F.coalesce("v", F.lit(0)) > 0)).alias("estimated"),
    )


def levels(series: DataFrame, at: str = "date") -> DataFrame:
    """series with level 0 to 4: the quarter of the rank among values over 0, ties upwards."""
    # a series has a row for each bucket of a chart; its windows are small by nature
    some = series.where("value > 0").withColumn("level", F.ceil(F.cume_dist().over(Window.orderBy("value")) * 4).cast("int"))
    return some.unionByName(series.where("value <= 0 or value is null").withColumn("level", F.lit(0)))


def summary(series: DataFrame, at: str = "date") -> DataFrame:
    """One row: total, active buckets, longest streak, best bucket (earliest on ties)."""
    n = F.row_number().over(Window.orderBy(at))
    rows = series.withColumn("n", n)
    active = rows.where("value > 0").withColumn("island", F.col("n") - F.row_number().over(Window.orderBy("n")))
    streak = active.groupBy("island").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("streak"))
    best = active.orderBy(F.desc("value"), at).limit(1).select(F.col(at).alias("best"), F.col("value").alias("best_value"))
    totals = series.agg(F.sum("value").alias("total"), F.count(F.when(F.col("value") > 0, 1)).alias("active"))
    key = F.lit(1).alias("_one")
    out = totals.select("*", key).join(streak.select("*", key), "_one", "left").join(best.select("*", key), "_one", "left")
    return out.drop("_one")


def calendar_grid(series: DataFrame) -> DataFrame:
    """(date, week, weekday, label): weeks begin on Sunday; a month's first date carries its label."""
    # dates of one chart
    first = F.first("date").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sunday = F.date_sub(first, F.dayofweek(first) - 1)
    before = F.lag("date").over(Window.orderBy("date"))
    new = before.isNull() | (F.month(before) != F.month("date"))
    return series.select("date", F.floor(F.datediff("date", sunday) / 7).cast("int").alias("week"), (F.dayofweek("date") - 1).alias("weekday"), F.when(new, F.date_format("date", "MMM")).alias("label"))


def resolution(hours: float, dates: int, heatmap: bool = False) -> str:
    return "daily" if heatmap else "hourly" if hours < 30 else "daily" if dates <= 30 else "calendar"
