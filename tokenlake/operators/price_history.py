"""Price history: change events, snapshots, route series and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROUTE = ["provider", "model"]
FIELDS = ("input", "output", "reasoning", "cache_read", "cache_write", "input_audio", "output_audio")


def price_changes(states: DataFrame, fields: list[str]) -> DataFrame:
    """Events from states (provider, model, commit_seq, ts, present, fields): a row each time a route's prices change.

    Upsert where any field differs from the route's state before, delete where
    it disappears; ``sequence`` is the place in order of commit, provider, model, op.
    """
    w = Window.partitionBy(*ROUTE).orderBy("commit_seq")
    now = F.when(F.col("present"), F.struct(*fields))
    rows = states.withColumns({"_now": now, "_was": F.lag(now).over(w)})
    changed = rows.where(~F.col("_now").eqNullSafe(F.col("_was"))).withColumn("op", F.when(F.col("present"), "upsert").otherwise("delete"))
    events = changed.select("op", "ts", "commit_seq", *ROUTE, *[F.when(F.col("present"), F.col(f)).alias(f) for f in fields])
    return numbered(events)


def numbered(events: DataFrame, after: int = 0) -> DataFrame:
    """``sequence`` from ``after`` + 1: places within commits plus the sizes of the commits before."""
    inside = F.row_number().over(Window.partitionBy("commit_seq").orderBy(*ROUTE, "op"))
    sizes = events.groupBy("commit_seq").agg(F.count("*").alias("_n"))
    # a row for each commit of a repository
    before = sizes.select(F.col("commit_seq").alias("_c"), (F.sum("_n").over(Window.orderBy("commit_seq")) - F.col("_n")).alias("_before"))
    return events.withColumn("_i", inside).join(before, F.col("commit_seq") == F.col("_c")).withColumn("sequence", F.col("_i") + F.col("_before") + after).drop("_i", "_before", "_c", "_n")


def price_changes_since(states: DataFrame, known: DataFrame, commit: int, fields: list[str]) -> DataFrame:
    """known events up to a commit, and the events after it, as price_changes() would give them.

    All events are made anew where known can't be continued: its sequence has
    gaps or repeats, or it or its commit is not of these states' commits.
    """
    commits = states.select("commit_seq").distinct()
    n, distinct, least, most, newest = known.agg(F.count("*"), F.countDistinct("sequence"), F.min("sequence"), F.max("sequence"), F.max("commit_seq")).first()
    sound = n == 0 or (n == distinct == most and least == 1 and newest <= commit)
    if not sound or not commits.where(F.col("commit_seq") == commit).count() or known.select("commit_seq").join(commits, "commit_seq", "left_anti").limit(1).count():
        return price_changes(states, fields).select(*[F.col(c).cast(known.schema[c].dataType) for c in known.columns])
    seed = latest_state(known, fields).select(*ROUTE, F.lit(commit).alias("commit_seq"), F.lit(None).cast("timestamp").alias("ts"), F.lit(True).alias("present"), *fields)
    later = states.where(F.col("commit_seq") > commit)
    w = Window.partitionBy(*ROUTE).orderBy("commit_seq")
    now = F.when(F.col("present"), F.struct(*fields))
    rows = seed.unionByName(later.select(*seed.columns)).withColumns({"_now": now, "_was": F.lag(now).over(w)})
    changed = rows.where((F.col("commit_seq") > commit) & ~F.col("_now").eqNullSafe(F.col("_was"))).withColumn("op", F.when(F.col("present"), "upsert").otherwise("delete"))
    last = known.agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]
    new = numbered(changed.select("op", "ts", "commit_seq", *ROUTE, *[F.when(F.col("present"), F.col(f)).alias(f) for f in fields]), last)
    return known.unionByName(new)


def latest_state(changes: DataFrame, fields: list[str]) -> DataFrame:
    """Active routes with their latest prices."""
    last = changes.groupBy(*ROUTE).agg(F.max_by(F.struct("op", "ts", *fields), F.col("sequence")).alias("x"))
    return last.where("x.op = 'upsert'").select(*ROUTE, "x.ts", *[f"x.{f}" for f in fields])


def _in_order(commits: DataFrame) -> DataFrame:
    """One row, true; reading it is an error where the UTC dates of (commit_seq, ts) decrease."""
    days = commits.groupBy("commit_seq").agg(F.to_date(F.min("ts")).alias("day"))
    # a row for each commit of a repository
    was = F.lag("day").over(Window.orderBy("commit_seq"))
    fall = days.select(F.when(F.col("day") < was, F.concat(was.cast("string"), F.lit(" to "), F.col("day").cast("string"))).alias("fall")).agg(F.min("fall").alias("fall"))
    message = F.concat(F.lit("commit dates decrease from "), F.col("fall"), F.lit("; no daily snapshots"))
    return fall.select(F.when(F.col("fall").isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")).alias("ok"))


def daily_snapshots(changes: DataFrame, fields: list[str], until: str, commits: DataFrame | None = None) -> DataFrame:
    """State at the end of each UTC day, from the first day with a price to the day before ``until``.

    Commits whose dates decrease are an error, raised when the snapshots are read. commits: all of a
    repository's (commit_seq, ts), else those of the changes are looked at.
    """
    end = F.date_sub(F.lit(until).cast("date"), 1)
    order = _in_order(commits if commits is not None else changes.select("commit_seq", "ts"))
    day_last = changes.where(order.scalar()).withColumn("date", F.to_date("ts")).groupBy(*ROUTE, "date").agg(F.max_by(F.struct("op", *fields), F.col("sequence")).alias("x"))
    nxt = F.lead("date").over(Window.partitionBy(*ROUTE).orderBy("date"))
    spans = day_last.withColumn("to", F.least(F.coalesce(F.date_sub(nxt, 1), end), end)).where("x.op = 'upsert' and date <= to")
    return spans.select(F.explode(F.sequence("date", "to")).alias("date"), *ROUTE, *[f"x.{f}" for f in fields])


def route_catalog(changes: DataFrame, fields: list[str]) -> DataFrame:
    ever = [F.bool_or(F.col(f).isNotNull()).alias(f"has_{f}") for f in fields]
    return changes.groupBy(*ROUTE).agg(F.count("*").alias("events"), (F.max_by("op", "sequence") != "delete").alias("active"), F.max("ts").alias("updated"), *ever)


def recent_routes(catalog: DataFrame, n: int = 5, only_changed: bool = False, contains: str = "") -> DataFrame:
    rows = catalog.where(F.col("events") > 1) if only_changed else catalog
    rows = rows.where(F.contains(F.lower("model"), F.lit(contains.lower()))) if contains else rows
    w = Window.partitionBy("provider").orderBy(F.desc("active"), F.desc("updated"), "model")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def route_series(changes: DataFrame, fields: list[str]) -> DataFrame:
    """For each event and field that it changes: previous and new value, and a strictly rising plot time (ms)."""
    w = Window.partitionBy(*ROUTE).orderBy("ts", "sequence")
    n = F.row_number().over(w)
    rows = changes.withColumn("_n", n).withColumn("plot_ts", F.col("_n") + F.max(F.unix_millis("ts") - F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    value = lambda f: F.when(F.col("op") != "delete", F.col(f))
    long = rows.select(*ROUTE, "ts", "sequence", "op", "plot_ts", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), value(f).alias("new")) for f in fields])).alias("x")).select("*", "x.field", "x.new").drop("x")
    w = Window.partitionBy(*ROUTE, "field").orderBy("ts", "sequence")
    long = long.withColumn("previous", F.lag("new").over(w))
    return long.where(~F.col("new").eqNullSafe(F.col("previous"))).select(*ROUTE, "field", "ts", "sequence", "plot_ts", "previous", "new")


def markers(series: DataFrame) -> DataFrame:
    """start, change or remove, and the value to show."""
    kind = F.when(F.col("previous").isNull(), "start").when(F.col("new").isNull(), "remove").otherwise("change")
    return series.select(*ROUTE, "field", "plot_ts", kind.alias("marker"), F.coalesce("new", "previous", F.lit(0)).alias("shown"))


def aligned(series: DataFrame, as_of: int) -> DataFrame:
    """All routes of a field carried forward onto the union of the field's change times, a tick before each removal, and the end."""
    times = series.select("field", "plot_ts").union(series.where(F.col("new").isNull()).select("field", F.col("plot_ts") - 1)).where(F.col("plot_ts") <= as_of)
    times = times.union(series.select("field", F.lit(as_of).cast("long"))).distinct()
    # the result is a chart: each of a field's routes at each of its times
    grid = series.select(*ROUTE, "field").distinct().join(times, "field").select(*ROUTE, "field", "plot_ts")
    both = grid.withColumn("_x", F.lit(None).cast(f"struct<v:{series.schema['new'].dataType.simpleString()}>")).unionByName(series.select(*ROUTE, "field", "plot_ts", F.struct(F.col("new").alias("v")).alias("_x")))
    w = Window.partitionBy(*ROUTE, "field").orderBy("plot_ts").rangeBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_l", F.last("_x", ignorenulls=True).over(w)).where(F.col("_x").isNull())
    return out.select(*ROUTE, "field", "plot_ts", F.col("_l.v").alias("value"))
