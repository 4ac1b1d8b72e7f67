"""The usage report: keys, filters, sums, sessions, units, totals, averages, order."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bounds
from ..functions.scalars import date_bucket, display_input, display_output, glob_regex, project_of, short_session

DIMENSIONS = ("source", "model", "provider", "project", "date", "session")
ALIASES = {"tool": "source", "cwd": "project", "day": "date"}
SUMS = ("input", "output", "input_bytes", "output_bytes", "reasoning", "cache_read", "cache_write", "total", "calls", "rounds")
FLAGS = ("input_estimated", "output_estimated", "input_bytes_estimated", "output_bytes_estimated")
COSTS = ("prompt_cost", "completion_cost", "reasoning_cost", "cache_read_cost", "cache_write_cost")


def dimensions(names: list[str]) -> list[str]:
    """Known dimensions in order, aliases replaced; none: source and model."""
    out = [ALIASES.get(n, n) for n in names]
    return [n for n in dict.fromkeys(out) if n in DIMENSIONS] or ["source", "model"]


def key_column(dim: str, bucket: str = "day", full_session_id: bool = False) -> Column:
    """Of usage with ``canonical``."""
    return {
        "source": F.col("source"),
        "model": F.col("canonical"),
        "provider": F.coalesce("provider", F.lit("-")),
        "project": project_of(F.col("project_name"), F.col("project_cwd")),
        "date": date_bucket(F.col("ts"), bucket),
        "session": F.col("session_id") if full_session_id else short_session(F.col("session_id")),
    }[dim]


def with_display(usage: DataFrame) -> DataFrame:
    return usage.withColumns({"input": display_input(), "output": display_output(), "total": display_input() + display_output()})


def filter_time(usage: DataFrame, since: str | None = None, until: str | None = None, period: str | None = None, now: datetime | None = None, tz: str = "UTC") -> DataFrame:
    """Rows between two bounds, as bounds.when() and until() read them; ``since`` outranks a period."""
    now = now or datetime.now(timezone.utc)
    first = bounds.when(since, now, tz) if since else bounds.period(period, now, tz) if period else None
    if first:
        usage = usage.where(F.col("ts") >= F.lit(first))
    if not until:
        return usage
    last, within = bounds.until(until, now, tz)
    return usage.where(F.col("ts") <= F.lit(last) if within else F.col("ts") < F.lit(last))


def period_start(period: str, now: Column, tz: str = "UTC") -> Column:
    """When a period that ends now begins: today, week (from Monday), month, or a number with s, m, h, d, w, mo (30 days) or y (365)."""
    local = F.from_utc_timestamp(now, tz)
    if period in ("today", "week", "month"):
        return F.to_utc_timestamp(F.date_trunc({"today": "day"}.get(period, period), local), tz)
    unit = period.lstrip("0123456789")
    seconds = int(period[: len(period) - len(unit)]) * {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 7 * 86400, "mo": 30 * 86400, "y": 365 * 86400}[unit]
    return now - F.make_dt_interval(secs=F.lit(seconds))


def filter_period(usage: DataFrame, period: str, now: str, tz: str = "UTC") -> DataFrame:
    """Rows of a period up to now; here 1m is a month of 30 days."""
    n = period.removesuffix("m")
    start = period_start(f"{n}mo" if n != period and n.isdigit() else period, F.lit(now).cast("timestamp"), tz)
    return usage.where((F.col("ts") >= start) & (F.col("ts") <= F.lit(now).cast("timestamp")))


def filter_glob(usage: DataFrame, column: str, glob: str) -> DataFrame:
    return usage.where(F.coalesce(F.regexp_like(F.col(column), F.lit(glob_regex(glob))), F.lit(False)))


def filter_model(usage: DataFrame, glob: str) -> DataFrame:
    """The raw or the canonical name matches."""
    fits = lambda c: F.coalesce(F.regexp_like(F.col(c), F.lit(glob_regex(glob))), F.lit(False))
    return usage.where(fits("model") | fits("canonical"))


def report(usage: DataFrame, roots: DataFrame, dims: list[str], bucket: str = "day", full_session_id: bool = False) -> DataFrame:
    """Sums, flags, times, costs and distinct sessions by any dimensions.

    usage has ``canonical`` (and the cost parts, null where there is no price);
    roots come from all records, before any filter.
    """
    dims = dimensions(dims)
    keys = [f"_{d}" for d in dims]
    r = roots.select(F.col("session_id").alias("_s"), "root_id")
    keyed = with_display(usage).select("*", *[key_column(d, bucket, full_session_id).alias(f"_{d}") for d in dims])
    costs = [c for c in COSTS if c in usage.columns]
    sums = [F.sum(c).alias(c) for c in (*SUMS, *costs, "cost_embedded", "sub_agent_sessions")]
    more = [*[F.bool_or(c).alias(c) for c in FLAGS], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")]
    # by session, then by root, then by group: every step only adds up the one before, and distinct ones are counted as rows
    sub = F.max((F.col("session_kind") == "sub_agent").cast("long")).alias("sub_agent_sessions")
    one = keyed.withColumns({"first_ts": F.col("ts"), "last_ts": F.col("ts")}).groupBy(*keys, "session_id").agg(*sums[:-1], *more, sub)
    by_root = one.join(r, F.col("session_id") == F.col("_s"), "left").groupBy(*keys, "root_id").agg(*sums, *more)
    out = by_root.groupBy(*keys).agg(*sums, *more, F.count("root_id").alias("root_sessions"))
    return out.withColumns({
        **{c: F.coalesce(c, F.lit(0)) for c in costs}, "cost_embedded": F.coalesce("cost_embedded", F.lit(0.0)), "sub_agent_sessions": F.coalesce("sub_agent_sessions", F.lit(0).cast("long")),
    }).withColumn("sessions", F.col("root_sessions") + F.col("sub_agent_sessions")).withColumnsRenamed({f"_{d}": f"key_{d}" for d in dims})


def added(*costs: str) -> Column:
    """The exact sum of at most five cost parts: sums of decimal(38,15) would give up a digit of scale each, these stay at 15."""
    first, *rest = (F.col(c).cast("decimal(34,15)") for c in costs)
    return sum(rest, first).cast("decimal(38,15)")


def with_cost(agg: DataFrame) -> DataFrame:
    return agg.withColumn("cost", added(*COSTS))


def project_unit(agg: DataFrame, unit: str = "tokens", split_input: bool = False) -> DataFrame:
    """The six measures in tokens, bytes (input and output only) or cost."""
    if unit == "cost":
        out = with_cost(agg).withColumns({
            "input": F.col("prompt_cost") if split_input else added("prompt_cost", "cache_read_cost", "cache_write_cost"),
            "output": added("completion_cost", "reasoning_cost"), "reasoning": F.col("reasoning_cost"),
            "cache_read": F.col("cache_read_cost"), "cache_write": F.col("cache_write_cost"), "total": F.col("cost"),
        })
        return out
    if unit == "bytes":
        return agg.withColumns({"input": F.col("input_bytes"), "output": F.col("output_bytes")})
    if split_input:
        return agg.withColumn("input", F.greatest(F.col("input") - F.col("cache_read") - F.col("cache_write"), F.lit(0)))
    return agg


def sort_report(agg: DataFrame, key: str = "total", descending: bool = True) -> DataFrame:
    """By a measure, the date or the calls; ties in order of the keys, whichever the direction."""
    column = {"date": "last_ts", "time": "last_ts"}.get(key, key if key in ("total", "input", "output", "cost", "calls") else "total")
    keys = [F.col(c).asc() for c in agg.columns if c.startswith("key_")]
    return agg.orderBy(F.col(column).desc() if descending else F.col(column).asc(), *keys)


def with_total(rows: DataFrame) -> DataFrame:
    """The rows and, if they are more than one, a TOTAL row; sessions add up."""
    keys = [c for c in rows.columns if c.startswith("key_")]
    sums = [c for c in rows.columns if c in SUMS + COSTS + ("cost", "cost_embedded", "sessions", "root_sessions", "sub_agent_sessions")]
    flags = [c for c in rows.columns if c in FLAGS]
    total = rows.agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in sums], *[F.bool_or(c).alias(c) for c in flags]).where("_n > 1").drop("_n")
    for i, k in enumerate(keys):
        total = total.withColumn(k, F.lit("TOTAL" if i == 0 else ""))
    return rows.unionByName(total, allowMissingColumns=True)


def averages(agg: DataFrame, by: str) -> DataFrame:
    """Measures per call, round or session; a denominator of at most 1 divides nothing."""
    den = F.col({"call": "calls", "round": "rounds", "session": "sessions"}[by])
    return agg.withColumns({f"avg_{c}": F.when(den > 1, F.col(c) / den).otherwise(F.col(c).cast("double")) for c in ("input", "output", "reasoning", "cache_read", "cache_write", "total")})


def cost_split(priced: DataFrame, dims: list[str], by: str, bucket: str = "day") -> DataFrame:
    """Cost of each group split by a second dimension, in rows; cost_per_map() folds them."""
    dims = dimensions(dims)
    rows = priced.where(F.col(COSTS[0]).isNotNull()).select(*[key_column(d, bucket).alias(f"key_{d}") for d in dims], key_column(by, bucket).alias("split"), added(*COSTS).alias("cost"))
    return rows.groupBy(*[f"key_{d}" for d in dims], "split").agg(F.sum("cost").alias("cost"))


def cost_per_map(split: DataFrame) -> DataFrame:
    keys = [c for c in split.columns if c.startswith("key_")]
    return split.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", "cost")))).alias("cost_per"))


def cost_per_columns(split: DataFrame, n: int = 3) -> DataFrame:
    """The n dearest split values (cost descending, name ascending) as columns; missing is 0."""
    keys = [c for c in split.columns if c.startswith("key_")]
    top = [r["split"] for r in split.groupBy("split").agg(F.sum("cost").alias("c")).orderBy(F.desc("c"), "split").limit(n).collect()]
    return split.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("split") == t, F.col("cost"))), F.lit(0)).alias(f"cost_{i + 1}") for i, t in enumerate(top)])


def summarise(usage: DataFrame, by: str) -> DataFrame:
    return with_display(usage).groupBy(by).agg(
        F.count("*").alias("records"), F.sum("total").alias("total"), F.sum("calls").alias("calls"), F.sum("rounds").alias("rounds"),
        F.bool_or(F.col("input_estimated") | F.col("output_estimated")).alias("estimated"),
    )


def select_sources(usage: DataFrame, sources: list[str]) -> DataFrame:
    return usage.where(F.col("source").isin(*dict.fromkeys(sources)))
