"""Prices as of a record's time, route fallbacks, provider policy and cost modes.

Which route prices a record does not depend on time (a route with any event
always has a price), so routes are chosen for each distinct (provider, model);
only the event is looked up by time. Events are the small side: they are
gathered by route and month, each month with the price that holds at its start,
and records meet them in equal joins on route and month. A month with many
events is cut into spans of as many events as there are spans; a record finds its span, and in it its
event, by halving, so it meets the square root of a month's events. No window
holds records, so a route with a third of them is a hot join key, which Spark
broadcasts past or splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import stored
from .report import COSTS

RATES = ("input", "output", "reasoning", "cache_read", "cache_write")


#: Events of a route's month that stay in one array; of more, each span holds the square root of their number.
SPAN = 256


def _upto(sorted_: Column, ts: Column) -> Column:
    """How many times of a sorted array are at or before ts, by halving; null without an array."""
    n = F.size(sorted_)
    start = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        late = F.get(sorted_, mid) > ts
        closed = s["lo"] >= s["hi"]
        return F.struct(F.when(closed | late, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(~closed & late, mid).otherwise(s["hi"]).alias("hi"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(n + F.lit(1))).cast("int"))
    return F.when(sorted_.isNotNull(), F.aggregate(rounds, start, halve, lambda s: s["lo"]))


class PriceIndex:
    """Events for lookups, by route (_k0, ...), month and span; one small table, written.

    spans: sorted times and values; ends: the first value of a route, the last one and its
    month; months: for each month up to the next with events, the value that holds at its start and its
    own events, or where they are in several spans, the times at which these start.
    """

    def __init__(self, events: DataFrame, keys: list[str], value: str, order: list[str], ts: str = "ts"):
        ks = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
        kn = [f"_k{i}" for i in range(len(keys))]
        at = F.struct(F.col(ts).alias("t"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
        ev = events.where(F.col(ts).isNotNull()).select(*ks, F.date_trunc("month", ts).alias("_month"), at.alias("at"), F.struct(F.col(value).alias("v")).alias("_v"))
        # of events of one time the last one counts
        ev = ev.groupBy(*kn, "_month", F.col("at.t").alias("t")).agg(F.max_by("_v", "at").alias("_v"), F.min_by("_v", "at").alias("_v0"))
        w = Window.partitionBy(*kn, "_month")
        size = F.greatest(F.lit(SPAN), F.ceil(F.sqrt(F.count("*").over(w))))
        ev = ev.withColumn("_span", F.floor((F.row_number().over(w.orderBy("t")) - 1) / size).cast("int"))
        spans = ev.groupBy(*kn, "_month", "_span").agg(F.sort_array(F.collect_list(F.struct("t", "_v"))).alias("_e"), F.min_by("_v0", "t").alias("_v0"))
        spans = spans.select(*kn, "_month", "_span", F.transform("_e", lambda x: x["t"]).alias("_times"), F.transform("_e", lambda x: x["_v"]).alias("_values"), "_v0")
        seen = Observation()
        self.keys, self.spans = kn, stored(spans.observe(seen, F.count_if(F.col("_span") > 0).alias("n")), "prices")
        self.cut = seen.get["n"] > 0
        held = self.spans.groupBy(*kn, "_month").agg(
            F.sort_array(F.collect_list(F.get("_times", F.lit(0)))).alias("_starts"), F.min_by("_v0", "_span").alias("_v0"), F.max_by(F.element_at("_values", -1), "_span").alias("_end_v"),
            F.first("_times").alias("_times"), F.first("_values").alias("_values"),
        )
        w = Window.partitionBy(*kn).orderBy("_month")
        held = held.withColumns({"_carry": F.lag("_end_v").over(w), "_next": F.lead("_month").over(w)})
        # every month up to the next one with events; the last month's price holds for good
        until = F.coalesce(F.add_months("_next", -1).cast("timestamp"), F.col("_from"))
        each = held.withColumnRenamed("_month", "_from").withColumn("_month", F.explode(F.sequence("_from", until, F.expr("interval 1 month"))))
        own = F.col("_month") == F.col("_from")
        one = F.size("_starts") == 1
        self.months = each.select(
            *kn, "_month", F.when(own, F.col("_carry")).otherwise(F.col("_end_v")).alias("_carry"), F.when(own & ~one, F.col("_starts")).alias("_starts"),
            F.when(own & one, F.col("_times")).alias("_times"), F.when(own & one, F.col("_values")).alias("_values"),
        )
        self.ends = held.groupBy(*kn).agg(F.min_by("_v0", "_month").alias("_first"), F.max("_month").alias("_end"), F.max_by("_end_v", "_month").alias("_last"))

    def look_up(self, rows: DataFrame, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
        """rows with ``value`` as of their time."""
        on = [F.col(k) == F.col(n) for k, n in zip(keys, self.keys)]
        month = F.date_trunc("month", ts)
        out = rows.join(self.ends, on, "left").drop(*self.keys)
        out = out.join(self.months, [*on, month == F.col("_month")], "left").drop(*self.keys, "_month")
        in_month = F.get("_values", _upto(F.col("_times"), F.col(ts)) - 1)
        if self.cut:
            out = out.withColumns({"_at": _upto(F.col("_starts"), F.col(ts)) - 1, "_one": in_month}).drop("_starts", "_times", "_values")
            spans = self.spans.select(*self.keys, "_month", "_span", "_times", "_values")
            out = out.join(spans, [*on, month == F.col("_month"), F.col("_at") == F.col("_span")], "left").drop(*self.keys, "_month", "_span", "_at")
            in_month = F.coalesce(F.col("_one"), in_month)
        found = F.coalesce(in_month, "_carry", F.when(month > F.col("_end"), F.col("_last")), F.col("_first"))
        return out.withColumn(value, found["v"]).drop("_first", "_end", "_last", "_carry", "_starts", "_times", "_values", "_one")


def asof(rows: DataFrame, events: DataFrame, keys: list[str], value: str, order: list[str], ts: str = "ts") -> DataFrame:
    """rows with ``value`` of the latest event of the same keys at or before their time.

    Before the first event the first event holds; without events, and with a
    null key, it is null. Events of one time follow ``order``. ``value`` may be
    a struct, whose null fields are kept.
    """
    return PriceIndex(events, keys, value, order, ts).look_up(rows, keys, value, ts)


def choose_routes(pairs: DataFrame, events: DataFrame, families: DataFrame, official: DataFrame) -> DataFrame:
    """For each (provider, model, canonical): the provider's route and the official one.

    Order: (provider, model), (provider, canonical), the provider's first
    family route of the canonical name, then the official provider's
    (canonical, then family route).
    families: (provider, canonical_name, model, position); official: (canonical, official).
    """
    known = events.select("provider", "model").distinct()

    def exists(df: DataFrame, provider: Column, model: Column, name: str) -> DataFrame:
        k = known.select(F.col("provider").alias("_p"), F.col("model").alias("_m"))
        hit = F.when(F.col("_p").isNotNull(), F.struct(F.col("_p").alias("provider"), F.col("_m").alias("model")))
        return df.join(k, (provider == F.col("_p")) & (model == F.col("_m")), "left").withColumn(name, hit).drop("_p", "_m")

    family = families.join(known, ["provider", "model"], "left_semi").groupBy("provider", "canonical_name").agg(F.min_by("model", "position").alias("fm"))
    norm = lambda c: F.lower(F.trim(F.col(c)))
    df = pairs.join(official.select(F.col("canonical").alias("_c"), "official"), F.col("canonical") == F.col("_c"), "left").drop("_c")
    df = exists(df, norm("provider"), norm("model"), "r1")
    df = exists(df, norm("provider"), F.col("canonical"), "r2")
    f1 = family.select(F.col("provider").alias("_p"), F.col("canonical_name").alias("_c"), F.struct("provider", F.col("fm").alias("model")).alias("r3"))
    df = df.join(f1, (norm("provider") == F.col("_p")) & (F.col("canonical") == F.col("_c")), "left").drop("_p", "_c")
    df = exists(df, norm("official"), F.col("canonical"), "o1")
    f2 = family.select(F.col("provider").alias("_p"), F.col("canonical_name").alias("_c"), F.struct("provider", F.col("fm").alias("model")).alias("o2"))
    df = df.join(f2, (norm("official") == F.col("_p")) & (F.col("canonical") == F.col("_c")), "left").drop("_p", "_c")
    own = F.when(F.col("model").isNotNull(), F.coalesce("o1", "o2"))
    return df.select("provider", "model", "canonical", F.coalesce("r1", "r2", "r3", "o1", "o2").alias("route"), own.alias("official_route"))


def _static_prices(routes: DataFrame, official: DataFrame, static: DataFrame | None, kind) -> DataFrame:
    """routes with ``static_price`` and ``static_official``, null where static has none."""
    if static is None:
        return routes.withColumns({"static_price": F.lit(None).cast(kind), "static_official": F.lit(None).cast(kind)})
    norm = lambda c: F.lower(F.trim(F.col(c)))
    # as in the history, no price of a record without a model
    df = routes.join(official.select(F.col("canonical").alias("_c"), norm("official").alias("_o")), F.col("canonical") == F.col("_c"), "left").drop("_c")
    for provider, name in ((norm("provider"), "_own"), (F.col("_o"), "static_official")):
        p = static.select(norm("provider").alias("_p"), norm("model").alias("_m"), F.struct(*RATES).cast(kind).alias(name))
        df = df.join(p, F.col("model").isNotNull() & (provider == F.col("_p")) & (F.col("canonical") == F.col("_m")), "left").drop("_p", "_m")
    return df.withColumn("static_price", F.coalesce("_own", "static_official")).drop("_own", "_o")


def price_usage(usage: DataFrame, events: DataFrame, families: DataFrame, official: DataFrame, static: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """usage with ``provider_price`` and ``official_price``, structs of RATES.

    static: prices without a time (provider, model, RATES), for pairs without a
    route in the history: of (provider, canonical), else of (official, canonical).
    pairs: the distinct (provider, model) with canonical, where usage has none yet.
    """
    upserts = events.where(F.col("op") == "upsert").withColumn("price", F.struct(*RATES))
    named = pairs is not None
    pairs = pairs if named else usage.select("provider", "model", "canonical").distinct()
    routes = choose_routes(pairs, upserts, families, official)
    routes = _static_prices(routes, official, static, upserts.select("price").schema["price"].dataType)
    both = [F.col(f"{r}.{c}").alias(f"_{r}_{c}") for r in ("route", "official_route") for c in ("provider", "model")]
    more = ["canonical"] if named else []
    routes = routes.select(F.col("provider").alias("_p"), F.col("model").alias("_m"), *more, *both, "static_price", "static_official")
    rows = usage.join(routes, F.col("provider").eqNullSafe(F.col("_p")) & F.col("model").eqNullSafe(F.col("_m")), "left").drop("_p", "_m")
    index = PriceIndex(upserts, ["provider", "model"], "price", ["sequence"])
    for route, price, fixed in (("route", "provider_price", "static_price"), ("official_route", "official_price", "static_official")):
        keys = [f"_{route}_provider", f"_{route}_model"]
        rows = index.look_up(rows, keys, price).withColumn(price, F.when(F.col(keys[0]).isNull(), F.col(fixed)).otherwise(F.col(price))).drop(*keys, fixed)
    return rows


def policy(usage: DataFrame, policies: DataFrame) -> DataFrame:
    """usage with ``multiplier`` and ``included``: of the provider's model, else the provider's, else 1 and false.

    policies: (provider, model or null, multiplier or null, included or null).
    """
    p = policies.select(F.col("provider").alias("_p"), F.col("model").alias("_m"), F.col("multiplier").alias("_x"), F.col("included").alias("_i"))
    whole = p.where(F.col("_m").isNull()).select("_p", F.col("_x").alias("_x0"), F.col("_i").alias("_i0"))
    norm = F.lower(F.trim("provider"))
    out = usage.join(whole, norm == F.col("_p"), "left").drop("_p")
    out = out.join(p.where(F.col("_m").isNotNull()), (norm == F.col("_p")) & (F.col("canonical") == F.col("_m")), "left").drop("_p", "_m")
    return out.withColumns({
        "multiplier": F.coalesce("_x", "_x0", F.lit(1).cast("decimal(6,3)")), "included": F.coalesce("_i", "_i0", F.lit(False)),
    }).drop("_x", "_i", "_x0", "_i0")


def cost_parts(price: str, multiplier: Column | None = None) -> list[Column]:
    """Five parts, exact decimals: tokens times rate per million; reasoning defaults to output, cache_write to input."""
    p = F.col(price)
    rate = {"prompt": p["input"], "completion": p["output"], "reasoning": F.coalesce(p["reasoning"], p["output"]), "cache_read": p["cache_read"], "cache_write": F.coalesce(p["cache_write"], p["input"])}
    # exact: 12 digits of tokens, rates of 6 + 6, multipliers of 3 + 3 digits fit a decimal(38,15)
    each = lambda r: (r.cast("decimal(12,6)") * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(18,12)")
    out = []
    for part, r in rate.items():
        v = F.col(part).cast("decimal(12,0)") * each(r)
        v = v if multiplier is None else v * multiplier.cast("decimal(6,3)")
        out.append(v.cast("decimal(38,15)").alias(f"{part}_cost"))
    return out


def cost(usage: DataFrame, mode: str = "actual") -> DataFrame:
    """usage with COSTS under a mode; null where nothing prices the record.

    actual: 0 where included, else provider price times multiplier; mixed:
    official price where included, else provider price; official: official price.
    Included also holds where all rates of the provider's price are 0.
    """
    p = F.col("provider_price")
    zero = F.coalesce((p["input"] == 0) & (p["output"] == 0) & (F.coalesce(p["reasoning"], F.lit(0)) == 0) & (p["cache_read"] == 0) & (F.coalesce(p["cache_write"], F.lit(0)) == 0), F.lit(False))
    free = F.col("included") | zero
    own, official = cost_parts("provider_price"), cost_parts("official_price")
    scaled = cost_parts("provider_price", F.col("multiplier"))
    cols = {}
    for i, name in enumerate(COSTS):
        if mode == "actual":
            cols[name] = F.when(free, F.lit(0).cast("decimal(38,15)")).otherwise(scaled[i])
        else:
            cols[name] = official[i] if mode == "official" else F.when(free, official[i]).otherwise(own[i])
    return usage.withColumns(cols)
