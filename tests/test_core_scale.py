"""Operators on inputs that grow in one key: long chains into cycles, many events in one month."""

import time

from pyspark.sql import functions as F

from tokenlake.operators import pricing, sessions


def test_chain_into_a_cycle(spark, monkeypatch):
    """Rounds grow with the logarithm of a chain's length, and rows stay of one size."""
    n, written = 3000, []
    keep = sessions.stored
    monkeypatch.setattr(sessions, "stored", lambda df, name: written.append(df.columns) or keep(df, name))
    rows = spark.range(n).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("session_id"), F.concat(F.lit("s"), F.when(F.col("id") == n - 1, n - 10).otherwise(F.col("id") + 1).cast("string")).alias("parent_session_id"), F.lit(1).alias("ts"), F.col("id").cast("string").alias("origin_key"))
    got = {r["session_id"]: r["root_id"] for r in sessions.session_roots(rows).collect()}
    assert len(got) == n
    assert all(got[f"s{i}"] == f"s{max(i, n - 10)}" for i in range(n))
    assert len(written) <= 2 * 12 and all(set(c) <= {"session_id", "up", "open", "root_id", "going"} for c in written)


def test_without_parents(spark):
    df = spark.createDataFrame([("a", None, 1, "k"), ("b", "b", 1, "l")], "session_id string, parent_session_id string, ts int, origin_key string")
    assert sorted(map(tuple, sessions.session_roots(df).collect())) == [("a", "a"), ("b", "b")]


def test_many_events_in_a_month(spark):
    """A month of 100,000 events is searched by halving in spans."""
    n, at = 100_000, F.lit("2024-03-01").cast("timestamp")
    second = lambda c: F.timestamp_seconds(F.unix_timestamp(at) + c)
    ev = spark.range(n).select(F.lit("r").alias("k"), second(F.col("id") * 20 + 10).alias("ts"), F.col("id").alias("sequence"), F.col("id").cast("double").alias("price"))
    use = spark.range(20_000).select(F.lit("r").alias("k"), F.col("id").alias("n"), second(F.col("id") * 101).alias("ts"))
    began = time.time()
    got = {r["n"]: r["price"] for r in pricing.asof(use, ev, ["k"], "price", ["sequence"]).select("n", "price").collect()}
    took = time.time() - began
    for i in range(20_000):
        assert got[i] == max(0.0, float(min(n - 1, (i * 101 - 10) // 20)))
    few = ev.where("sequence % 1000 = 0")
    began = time.time()
    pricing.asof(use, few, ["k"], "price", ["sequence"]).select("n", "price").collect()
    assert took < 10 * (time.time() - began) + 10


def test_halving(spark):
    rows = [(i, list(range(0, 2 * n, 2)), t) for i, (n, t) in enumerate((n, t) for n in range(7) for t in range(-1, 15))] + [(-1, None, 3)]
    got = spark.createDataFrame(rows, "i int, a array<int>, t int").select("*", pricing._upto(F.col("a"), F.col("t")).alias("n")).collect()
    for r in got:
        assert r["n"] == (None if r["a"] is None else sum(x <= r["t"] for x in r["a"]))
