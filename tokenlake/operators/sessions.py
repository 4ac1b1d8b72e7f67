"""Session forests and exact-session preference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.storage import stored


def _marked(df: DataFrame, name: str, flag: str) -> tuple[DataFrame, int]:
    """df written and read again, and how many of its rows have the flag, counted while writing."""
    seen = Observation()
    out = stored(df.observe(seen, F.count_if(flag).alias("n")), name)
    return out, seen.get["n"]


def session_roots(usage: DataFrame, order: str = "ts") -> DataFrame:
    """(session_id, root_id): parent links followed to the top.

    The latest record of a session (by ``order``) gives its parent, which need
    not be a session itself. Each round doubles the links of distinct sessions
    twice, and is one write. Sessions that lead into a cycle never reach a top;
    they get the first session of the cycle on their way.
    """
    links = usage.groupBy("session_id").agg(F.max_by("parent_session_id", F.struct(order, "origin_key")).alias("up"))
    links = links.select("session_id", F.when(F.col("up") != F.col("session_id"), F.col("up")).alias("up"))
    links, left = _marked(links.withColumn("open", F.col("up").isNotNull()), "links", "open")
    links = links.drop("open")
    if not left:
        return links.select("session_id", F.col("session_id").alias("root_id"))
    above = links.where("up is not null").select(F.col("session_id").alias("_s"), F.lit(True).alias("_open"))
    jumps, rounds, before = links, 0, None
    while True:
        for _ in range(2):
            far = jumps.select(F.col("session_id").alias("_s"), F.col("up").alias("_u"))
            # a parent that is no session is a top; one without a parent is, too
            jumps = jumps.join(far, F.col("up") == F.col("_s"), "left").select("session_id", F.coalesce("_u", "up").alias("up"))
        marked = jumps.join(above, F.col("up") == F.col("_s"), "left").select("session_id", "up", F.coalesce("_open", F.lit(False)).alias("open"))
        rounds, before = rounds + 2, left
        marked, left = _marked(marked, "jumps", "open")
        jumps = marked.drop("open")
        if not left or (before == left and 2**rounds > left):  # a walk without a cycle has ended by now
            break
    tops = marked.where("not open").select("session_id", F.coalesce("up", "session_id").alias("root_id"))
    if not left:
        return tops
    return tops.unionByName(_into_cycles(links, marked.where("open")))


def _into_cycles(links: DataFrame, far: DataFrame) -> DataFrame:
    """Of sessions that all lead into cycles: the first one on a cycle; far: where they are after more steps than there are such sessions.

    By then every walk is on its cycle, so those ends are the sessions on cycles. They
    keep still while the links of the others double: log n rounds of rows of one size.
    """
    on = far.select(F.col("up").alias("_c")).distinct()
    of = links.join(far.select("session_id"), "session_id", "left_semi").join(on, F.col("session_id") == F.col("_c"), "left")
    steps = of.select("session_id", F.when(F.col("_c").isNotNull(), F.col("session_id")).otherwise(F.col("up")).alias("root_id"), F.col("_c").isNull().alias("going"))
    steps, left = _marked(steps, "cycles", "going")
    while left:
        there = steps.select(F.col("session_id").alias("_s"), F.col("root_id").alias("_to"), F.col("going").alias("_going"))
        # who arrives at one that keeps still keeps still
        steps = steps.join(there, F.col("root_id") == F.col("_s")).select("session_id", F.col("_to").alias("root_id"), "_going")
        steps, left = _marked(steps.withColumnRenamed("_going", "going"), "cycles", "going")
    return steps.select("session_id", "root_id")


def prefer_exact(usage: DataFrame, source: str = "copilot", mode: str = "session.shutdown") -> DataFrame:
    """Of a source's sessions with an exact record, only the exact records stay."""
    exact = usage.where((F.col("source") == source) & (F.col("mode") == mode)).select(F.col("session_id").alias("_s")).distinct()
    joined = usage.join(exact, (F.col("session_id") == F.col("_s")) & (F.col("source") == source), "left")
    return joined.where(F.col("_s").isNull() | F.coalesce(F.col("mode") == mode, F.lit(False))).drop("_s")
