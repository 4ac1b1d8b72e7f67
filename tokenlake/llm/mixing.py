"""Mixing sources to target weights by capped water-filling.

Targets: the sources share a total by weight; a source whose share is over
``max_epochs`` times its size is clamped there, and the excess goes to the
others by weight, again and again until none is over. Sources stay a
distributed table; each round brings one row of sums to the driver.

Sampling: a source is taken ``target / size`` times. All its documents are
taken the whole number of times; for the fraction, documents are ordered by a
seeded hash of id and text, and those below the source's threshold hash are
taken once more. The threshold is found by refining 12 bits of the hash at a
time from sums by (source, bucket), so no source is sorted or gathered. The
documents that share the threshold hash itself (as a rule one) take the part
that is still missing, which makes every source end within a word a document
of its target. Reruns agree, as only content and seed decide.

Edge cases: a null or empty text has size 0 and takes 0; a null source is a
source, the last in order; a source of size 0 has target 0; repeated rows
are separate documents that share a hash, and so are treated alike; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Scratch, numbered

#: Up to this many sources their table is broadcast; beyond, it is joined.
BROADCAST_SOURCES = 20_000
BITS, ROUNDS = 12, 5


def sizes(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weights(by_source: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Sources in code point order, null last, weigh as the tuple says, repeating."""
    order = [F.col("source").asc_nulls_last()]
    picked = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    return numbered(by_source, order, scratch, "sources").withColumn("weight", picked.cast("double")).drop("rank")


def water_fill(by_source: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """(source, source_size, weight) with ``target``; each round clamps at least one source or ends."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = 0.0  # words for each unit of weight; it only grows
    while True:
        over = cap <= F.col("weight") * F.lit(level) if level else F.lit(False)
        row = by_source.agg(
            F.sum(F.when(over, cap).otherwise(0.0)).alias("clamped"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight")
        ).first()
        if not row["weight"]:
            break
        rise = (total - row["clamped"]) / row["weight"]
        if rise <= level * (1 + 1e-15):
            break
        level = rise
    return by_source.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def thresholds(docs: DataFrame, targets: DataFrame, small: bool) -> DataFrame:
    """For each source: whole, the threshold hash, and what share of their words those at it take."""
    goal = targets.where(F.col("source_size") > 0).select(
        "source",
        F.floor(F.col("target") / F.col("source_size")).alias("whole"),
        (F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).alias("left"),
    ).withColumn("prefix", F.lit(0).cast("long"))
    for k in range(1, ROUNDS + 1):
        bits = BITS * k
        here = F.shiftrightunsigned(F.col("h"), 60 - bits)
        in_bucket = _joined(docs, goal, small).where(F.shiftrightunsigned(F.col("h"), 60 - bits + BITS) == F.col("prefix"))
        sums = in_bucket.groupBy("source", "whole", "left", here.alias("bucket")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))  # at most 2^12 rows a source
        goal = (
            sums.withColumn("to", run)
            .where(F.col("to") > F.col("left"))
            .groupBy("source")
            .agg(F.min_by(F.struct("whole", "left", "bucket", "words", "to"), F.col("bucket")).alias("x"))
            .select("source", "x.whole", (F.col("x.left") - (F.col("x.to") - F.col("x.words"))).alias("left"), F.col("x.bucket").alias("prefix"), "x.words")
        )
    return goal.select("source", F.col("prefix").alias("threshold"), (F.col("left") / F.col("words")).alias("part"))


def _joined(docs: DataFrame, by_source: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    right = by_source.withColumnRenamed("source", "_source")
    right = F.broadcast(right) if small else right
    return docs.join(right, docs["source"].eqNullSafe(right["_source"]), how).drop("_source")


def _hash(seed: int) -> Column:
    none = F.lit("")
    content = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), none), F.lit("|"), F.coalesce("text", none))
    return F.conv(F.substring(F.md5(content), 1, 15), 16, 10).cast("long")  # 60 bits


def mix(docs: DataFrame, scratch: Scratch, *, keep: list[str], text: bool = False, weights: tuple[int, ...] = (1, 2, 3), max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """Columns row (struct of the kept ones), text on demand, size, source_size, target, taken.

    docs has doc_id, text, source. ``taken`` is the number of words of the
    document in the mix, all repetitions counted.
    """
    row = F.struct(*[docs[c] for c in keep]).alias("row")
    df = docs.select(row, docs["source"], docs["doc_id"], docs["text"].cast("string").alias("text")).withColumns({"size": sizes(docs), "h": _hash(seed)})
    sized = scratch.write(df.drop("text"), "sizes")
    by_source = scratch.write(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "by-source")
    weighed = scratch.write(cycle_weights(by_source, scratch, weights), "weights")
    n, total = weighed.agg(F.count("*"), F.sum("source_size")).first()
    small = n <= BROADCAST_SOURCES
    targets = water_fill(weighed, float(total or 0), max_epochs)
    cut = scratch.write(thresholds(sized.where(F.col("size") > 0).select("source", "size", "h"), targets, small), "thresholds")
    right = targets.select("source", "source_size", "target").join(
        cut.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left"
    ).drop("_s")
    whole = F.floor(F.col("target") / F.col("source_size"))
    extra = (
        F.when(F.col("threshold").isNull() | (F.col("h") > F.col("threshold")), F.lit(0))
        .when(F.col("h") < F.col("threshold"), F.col("size"))
        .otherwise(F.floor(F.col("size") * F.col("part")))
    )
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(whole * F.col("size") + extra).cast("long")
    # with texts, sizes and hashes are computed again rather than the texts written
    out = _joined(df if text else sized, right, small).withColumn("taken", taken)
    return out.select("row", *["text"] * text, "size", "source_size", "target", "taken")


def repetitions(mixed: DataFrame) -> DataFrame:
    """A row for each repetition of a document in mix(text=True): row, text, repetition, words; the last may be a part."""
    n = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = mixed.where(F.col("taken") > 0).withColumn("repetition", F.explode(F.sequence(F.lit(1), n)))
    words = F.least(F.col("size"), F.col("taken") - F.col("size") * (F.col("repetition") - 1))
    # words with the blanks before them, so that lines stay lines
    spaced = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), 0)
    part = F.array_join(F.slice(spaced, F.lit(1), words.cast("int")), "")
    return rows.select("row", F.when(words < F.col("size"), part).otherwise(F.col("text")).alias("text"), "repetition", words.alias("words"))
