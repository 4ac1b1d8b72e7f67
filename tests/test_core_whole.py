"""Static prices, checkpoints that can't be continued, and byte offsets of streamed lines."""

from pyspark.sql import functions as F

from tokenlake.operators import price_history, pricing
from tokenlake.sources import decoders, lines
from tokenlake.streaming import usage as streaming

RATES = "input double, output double, reasoning double, cache_read double, cache_write double"


def test_static_prices(spark):
    usage = spark.sql("SELECT * FROM VALUES (1, 'P', 'm', 'm'), (2, 'P', 'h', 'h'), (3, 'Q', 'm', 'm'), (4, 'Q', 'x', 'x'), (5, NULL, 'm', 'm'), (6, 'P', NULL, '-') t(id, provider, model, canonical)").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    events = spark.createDataFrame([("upsert", 1, "p", "h", 9.0, 9.0, None, 9.0, None)], f"op string, sequence long, provider string, model string, {RATES}").withColumn("ts", F.lit("2023-01-01").cast("timestamp"))
    families = spark.createDataFrame([], "provider string, canonical_name string, model string, position long")
    official = spark.createDataFrame([("m", "o"), ("h", "o")], "canonical string, official string")
    static = spark.createDataFrame([("p", "m", 1.0, 1.0, None, 0.0, None), ("o", "m", 2.0, 2.0, None, 0.0, None), ("p", "h", 3.0, 3.0, None, 0.0, None), ("o", "h", 4.0, 4.0, None, 0.0, None)], f"provider string, model string, {RATES}")
    out = pricing.price_usage(usage, events, families, official, static)
    got = {r["id"]: (r["provider_price"] and r["provider_price"]["input"], r["official_price"] and r["official_price"]["input"]) for r in out.collect()}
    assert got == {1: (1.0, 2.0), 2: (9.0, 4.0), 3: (2.0, 2.0), 4: (None, None), 5: (2.0, 2.0), 6: (None, None)}


def test_bad_checkpoints(spark):
    states = spark.sql("SELECT 'p' AS provider, 'm' AS model, CAST(id AS INT) AS commit_seq, timestamp_seconds(id) AS ts, true AS present, CAST(id AS DOUBLE) AS input FROM range(1, 9)")
    whole = price_history.price_changes(states, ["input"])
    want = sorted(map(tuple, whole.collect()))
    known = whole.where("commit_seq <= 5")
    gap, wrong = known.where("sequence != 3"), known.withColumn("commit_seq", F.col("commit_seq") - 1).withColumn("input", F.lit(7.0))
    for before, commit in ((known, 5), (gap, 5), (wrong, 5), (known.withColumn("input", F.lit(7.0)), 50)):
        assert sorted(map(tuple, price_history.price_changes_since(states, before, commit, ["input"]).collect())) == want


def test_streamed_offsets(spark, tmp_path):
    src = tmp_path / "logs"
    src.mkdir()
    line = '{"type":"assistant","timestamp":"2024-01-01T00:00:0%dZ","sessionId":"s","message":{"model":"m\u00e9","usage":{"input_tokens":%d,"output_tokens":1}}}\n'
    (src / "a.jsonl").write_text("\n".join(line % (i, i) for i in range(3)))
    spark.sql("DROP TABLE IF EXISTS usage_offsets")
    streaming.ingest(streaming.file_lines(spark, str(src)), decoders.decode_claude, "usage_offsets", str(tmp_path / "ck")).awaitTermination()
    want = sorted(r["origin_key"] for r in decoders.decode_claude(lines.lines(spark, str(src))).collect())
    assert sorted(r["origin_key"] for r in spark.table("usage_offsets").collect()) == want and len(set(want)) == 3
    spark.sql("DROP TABLE usage_offsets")
