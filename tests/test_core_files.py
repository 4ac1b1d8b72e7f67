"""Files and streams: round trips, and batch equals stream."""

import datetime

import pytest
from pyspark.sql import functions as F

from tokenlake.plans import views
from tokenlake.sources import decoders, lines, price_files
from tokenlake.streaming import usage as streaming

SF = "/root/testdata/sf0.001"


def test_price_files(spark, tmp_path):
    rows = [("upsert", "2024-01-01T00:00:00Z", "c1", 1, " OpenAI ", "GPT-5", 1.5, None), ("delete", "2024-01-02T00:00:00Z", "c2", 2, "openai", "gpt-5", None, None)]
    df = spark.createDataFrame(rows, "op string, ts string, commit_sha string, sequence int, provider string, model string, input double, cache_write double")
    price_files.write_changes(df, str(tmp_path / "c"))
    got = price_files.read_price_events(spark, str(tmp_path / "c")).collect()
    assert [(r["provider"], r["model"], float(r["input"]), float(r["output"]), r["cache_write"]) for r in got] == [("openai", "gpt-5", 1.5, 0.0, None)]
    (tmp_path / "bad.csv").write_text("op,ts\nmove,2024-01-01\n")
    with pytest.raises(Exception, match="unknown op"):
        price_files.read_price_events(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "f.csv").write_text("provider,model,canonical_name,family,release_date\nA,M,N,,\nB,M,,,\n")
    assert [tuple(r)[:3] for r in price_files.read_families(spark, str(tmp_path / "f.csv")).collect()] == [("a", "n", "m")]


def test_stream_ingest(spark, tmp_path):
    src = tmp_path / "logs"
    src.mkdir()
    line = '{"type":"assistant","timestamp":"2024-01-01T00:00:0%dZ","sessionId":"s","message":{"model":"m","usage":{"input_tokens":%d,"output_tokens":1}}}\n'
    spark.sql("DROP TABLE IF EXISTS usage_stream")
    for name in ("a", "b"):
        (src / f"{name}.jsonl").write_text("".join(line % (i, i) for i in range(3)))
        streaming.ingest(streaming.file_lines(spark, str(src)), decoders.decode_claude, "usage_stream", str(tmp_path / "ck")).awaitTermination()
    batch = decoders.decode_claude(lines.lines(spark, str(src)))
    got = sorted((r["prompt"], r["rounds"]) for r in spark.table("usage_stream").collect())
    assert got == sorted((r["prompt"], r["rounds"]) for r in batch.collect()) and len(got) == 6
    spark.sql("DROP TABLE usage_stream")


def test_stream_hours(spark, tmp_path):
    usage = views.usage(spark, SF)
    usage.where("day(ts) < 20").write.parquet(str(tmp_path / "u"))
    # a row far ahead closes every hour before it
    ahead = usage.limit(1).withColumn("ts", F.lit(datetime.datetime(2030, 1, 1)).cast("timestamp"))
    ahead.write.mode("append").parquet(str(tmp_path / "u"))
    stream = spark.readStream.schema(usage.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "u"))
    q = streaming.hourly_totals(stream, "400 days").writeStream.format("memory").queryName("hours").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("hours").collect()}
    want = {tuple(r) for r in streaming.hourly_totals(usage.where("day(ts) < 20")).collect()}
    assert got == want
