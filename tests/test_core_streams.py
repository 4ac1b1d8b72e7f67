"""Growing, shrinking and vanishing log files; retried batches; hours of a stream."""

import json

import pytest
from pyspark.sql import functions as F

from tokenlake.sources import decoders, lines
from tokenlake.streaming import usage as streaming


def line(i, tokens):
    return json.dumps({"type": "assistant", "uuid": f"u{i}", "sessionId": "s", "message": {"model": "m", "usage": {"input_tokens": tokens}}}) + "\n"


def rows_of(df):
    return sorted((r["source_file"].rpartition("/")[2], r["origin_key"], r["prompt"]) for r in df.collect())


@pytest.fixture
def at(spark, tmp_path):
    src = tmp_path / "logs"
    src.mkdir()
    for i in range(4):
        (src / f"f{i}.jsonl").write_text(line(0, i) + line(1, 10 + i))
    return src


def test_sync(spark, at):
    table = "usage_sync"
    sync = lambda n=None: streaming.sync(spark, str(at), decoders.decode_claude, table, n)
    same = lambda: rows_of(spark.table(table)) == rows_of(decoders.decode_claude(lines.lines(spark, str(at))))
    assert sync() == 4 and same()
    assert sync() == 0
    with (at / "f0.jsonl").open("a") as f:  # grows
        f.write(line(2, 99))
    assert sync() == 1 and same() and len(rows_of(spark.table(table))) == 9
    (at / "f1.jsonl").write_text(line(0, 1))  # shrinks
    (at / "f2.jsonl").unlink()  # goes
    (at / "f9.jsonl").write_text(line(0, 7))  # comes
    assert sync() == 3 and same() and len(rows_of(spark.table(table))) == 7
    (at / "f3.jsonl").write_text(line(0, 5) + '{"cut": ')  # incomplete: its rows stay
    assert sync() == 1 and ("f3.jsonl", "event:u1:slot:0", 13) in rows_of(spark.table(table))
    for p in at.iterdir():  # all rows of all files go
        p.write_text("")
    assert sync() == 4 and spark.table(table).count() == 0
    (at / "f0.jsonl").write_text(line(0, 3))
    assert sync() == 1 and same()


def test_retried_batches(spark, at):
    table = "usage_retried"
    sync = lambda n: streaming.sync(spark, str(at), decoders.decode_claude, table, n)
    assert sync(0) == 4 and sync(0) == 0
    before = rows_of(spark.table(table))
    (at / "f0.jsonl").write_text(line(5, 5))
    assert sync(0) == 0 and rows_of(spark.table(table)) == before  # applied already
    # a batch that failed after the rows were written, before its files were known, is done again
    keep = spark.table("usage_retried_files").collect()
    assert sync(1) == 1
    after = rows_of(spark.table(table))
    schema = spark.table("usage_retried_files").schema
    streaming.stored(spark.createDataFrame(keep, schema), "t").write.mode("overwrite").saveAsTable("usage_retried_files")
    assert sync(1) == 1 and rows_of(spark.table(table)) == after != before


def test_follow(spark, at, tmp_path):
    for _ in range(2):
        streaming.follow(spark, str(at), decoders.decode_claude, "usage_followed", str(tmp_path / "ck")).awaitTermination()
        assert rows_of(streaming.current(spark, "usage_followed")) == rows_of(decoders.decode_claude(lines.lines(spark, str(at))))
        with (at / "f1.jsonl").open("a") as f:
            f.write(line(8, 8))


def test_ingest_leaves_nothing_behind(spark, at, tmp_path):
    import os

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    held = lambda: {x for x in os.listdir(root) if x.startswith("tokenlake-lines") or x.startswith("tokenlake-usage")} if os.path.isdir(root) else set()
    before = held()
    streaming.ingest(streaming.file_lines(spark, str(at)), decoders.decode_claude, "usage_bare", str(tmp_path / "ck")).awaitTermination()
    assert held() == before and streaming.current(spark, "usage_bare").where(F.col("prompt") > 0).count() == 7
