"""Known values of the engine's operators on small inputs of our own."""

import pytest
from pyspark.sql import functions as F

from tokenlake.functions import scalars
from tokenlake.operators import activity, incremental, names, pricing, report, sessions
from tokenlake.sources import decoders, lines


def test_names(spark):
    aliases = {"gpt-5": "gpt-5", "claude-sonnet-4.5": "claude-sonnet-4.5", "claude-3.5-haiku": "claude-3.5-haiku", "openai/o3": "openai-o3"}
    cases = {
        ("x", "GPT-5"): "gpt-5", ("x", " gpt-5-2025-08-07 "): "gpt-5", ("x", "openai/gpt-5-chat-latest"): "gpt-5-chat", ("x", "anthropic-claude-sonnet-4-5-20250929"): "claude-sonnet-4.5",
        ("x", "claude-3-5-haiku@20241022"): "claude-3.5-haiku", ("x", "claude-sonnet-4-5-thinking"): "claude-sonnet-4.5", ("openai", "O3"): "openai-o3", ("x", "o3"): "o3", ("x", None): "-", (None, "gpt-5-fast"): "gpt-5",
        ("x", "Unknown-Model-20250101"): "unknown-model-20250101", ("x", "gpt-5@default"): "gpt-5",
    }
    df = spark.createDataFrame(list(cases), "provider string, model string")
    got = {(r["provider"], r["model"]): r["canonical"] for r in names.resolve_pairs(df, aliases).collect()}
    want = dict(cases) | {("x", "openai/gpt-5-chat-latest"): "openai/gpt-5-chat-latest"}
    # '-latest' goes first, then '-chat', which leads to the alias
    want[("x", "openai/gpt-5-chat-latest")] = "gpt-5"
    assert got == want


def test_sessions_with_cycles(spark):
    rows = [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("d", "a", 1), ("e", None, 1), ("f", "e", 1), ("g", "missing", 1), ("h", "h", 1), ("i", "e", 1), ("i", "f", 2), ("j", "i", 1)]
    df = spark.createDataFrame([(s, p, t, f"{s}{t}") for s, p, t in rows], "session_id string, parent_session_id string, ts int, origin_key string")
    got = {r["session_id"]: r["root_id"] for r in sessions.session_roots(df).collect()}
    assert got == {"a": "a", "b": "b", "c": "c", "d": "a", "e": "e", "f": "e", "g": "missing", "h": "h", "i": "e", "j": "e"}


def test_asof(spark):
    ev = spark.createDataFrame([("r", "2025-06-01", 1, 1.0), ("r", "2025-08-01", 2, 3.0), ("r", "2025-08-01", 3, None)], "k string, ts string, sequence long, price double").withColumn("ts", F.to_timestamp("ts"))
    use = spark.createDataFrame([("r", "2025-05-01", 1), ("r", "2025-07-15", 2), ("r", "2025-08-02", 3), ("r", "2025-12-02", 4), ("q", "2025-12-02", 5)], "k string, ts string, n int").withColumn("ts", F.to_timestamp("ts"))
    got = {r["n"]: r["price"] for r in pricing.asof(use, ev, ["k"], "price", ["sequence"]).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: None, 4: None, 5: None}


def test_costs(spark):
    price = "struct<input:double,output:double,reasoning:double,cache_read:double,cache_write:double>"
    rows = [(1, 10, 0, 0, 0, 0, (1.5, 9.0, None, 0.0, None), (2.0, 2.0, None, 0.0, None), False), (2, 0, 0, 0, 0, 10, (1.5, 9.0, None, 0.0, None), None, False), (3, 0, 0, 0, 0, 10, (1.5, 9.0, None, 0.0, 0.0), None, False), (4, 10**6, 0, 0, 0, 0, (0.0, 0.0, None, 0.0, None), (2.0, 2.0, None, 0.0, None), False)]
    df = spark.createDataFrame(rows, f"n int, prompt long, completion long, reasoning long, cache_read long, cache_write long, provider_price {price}, official_price {price}, included boolean").withColumn("multiplier", F.lit(1).cast("decimal(6,3)"))
    total = sum((F.col(c) for c in report.COSTS[1:]), F.col(report.COSTS[0])).cast("double")
    got = {m: {r["n"]: r["c"] for r in pricing.cost(df, m).select("n", total.alias("c")).collect()} for m in ("actual", "mixed")}
    assert got["actual"][1] == got["actual"][2] == 0.000015 and got["actual"][3] == 0.0
    assert got["actual"][4] == 0.0 and got["mixed"][4] == 2.0


def test_activity(spark):
    s = spark.createDataFrame([(i, v) for i, v in enumerate([0, 10, 20, 0, 20, 5, 0])], "date int, value long")
    r = activity.summary(s).first()
    assert (r["total"], r["active"], r["streak"], r["best"]) == (55, 4, 2, 2)
    for values, want in (([0, 10, 20, 30, 40], [0, 1, 2, 3, 4]), ([3, 3, 3], [4, 4, 4])):
        got = activity.levels(spark.createDataFrame(list(enumerate(values)), "date int, value long")).orderBy("date").collect()
        assert [r["level"] for r in got] == want


def test_globs():
    import re

    for glob, text, ok in (("a*c", "a/b/c", True), ("a?c", "abc", True), ("[!x]b", "xb", False), ("[ab]*", "bzz", True), ("**/x", "a/b/x", True), ("a.c", "abc", False)):
        assert bool(re.match(scalars.glob_regex(glob), text)) is ok


def test_origin_keys(spark):
    df = spark.createDataFrame([("f", 1, 0, "x"), ("f", 2, 9, "x"), ("f", 3, 18, None)], "source_file string, line_no int, byte_offset long, id string")
    got = [r["origin_key"] for r in lines.with_origin_key(df, "id").orderBy("line_no").collect()]
    assert got == ["event:x:slot:0", "event:x:slot:0:duplicate:1", "offset:18:slot:0"]


def test_codex_totals(spark):
    rows = ['{"type":"session_meta","payload":{"id":"s","cwd":"/w/p","model_provider":"openai"}}', '{"type":"turn_context","payload":{"model":"gpt-5","turn_id":"1"}}']
    for i, (a, b, c, d) in enumerate([(100, 40, 50, 10), (200, 80, 90, 20), (400, 160, 180, 40), (500, 200, 220, 50)]):
        if i == 2:
            rows.append('{"type":"turn_context","payload":{"model":"gpt-5","turn_id":"2"}}')
        rows.append('{"type":"event_msg","payload":{"type":"token_count","info":{"total_token_usage":{"input_tokens":%d,"cached_input_tokens":%d,"output_tokens":%d,"reasoning_output_tokens":%d}}}}' % (a, b, c, d))
    df = spark.createDataFrame([("f", i, i, v) for i, v in enumerate(rows)], "source_file string, line_no int, byte_offset long, value string")
    got = decoders.decode_codex(df).orderBy("origin_key").collect()
    assert [r["prompt"] for r in got] == [60, 60, 120, 60] and [r["completion"] for r in got] == [40, 30, 70, 30] and [r["cache_read"] for r in got] == [40, 40, 80, 40]
    assert sum(r["rounds"] for r in got) == 2


def test_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":"é"}\n\n{"b":1}\n')
    (tmp_path / "b.jsonl").write_text('{"a":1}\n{"b":\n')
    df = lines.lines(spark, str(tmp_path))
    got = sorted((r["source_file"][-7:], r["line_no"], r["byte_offset"]) for r in df.collect())
    assert got == [("a.jsonl", 0, 0), ("a.jsonl", 2, 12), ("b.jsonl", 0, 0), ("b.jsonl", 1, 8)]
    assert {r["source_file"][-7:]: r["complete"] for r in lines.file_status(df).collect()} == {"a.jsonl": True, "b.jsonl": False}


def test_reconcile_rejects_bad_keys(spark):
    ok = spark.createDataFrame([("f", "k", 1)], "source_file string, origin_key string, v int")
    status = spark.createDataFrame([("f", True)], "source_file string, complete boolean")
    with pytest.raises(ValueError, match="repeated"):
        incremental.reconcile(ok, ok.union(ok), status)
    assert incremental.snapshot(incremental.reconcile(ok, ok.limit(0), status)).count() == 0
