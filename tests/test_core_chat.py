"""State replay, JSON walkers and chat records."""

import json

from pyspark.sql import functions as F

from tokenlake.functions.json_text import json_text
from tokenlake.sources import chat


def _lines(spark, recs):
    return spark.createDataFrame([("d/s.jsonl", i, json.dumps(r)) for i, r in enumerate(recs)], "source_file string, line_no int, value string")


def test_replay(spark):
    recs = [
        {"kind": 0, "v": {"sessionId": "S", "requests": [{"requestId": "b", "completionTokens": 9, "x": 1}]}}, {"kind": 1, "k": ["requests", 0, "completionTokens"], "v": 4}, {"kind": 2, "k": ["requests", 2], "v": {"requestId": "a"}},
        {"kind": 1, "k": ["requests", 2, "deep", "list", 1], "v": "t"}, {"kind": 1, "k": ["title"], "v": "T"}, {"kind": 7}, {"kind": 1, "k": ["requests"], "v": []},
    ]
    got = [json.loads(r["request"]) for r in chat.replay_state(_lines(spark, recs)).orderBy("n").collect()]
    assert got == [{"requestId": "a", "deep": {"list": [None, "t"]}}, {"requestId": "b", "completionTokens": 9, "x": 1}]


def test_walkers(spark):
    v = json.dumps({"text": "abc", "children": [{"text": "d"}, "é"], "node": {"text": "f"}, "value": "v", "output": [{"content": "o"}], "n": 3})
    df = spark.createDataFrame([(v,), ("not json",), (None,)], "v string").coalesce(1)
    got = {m: [tuple(r["x"]) for r in df.select(json_text(F.col("v"), m).alias("x")).collect()] for m in ("all", "text", "rich", "nested")}
    assert got["all"][0] == ("abc\nd\né\nf\nv\no", 8, 9) and got["text"][0] == ("abc", 3, 3) and got["rich"][0] == ("abc\nd\né\nf", 6, 7) and got["nested"][0] == ("abc\nv\no", 5, 5)
    assert all(g[1:] == [("", 0, 0)] * 2 for g in got.values())


def test_chat(spark):
    request = {
        "requestId": "r1", "timestamp": 1_700_000_000_000, "modelId": "copilot/gpt-5", "message": {"text": "hello you"}, "response": [{"value": "12345678"}, {"kind": "thinking", "value": "x" * 99}],
        "result": {"metadata": {"toolCallRounds": [{"response": "zz", "toolCalls": [{"id": "c1", "arguments": "abcd"}], "thinking": {"tokens": 17}}, {"response": "yyy", "toolCalls": []}], "toolCallResults": {"c1": {"content": [{"text": "result!"}]}}}},
    }
    r = chat.decode_chat(_lines(spark, [{"kind": 0, "v": {"sessionId": "S", "requests": [request]}}, {"kind": 1, "k": ["requests", 1], "v": {"requestId": "r2", "slashCommand": {"name": "compact"}, "completionTokens": 5}}])).orderBy("origin_key").collect()
    assert (r[0]["prompt"], r[0]["completion"], r[0]["reasoning"], r[0]["calls"], r[0]["provider"], r[0]["model"], r[0]["session_id"]) == (5, 3, 17, 3, "github-copilot", "gpt-5", "S")
    assert (r[1]["completion"], r[1]["mode"], r[1]["output_estimated"]) == (5, "compaction", False)


def test_sessions_over_many_batches(spark):
    """A session's lines come in order over many batches, and several sessions share a partition."""
    import json

    from tokenlake.sources import chat

    rows = []
    for s in range(5):
        rows.append((f"f{s}", 0, json.dumps({"kind": 0, "v": {"sessionId": f"s{s}", "requests": []}})))
        rows += [(f"f{s}", i + 1, json.dumps({"kind": 1, "k": ["requests"], "v": [{"requestId": f"r{i % 120}", "completionTokens": i}]})) for i in range(300)]
        rows.append((f"f{s}", 999, "no json"))
    df = spark.createDataFrame(rows[::-1], "source_file string, line_no int, value string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = chat.replay_state(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    assert len(got) == 5 * 120
    for r in got:
        request = json.loads(r["request"])
        last = max(i for i in range(300) if f"r{i % 120}" == request["requestId"])
        assert request["completionTokens"] == last and json.loads(r["session"])["sessionId"] == "s" + r["source_file"][1:]
