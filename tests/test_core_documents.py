"""Document inheritance, plugin summaries, chat transcripts, periods and roots of cycles on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from tokenlake.operators import catalog, pricing, report, sessions
from tokenlake.sources import chat, decoders


def _versions(spark, rows):
    return spark.createDataFrame([(c, p, json.dumps(d) if isinstance(d, dict) else None, d if isinstance(d, str) else None) for c, p, d in rows], "commit_seq int, path string, doc string, target string")


def _route(m):
    return f"providers/p/models/{m}.toml"


def test_inheritance(spark):
    rows = [
        (1, _route("a"), {"base_model": "x/b", "cost": {"input": 1}, "base_model_omit": ["cost.output", "no.such"]}), (1, "models/x/b.toml", {"cost": {"input": 9, "output": 2, "audio": {"in": 3}}, "release_date": "2024-02"}),
        (3, "models/x/b.toml", {"cost": {"output": 5, "reasoning": 7}, "release_date": "2024-02-30"}), (2, _route("old"), {"extends": {"from": "p/a", "omit": ["cost.reasoning"]}, "release_date": "2023-01-02"}),
        (2, _route("link"), _route("a")), (4, _route("a"), None), (1, _route("lone"), {"base_model": "none", "cost": {"input": 4}}),
    ]
    got = {(r["path"], r["since"]): json.loads(r["doc"]) if r["doc"] else None for r in catalog.resolve_docs(_versions(spark, rows)).collect()}
    assert got[_route("a"), 1] == {"cost": {"input": 1, "audio": {"in": 3}}, "release_date": "2024-02"} and got[_route("a"), 3]["cost"] == {"reasoning": 7, "input": 1}
    assert got[_route("old"), 3]["cost"] == {"input": 1} and got[_route("old"), 4] == {"release_date": "2023-01-02"} and got[_route("old"), 2]["release_date"] == "2023-01-02"
    assert got[_route("link"), 2] == got[_route("a"), 1] and got[_route("link"), 4] is None and got[_route("lone"), 1] == {"cost": {"input": 4}}
    fam = {r["model"]: r["release_date"] for r in catalog.families(_versions(spark, rows), {"a": "a"}, {}).collect()}
    assert fam == {"a": None, "old": "2023-01-02", "link": None, "lone": None}
    with pytest.raises(Exception, match="inheritance cycle"):
        catalog.resolve_docs(_versions(spark, [(1, _route("a"), {"extends": "p/b"}), (1, _route("b"), {"extends": "p/a"})])).collect()


def test_plugin_summary(spark):
    ask = {"query": "q", "provider": "w", "answer": "a", "results": [{"title": "t", "url": "u"}]}
    bad = {"query": "q2", "error": "late"}
    line = lambda **s: json.dumps({"type": "message", "id": "e", "parentId": "up", "message": {"role": "toolResult", "details": {"curatedQueries": [ask, bad], "summary": {"text": " done ", "workflow": "summary-review", "model": "g/m", "tokenEstimate": 12, **s}}}})
    df = spark.createDataFrame([("f.jsonl", 1, 0, line()), ("f.jsonl", 2, 9, line(fallbackUsed=True)), ("f.jsonl", 3, 18, line(workflow="other"))], "source_file string, line_no long, byte_offset long, value string")
    (r,) = decoders.decode_pi_plugin(df).collect()
    text = decoders.SUMMARY_HEAD + "\n[Result 1]\nQuery: q\nProvider: w\nAnswer: a\nSources:\n1. t — u\n\n[Result 2]\nQuery: q2\nStatus: Error\nError: late\n\n</search_results>"
    assert (r["provider"], r["model"], r["completion"], r["agent"], r["origin_key"], r["rounds"]) == ("g", "m", 12, "up", "event:e:slot:1", 0)
    assert (r["input_bytes"], r["prompt"], r["output_bytes"]) == (len(text.encode()), -(-len(text) // 4), 4)


def test_chat_transcript():
    request = {
        "message": {"parts": [{"text": "a"}, {"text": "b"}]}, "response": [{"kind": "inlineReference", "value": "no"}, {"kind": "toolInvocationSerialized", "toolCallId": "1", "source": {"label": "L"}, "pastTenseMessage": "did"}, {"value": "yes"}],
        "result": {"metadata": {"toolCallRounds": [{"response": "r", "toolCalls": [{"id": "1", "arguments": "x"}, {"id": "2", "name": "n", "arguments": "y"}, {"id": "3", "arguments": ""}]}], "toolCallResults": {"2": {"content": [{"value": {"node": {"text": "deep"}}}]}}}},
    }
    assert chat.spoken(request) == [
        ("user", "a\nb", None, None), ("tool_call", "L", "did", "1"), ("assistant", "yes", None, None), ("tool_call", "n: y", None, "2"), ("tool_call_result", "deep", "r", "2"), ("tool_call_result", "r", "r", "3"),
    ]
    assert chat.measures(request)[:4] == (6, 6, 8, 8)
    assert chat.spoken({}) == []


def test_periods(spark):
    now = F.lit("2024-03-13 10:30:00").cast("timestamp")
    want = {"today": "2024-03-12 23:00:00", "week": "2024-03-10 23:00:00", "month": "2024-02-29 23:00:00", "90s": "2024-03-13 10:28:30", "2d": "2024-03-11 10:30:00", "1mo": "2024-02-12 10:30:00", "1y": "2023-03-14 10:30:00", "1m": "2024-03-13 10:29:00"}
    row = spark.range(1).select(*[report.period_start(p, now, "Europe/Paris").cast("string").alias(p) for p in want]).first()
    assert row.asDict() == want
    rows = spark.createDataFrame([("2024-03-01 00:00:00",), ("2024-02-01 00:00:00",), ("2024-03-14 00:00:00",)], "ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert report.filter_period(rows, "1m", "2024-03-13 10:30:00").count() == 1


def test_roots_of_cycles_and_chains(spark):
    links = {f"c{i}": f"c{i + 1}" for i in range(40)} | {"x": "y", "y": "z", "z": "y", "s": "s", "t": "x", "n": None}
    rows = [(k, v, "2024-01-01 00:00:00", k) for k, v in links.items()]
    df = spark.createDataFrame(rows, "session_id string, parent_session_id string, ts string, origin_key string")
    got = {r["session_id"]: r["root_id"] for r in sessions.session_roots(df).collect()}
    assert got == {f"c{i}": "c40" for i in range(40)} | {"x": "y", "y": "y", "z": "z", "s": "s", "t": "y", "n": "n"}


def test_asof_edges(spark):
    ev = spark.createDataFrame([("a", "2024-01-31 00:00:00", 1, 1.0), ("a", "2024-01-31 00:00:00", 2, 2.0), ("a", "2024-04-05 00:00:00", 3, None), ("b", "2024-02-01 00:00:00", 4, 4.0)], "k string, ts string, seq int, price double")
    rows = [("a", "2023-06-01 00:00:00"), ("a", "2024-01-31 00:00:00"), ("a", "2024-03-10 00:00:00"), ("a", "2024-04-04 00:00:00"), ("a", "2024-04-05 00:00:00"), ("a", "2030-01-01 00:00:00"), ("b", None), ("c", "2024-01-01 00:00:00"), (None, "2024-01-01 00:00:00")]
    ts = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    out = pricing.asof(ts(spark.createDataFrame(rows, "k string, ts string")), ts(ev), ["k"], "price", ["seq"])
    got = {(r["k"], str(r["ts"])[:10]): r["price"] for r in out.collect()}
    assert got == {("a", "2023-06-01"): 1.0, ("a", "2024-01-31"): 2.0, ("a", "2024-03-10"): 2.0, ("a", "2024-04-04"): 2.0, ("a", "2024-04-05"): None, ("a", "2030-01-01"): None, ("b", "None"): 4.0, ("c", "2024-01-01"): None, (None, "2024-01-01"): None}
