"""Decoders on small logs of our own, with the values that such logs have to give."""

import json
import random

from pyspark.sql import functions as F

from tokenlake.functions import json_text
from tokenlake.sources import decoders


def made(spark, rows, name="logs/s1/events.jsonl"):
    at, out = 0, []
    for i, r in enumerate(rows):
        value = r if isinstance(r, str) else json.dumps(r)
        out.append((name, i, at, value))
        at += len(value.encode()) + 1
    return spark.createDataFrame(out, "source_file string, line_no int, byte_offset long, value string")


def test_sizes_of_all_strings(spark):
    r = random.Random(4)
    parts = ["a", 'q"uote', "back\\slash", "\\u0041", "\n\t", "é", "漢", "\U0001f600", "", "a: b", '": "', "\x01", "\\", '\\"']

    def value(depth):
        kind = r.randrange(6 if depth else 3)
        if kind < 2:
            return "".join(r.choice(parts) for _ in range(r.randrange(4)))
        if kind == 2:
            return r.choice([None, 1, 2.5, True])
        if kind == 3:
            return [value(depth - 1) for _ in range(r.randrange(4))]
        return {"".join(r.choice(parts) for _ in range(2)): value(depth - 1) for _ in range(r.randrange(4))}

    def sizes(v):
        found = list(json_text.all_strings(v))
        return sum(map(len, found)), sum(len(x.encode()) for x in found)

    values = [value(4) for _ in range(400)] + ["x" * 200_000, ["\\n\"" * 50_000]]
    rows = [(i, json.dumps(v, ensure_ascii=i % 2 == 0, indent=r.choice([None, 1]))) for i, v in enumerate(values)] + [(-1, None)]
    got = spark.createDataFrame(rows, "i int, v string").select("i", json_text.string_sizes(F.col("v")).alias("s")).collect()
    for x in got:
        assert tuple(x["s"]) == (sizes(values[x["i"]]) if x["i"] >= 0 else (0, 0)), rows[x["i"]]


def test_events(spark):
    rows = [
        {"type": "session.start", "data": {"sessionId": "sid"}}, {"type": "session.model_change", "data": {"newModel": "copilot/gpt-5"}}, {"type": "system.message", "data": {"content": "12345", "more": ["x"]}},
        {"type": "user.message", "data": {"content": "abcd"}}, {"type": "user.message", "data": {"content": "é"}},
        {"type": "assistant.message", "id": "a1", "timestamp": "2026-01-02T03:04:05Z", "data": {"messageId": "m1", "content": "four", "outputTokens": 20, "toolRequests": [{"name": "run", "arguments": {"cmd": "lsla"}}]}},
        {"type": "tool.execution_complete", "data": {"toolCallId": "t", "result": {"content": "ok"}}}, {"type": "assistant.message", "data": {"messageId": "m2", "content": "bye"}}, "not json",
        {"type": "session.compaction_complete", "id": "c1", "data": {"compactionTokensUsed": {"inputTokens": 15, "output": 3, "reasoningTokens": 2, "cachedInput": 7, "model": "openai/o3"}}},
        {"type": "session.compaction_complete", "id": "c2", "data": {}}, {"type": "assistant.message", "id": "a1", "data": {"content": ""}},
    ]
    got = {r["origin_key"]: r for r in decoders.decode_events(made(spark, rows)).collect()}
    assert set(got) == {"event:a1:assistant", "message:m2:assistant", "event:c1:compaction", "event:a1:assistant:duplicate:1"}
    a1, m2, c1 = got["event:a1:assistant"], got["message:m2:assistant"], got["event:c1:compaction"]
    assert (a1["session_id"], a1["provider"], a1["model"], a1["prompt"], a1["completion"], a1["input_bytes"], a1["output_bytes"], a1["rounds"], a1["output_estimated"]) == ("sid", "github-copilot", "gpt-5", 2 + 1 + 1, 20, 12, 11, 1, False)
    assert (m2["prompt"], m2["completion"], m2["input_bytes"], m2["output_bytes"], m2["rounds"], m2["output_estimated"]) == (1 + 1 + 2, 1, 3 + 11, 3, 1, True)
    assert (c1["provider"], c1["model"], c1["prompt"], c1["completion"], c1["reasoning"], c1["cache_read"], c1["mode"], c1["rounds"], c1["calls"], c1["input_estimated"], c1["is_compaction"]) == ("openai", "o3", 15, 3, 2, 7, "compaction", 0, 1, False, True)
    bare = decoders.decode_events(made(spark, rows[5:6])).first()
    assert (bare["session_id"], bare["model"], bare["prompt"], bare["rounds"]) == ("s1", "unknown", 0, 0)


def test_shutdown_shares(spark):
    metric = lambda i, o, r=0, cr=0: {"usage": {"inputTokens": i, "outputTokens": o, "reasoningTokens": r, "cacheReadTokens": cr}, "requests": {"count": 9}}
    rows = [
        {"type": "user.message", "data": {"content": "x" * 60}}, {"type": "assistant.message", "data": {"content": "y" * 30}}, {"type": "user.message", "data": {"content": "z" * 10}},
        {"type": "assistant.message", "data": {"content": "w" * 10}}, {"type": "session.compaction_complete", "data": {}}, {"type": "user.message", "data": {"content": "never answered"}},
        {"type": "session.shutdown", "id": "e", "data": {"modelMetrics": {"gpt-5-mini": metric(40, 20, 5, 30), "openai/o3": metric(60, 0)}}},
    ]
    df = made(spark, rows)
    got = {r["model"]: r for r in decoders.decode_event_files(df).collect()}
    # tokens 10 + 15 + 5 and 60; input 60 + 30 + 10 bytes, output 40
    assert {m: (r["input_bytes"], r["output_bytes"], r["rounds"], r["calls"], r["origin_key"]) for m, r in got.items()} == {
        "gpt-5-mini": (33, 13, 3, 3, "event:e:shutdown:provider:github-copilot:model:gpt-5-mini"), "o3": (67, 27, 3, 3, "event:e:shutdown:provider:openai:model:o3"),
    }
    assert got["o3"]["session_id"] == "events"
    assert decoders.decode_event_files(made(spark, rows[:-1])).count() == 2


def test_pi(spark):
    use = {"input": 5, "output": 3, "cacheRead": 1, "cacheWrite": 2, "totalTokens": 8, "cost": {"total": 0.5}}
    think = [{"type": "thinking", "thinking": "hmm"}, {"type": "toolCall", "arguments": {"cmd": "ls"}}]
    rows = [
        {"type": "session", "id": "old", "cwd": "/p"}, {"type": "model_change", "provider": "openai", "modelId": "gpt-5"}, {"type": "message", "id": "u1", "message": {"role": "user", "content": "ab"}},
        {"type": "message", "id": "u2", "message": {"role": "user", "content": [{"type": "text", "text": "é"}]}}, {"type": "message", "id": "a1", "parentId": "u2", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "assistant", "content": think, "usage": use, "api": "chat"}},
        {"type": "model_change", "modelId": "o3"}, {"type": "message", "message": {"role": "toolResult", "content": "out", "usage": {}, "responseId": "r9"}}, {"type": "message", "message": {"role": "custom", "content": "not counted", "usage": {"input": 1}}}, {"type": "session", "id": "new", "cwd": "/q"},
    ]
    got = {r["origin_key"]: r for r in decoders.decode_pi(made(spark, rows, "x/a.jsonl")).collect()}
    a1, r9 = got["event:a1:slot:0"], got["event:r9:slot:0"]
    assert (a1["session_id"], a1["project_cwd"], a1["provider"], a1["model"], a1["rounds"], a1["mode"], a1["agent"], a1["total_direct"], a1["cost_embedded"]) == ("new", "/p", "openai", "gpt-5", 2, "chat", "u2", 8, 0.5)
    assert (a1["input_bytes"], a1["output_bytes"], a1["prompt"], a1["completion"], a1["cache_read"], a1["cache_write"]) == (2 + 4 + 2, 8 + 3 + 8 + 2, 5, 3, 1, 2)
    assert (r9["provider"], r9["model"], r9["rounds"], r9["agent"], r9["input_bytes"], r9["output_bytes"], r9["prompt"]) == (None, "o3", 0, "r9", 3, 0, 0)
    last = [r for k, r in got.items() if k.startswith("offset:")]
    assert len(got) == 3 and len(last) == 1 and (last[0]["input_bytes"], last[0]["output_bytes"]) == (0, 0)


def test_messages_without_ids(spark):
    message = spark.createDataFrame([(None, 7, "s", 5, '{"role": "assistant", "tokens": {"input": 1}}'), ("", 8, "s", 6, '{"role":"assistant","tokens":{"output":2}}'), ("m", 9, "s", 7, '{"role":"user","note":"\\"role\\":\\"assistant\\"","tokens":{}}')], "id string, rowid long, session_id string, time_created long, data string")
    none = spark.createDataFrame([], "id string, project_id string, directory string, title string, name string")
    got = decoders.decode_messages(message, none.select("id", "project_id", "directory", "title"), none.select("id", "name")).collect()
    assert sorted((r["origin_key"], r["prompt"], r["completion"]) for r in got) == [("rowid:7", 1, 0), ("rowid:8", 0, 2)]
