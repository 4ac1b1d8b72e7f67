"""Transcripts, workspaces and pricing files."""

import json

from tokenlake.sources import transcripts, workspaces


def _lines(spark, recs):
    return spark.createDataFrame([("f", i, json.dumps(r)) for i, r in enumerate(recs)], "source_file string, line_no int, value string")


def test_codex(spark):
    item = lambda **p: {"type": "response_item", "payload": p}
    recs = [item(type="message", role="user", content=[{"type": "t", "text": "hi"}]), item(type="message", role="ghost", content="x"), item(type="function_call", name="ls", arguments="{}", call_id="1"), item(type="function_call_output", output="ok", call_id="1"), item(type="reasoning", encrypted_content="E"), item(type="message", role="assistant", content="")]
    got = [(r["role"], r["text"], r["encrypted_text"]) for r in transcripts.transcript_codex(_lines(spark, recs)).orderBy("line_no").collect()]
    assert got == [("user", "hi", None), ("tool_call", "ls: {}", None), ("tool", "ok", None), ("reasoning", None, "E")]


def test_events(spark, tmp_path):
    recs = [
        {"type": "user.message", "data": {"content": "do"}}, {"type": "assistant.message", "data": {"content": "", "toolRequests": [{"toolCallId": "a", "name": "ls", "arguments": "x"}]}},
        {"type": "tool.execution_start", "data": {"toolCallId": "a", "toolName": "ls"}}, {"type": "tool.execution_start", "data": {"toolCallId": "b", "toolName": "cat", "arguments": "y"}}, {"type": "tool.execution_complete", "data": {"toolCallId": "a", "result": {"content": "out", "detailedContent": "more"}}},
    ]
    df = transcripts.transcript_events(_lines(spark, recs))
    assert [(r["role"], r["text"]) for r in df.orderBy("line_no", "part").collect()] == [("user", "do"), ("tool_call", "ls: x"), ("tool_call", "cat: y"), ("tool", "more")]
    transcripts.write_transcripts(df, str(tmp_path / "t"))
    assert (tmp_path / "t" / "session_file=f").is_dir()


def test_workspaces(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "workspace.json").write_text('{"folder": "file:///home/me/a%20b+c/"}')
    r = workspaces.workspaces(spark, str(tmp_path / "w")).first()
    assert (r["project_cwd"], r["project_name"]) == ("/home/me/a b+c/", "a b+c")


def test_pricing(spark, tmp_path):
    one = {"providers": {"P": {"included": True, "multiplier": 2, "models": {"m": {"multiplier": 3}}}}, "models": {"m": {"provider": "p", "aliases": ["x"]}}, "prices": [{"provider": "p", "model": "M", "input": 1, "output": 2}]}
    two = {"providers": {"p": {"multiplier": 5}}, "prices": [{"provider": "P", "model": "m", "input": 9, "output": 2, "reasoning": 0}]}
    for name, d in (("1", one), ("2", two)):
        (tmp_path / f"{name}.json").write_text(json.dumps(d, indent=1))
    got = workspaces.read_pricing(spark, [str(tmp_path / "1.json"), str(tmp_path / "2.json")])
    assert sorted((r["model"] or "", float(r["multiplier"]), r["included"]) for r in got["policies"].collect()) == [("", 5.0, True), ("m", 3.0, None)]
    r = got["prices"].first()
    assert (r["model"], float(r["input"]), float(r["cache_read"]), float(r["reasoning"]), r["cache_write"]) == ("m", 9.0, 0.0, 0.0, None)
    assert got["models"].first()["official"] == "p"
