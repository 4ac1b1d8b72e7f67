"""Chat sessions that are logged as state patches: replay, then one estimated record a request."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.json_text import rich_text, text_value
from .decoders import completed

#: Response items that hold no text of the answer.
SKIPPED = frozenset("codeblockUri textEditGroup undoStop inlineReference reference mcpServersStarting promptFile agent thinking".split())


class Replay:
    """A session's state under patches, and its requests as last seen."""

    def __init__(self):
        self.state, self.requests = None, {}

    def line(self, rec) -> None:
        kind = rec.get("kind") if isinstance(rec, dict) else None
        if kind == 0 and "v" in rec:
            self.state = rec["v"]
            self._see_all()
        elif kind in (1, 2) and "v" in rec and isinstance(rec.get("k"), list):
            path = [k for k in rec["k"] if isinstance(k, str) or (isinstance(k, int) and not isinstance(k, bool) and k >= 0)]
            self.state = self._set(self.state, path, rec["v"])
            if path[:1] == ["requests"]:
                if len(path) == 1:
                    self._see_all()
                elif isinstance(path[1], int):
                    self._see(self.state["requests"][path[1]])

    @staticmethod
    def _set(state, path: list, value):
        """state with value at path; what is missing on the way becomes objects and arrays, padded with null."""
        root = [state]
        at, key = root, 0
        for step in path:
            here = at[key]
            if isinstance(step, str):
                here = at[key] = here if isinstance(here, dict) else {}
                here.setdefault(step, None)
            else:
                here = at[key] = here if isinstance(here, list) else []
                here.extend([None] * (step + 1 - len(here)))
            at, key = here, step
        at[key] = value
        return root[0]

    def _see_all(self) -> None:
        requests = self.state.get("requests") if isinstance(self.state, dict) else None
        for r in requests if isinstance(requests, list) else ():
            self._see(r)

    def _see(self, request) -> None:
        name = request.get("requestId") if isinstance(request, dict) else None
        if isinstance(name, str) and name:
            old = self.requests.get(name, {})
            new = {**old, **request}
            most = [t for t in (old.get("completionTokens"), new.get("completionTokens")) if isinstance(t, int)]
            if most:
                new["completionTokens"] = max(most)
            self.requests[name] = json.loads(json.dumps(new))

    def result(self) -> list:
        if self.requests:
            return [self.requests[k] for k in sorted(self.requests)]
        requests = self.state.get("requests") if isinstance(self.state, dict) else None
        return requests if isinstance(requests, list) else []


_REPLAYED = "source_file string, n int, request string, session string"


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of whole sessions in order, session after session; of a session only its state is held."""
    now, replay = None, Replay()

    def done() -> Iterator[pa.RecordBatch]:
        state = replay.state if isinstance(replay.state, dict) else {}
        rest = json.dumps({k: v for k, v in state.items() if k != "requests"}, ensure_ascii=False)
        requests = replay.result()
        for i in range(0, len(requests), 100):
            some = [json.dumps(r, ensure_ascii=False) for r in requests[i : i + 100]]
            yield pa.record_batch(
                [pa.array([now] * len(some)), pa.array(range(i, i + len(some)), pa.int32()), pa.array(some), pa.array([rest] * len(some))], names=["source_file", "n", "request", "session"]
            )

    for batch in batches:
        for name, value in zip(batch.column("source_file").to_pylist(), batch.column("value")):
            if name != now:
                yield from done()
                now, replay = name, Replay()
            try:
                replay.line(json.loads(value.as_py()))
            except ValueError:
                continue
    yield from done()


def replay_state(lines: DataFrame) -> DataFrame:
    """(source_file, n, request, session): JSON of each request in order, and of the final state without requests.

    A session's lines are replayed as they stream by, sorted within its partition, so a log
    may be longer than a task's memory; sessions run side by side.
    """
    dealt = lines.where("value is not null").select("source_file", "line_no", "value").repartition("source_file").sortWithinPartitions("source_file", "line_no")
    return dealt.mapInArrow(_replayed, _REPLAYED)


def _at(v, *path):
    for p in path:
        v = v.get(p) if isinstance(v, dict) else None
    return v


def _size(texts) -> np.ndarray:
    """Characters and bytes."""
    texts = list(texts)
    return np.array([sum(map(len, texts)), sum(len(t.encode()) for t in texts)])


def result_texts(result):
    for x in _at(result, "content") if isinstance(_at(result, "content"), list) else ():
        yield from rich_text(x.get("value", x) if isinstance(x, dict) else x)


def response_texts(items):
    for item in items if isinstance(items, list) else ():
        kind = _at(item, "kind")
        if kind == "toolInvocationSerialized":
            yield from text_value(_at(item, "invocationMessage"))
            yield from text_value(_at(item, "pastTenseMessage"))
        elif kind == "progressTaskSerialized":
            yield from text_value(_at(item, "content"))
        elif kind not in SKIPPED and isinstance(_at(item, "value"), str):
            yield item["value"]


def measures(request: dict) -> tuple:
    """(input chars, input bytes, output chars, output bytes, reasoning, tool rounds, compaction) of a request."""
    meta = _at(request, "result", "metadata") or {}
    user = _size(text_value(_at(meta, "renderedUserMessage")))
    size = user + _size(text_value(_at(meta, "renderedGlobalContext")))
    if not user[0]:
        message = _at(request, "message")
        own = [_at(message, "text")] if isinstance(_at(message, "text"), str) else [_at(p, "text") for p in _at(message, "parts") or ()]
        size = size + _size(t for t in own if isinstance(t, str))
    rounds = _at(meta, "toolCallRounds") if isinstance(_at(meta, "toolCallRounds"), list) else []
    results = _at(meta, "toolCallResults") or {}
    out, thinking = _size(response_texts(_at(request, "response"))), 0
    for r in rounds:
        calls = _at(r, "toolCalls") if isinstance(_at(r, "toolCalls"), list) else []
        got = sum((_size(result_texts(_at(results, str(_at(c, "id"))))) for c in calls), np.zeros(2, int))
        size = size + (got if got[0] else _size(text_value(_at(r, "response"))))
        out = out + _size(a for c in calls for a in [_at(c, "arguments")] if isinstance(a, str))
        tokens = _at(r, "thinking", "tokens")
        thinking += tokens if isinstance(tokens, int) else 0
    compact = "compact" in (_at(request, "command"), _at(request, "slashCommand", "command"), _at(request, "slashCommand", "name"))
    return *size.tolist(), *out.tolist(), thinking, len(rounds), compact


def decode_chat(lines: DataFrame) -> DataFrame:
    """One record for each request; tokens are estimates of a quarter of the characters."""
    kind = "chars_in long, bytes_in long, chars_out long, bytes_out long, reasoning long, tool_rounds long, compaction boolean"

    def run(requests: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measures(json.loads(r)) for r in requests], columns=[x.split()[0] for x in kind.split(", ")])

    rows = replay_state(lines).withColumn("m", F.pandas_udf(run, kind)("request"))
    r = lambda p: F.get_json_object("request", p)
    s = lambda p: F.get_json_object("session", p)
    stem = F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.[^.]*$", "")
    model = F.coalesce(r("$.modelId"), r("$.agent.modelId"), s("$.inputState.selectedModel.metadata.family"), s("$.inputState.selectedModel.metadata.id"))
    given = r("$.completionTokens").try_cast("long")
    return completed(rows.select(
        F.lit("copilot").alias("source"), F.coalesce(s("$.sessionId"), stem).alias("session_id"), s("$.customTitle").alias("session_title"),
        F.when(F.contains(model, F.lit("/")) & ~model.startswith("copilot/"), F.substring_index(model, "/", 1)).otherwise("github-copilot").alias("provider"), F.substring_index(model, "/", -1).alias("model"),
        F.timestamp_millis(F.coalesce(r("$.timestamp").try_cast("long"), s("$.creationDate").try_cast("long"), F.lit(0))).alias("ts"),
        F.ceil(F.col("m.chars_in") / 4).cast("long").alias("prompt"), F.coalesce(given, F.ceil(F.col("m.chars_out") / 4).cast("long")).alias("completion"), "m.reasoning",
        F.lit(True).alias("input_estimated"), given.isNull().alias("output_estimated"), F.when(F.col("m.compaction"), "compaction").otherwise(r("$.modeInfo.modeId")).alias("mode"), F.col("m.bytes_in").alias("input_bytes"), F.col("m.bytes_out").alias("output_bytes"), F.col("m.compaction").alias("is_compaction"),
        F.lit(1).alias("rounds"), (F.col("m.tool_rounds") + 1).alias("calls"), F.concat(F.lit("event:"), F.coalesce(r("$.requestId"), F.col("n").cast("string")), F.lit(":slot:0")).alias("origin_key"), "source_file",
    ))


def _joined(texts) -> str:
    return "\n".join(t for t in texts if t)


def spoken(request: dict) -> list[tuple]:
    """(role, text, display, call_id) of a request: the prompt, answers and tool calls with results, each call once."""
    results = _at(request, "result", "metadata", "toolCallResults") or {}
    result = lambda i: _joined(result_texts(results[i])) if i in results else None
    own = lambda v, *path: v if isinstance(v := _at(v, *path), str) else ""
    prompt = _joined(text_value(_at(request, "result", "metadata", "renderedUserMessage"))) or own(request, "message", "text") or _joined(own(p, "text") for p in _at(request, "message", "parts") or ())
    out, shown = [("user", prompt, None, None)] if prompt else [], set()
    for item in request.get("response") if isinstance(request.get("response"), list) else ():
        call = own(item, "toolCallId")
        if _at(item, "kind") != "toolInvocationSerialized":
            text = _joined(response_texts([item]))
            out += [("assistant", text, None, call or None)] if text else []
        elif call:
            display = _joined([*text_value(_at(item, "invocationMessage")), *text_value(_at(item, "pastTenseMessage"))]) or None
            name = own(item, "toolId") or own(item, "source", "label") or "tool"
            args = own(item, "toolSpecificData", "prompt") or own(item, "toolSpecificData", "description")
            out.append(("tool_call", f"{name}: {args}" if args else name, display, call))
            out += [("tool_call_result", result(call), display, call)] if result(call) else []
            shown.add(call)
    for r in _at(request, "result", "metadata", "toolCallRounds") or ():
        for c in _at(r, "toolCalls") or ():
            call, args = own(c, "id"), own(c, "arguments")
            if call and call not in shown:
                out += [("tool_call", f"{own(c, 'name') or 'tool'}: {args}", None, call)] if args else []
                text = own(r, "response") if result(call) is None else result(call)
                out += [("tool_call_result", text, own(r, "response") or None, call)] if text else []
    return out


def transcript_chat(lines: DataFrame) -> DataFrame:
    """(source_file, n, part, role, text, display, call_id): requests by time, each as its prompt, answers and tool calls."""

    def run(requests: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("role", "text", "display", "call_id"), x)) for x in spoken(json.loads(r))] for r in requests])

    said = F.pandas_udf(run, "array<struct<role:string,text:string,display:string,call_id:string>>")
    time = F.coalesce(F.get_json_object("request", "$.timestamp").try_cast("long"), F.lit(0))
    rows = replay_state(lines).withColumn("n", F.row_number().over(Window.partitionBy("source_file").orderBy(time, "n")) - 1)
    return rows.select("source_file", "n", F.posexplode(said("request")).alias("part", "x")).select("source_file", "n", "part", "x.*")
