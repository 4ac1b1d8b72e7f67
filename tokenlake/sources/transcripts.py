"""Transcripts: who said what, from rollouts and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.json_text import json_text
from ..functions.storage import dealt
from .lines import field

ROLES = ("user", "assistant", "developer", "system")


def transcript_codex(lines: DataFrame) -> DataFrame:
    """(source_file, line_no, role, text, encrypted_text, call_id): one row at most for each response item."""
    kind, role = field("$.payload.type"), field("$.payload.role")
    rows = lines.where(field("$.type") == "response_item")
    content = json_text(F.coalesce(F.when(field("$.payload.content").startswith("["), field("$.payload.content")), F.to_json(F.array(field("$.payload.content")))), "message")["text"]
    call = F.concat_ws(": ", field("$.payload.name"), F.coalesce(field("$.payload.arguments"), field("$.payload.input")))
    is_call, is_result = kind.isin("function_call", "custom_tool_call"), kind.isin("function_call_output", "custom_tool_call_output")
    out = rows.select(
        "source_file", "line_no",
        F.when((kind == "message") & role.isin(*ROLES), role).when(is_call, "tool_call").when(is_result, "tool").when(kind == "reasoning", "reasoning").alias("role"),
        F.when(kind == "message", content).when(is_call, call).when(is_result, field("$.payload.output")).alias("text"),
        F.when(kind == "reasoning", field("$.payload.encrypted_content")).alias("encrypted_text"), field("$.payload.call_id").alias("call_id"),
    )
    return out.where(F.col("role").isNotNull() & ((F.coalesce("text", F.lit("")) != "") | F.col("encrypted_text").isNotNull()))


def transcript_events(lines: DataFrame) -> DataFrame:
    """(source_file, line_no, part, role, text, call_id): messages, tool calls (once each) and results."""
    kind = field("$.type")
    role = F.when(kind == "system.message", "system").when(kind == "user.message", "user").when(kind == "assistant.message", "assistant")
    said = lines.where(role.isNotNull()).select("source_file", "line_no", F.lit(0).alias("part"), role.alias("role"), field("$.data.content").alias("text"), F.lit(None).cast("string").alias("call_id"))
    request = "array<struct<toolCallId:string,name:string,arguments:string>>"
    asked = lines.where(kind == "assistant.message").select("source_file", "line_no", F.posexplode(F.from_json(field("$.data.toolRequests"), request)).alias("i", "t"))
    asked = asked.select("source_file", "line_no", (F.col("i") + 1).alias("part"), F.lit("tool_call").alias("role"), F.concat_ws(": ", "t.name", "t.arguments").alias("text"), F.col("t.toolCallId").alias("call_id"))
    begun = lines.where(kind == "tool.execution_start").select("source_file", "line_no", F.lit(1).alias("part"), F.lit("tool_call").alias("role"), F.concat_ws(": ", field("$.data.toolName"), field("$.data.arguments")).alias("text"), field("$.data.toolCallId").alias("call_id"))
    # a call that the message requested is not shown again when it begins
    begun = begun.join(asked.select(F.col("source_file").alias("_f"), F.col("call_id").alias("_c")).distinct(), (F.col("source_file") == F.col("_f")) & (F.col("call_id") == F.col("_c")), "left_anti")
    calls = asked.unionByName(begun)
    first = F.row_number().over(Window.partitionBy("source_file", F.coalesce("call_id", F.concat_ws("/", F.col("line_no").cast("string"), F.col("part").cast("string")))).orderBy("line_no", "part")) == 1
    calls = calls.withColumn("_first", first).where("_first").drop("_first")
    result = F.coalesce(field("$.data.result.detailedContent"), field("$.data.result.content"), field("$.data.result"), field("$.data.error"))
    done = lines.where(kind == "tool.execution_complete").select("source_file", "line_no", F.lit(0).alias("part"), F.lit("tool").alias("role"), result.alias("text"), field("$.data.toolCallId").alias("call_id"))
    return said.unionByName(calls).unionByName(done).where(F.coalesce("text", F.lit("")) != "")


def write_transcripts(rows: DataFrame, path: str, session: str = "source_file") -> None:
    """One folder for each session; characters that a file name can't hold become '_'."""
    name = F.translate(F.col(session), '/\\:*?"<>|', "_" * 9)
    dealt(rows.withColumn("session_file", name), "session_file").sortWithinPartitions("session_file", "line_no").write.partitionBy("session_file").json(path)
