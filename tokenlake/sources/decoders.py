"""Session logs to usage records, with window functions over each file's lines.

Every decoder takes lines (source_file, line_no, byte_offset, value) and gives
the usage columns it knows; completed() fills the schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.json_text import string_sizes
from ..functions.scalars import rough_tokens, saturating_sub, split_provider
from .lines import before, field, so_far, with_distinct_key, with_origin_key

USAGE = (
    "source string, session_id string, session_kind string, parent_session_id string, session_title string, project_cwd string, project_name string, "
    "provider string, model string, ts timestamp, prompt long, completion long, input_bytes long, output_bytes long, input_estimated boolean, "
    "output_estimated boolean, input_bytes_estimated boolean, output_bytes_estimated boolean, reasoning long, cache_read long, cache_write long, "
    "total_direct long, mode string, agent string, is_compaction boolean, rounds long, calls long, cost_embedded double, origin_key string, source_file string"
)
DEFAULTS = {"session_kind": "root", "calls": 1}


def completed(df: DataFrame) -> DataFrame:
    """df with all usage columns: counters 0, flags false, the rest null where it has none."""
    out = []
    for name, kind in (x.split() for x in USAGE.split(", ")):
        default = F.lit(DEFAULTS.get(name, 0 if kind == "long" and name != "total_direct" else False if kind == "boolean" else None))
        out.append((F.coalesce(F.col(name), default) if name in df.columns else default).cast(kind).alias(name))
    return df.select(*out)


def _number(path: str) -> Column:
    return F.coalesce(field(path, "long"), F.lit(0))


def _stem() -> Column:
    return F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.[^.]*$", "")


def _file_first(col: Column) -> Column:
    return F.first(col, ignorenulls=True).over(Window.partitionBy("source_file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def _folder() -> Column:
    """The name of a file's folder, null where it has none."""
    return F.nullif(F.regexp_extract("source_file", r"([^/]+)/[^/]*$", 1), F.lit(""))


def _parsed(lines: DataFrame) -> DataFrame:
    """lines that are JSON, parsed once as ``_v``."""
    return lines.withColumn("_v", F.try_parse_json("value")).where(F.col("_v").isNotNull())


def _at(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("_v", path, kind)


def _has(path: str) -> Column:
    """Whether a field is there and not null."""
    v = _at(path, "variant")
    return F.coalesce(v.isNotNull() & ~F.is_variant_null(v), F.lit(False))


def _text(path: str) -> Column:
    """A field that is a string; null where it is anything else."""
    return F.when(F.schema_of_variant(_at(path, "variant")) == "STRING", _at(path))


def _sizes(path: str) -> Column:
    """Characters and bytes of all strings in a field, at any depth."""
    return string_sizes(F.to_json(_at(path, "variant")))


def decode_claude(lines: DataFrame) -> DataFrame:
    """Assistant lines with usage; session and directory are the file's first, the directory else its folder's name.

    The first call of each user line is a round; calls before the first user line share its round.
    """
    u = "$.message.usage"
    kind = _at("$.type")
    items = F.from_json(F.to_json(_at("$.message.content", "variant")), "array<struct<type:string>>")
    tools = F.coalesce(F.exists(items, lambda x: x["type"].isin("tool_result", "tool_use")), F.lit(False))
    is_call = F.coalesce((kind == "assistant") & _has(u), F.lit(False))
    count = lambda path: F.coalesce(_at(f"{u}.{path}", "long"), F.lit(0))
    made = count("cache_creation.ephemeral_5m_input_tokens") + count("cache_creation.ephemeral_1h_input_tokens")
    rows = _parsed(lines).select(
        "source_file", "line_no", "byte_offset", is_call.alias("_call"), F.coalesce((kind == "user") & ~tools, F.lit(False)).cast("int").alias("_user"),
        _file_first(_at("$.sessionId")).alias("session_id"), _file_first(_at("$.cwd")).alias("_cwd"), F.coalesce(_at("$.uuid"), _at("$.id"), _at("$.message.id")).alias("_id"),
        F.nullif(_at("$.message.model"), F.lit("")).alias("model"), F.coalesce(_at("$.timestamp").try_cast("timestamp"), F.lit(0).cast("timestamp")).alias("ts"),
        count("input_tokens").alias("prompt"), count("output_tokens").alias("completion"), count("cache_read_input_tokens").alias("cache_read"),
        F.when(made > 0, made).otherwise(count("cache_creation_input_tokens")).alias("cache_write"),
    )
    rows = rows.withColumn("_round", F.greatest(F.sum("_user").over(so_far()), F.lit(1))).where("_call")
    first = F.row_number().over(Window.partitionBy("source_file", "_round").orderBy("line_no")) == 1
    calls = with_origin_key(rows.withColumn("rounds", first.cast("long")), "_id")
    folder = _folder()
    cwd = F.when(folder.startswith("-"), F.concat(F.lit("/"), F.replace(F.substring(folder, 2, 1 << 30), F.lit("-"), F.lit("/")))).otherwise(folder)
    return completed(calls.select(
        F.lit("claude").alias("source"), F.coalesce("session_id", _stem()).alias("session_id"), F.coalesce("_cwd", cwd).alias("project_cwd"), F.lit("anthropic").alias("provider"), "model", "ts",
        "prompt", "completion", "cache_read", "cache_write", F.lit(True).alias("input_bytes_estimated"), F.lit(True).alias("output_bytes_estimated"), "rounds", "origin_key", "source_file",
    ))


def token_deltas(rows: DataFrame, fields: list[str]) -> DataFrame:
    """rows with last_* and total_* counters as deltas d_*: the last usage if given, else the total less the total before."""
    has_last, has_total = F.col(f"last_{fields[0]}").isNotNull(), F.col(f"total_{fields[0]}").isNotNull()
    out = rows
    for f in fields:
        prev = F.last(F.when(has_total, F.struct(F.col(f"total_{f}").alias("n"))), ignorenulls=True).over(before())
        # a count that the total before did not have is no delta
        less = F.when(prev.isNull(), F.col(f"total_{f}")).otherwise(saturating_sub(F.col(f"total_{f}"), prev["n"]))
        out = out.withColumn(f"d_{f}", F.when(has_last, F.col(f"last_{f}")).when(has_total, less))
    return out


def decode_codex(lines: DataFrame) -> DataFrame:
    """Rollouts: a record for each token_count; models carry forward; inherited turns of a fork give none.

    A session's data stand in its payload or in that one's ``meta``; its originator stands in for a provider.
    """
    kind, payload = field("$.type"), field("$.payload.type")
    meta, turn, item = kind == "session_meta", kind == "turn_context", kind == "response_item"
    count = (kind == "event_msg") & (payload == "token_count")
    names = {"input": "input_tokens", "cached": "cached_input_tokens", "output": "output_tokens", "reasoning": "reasoning_output_tokens", "all": "total_tokens"}
    of_meta = lambda k: F.when(field("$.payload.meta").isNotNull(), field(f"$.payload.meta.{k}")).otherwise(field(f"$.payload.{k}"))
    uuid7 = r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{12}$"
    rows = lines.select(
        "*", meta.alias("_meta"), turn.alias("_turn"), F.coalesce(count, F.lit(False)).alias("_count"),
        _file_first(F.when(meta, F.coalesce(of_meta("id"), field("$.id")))).alias("_sid"), _file_first(F.when(meta, of_meta("forked_from_id"))).alias("_fork"),
        _file_first(F.when(meta, F.coalesce(of_meta("cwd"), field("$.cwd"))).otherwise(field("$.payload.cwd"))).alias("project_cwd"), field("$.id").alias("_id"),
        F.last(field("$.timestamp", "timestamp"), ignorenulls=True).over(so_far()).alias("ts"), field("$.payload.turn_id").alias("_tid"),
        F.last(F.when(turn, field("$.payload.model")), ignorenulls=True).over(so_far()).alias("_m1"), F.first(F.when(meta, F.coalesce(of_meta("model"), field("$.model"))).when(item, field("$.payload.model")), ignorenulls=True).over(so_far()).alias("_m2"),
        F.last(F.when(turn, field("$.payload.model_provider")), ignorenulls=True).over(so_far()).alias("_p1"), F.first(F.when(meta, F.coalesce(of_meta("model_provider"), of_meta("originator"), field("$.originator"))), ignorenulls=True).over(so_far()).alias("_p2"),
        *[field(f"$.payload.info.last_token_usage.{v}", "long").alias(f"last_{k}") for k, v in names.items()],
        *[field(f"$.payload.info.total_token_usage.{v}", "long").alias(f"total_{k}") for k, v in names.items()],
    )
    known = F.regexp_like("_tid", F.lit(uuid7)) & F.regexp_like("_sid", F.lit(uuid7))
    change = F.when(F.col("_meta"), F.col("_fork").isNotNull()).when(F.col("_turn") & known, F.col("_tid") < F.col("_sid"))
    rows = rows.withColumn("_inherited", F.coalesce(F.last(change, ignorenulls=True).over(so_far()), F.lit(False)))
    rows = token_deltas(rows, list(names))
    rows = rows.withColumn("_close", F.col("_count") & F.col("d_input").isNotNull())
    # pending counts end at a closing row and where own turns begin
    was = F.lag("_inherited", 1, False).over(Window.partitionBy("source_file").orderBy("line_no"))
    rows = rows.withColumn("_cut", (F.col("_inherited") != was).cast("int"))
    rows = rows.withColumn("_gid", F.coalesce(F.sum(F.col("_close").cast("int")).over(before()), F.lit(0)) + F.sum("_cut").over(so_far()))
    role = field("$.payload.role")
    message = F.when(item & (payload == "message"), F.coalesce(_text_bytes("$.payload.content"), F.lit(0)))
    call = item & payload.isin("function_call", "custom_tool_call")
    call_bytes = F.when(call, F.coalesce(F.octet_length(field("$.payload.name")), F.lit(0)) + F.coalesce(F.octet_length(field("$.payload.arguments")), F.lit(0)) + F.coalesce(F.octet_length(field("$.payload.input")), F.lit(0)))
    result = F.when(item & payload.isin("function_call_output", "custom_tool_call_output"), F.coalesce(F.octet_length(field("$.payload.output")), F.lit(0)))
    first_turn = F.row_number().over(Window.partitionBy("source_file", "_tid", "_turn", "_inherited").orderBy("line_no")) == 1
    rows = rows.withColumns({
        "_in": F.coalesce(F.when(role != "assistant", message), result, F.lit(0)), "_out": F.coalesce(F.when(role == "assistant", message), call_bytes, F.lit(0)),
        "_round": (F.col("_turn") & ~F.col("_inherited") & (F.col("_tid").isNull() | first_turn)).cast("int"),
    })
    w = Window.partitionBy("source_file", "_gid").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"input_bytes": F.sum("_in").over(w), "output_bytes": F.sum("_out").over(w), "rounds": F.sum("_round").over(w)})
    calls = rows.where(F.col("_close") & ~F.col("_inherited"))
    n = F.row_number().over(Window.partitionBy("source_file").orderBy("line_no"))
    none = F.sum("rounds").over(Window.partitionBy("source_file")) == 0
    calls = calls.withColumn("rounds", F.when(none & (n == 1), 1).otherwise(F.col("rounds")))
    return completed(with_origin_key(calls, "_id").select(
        F.lit("codex").alias("source"), F.coalesce("_sid", _stem()).alias("session_id"), F.when(F.col("_fork").isNotNull(), "sub_agent").otherwise("root").alias("session_kind"), F.col("_fork").alias("parent_session_id"),
        "project_cwd", F.coalesce("_p1", "_p2").alias("provider"), F.coalesce("_m1", "_m2").alias("model"), F.coalesce("ts", F.lit(0).cast("timestamp")).alias("ts"),
        saturating_sub(F.col("d_input"), F.col("d_cached")).alias("prompt"), saturating_sub(F.col("d_output"), F.col("d_reasoning")).alias("completion"), F.col("d_cached").alias("cache_read"), F.col("d_reasoning").alias("reasoning"),
        F.col("d_all").alias("total_direct"), "input_bytes", "output_bytes", "rounds", "origin_key", "source_file",
    ))


def _text_bytes(path: str) -> Column:
    """Bytes of the texts of a message's content: a string, or items with text."""
    content = field(path)
    items = F.from_json(content, "array<struct<text:string>>")
    total = F.aggregate(F.coalesce(items, F.array().cast("array<struct<text:string>>")), F.lit(0), lambda a, x: a + F.coalesce(F.octet_length(x["text"]), F.lit(0)))
    return F.when(content.startswith("["), total).otherwise(F.octet_length(content))


def _event_name() -> Column:
    """An event's own id, its message's, or its place."""
    text = lambda name, path: F.concat(F.lit(name), F.nullif(_text(path), F.lit("")))
    return F.coalesce(text("event:", "$.id"), text("message:", "$.data.messageId"), F.concat(F.lit("offset:"), F.col("byte_offset").cast("string")))


def _epoch(path: str = "$.timestamp") -> Column:
    return F.coalesce(_at(path).try_cast("timestamp"), F.lit(0).cast("timestamp"))


def _started() -> Column:
    """The session id of the file's first start that has one."""
    return _file_first(F.when(_at("$.type") == "session.start", _text("$.data.sessionId")))


def shutdown_records(lines: DataFrame, source: str) -> DataFrame:
    """A record for each model of a session.shutdown event's metrics."""
    metrics = "map<string,struct<usage:struct<inputTokens:long,outputTokens:long,reasoningTokens:long,cacheReadTokens:long,cacheWriteTokens:long>,requests:struct<count:long>>>"
    rows = _parsed(lines).select("*", _started().alias("_sid")).where(_at("$.type") == "session.shutdown")
    each = rows.select("*", F.explode(F.from_json(F.to_json(_at("$.data.modelMetrics", "variant")), metrics)).alias("name", "m"))
    c = lambda f: F.coalesce(F.col(f"m.usage.{f}"), F.lit(0))
    provider, model = split_provider(F.col("name"), "github-copilot")
    count = F.coalesce("m.requests.count", F.lit(1))
    each = each.withColumns({"_p": provider, "_name": model})
    each = with_distinct_key(each, F.concat(_event_name(), F.lit(":shutdown:provider:"), "_p", F.lit(":model:"), "_name"))
    return completed(each.select(
        F.lit(source).alias("source"), F.coalesce("_sid", _text("$.data.sessionId"), _stem()).alias("session_id"), F.col("_p").alias("provider"), F.col("_name").alias("model"), _epoch().alias("ts"),
        saturating_sub(saturating_sub(c("inputTokens"), c("cacheReadTokens")), c("cacheWriteTokens")).alias("prompt"), saturating_sub(c("outputTokens"), c("reasoningTokens")).alias("completion"),
        c("reasoningTokens").alias("reasoning"), c("cacheReadTokens").alias("cache_read"), c("cacheWriteTokens").alias("cache_write"), F.lit("session.shutdown").alias("mode"),
        F.lit(True).alias("input_bytes_estimated"), F.lit(True).alias("output_bytes_estimated"), count.alias("rounds"), count.alias("calls"), "origin_key", "source_file",
    ))


def _event_sizes(lines: DataFrame) -> DataFrame:
    """Event lines with what each adds to the next input (tokens, bytes), what an answer gives out, and their kinds."""
    kind = _at("$.type")
    answer, given = kind == "assistant.message", kind.isin("system.message", "user.message", "tool.execution_complete")
    rows = _parsed(lines).select(
        "source_file", "line_no", "byte_offset", "_v", F.coalesce(answer, F.lit(False)).alias("_close"), F.coalesce(kind == "user.message", F.lit(False)).cast("long").alias("_user"),
        F.coalesce(kind == "session.compaction_complete", F.lit(False)).alias("_compacted"), F.when(given, _sizes("$.data")).alias("_given"),
        F.when(answer, _sizes("$.data.content")).alias("_content"), F.when(answer, _sizes("$.data.toolRequests")).alias("_asked"),
    )
    zero = F.lit(0).cast("long")
    return rows.withColumns({
        "_in": F.coalesce(rough_tokens(F.col("_given.chars")), zero), "_ib": F.coalesce("_given.bytes", zero),
        "_out": F.coalesce(rough_tokens(F.col("_content.chars")) + rough_tokens(F.col("_asked.chars")), zero), "_ob": F.coalesce(F.col("_content.bytes") + F.col("_asked.bytes"), zero),
        "_gid": F.coalesce(F.sum(F.col("_close").cast("int")).over(before()), F.lit(0)),
    })


def decode_events(lines: DataFrame) -> DataFrame:
    """Event streams: each answer closes a record, and what it gave out is input to the next; a compaction is an exact record."""
    rows = _event_sizes(lines)
    compaction = F.col("_compacted") & _at("$.data.compactionTokensUsed", "variant").isNotNull()
    used = "$.data.compactionTokensUsed"
    alias = lambda a, b: F.coalesce(_at(f"{used}.{a}", "long"), _at(f"{used}.{b}", "long"), F.lit(0))
    changed = split_provider(F.when(_at("$.type") == "session.model_change", _text("$.data.newModel")), "github-copilot")[1]
    w = Window.partitionBy("source_file", "_gid").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "*", F.coalesce(_started(), _folder(), F.lit("unknown")).alias("session_id"), F.coalesce(F.last(changed, ignorenulls=True).over(so_far()), F.lit("unknown")).alias("_model"),
        F.sum("_in").over(w).alias("_sum"), F.sum("_ib").over(w).alias("_bytes"), (F.sum("_user").over(so_far()) > 0).cast("long").alias("_round"), compaction.alias("is_compaction"),
    )
    # what the answer before gave out is estimated, even where its own count is exact
    answers = Window.partitionBy("source_file", "_close").orderBy("line_no")
    fed = lambda c: F.coalesce(F.lag(c).over(answers), F.lit(0))
    rows = rows.withColumns({"_sum": F.col("_sum") + fed("_out"), "_bytes": F.col("_bytes") + fed("_ob")}).where("_close OR is_compaction")
    is_, exact = F.col("is_compaction"), _at("$.data.outputTokens", "long")
    provider, model = split_provider(F.when(is_, F.coalesce(_text(f"{used}.model"), F.col("_model"))).otherwise(F.col("_model")), "github-copilot")
    rows = with_distinct_key(rows, F.concat(_event_name(), F.when(is_, ":compaction").otherwise(":assistant")))
    by = lambda a, b: F.when(is_, a).otherwise(b)
    nought = F.lit(0).cast("long")
    return completed(rows.select(
        F.lit("copilot-cli").alias("source"), "session_id", provider.alias("provider"), model.alias("model"), _epoch().alias("ts"), by(alias("inputTokens", "input"), F.col("_sum")).alias("prompt"),
        by(alias("outputTokens", "output"), F.coalesce(exact, "_out")).alias("completion"), by(alias("reasoningTokens", "reasoning"), nought).alias("reasoning"),
        by(alias("cacheReadTokens", "cachedInput"), nought).alias("cache_read"), by(F.coalesce(_at(f"{used}.cacheWriteTokens", "long"), nought), nought).alias("cache_write"),
        by(nought, F.col("_bytes")).alias("input_bytes"), by(nought, F.col("_ob")).alias("output_bytes"), (~is_).alias("input_estimated"), (~is_ & exact.isNull()).alias("output_estimated"),
        F.lit(True).alias("input_bytes_estimated"), F.lit(True).alias("output_bytes_estimated"), F.when(is_, "compaction").alias("mode"), F.when(is_, "compaction").alias("agent"),
        "is_compaction", by(nought, F.col("_round")).alias("rounds"), "origin_key", "source_file",
    ))


def event_totals(lines: DataFrame) -> DataFrame:
    """(source_file, input_bytes, output_bytes, rounds, calls) of whole streams: input up to the last answer, user lines, answers and compactions."""
    rows = _event_sizes(lines)
    answers = F.sum(F.col("_close").cast("long"))
    last = F.max(F.when(F.col("_close"), F.col("_gid"))).over(Window.partitionBy("source_file"))
    rows = rows.withColumn("_read", F.when(F.col("_gid") <= last, F.col("_ib")).otherwise(0) + F.when(F.col("_close") & (F.col("_gid") < last), F.col("_ob")).otherwise(0))
    return rows.groupBy("source_file").agg(
        F.sum("_read").alias("input_bytes"), F.sum("_ob").alias("output_bytes"), F.sum("_user").alias("rounds"), (answers + F.sum(F.col("_compacted").cast("long"))).alias("calls")
    )


def apportion(records: DataFrame, totals: DataFrame) -> DataFrame:
    """Shutdown records with their stream's bytes by share of all tokens; rounds and calls of the whole stream on each."""
    w = Window.partitionBy("source_file")
    tokens = F.col("prompt") + F.col("completion") + F.col("reasoning")
    share = lambda total: F.when(F.sum(tokens).over(w) > 0, F.round(F.col(total) * (tokens / F.sum(tokens).over(w)))).otherwise(0).cast("long")
    whole = totals.select("source_file", *[F.col(c).alias(f"_{c}") for c in ("input_bytes", "output_bytes", "rounds", "calls")])
    joined = records.join(whole, "source_file", "left")
    made = {c: F.coalesce(share(f"_{c}"), F.lit(0)) for c in ("input_bytes", "output_bytes")} | {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in ("rounds", "calls")}
    return joined.withColumns(made).select(*records.columns)


def decode_event_files(lines: DataFrame) -> DataFrame:
    """Files with shutdown metrics give those, with bytes, rounds and calls of their stream; the others their stream's records."""
    metrics = F.coalesce(F.json_object_keys(F.to_json(_at("$.data.modelMetrics", "variant"))), F.array().cast("array<string>"))
    ended = F.coalesce((_at("$.type") == "session.shutdown") & (F.size(metrics) > 0), F.lit(False))
    files = _parsed(lines).where(ended).select("source_file").distinct()
    of = lines.join(files, "source_file", "left_semi")
    exact = apportion(shutdown_records(of, "copilot-cli"), event_totals(of))
    return exact.unionByName(decode_events(lines.join(files, "source_file", "left_anti")).select(*exact.columns))


def decode_pi(lines: DataFrame) -> DataFrame:
    """Message logs with exact usage; a model change sets provider and model, or clears them; user lines since the last call are its rounds."""
    kind, u = _at("$.type"), "$.message.usage"
    role = _at("$.message.role")
    message = (kind == "message") & (F.schema_of_variant(_at("$.message", "variant")).startswith("OBJECT"))
    size = _sizes("$.message.content")["bytes"]
    change = F.when(kind == "model_change", F.struct(_at("$.provider").alias("p"), _at("$.modelId").alias("m")))
    count = lambda path: F.coalesce(_at(f"{u}.{path}", "long"), F.lit(0))
    rows = _parsed(lines).select(
        "source_file", "line_no", "byte_offset", F.coalesce(message & _has(u), F.lit(False)).alias("_close"),
        F.last(F.when(kind == "session", _at("$.id")), ignorenulls=True).over(Window.partitionBy("source_file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("session_id"),
        _file_first(F.when(kind == "session", _at("$.cwd"))).alias("project_cwd"), F.last(change, ignorenulls=True).over(so_far()).alias("_change"),
        F.when(message & role.isin("user", "system", "toolResult"), size).otherwise(0).alias("_in"), F.when(message & (role == "assistant"), size).otherwise(0).alias("_out"),
        F.coalesce(message & (role == "user"), F.lit(False)).cast("long").alias("_user"), F.coalesce(_at("$.id"), _at("$.message.responseId")).alias("_id"),
        _at("$.message.provider").alias("_p"), _at("$.message.model").alias("_own"), _epoch().alias("ts"), count("input").alias("prompt"), count("output").alias("completion"),
        count("cacheRead").alias("cache_read"), count("cacheWrite").alias("cache_write"), _at(f"{u}.totalTokens", "long").alias("total_direct"), _at(f"{u}.cost.total", "double").alias("cost_embedded"),
        _at("$.message.api").alias("mode"), F.coalesce(_at("$.message.responseId"), _at("$.parentId")).alias("agent"),
    )
    rows = rows.withColumn("_gid", F.coalesce(F.sum(F.col("_close").cast("int")).over(before()), F.lit(0)))
    w = Window.partitionBy("source_file", "_gid").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    calls = rows.withColumns({"input_bytes": F.sum("_in").over(w), "output_bytes": F.sum("_out").over(w), "_rounds": F.sum("_user").over(w)}).where("_close")
    none = F.sum("_rounds").over(Window.partitionBy("source_file")) == 0
    calls = calls.withColumn("rounds", F.when(none & (F.col("_gid") == 0), 1).otherwise(F.col("_rounds")))
    return completed(with_origin_key(calls, "_id").select(
        F.lit("pi-agent").alias("source"), F.coalesce("session_id", _stem()).alias("session_id"), "project_cwd", F.coalesce("_p", "_change.p").alias("provider"), F.coalesce("_own", "_change.m").alias("model"),
        "ts", "prompt", "completion", "cache_read", "cache_write", "total_direct", "cost_embedded", "input_bytes", "output_bytes",
        F.lit(True).alias("input_bytes_estimated"), F.lit(True).alias("output_bytes_estimated"), "mode", "agent", "rounds", "origin_key", "source_file",
    ))


def decode_messages(message: DataFrame, session: DataFrame, project: DataFrame) -> DataFrame:
    """A message table (id, session_id, time_created ms, data JSON, and rowid where ids may lack) joined to sessions and projects."""
    d = lambda path, kind=None: F.get_json_object("data", path).try_cast(kind or "string")
    rows = message.where((d("$.role") == "assistant") & d("$.tokens").isNotNull())
    # messages without a parent are rounds of their own; dealt by id, they are no hot key of the window
    parent = F.coalesce(F.concat(F.lit("p"), d("$.parentID")), F.concat(F.lit("m"), "session_id", F.lit("/"), "id"))
    first = F.row_number().over(Window.partitionBy(parent).orderBy("time_created", "id")) == 1
    rows = rows.withColumn("rounds", F.when(d("$.parentID").isNull() | first, 1).otherwise(0))
    s = session.select(F.col("id").alias("_sid"), "project_id", "directory", F.col("title").alias("session_title"))
    joined = rows.join(s, F.col("session_id") == F.col("_sid"), "left").join(project.select(F.col("id").alias("_pid"), F.col("name").alias("project_name")), F.col("project_id") == F.col("_pid"), "left")
    n = lambda path: F.coalesce(d(path, "long"), F.lit(0))
    key = F.concat(F.lit("message:"), F.nullif(F.col("id"), F.lit("")))
    key = F.coalesce(key, F.concat(F.lit("rowid:"), F.col("rowid").cast("string"))) if "rowid" in message.columns else key
    return completed(joined.select(
        F.lit("opencode").alias("source"), "session_id", "session_title", "project_name", F.coalesce(d("$.path.cwd"), "directory").alias("project_cwd"), d("$.providerID").alias("provider"), d("$.modelID").alias("model"),
        F.timestamp_millis(F.coalesce(d("$.time.completed", "long"), d("$.time.created", "long"), "time_created")).alias("ts"), n("$.tokens.input").alias("prompt"), n("$.tokens.output").alias("completion"),
        n("$.tokens.reasoning").alias("reasoning"), n("$.tokens.cache.read").alias("cache_read"), n("$.tokens.cache.write").alias("cache_write"), F.when(d("$.cost", "double") > 0, d("$.cost", "double")).alias("cost_embedded"),
        F.lit(True).alias("input_bytes_estimated"), F.lit(True).alias("output_bytes_estimated"), "rounds", key.alias("origin_key"), F.lit(None).cast("string").alias("source_file"),
    ))


# The prompt that the search plugin sends with its results.
SUMMARY_HEAD = """You are writing the final web search summary for a coding assistant.
Write a concise, factual summary using only the provided search results.
Requirements:
- Keep it readable and skimmable.
- Include key findings and caveats.
- Do not invent sources or claims.
- If evidence is weak or conflicting, say so explicitly.
- End with a short "Sources" section listing the most relevant URLs.

<search_results>
"""
SUMMARY_TAIL = "\n\n</search_results>"
_SUMMARY = (
    "curatedQueries array<struct<query:string,provider:string,answer:string,sources:array<struct<title:string,url:string>>,results:array<struct<title:string,url:string>>,error:string>>, "
    "summary struct<text:string,workflow:string,model:string,tokenEstimate:long,fallbackUsed:boolean>"
)


def _query_text(q: Column) -> Column:
    """One search result as the prompt words it."""
    text = lambda c, other="": F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    links = F.when(F.size(q["results"]) > 0, q["results"]).otherwise(F.coalesce(q["sources"], F.array().cast("array<struct<title:string,url:string>>")))
    listed = F.transform(links, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), text(x["title"]), F.lit(" — "), text(x["url"])))
    sources = F.when(F.size(links) > 0, F.concat(F.lit("Sources:\n"), F.array_join(listed, "\n"))).otherwise("Sources: none")
    found = F.concat_ws(
        "\n", F.concat(F.lit("Query: "), text(q["query"])), F.concat(F.lit("Provider: "), F.coalesce(q["provider"], F.lit("unknown"))),
        F.concat(F.lit("Answer: "), text(q["answer"], "(no answer text returned)")), sources,
    )
    return F.when(q["error"].isNotNull(), F.concat(F.lit("Query: "), text(q["query"]), F.lit("\nStatus: Error\nError: "), q["error"])).otherwise(found)


def decode_pi_plugin(lines: DataFrame) -> DataFrame:
    """Estimated records of search summaries in tool results; the prompt is worded anew from the curated queries."""
    rows = lines.where(field("$.type") == "message").withColumn("_d", F.from_json(field("$.message.details"), _SUMMARY))
    done = F.col("_d.summary")
    rows = rows.where((done["workflow"] == "summary-review") & ~F.coalesce(done["fallbackUsed"], F.lit(False)) & done["model"].isNotNull())
    each = F.transform(F.coalesce("_d.curatedQueries", F.array().cast(rows.select("_d.curatedQueries").schema[0].dataType)), lambda q, i: F.concat(F.lit("\n[Result "), (i + 1).cast("string"), F.lit("]\n"), _query_text(q)))
    prompt = F.concat(F.lit(SUMMARY_HEAD), F.array_join(each, "\n"), F.when(F.size(each) > 0, SUMMARY_TAIL).otherwise(SUMMARY_TAIL[1:]))
    model = done["model"]
    head, rest = F.when(F.contains(model, F.lit("/")), F.substring_index(model, "/", 1)), F.regexp_replace(model, "^[^/]*/", "")
    rows = rows.withColumns({"_id": F.nullif(F.coalesce(field("$.id"), field("$.message.responseId")), F.lit("")), "_prompt": prompt})
    session = F.coalesce(_file_first(F.when(field("$.type") == "session", field("$.id"))), _stem())
    of = lines.select("source_file", session.alias("session_id"), _file_first(F.when(field("$.type") == "session", field("$.cwd"))).alias("project_cwd")).distinct()
    rows = rows.join(of.withColumnRenamed("source_file", "_f"), F.col("source_file") == F.col("_f"), "left").drop("_f")
    return completed(with_origin_key(rows, "_id", 1).select(
        F.lit("pi-agent").alias("source"), "session_id", "project_cwd", head.alias("provider"), rest.alias("model"), F.coalesce(field("$.timestamp", "timestamp"), F.lit(0).cast("timestamp")).alias("ts"),
        F.ceil(F.char_length("_prompt") / 4).cast("long").alias("prompt"), F.coalesce(done["tokenEstimate"], F.lit(0).cast("long")).alias("completion"),
        F.octet_length("_prompt").cast("long").alias("input_bytes"), F.octet_length(F.trim(F.coalesce(done["text"], F.lit("")))).cast("long").alias("output_bytes"),
        *[F.lit(True).alias(c) for c in ("input_estimated", "output_estimated", "input_bytes_estimated", "output_bytes_estimated")],
        done["workflow"].alias("mode"), field("$.parentId").alias("agent"), F.lit(0).alias("rounds"), F.lit(1).alias("calls"), "origin_key", "source_file",
    ))
