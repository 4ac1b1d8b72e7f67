"""Decoder queries: log lines made from the conversations table, decoded, against SQL over that table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import incremental
from ..sources import decoders, lines
from . import views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _lines(rows: DataFrame, *, user: Column | None = None, assistant: Column | None = None, extra: list[tuple[Column, int, Column]] = ()) -> DataFrame:
    """One JSON line for each row by role, plus (condition, shift, line) more; lines are numbered in tens."""
    parts = [rows.select("source_file", (F.col("line_no") * 10).alias("line_no"), F.when(F.col("role") == "assistant", assistant).when(F.col("role").isin("user", "system"), user).alias("value"))]
    parts += [rows.where(when).select("source_file", (F.col("line_no") * 10 + shift).alias("line_no"), line.alias("value")) for when, shift, line in extra]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("value is not null").withColumn("byte_offset", F.col("line_no").cast("long") * 1000)


def _js(**fields) -> Column:
    return F.to_json(F.struct(*[(F.lit(v) if isinstance(v, (str, int)) else v).alias(k) for k, v in fields.items()]))


def _st(**fields) -> Column:
    return F.struct(*[(F.lit(v) if isinstance(v, (str, int)) else v).alias(k) for k, v in fields.items()])


_NOT_CALL = "role IN ('user', 'system')"
_LOG = f"log AS ({views.LOG_DUCK}), w AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY source_file ORDER BY line_no) AS users, count(*) FILTER (role = 'assistant') OVER (PARTITION BY source_file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gid FROM log)"
_PENDING = """p AS (SELECT source_file, gid, sum(CASE WHEN role <> 'assistant' THEN bytes ELSE 0 END) AS ib, sum(CASE WHEN role <> 'assistant' THEN CAST(ceil(chars / 4) AS BIGINT) ELSE 0 END) AS it,
    sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS us, max(CASE WHEN role = 'assistant' THEN line_no END) AS line_no, max(CASE WHEN role = 'assistant' THEN bytes END) AS ob, max(CASE WHEN role = 'assistant' THEN CAST(ceil(chars / 4) AS BIGINT) END) AS ot FROM w GROUP BY 1, 2)"""


def _key(origin: Column) -> Column:
    return F.regexp_extract(origin, r"^offset:(\d+):", 1).cast("long")


@_query(
    "decode_claude",
    f"""WITH log AS ({views.LOG_DUCK}), w AS (
        SELECT *, greatest(1, count(*) FILTER (role = 'user' AND line_no % 4 <> 2) OVER (PARTITION BY source_file ORDER BY line_no)) AS round FROM log)
      SELECT source_file, CASE line_no % 3 WHEN 0 THEN 'event:u' || line_no WHEN 1 THEN 'event:m' || line_no ELSE 'offset:' || line_no * 10000 END || ':slot:0' AS origin_key,
        10 * line_no AS prompt, CAST(chars AS BIGINT) AS completion, CAST(CASE WHEN line_no % 2 = 0 THEN line_no + 3 ELSE line_no END AS BIGINT) AS cache_write,
        CAST(CASE WHEN row_number() OVER (PARTITION BY source_file, round ORDER BY line_no) = 1 THEN 1 ELSE 0 END AS BIGINT) AS rounds, CASE WHEN line_no % 5 <> 0 THEN 'm-1' END AS model,
        'anthropic' AS provider, replace(source_file, '.jsonl', '') AS session_id, '/home/' || replace(replace(source_file, '.jsonl', ''), '-', '/') AS project_cwd
      FROM w WHERE role = 'assistant'""",
)
def decode_claude(spark, sf_dir):
    """Calls with and without ids and models, before the first user line and after tool results; caches in both forms; directories from the folder's name."""
    n = F.col("line_no")
    log = views.session_log(spark, sf_dir).where("role is not null")
    made = F.when(n % 2 == 0, _st(ephemeral_5m_input_tokens=n, ephemeral_1h_input_tokens=3))
    usage = _st(input_tokens=n * 10, output_tokens=F.col("chars"), cache_creation_input_tokens=n, cache_creation=made)
    name = lambda when, head: F.when(n % 3 == when, F.concat(F.lit(head), n.cast("string")))
    said = F.when(n % 4 == 2, _js(type="user", message=_st(role="user", content=F.array(_st(type="text", text="x"), _st(type="tool_result", text=F.col("text")))))).otherwise(_js(type="user", message=_st(role="user", content=F.col("text"))))
    answer = _js(type="assistant", uuid=name(0, "u"), message=_st(role="assistant", id=name(1, "m"), model=F.when(n % 5 == 0, "").otherwise("m-1"), usage=usage))
    lines_ = _lines(log, user=F.when(F.col("role") == "user", said), assistant=answer)
    stem = F.regexp_replace("source_file", r"\.jsonl$", "")
    lines_ = lines_.withColumn("source_file", F.concat(F.lit("x/-home-"), stem, F.lit("/"), "source_file"))
    got = decoders.decode_claude(lines_).withColumn("source_file", F.regexp_extract("source_file", "[^/]*$", 0))
    return got.select("source_file", "origin_key", "prompt", "completion", "cache_write", "rounds", "model", "provider", "session_id", "project_cwd")


@_query("decode_codex", f"WITH {_LOG}, {_PENDING} SELECT source_file, CAST(line_no AS BIGINT) * 10000 + 5000 AS key, CAST(ob AS BIGINT) AS prompt, CAST(2 * ob AS BIGINT) AS completion, CAST(ib AS BIGINT) AS input_bytes, CAST(ob AS BIGINT) AS output_bytes, 'm-2' AS model, CASE WHEN length(source_file) % 2 = 0 THEN 'host' ELSE 'openai' END AS provider, 'sid' AS session_id, CAST(9 * ob AS BIGINT) AS total_direct FROM p WHERE line_no IS NOT NULL")
def decode_codex(spark, sf_dir):
    log = views.session_log(spark, sf_dir)
    running = F.sum(F.when(F.col("role") == "assistant", F.col("bytes")).otherwise(0)).over(Window.partitionBy("source_file").orderBy("line_no"))
    log = log.withColumn("run", running)
    item = lambda role: _js(type="response_item", payload=_st(type="message", role=role, content=F.array(_st(type="text", text=F.col("text")))))
    total = _st(input_tokens=F.col("run") * 2, cached_input_tokens=F.col("run"), output_tokens=F.col("run") * 3, reasoning_output_tokens=F.col("run"), total_tokens=F.col("run") * 9)
    count = _js(type="event_msg", payload=_st(type="token_count", info=_st(total_token_usage=total)))
    made = _lines(log, user=item(F.col("role")), assistant=item("assistant"), extra=[
        (F.col("role") == "assistant", 5, count), (F.col("role") == "assistant", -5, _js(type="turn_context", payload=_st(model="m-2", turn_id="t"))),
    ])
    # every other file wraps its session's data and names only an originator
    meta = F.when(F.length("source_file") % 2 == 0, _js(type="session_meta", payload=_st(meta=_st(id="sid", cwd="/w", originator="host")))).otherwise(_js(type="session_meta", payload=_st(id="sid", cwd="/w", model_provider="openai")))
    head = log.select("source_file").distinct().select("source_file", F.lit(-99).cast(made.schema["line_no"].dataType).alias("line_no"), meta.alias("value"), F.lit(0).cast("long").alias("byte_offset"))
    return decoders.decode_codex(made.unionByName(head)).select("source_file", _key(F.col("origin_key")).alias("key"), "prompt", "completion", "input_bytes", "output_bytes", "model", "provider", "session_id", "total_direct")


#: Sizes of what the event lines of event_lines() hold: nested data of messages, answers with tool requests, tool results.
_EVENTS = f"""log AS ({views.LOG_DUCK} WHERE role IN ('user', 'system', 'assistant')),
  w AS (SELECT *, role = 'assistant' AS a, count(*) FILTER (role = 'assistant') OVER (PARTITION BY source_file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gid,
      count(*) FILTER (role = 'user') OVER (PARTITION BY source_file ORDER BY line_no) AS users,
      coalesce(last_value(CASE WHEN line_no % 5 = 0 THEN 'gpt-' || line_no END IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY line_no), 'unknown') AS model FROM log),
  z AS (SELECT *, CASE WHEN a THEN 0 ELSE CAST(ceil((2 * chars + length(role)) / 4) AS BIGINT) END AS it, CASE WHEN a THEN 0 ELSE 2 * bytes + length(role) END AS ib,
      CASE WHEN a THEN CAST(ceil(chars / 4) + ceil((3 + chars) / 4) AS BIGINT) END AS ot, CASE WHEN a THEN 2 * bytes + 3 END AS ob,
      CASE WHEN a THEN CAST(ceil((1 + chars) / 4) AS BIGINT) END AS tt, CASE WHEN a THEN bytes + 1 END AS tb FROM w),
  g AS (SELECT source_file, gid, sum(it) AS it, sum(ib) AS ib FROM z GROUP BY 1, 2)"""


def event_lines(spark, sf_dir, name: bool = True) -> DataFrame:
    """Event streams of the conversations: messages with nested data, answers that ask for tools, tool results, model changes and compactions."""
    n = F.col("line_no")
    log = views.session_log(spark, sf_dir).where("role in ('user', 'system', 'assistant')")
    answer = F.col("role") == "assistant"
    told = _js(type=F.concat("role", F.lit(".message")), data=_st(content=F.col("text"), parts=F.array(_st(deep=_st(note=F.col("text"), kind=F.col("role"))))))
    request = F.array(_st(name="run", arguments=_st(cmd=F.col("text"), n=1)))
    ident = lambda when, head: F.when(when, F.concat(F.lit(head), n.cast("string")))
    said = _js(type="assistant.message", id=ident(n % 3 == 0, "a"), data=_st(messageId=ident(n % 2 == 0, "m"), content=F.col("text"), outputTokens=F.when(n % 4 == 1, n), toolRequests=request))
    result = _js(type="tool.execution_complete", data=_st(toolCallId="t", result=_st(content=F.col("text"))))
    used = _st(inputTokens=n * 5, output=n, cachedInput=2, model=F.when(n % 2 == 0, "other/x"))
    made = _lines(log, user=told, assistant=said, extra=[
        (answer, 5, result), (answer & (n % 4 == 3), 7, _js(type="session.compaction_complete", id=ident(n >= 0, "c"), data=_st(compactionTokensUsed=used))),
        (n % 5 == 0, -5, _js(type="session.model_change", data=_st(newModel=F.concat(F.lit("openai/gpt-"), n.cast("string"))))),
    ])
    return made.withColumn("source_file", F.concat(F.lit("logs/"), "source_file", F.lit("/events.jsonl")))


@_query(
    "decode_events",
    f"""WITH {_EVENTS}, c AS (SELECT z.*, g.it AS gi, g.ib AS gb, coalesce(lag(ot + tt) OVER (PARTITION BY z.source_file ORDER BY line_no), 0) AS pt, coalesce(lag(ob + tb) OVER (PARTITION BY z.source_file ORDER BY line_no), 0) AS pb
        FROM z JOIN g ON z.source_file = g.source_file AND z.gid = g.gid WHERE a)
      SELECT source_file AS session_id, CASE WHEN line_no % 3 = 0 THEN 'event:a' || line_no WHEN line_no % 2 = 0 THEN 'message:m' || line_no ELSE 'offset:' || line_no * 10000 END || ':assistant' AS origin_key,
        'github-copilot' AS provider, model, CAST(gi + pt AS BIGINT) AS prompt, CAST(CASE WHEN line_no % 4 = 1 THEN line_no ELSE ot END AS BIGINT) AS completion, CAST(0 AS BIGINT) AS cache_read,
        CAST(gb + pb AS BIGINT) AS input_bytes, CAST(ob AS BIGINT) AS output_bytes, line_no % 4 <> 1 AS output_estimated, FALSE AS is_compaction, CAST(CASE WHEN users > 0 THEN 1 ELSE 0 END AS BIGINT) AS rounds FROM c
      UNION ALL
      SELECT source_file, 'event:c' || line_no || ':compaction', CASE WHEN line_no % 2 = 0 THEN 'other' ELSE 'github-copilot' END, CASE WHEN line_no % 2 = 0 THEN 'x' ELSE model END, CAST(line_no * 5 AS BIGINT), CAST(line_no AS BIGINT),
        CAST(2 AS BIGINT), 0, 0, FALSE, TRUE, 0 FROM z WHERE a AND line_no % 4 = 3""",
)
def decode_events(spark, sf_dir):
    return decoders.decode_events(event_lines(spark, sf_dir)).select(
        "session_id", "origin_key", "provider", "model", "prompt", "completion", "cache_read", "input_bytes", "output_bytes", "output_estimated", "is_compaction", "rounds"
    )


@_query(
    "decode_event_files",
    f"""WITH {_EVENTS}, last AS (SELECT source_file, max(gid) AS last FROM z WHERE a GROUP BY 1),
      t AS (SELECT z.source_file, sum(CASE WHEN gid <= last THEN ib ELSE 0 END) + sum(CASE WHEN a AND gid < last THEN ob + tb ELSE 0 END) AS ib, sum(coalesce(ob, 0)) AS ob, count(*) FILTER (role = 'user') AS users,
          count(*) FILTER (a) + count(*) FILTER (a AND line_no % 4 = 3) AS calls, max(line_no) AS n FROM z LEFT JOIN last USING (source_file) GROUP BY 1),
      m(model, i, cr, o, rs) AS (VALUES ('gpt-5', 10, 4, 3, 1), ('solo', 2, 3, 5, 0)), x AS (SELECT *, greatest(i * n - cr * n, 0) AS p, o * n AS c, sum(greatest(i * n - cr * n, 0) + o * n) OVER (PARTITION BY source_file) AS whole FROM t, m),
      stream AS (SELECT source_file, count(*) AS k FROM z WHERE a GROUP BY 1)
      SELECT source_file AS session_id, model, CAST(p AS BIGINT) AS prompt, CAST(c - rs * n AS BIGINT) AS completion, CAST(CASE WHEN whole > 0 THEN round(coalesce(ib, 0) * (p + c) / whole) ELSE 0 END AS BIGINT) AS input_bytes,
        CAST(CASE WHEN whole > 0 THEN round(ob * (p + c) / whole) ELSE 0 END AS BIGINT) AS output_bytes, CAST(users AS BIGINT) AS rounds, CAST(calls AS BIGINT) AS calls FROM x WHERE length(source_file) % 2 = 0
      UNION ALL SELECT source_file, 'stream', k, 0, 0, 0, 0, 0 FROM stream WHERE length(source_file) % 2 = 1""",
)
def decode_event_files(spark, sf_dir):
    """Every other file ends in metrics of two models, with caches; the rest are told by how many answers they have."""
    made = event_lines(spark, sf_dir)
    stem = F.regexp_extract("source_file", "^logs/(.*)/events", 1)
    ends = made.groupBy("source_file").agg(F.max("line_no").alias("end")).where(F.length(stem) % 2 == 0).join(
        views.session_log(spark, sf_dir).where("role in ('user', 'system', 'assistant')").groupBy(F.col("source_file").alias("f")).agg(F.max("line_no").alias("n")), stem == F.col("f")
    )
    n = F.col("n")
    metric = lambda i, cr, o, rs: _st(usage=_st(inputTokens=n * i, outputTokens=n * o, reasoningTokens=n * rs, cacheReadTokens=n * cr, cacheWriteTokens=0))
    metrics = F.create_map(F.lit("openai/gpt-5"), metric(10, 4, 3, 1), F.lit("solo"), metric(2, 3, 5, 0))
    start = _js(type="session.start", data=_st(sessionId=F.col("f")))
    both = [(F.lit(-99).cast("long"), start), (F.col("end") + 1, _js(type="session.shutdown", data=_st(modelMetrics=metrics)))]
    for line_no, value in both:
        made = made.unionByName(ends.select("source_file", line_no.alias("line_no"), value.alias("value"), F.lit(0).cast("long").alias("byte_offset")))
    got = decoders.decode_event_files(made)
    exact = got.where("mode = 'session.shutdown'").select("session_id", "model", "prompt", "completion", "input_bytes", "output_bytes", "rounds", "calls")
    rest = got.where("mode is null").groupBy("session_id").agg(F.count("*").alias("prompt"))
    zeros = {c: F.lit(0).cast("long") for c in exact.columns if c not in ("session_id", "model", "prompt")}
    return exact.unionByName(rest.withColumns({"model": F.lit("stream")} | zeros))


@_query(
    "decode_pi",
    f"""WITH log AS ({views.LOG_DUCK} WHERE role IN ('user', 'system', 'assistant')),
      w AS (SELECT *, role = 'assistant' OR (role = 'system' AND line_no % 2 = 1) AS close FROM log),
      x AS (SELECT *, coalesce(sum(CAST(close AS INT)) OVER (PARTITION BY source_file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gid,
          max(CASE WHEN line_no % 3 = 0 THEN line_no END) OVER (PARTITION BY source_file ORDER BY line_no) AS change FROM w),
      g AS (SELECT source_file, gid, sum(CASE WHEN role <> 'assistant' THEN bytes + 4 ELSE 0 END) AS ib, sum(CASE WHEN role = 'assistant' THEN 3 * bytes + 12 ELSE 0 END) AS ob, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS us FROM x GROUP BY 1, 2),
      c AS (SELECT x.*, g.ib, g.ob, g.us, sum(g.us) OVER (PARTITION BY x.source_file) AS all_us FROM x JOIN g ON x.source_file = g.source_file AND x.gid = g.gid WHERE close)
      SELECT source_file AS session_id, CASE line_no % 3 WHEN 0 THEN 'event:i' || line_no WHEN 1 THEN 'event:r' || line_no ELSE 'offset:' || line_no * 10000 END || ':slot:0' AS origin_key,
        CASE WHEN change % 2 = 0 THEN 'p' || change END AS provider, 'm' || change AS model, CAST(7 * line_no AS BIGINT) AS prompt, CAST(chars AS BIGINT) AS completion, CAST(ib AS BIGINT) AS input_bytes, CAST(ob AS BIGINT) AS output_bytes,
        CAST(CASE WHEN all_us = 0 AND gid = 0 THEN 1 ELSE us END AS BIGINT) AS rounds, line_no / 100.0 AS cost_embedded, 'api' AS mode, CASE WHEN line_no % 3 = 1 THEN 'r' || line_no ELSE 'up' END AS agent FROM c""",
)
def decode_pi(spark, sf_dir):
    """Answers with thinking and tool calls, usage on other roles, several user lines to a call, model changes without a provider, later session headers."""
    n = F.col("line_no")
    log = views.session_log(spark, sf_dir).where("role in ('user', 'system', 'assistant')")
    usage = _st(input=n * 7, output=F.col("chars"), cost=_st(total=n / 100))
    ident = lambda when, head: F.when(n % 3 == when, F.concat(F.lit(head), n.cast("string")))
    closes = (F.col("role") == "assistant") | ((F.col("role") == "system") & (n % 2 == 1))
    told = F.array(_st(type="text", text=F.col("text")))
    said = F.to_json(F.array(_st(type="text", text=F.col("text"), x=_st(thinking=F.col("text"), arguments=_st(cmd=F.col("text")), n=1), tag="toolCall")))
    line = lambda content: _js(type="message", id=ident(0, "i"), parentId="up", message=_st(role=F.col("role"), content=content, usage=F.when(closes, usage), api="api", responseId=ident(1, "r")))
    content = F.from_json(said, "array<struct<text:string,x:struct<thinking:string,arguments:struct<cmd:string>,n:int>,tag:string,type:string>>")
    change = _js(type="model_change", modelId=F.concat(F.lit("m"), n.cast("string")), provider=F.when(n % 2 == 0, F.concat(F.lit("p"), n.cast("string"))))
    made = _lines(log, user=line(told), assistant=line(content), extra=[
        (n % 3 == 0, -5, change), (n >= 0, 8, _js(type="session", id=F.col("source_file"))), (n >= 0, -8, _js(type="session", id="early")),
    ])
    return decoders.decode_pi(made).select("session_id", "origin_key", "provider", "model", "prompt", "completion", "input_bytes", "output_bytes", "rounds", "cost_embedded", "mode", "agent")


@_query(
    "decode_shutdown",
    f"""WITH {_LOG}, s AS (SELECT source_file, count(*) AS n, sum(bytes) AS b FROM log GROUP BY 1), m(model, provider, i, cr, o, rs, c) AS (VALUES ('gpt-5', 'openai', 10, 4, 3, 1, 2), ('solo', 'github-copilot', 2, 3, 5, 0, NULL))
      SELECT source_file, model, provider, CAST(greatest(i * n - cr * n, 0) AS BIGINT) AS prompt, CAST(cr * n AS BIGINT) AS cache_read, CAST((o - rs) * b AS BIGINT) AS completion, CAST(rs * b AS BIGINT) AS reasoning, CAST(coalesce(c, 1) AS BIGINT) AS calls FROM s, m""",
)
def decode_shutdown(spark, sf_dir):
    s = views.session_log(spark, sf_dir).groupBy("source_file").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    n, b = F.col("n"), F.col("b")
    none = F.lit(None).cast("int")
    metric = lambda i, cr, o, rs, c: _st(usage=_st(inputTokens=n * i, outputTokens=b * o, reasoningTokens=b * rs, cacheReadTokens=n * cr, cacheWriteTokens=0), requests=_st(count=c))
    metrics = F.create_map(F.lit("openai/gpt-5"), metric(10, 4, 3, 1, F.lit(2)), F.lit("solo"), metric(2, 3, 5, 0, none))
    made = s.select("source_file", F.lit(0).alias("line_no"), F.lit(0).cast("long").alias("byte_offset"), _js(type="session.shutdown", timestamp="2024-01-01T00:00:00Z", data=_st(modelMetrics=metrics)).alias("value"))
    return decoders.shutdown_records(made, "copilot-cli").select("source_file", "model", "provider", "prompt", "cache_read", "completion", "reasoning", "calls")


@_query(
    "decode_messages",
    """WITH a AS (SELECT *, conv_id || '/' || turn AS id, conv_id || '|' || CAST(floor(turn / 4) AS INT) AS parent FROM conversations WHERE role = 'assistant')
      SELECT id, 'p' || (conv_id % 3) AS project_name, CAST(length(text) AS BIGINT) AS completion, CAST(CASE WHEN row_number() OVER (PARTITION BY parent ORDER BY conv_id * 100000 + turn, id) = 1 THEN 1 ELSE 0 END AS BIGINT) AS rounds FROM a""",
)
def decode_messages(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    parent = F.concat_ws("|", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 4).cast("string"))
    data = _js(role=F.col("role"), parentID=parent, tokens=_st(input=F.col("turn"), output=F.char_length("text")))
    message = c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").cast("string").alias("session_id"), (F.col("conv_id") * 100000 + F.col("turn")).alias("time_created"), data.alias("data"))
    session = c.select(F.col("conv_id").cast("string").alias("id"), (F.col("conv_id") % 3).cast("string").alias("project_id"), F.lit("/d").alias("directory"), F.lit("t").alias("title")).distinct()
    project = c.select((F.col("conv_id") % 3).cast("string").alias("id"), F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("name")).distinct()
    out = decoders.decode_messages(message, session, project)
    return out.select(F.regexp_extract("origin_key", "^message:(.*)$", 1).alias("id"), "project_name", "completion", "rounds")


@_query("file_status", "SELECT concat('conv-', CAST(conv_id AS VARCHAR), '.jsonl') AS source_file, conv_id % 10 <> 3 AS complete FROM conversations GROUP BY conv_id")
def file_status(spark, sf_dir):
    log = views.session_log(spark, sf_dir)
    broken = F.regexp_extract("source_file", r"(\d+)\.jsonl", 1).cast("long") % 10 == 3
    made = log.select("source_file", F.when(broken & (F.col("line_no") == F.min("line_no").over(Window.partitionBy("source_file"))), F.lit('{"cut": ')).otherwise(_js(text=F.col("text"))).alias("value"))
    return lines.file_status(made)


_OLD = "o_orderkey % 4 <> 0"
_NEW = "o_orderkey % 5 <> 0"


@_query(
    "reconcile",
    f"""WITH f AS (SELECT 'f' || (o_custkey % 50) AS source_file, 'k' || o_orderkey AS origin_key, o_orderkey, o_totalprice AS v FROM orders),
      old AS (SELECT source_file, origin_key, v FROM f WHERE {_OLD}), new AS (SELECT source_file, origin_key, CASE WHEN o_orderkey % 7 = 0 THEN v + 1 ELSE v END AS v FROM f WHERE {_NEW}),
      ok AS (SELECT DISTINCT source_file FROM new WHERE CAST(substr(source_file, 2) AS INT) % 3 <> 0)
      SELECT coalesce(o.source_file, n.source_file) AS source_file, coalesce(o.origin_key, n.origin_key) AS origin_key,
        CASE WHEN ok.source_file IS NULL THEN o.v ELSE coalesce(n.v, o.v) END AS v,
        CASE WHEN ok.source_file IS NULL THEN 'unchanged' WHEN o.origin_key IS NULL THEN 'insert' WHEN n.origin_key IS NULL THEN 'delete' WHEN o.v <> n.v THEN 'update' ELSE 'unchanged' END AS op
      FROM old o FULL JOIN new n USING (source_file, origin_key) LEFT JOIN ok ON ok.source_file = coalesce(o.source_file, n.source_file) WHERE ok.source_file IS NOT NULL OR o.origin_key IS NOT NULL""",
)
def reconcile(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    f = o.select(F.concat(F.lit("f"), (F.col("o_custkey") % 50).cast("string")).alias("source_file"), F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("origin_key"), "o_orderkey", F.col("o_totalprice").alias("v"))
    old = f.where(_OLD).select("source_file", "origin_key", "v")
    new = f.where(_NEW).select("source_file", "origin_key", F.when(F.col("o_orderkey") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("v"))
    status = new.select("source_file").distinct().withColumn("complete", F.substring("source_file", 2, 10).cast("int") % 3 != 0)
    return incremental.reconcile(old, new, status)
