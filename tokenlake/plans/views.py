"""Views of the driver's tables in the engine's schemas, as text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_USAGE = """
SELECT CASE event_type WHEN 'click' THEN 'codex' WHEN 'view' THEN 'claude' WHEN 'purchase' THEN 'opencode'
            WHEN 'signup' THEN 'copilot' ELSE 'pi-agent' END AS source,
  concat('session-', lpad(CAST(user_id AS {S}), 6, '0'), '-', CAST(k % 4 AS {S})) AS session_id,
  CASE WHEN k % 4 = 0 THEN 'root' ELSE 'sub_agent' END AS session_kind,
  CASE WHEN k % 4 > 0 THEN concat('session-', lpad(CAST(user_id AS {S}), 6, '0'), '-', CAST(k % 4 - 1 AS {S})) END AS parent_session_id,
  CASE WHEN k % 5 > 0 THEN concat('/home/dev/proj', CAST(k % 5 AS {S})) END AS project_cwd,
  CASE WHEN k % 10 = 1 THEN 'named' END AS project_name,
  CASE k % 6 WHEN 1 THEN 'openai' WHEN 2 THEN 'anthropic' WHEN 3 THEN 'github-copilot' WHEN 4 THEN 'google' WHEN 5 THEN 'free-host' END AS provider,
  CASE k % 8 WHEN 1 THEN 'gpt-5' WHEN 2 THEN 'openai/gpt-5-2025-08-07' WHEN 3 THEN 'claude-sonnet-4-5-20250929'
       WHEN 4 THEN 'claude-opus-4-5-thinking' WHEN 5 THEN 'GPT-5-Chat-Latest' WHEN 6 THEN 'gemini-3-flash-preview' WHEN 7 THEN 'future-model-xyz' END AS model,
  CAST(ts AS TIMESTAMP) AS ts,
  CAST(floor(value * 10) AS BIGINT) AS prompt, CAST(floor(value * 3) AS BIGINT) AS completion,
  CAST(user_id * 4 + k AS BIGINT) AS input_bytes, CAST(k * 3 AS BIGINT) AS output_bytes,
  k % 7 = 0 AS input_estimated, k % 11 = 0 AS output_estimated, TRUE AS input_bytes_estimated, TRUE AS output_bytes_estimated,
  CAST(k AS BIGINT) AS reasoning, CAST(user_id * 7 AS BIGINT) AS cache_read, CAST(k % 3 AS BIGINT) AS cache_write,
  CASE WHEN event_type = 'signup' AND k % 10 = 0 THEN 'session.shutdown' END AS mode,
  CAST(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS rounds, CAST(1 AS BIGINT) AS calls,
  CASE WHEN event_type = 'purchase' THEN value / 100 END AS cost_embedded,
  concat('event:', CAST(event_id AS {S}), ':slot:0') AS origin_key, concat('f', CAST(user_id % 20 AS {S})) AS source_file
FROM (SELECT *, CAST({J} AS BIGINT) AS k FROM {events}) e
"""

_EVENTS = """
SELECT CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'upsert' END AS op,
  CAST({day} AS TIMESTAMP) AS ts, concat('c', CAST(o_orderkey % 60 AS {S})) AS commit_sha,
  CAST(o_orderkey % 60 AS INT) AS commit_seq, CAST(o_orderkey AS BIGINT) AS sequence,
  CASE o_custkey % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'google' ELSE 'free-host' END AS provider,
  CASE CAST(floor(o_custkey / 4) AS INT) % 5 WHEN 0 THEN 'gpt-5' WHEN 1 THEN 'claude-sonnet-4.5' WHEN 2 THEN 'claude-opus-4.5' WHEN 3 THEN 'gemini-3-flash' ELSE 'future-model-xyz' END AS model,
  CASE WHEN o_custkey % 4 = 3 THEN CAST(0 AS DECIMAL(18,6)) ELSE CAST(o_totalprice / 10000 AS DECIMAL(18,6)) END AS input,
  CASE WHEN o_custkey % 4 = 3 THEN CAST(0 AS DECIMAL(18,6)) ELSE CAST(floor(o_totalprice / 1000) AS DECIMAL(18,6)) END AS output,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS DECIMAL(18,6)) WHEN o_custkey % 4 = 3 THEN CAST(0 AS DECIMAL(18,6)) ELSE CAST(5 AS DECIMAL(18,6)) END AS reasoning,
  CAST(CASE WHEN o_custkey % 4 = 3 THEN 0 ELSE o_orderkey % 7 END AS DECIMAL(18,6)) AS cache_read,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN NULL WHEN o_custkey % 4 = 3 THEN 0 ELSE o_orderkey % 5 END AS DECIMAL(18,6)) AS cache_write
FROM {orders}
"""

#: alias -> canonical name
ALIASES = {"gpt-5": "gpt-5", "claude-sonnet-4.5": "claude-sonnet-4.5", "claude-opus-4.5": "claude-opus-4.5", "gemini-3-flash": "gemini-3-flash"}
#: canonical name -> official provider
OFFICIAL = {"gpt-5": "openai", "claude-sonnet-4.5": "anthropic", "claude-opus-4.5": "anthropic", "gemini-3-flash": "google"}
#: (provider, model or None, multiplier or None, included or None)
POLICIES = (("github-copilot", None, None, True), ("github-copilot", "gpt-5", "0", False), ("github-copilot", "claude-opus-4.5", "10", None), ("anthropic", None, "1.5", None))
#: (provider, canonical name, model, position)
FAMILIES = (("google", "gpt-5", "gemini-3-flash", 1), ("openai", "claude-opus-4.5", "future-model-xyz", 2))

USAGE_DUCK = _USAGE.format(S="VARCHAR", J="json_extract_string(props, '$.k')", events="events")
EVENTS_DUCK = _EVENTS.format(S="VARCHAR", orders="orders", day="CAST('2023-12-15' AS DATE) + CAST(o_orderkey % 60 AS INT)")
LOG_DUCK = "SELECT concat('conv-', CAST(conv_id AS VARCHAR), '.jsonl') AS source_file, turn AS line_no, role, text, octet_length(encode(text)) AS bytes, length(text) AS chars FROM conversations"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _USAGE.format(S="STRING", J="get_json_object(props, '$.k')", events="{events}")
    return spark.sql(sql, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def price_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _EVENTS.format(S="STRING", orders="{orders}", day="date_add(CAST('2023-12-15' AS DATE), CAST(o_orderkey % 60 AS INT))")
    return spark.sql(sql, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "SELECT concat('conv-', CAST(conv_id AS STRING), '.jsonl') AS source_file, turn AS line_no, role, text, octet_length(text) AS bytes, char_length(text) AS chars FROM {c}",
        c=spark.read.parquet(f"{sf_dir}/conversations.parquet"),
    )


def official(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(OFFICIAL.items()), "canonical string, official string")


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FAMILIES), "provider string, canonical_name string, model string, position int")


def policies(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(POLICIES), "provider string, model string, multiplier string, included boolean")
    return rows.withColumn("multiplier", rows["multiplier"].cast("decimal(6,3)"))
