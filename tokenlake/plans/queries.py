"""Registered queries of the engine's own operators over the driver's tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.storage import folder, removed, stored
from ..operators import activity, names, price_history, pricing, report, sessions
from ..streaming import usage as usage_stream
from . import views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.canonicalise(views.usage(spark, sf_dir), views.ALIASES)


# --- SQL pieces -----------------------------------------------------------

_VALUES = ", ".join(f"('{a}', '{c}')" for a, c in views.ALIASES.items())
_STEP = """
  CASE WHEN regexp_matches(b, '-\\d{8}$') THEN regexp_replace(b, '-\\d{8}$', '') WHEN regexp_matches(b, '-\\d{6}$') THEN regexp_replace(b, '-\\d{6}$', '')
       WHEN regexp_matches(b, '@\\d{8}$') THEN regexp_replace(b, '@\\d{8}$', '') WHEN regexp_matches(b, '-\\d{4}-\\d{2}-\\d{2}$') THEN regexp_replace(b, '-\\d{4}-\\d{2}-\\d{2}$', '')
       WHEN b <> cur THEN b
       WHEN regexp_matches(cur, '(:thinking|-thinking|-think|-fast)$') THEN regexp_replace(cur, '(:thinking|-thinking|-think|-fast)$', '')
       WHEN ends_with(cur, '-latest') THEN regexp_replace(cur, '-latest$', '')
       WHEN regexp_matches(cur, '(-chat|-preview)$') THEN regexp_replace(cur, '(-chat|-preview)$', '')
       WHEN regexp_matches(cur, '^(zai-org-|anthropic-|openai-|copilot-|google-|zai-|deepseek-|alibaba-|minimax-)')
            THEN regexp_replace(cur, '^(zai-org-|anthropic-|openai-|copilot-|google-|zai-|deepseek-|alibaba-|minimax-)', '')
       WHEN regexp_matches(cur, '^[^/]*/.') THEN regexp_replace(cur, '^[^/]*/', '')
       ELSE coalesce((SELECT min(a) FROM al WHERE length(a) = length(cur) AND a <> cur AND regexp_replace(a, '(\\d)\\.(\\d)', '\\1-\\2') = cur), cur) END
"""
_NAMED = f"""
  usage AS ({views.USAGE_DUCK}), al(a, c) AS (VALUES {_VALUES}),
  pairs AS (SELECT DISTINCT provider, model, lower(trim(model)) AS m FROM usage),
  walk AS (
    SELECT provider, model, m AS cur, regexp_replace(m, '@default$', '') AS b, 0 AS n FROM pairs WHERE m IS NOT NULL
    UNION ALL
    SELECT provider, model, nxt, regexp_replace(nxt, '@default$', ''), n + 1
    FROM (SELECT *, {_STEP} AS nxt FROM walk WHERE n < 30 AND (n = 0 OR cur NOT IN (SELECT a FROM al))) WHERE nxt <> cur),
  resolved AS (SELECT provider, model, min(c) AS c FROM walk JOIN al ON cur = a WHERE n > 0 GROUP BY provider, model),
  named AS (
    SELECT p.provider, p.model, coalesce((SELECT c FROM al WHERE a = lower(trim(p.provider)) || '/' || p.m), (SELECT c FROM al WHERE a = p.m), r.c, p.m, '-') AS canonical
    FROM pairs p LEFT JOIN resolved r ON p.provider IS NOT DISTINCT FROM r.provider AND p.model = r.model),
  cu AS (SELECT u.*, n.canonical FROM usage u JOIN named n ON u.provider IS NOT DISTINCT FROM n.provider AND u.model IS NOT DISTINCT FROM n.model)
"""
_ROOTS = """
  last AS (SELECT session_id, arg_max(coalesce(parent_session_id, ''), (ts, origin_key)) AS up FROM usage GROUP BY session_id),
  climb AS (
    SELECT session_id, session_id AS top, 0 AS n FROM last
    UNION ALL
    SELECT c.session_id, l.up, n + 1 FROM climb c JOIN last l ON c.top = l.session_id WHERE l.up <> ''),
  roots AS (SELECT session_id, arg_max(top, n) AS root_id FROM climb GROUP BY session_id)
"""
_KEYS = {
    "source": "source", "model": "canonical", "provider": "coalesce(provider, '-')",
    "project": "coalesce(project_name, regexp_extract(project_cwd, '([^/]+)/*$', 1), '-')", "date": "strftime(ts, '%Y-%m-%d')",
    "session": "CASE WHEN length(session_id) > 14 THEN substr(session_id, 1, 14) || '…' ELSE session_id END",
}


def _report_sql(dims: list[str], where: str = "TRUE", keys: dict = _KEYS) -> str:
    cols = ", ".join(f"{keys[d]} AS key_{d}" for d in dims)
    return f"""
      WITH RECURSIVE {_NAMED}, {_ROOTS}
      SELECT {cols}, CAST(sum(prompt + cache_read + cache_write) AS BIGINT) AS input, CAST(sum(completion + reasoning) AS BIGINT) AS output,
        CAST(sum(input_bytes) AS BIGINT) AS input_bytes, CAST(sum(output_bytes) AS BIGINT) AS output_bytes, CAST(sum(reasoning) AS BIGINT) AS reasoning,
        CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write,
        CAST(sum(prompt + cache_read + cache_write + completion + reasoning) AS BIGINT) AS total, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(rounds) AS BIGINT) AS rounds,
        bool_or(input_estimated) AS input_estimated, bool_or(output_estimated) AS output_estimated,
        bool_or(input_bytes_estimated) AS input_bytes_estimated, bool_or(output_bytes_estimated) AS output_bytes_estimated,
        round(coalesce(sum(cost_embedded), 0), 4) AS cost_embedded,
        count(DISTINCT root_id) AS root_sessions, count(DISTINCT CASE WHEN session_kind = 'sub_agent' THEN session_id END) AS sub_agent_sessions,
        min(ts) AS first_ts, max(ts) AS last_ts,
        count(DISTINCT root_id) + count(DISTINCT CASE WHEN session_kind = 'sub_agent' THEN session_id END) AS sessions
      FROM cu JOIN roots USING (session_id) WHERE {where} GROUP BY {", ".join(str(i + 1) for i in range(len(dims)))}
    """


def _report(spark, sf_dir, dims, where=lambda u: u, **more) -> DataFrame:
    u = _canonical(spark, sf_dir)
    agg = report.report(where(u), sessions.session_roots(views.usage(spark, sf_dir)), dims, **more)
    return agg.withColumn("cost_embedded", F.round("cost_embedded", 4))


# --- names ----------------------------------------------------------------


@_query("canonical_names", f"WITH RECURSIVE {_NAMED} SELECT provider, model, canonical FROM named")
def canonical_names(spark, sf_dir):
    return names.resolve_pairs(views.usage(spark, sf_dir).select("provider", "model").distinct(), views.ALIASES)


@_query(
    "family_series",
    f"""WITH RECURSIVE {_NAMED}, n AS (SELECT DISTINCT canonical FROM cu),
      f AS (SELECT canonical, coalesce('claude-' || nullif(regexp_extract(canonical, '^claude-(haiku|sonnet|opus|fable)(-|$)', 1), ''),
        nullif(regexp_extract(canonical, '^(gemini-[0-9.]+-(?:flash(?:-lite)?|pro))(-|$)', 1), ''), nullif(regexp_extract(canonical, '^(gpt-[0-9]+(?:[.][0-9]+)?)(-|$)', 1), ''),
        regexp_replace(canonical, '-(mini|nano|pro|flash|lite|turbo|codex|chat|reasoner|highspeed)$', '')) AS family FROM n)
      SELECT canonical, family, coalesce('claude-' || nullif(regexp_extract(canonical, '^claude-(?:haiku|sonnet|opus|fable)-([0-9]+(?:[.][0-9]+)?)', 1), ''),
        nullif(regexp_extract(canonical, '^(gpt-[0-9]+(?:[.][0-9]+)?)', 1), ''), nullif(regexp_extract(canonical, '^(gemini-[0-9]+(?:[.][0-9]+)?)', 1), ''), family) AS series FROM f""",
)
def family_series(spark, sf_dir):
    return _canonical(spark, sf_dir).select("canonical").distinct().select("canonical", scalars.infer_family(F.col("canonical")).alias("family"), scalars.infer_series(F.col("canonical")).alias("series"))


@_query(
    "provider_split",
    f"""WITH usage AS ({views.USAGE_DUCK}), m AS (SELECT DISTINCT model FROM usage WHERE model IS NOT NULL)
      SELECT model, CASE WHEN contains(model, '/') THEN CASE split_part(model, '/', 1) WHEN 'copilot' THEN 'github-copilot' ELSE split_part(model, '/', 1) END ELSE 'github-copilot' END AS p,
        CASE WHEN contains(model, '/') THEN substr(model, instr(model, '/') + 1) ELSE model END AS m FROM m""",
)
def provider_split(spark, sf_dir):
    p, m = scalars.split_provider(F.col("model"), "github-copilot")
    return views.usage(spark, sf_dir).where("model is not null").select("model").distinct().select("model", p.alias("p"), m.alias("m"))


# --- report ---------------------------------------------------------------


@_query("report_source_model", _report_sql(["source", "model"]))
def report_source_model(spark, sf_dir):
    return _report(spark, sf_dir, [])


@_query("report_six_dimensions", _report_sql(["source", "model", "provider", "project", "date", "session"]))
def report_six_dimensions(spark, sf_dir):
    return _report(spark, sf_dir, ["tool", "model", "provider", "cwd", "day", "session", "nonsense"])


@_query("report_by_week", _report_sql(["date", "source"], keys=_KEYS | {"date": "strftime(ts, '%G-W%V')"}))
def report_by_week(spark, sf_dir):
    return _report(spark, sf_dir, ["date", "source"], bucket="week")


@_query("report_by_month", _report_sql(["date", "provider"], keys=_KEYS | {"date": "strftime(ts, '%Y-%m')"}))
def report_by_month(spark, sf_dir):
    return _report(spark, sf_dir, ["date", "provider"], bucket="month")


@_query("report_full_sessions", _report_sql(["session"], keys=_KEYS | {"session": "session_id"}))
def report_full_sessions(spark, sf_dir):
    return _report(spark, sf_dir, ["session"], full_session_id=True)


@_query(
    "report_filtered",
    _report_sql(["provider", "project"], "ts >= TIMESTAMP '2024-01-05 12:00:00' AND ts < TIMESTAMP '2024-01-21' AND (model SIMILAR TO 'claude-.*' OR canonical SIMILAR TO 'claude-.*') AND provider SIMILAR TO '[ago].*' AND project_cwd SIMILAR TO '/home/.*/proj[^3]'"),
)
def report_filtered(spark, sf_dir):
    def where(u):
        u = report.filter_time(u, "2024-01-05 12:00:00", "2024-01-20")
        u = report.filter_model(u, "claude-*")
        return report.filter_glob(report.filter_glob(u, "provider", "[ago]*"), "project_cwd", "/home/**/proj[!3]")

    return _report(spark, sf_dir, ["provider", "project"], where)


@_query(
    "report_sorted_total",
    f"""WITH RECURSIVE r AS ({_report_sql(["project", "model"])}), s AS (SELECT * FROM r ORDER BY total DESC, key_project, key_model LIMIT 7)
      SELECT key_project, key_model, input, output, total, calls, sessions FROM s
      UNION ALL SELECT 'TOTAL', '', CAST(sum(input) AS BIGINT), CAST(sum(output) AS BIGINT), CAST(sum(total) AS BIGINT), CAST(sum(calls) AS BIGINT), CAST(sum(sessions) AS BIGINT) FROM s HAVING count(*) > 1""",
)
def report_sorted_total(spark, sf_dir):
    top = report.sort_report(_report(spark, sf_dir, ["project", "model"]), "total").limit(7)
    return report.with_total(top.select("key_project", "key_model", "input", "output", "total", "calls", "sessions"))


@_query(
    "report_averages",
    f"""WITH r AS ({_report_sql(["source", "provider"])})
      SELECT key_source, key_provider, {", ".join(f"round(CASE WHEN sessions > 1 THEN {c} / sessions ELSE CAST({c} AS DOUBLE) END, 6) AS avg_{c}" for c in ("input", "output", "reasoning", "cache_read", "cache_write", "total"))} FROM r""",
)
def report_averages(spark, sf_dir):
    a = report.averages(_report(spark, sf_dir, ["source", "provider"]), "session")
    return a.select("key_source", "key_provider", *[F.round(c, 6).alias(c) for c in a.columns if c.startswith("avg_")])


@_query(
    "report_units",
    f"""WITH r AS ({_report_sql(["source", "project"])})
      SELECT key_source, key_project, input_bytes AS bytes_in, output_bytes AS bytes_out, greatest(input - cache_read - cache_write, 0) AS split_in FROM r""",
)
def report_units(spark, sf_dir):
    agg = _report(spark, sf_dir, ["source", "project"])
    b = report.project_unit(agg, "bytes").select("key_source", "key_project", F.col("input").alias("bytes_in"), F.col("output").alias("bytes_out"))
    return b.join(report.project_unit(agg, split_input=True).select("key_source", "key_project", F.col("input").alias("split_in")), ["key_source", "key_project"])


@_query(
    "summary_by_file",
    f"""WITH usage AS ({views.USAGE_DUCK}) SELECT source_file, count(*) AS records, CAST(sum(prompt + cache_read + cache_write + completion + reasoning) AS BIGINT) AS total,
      CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(rounds) AS BIGINT) AS rounds, bool_or(input_estimated OR output_estimated) AS estimated FROM usage WHERE source IN ('codex', 'pi-agent') GROUP BY source_file""",
)
def summary_by_file(spark, sf_dir):
    return report.summarise(report.select_sources(views.usage(spark, sf_dir), ["codex", "pi-agent", "codex"]), "source_file")


@_query("session_roots", f"WITH RECURSIVE usage AS ({views.USAGE_DUCK}), {_ROOTS} SELECT session_id, root_id FROM roots")
def session_roots(spark, sf_dir):
    return sessions.session_roots(views.usage(spark, sf_dir))


@_query(
    "prefer_exact",
    f"""WITH usage AS ({views.USAGE_DUCK}), e AS (SELECT DISTINCT session_id FROM usage WHERE source = 'copilot' AND mode = 'session.shutdown')
      SELECT origin_key, session_id, mode FROM usage WHERE NOT (source = 'copilot' AND session_id IN (SELECT session_id FROM e)) OR coalesce(mode = 'session.shutdown', FALSE)""",
)
def prefer_exact(spark, sf_dir):
    return sessions.prefer_exact(views.usage(spark, sf_dir)).select("origin_key", "session_id", "mode")


@_query("text_sizes", "SELECT doc_id, length(text) AS chars, octet_length(encode(text)) AS bytes, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def text_sizes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.char_length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), scalars.rough_tokens(F.char_length("text")).alias("tokens"))


# --- pricing --------------------------------------------------------------

_RATES = "{'input': input, 'output': output, 'reasoning': reasoning, 'cache_read': cache_read, 'cache_write': cache_write}"
_V = lambda rows: ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
_PRICED = f"""
  {_NAMED}, ev AS (SELECT * FROM ({views.EVENTS_DUCK}) WHERE op = 'upsert'), known AS (SELECT DISTINCT provider, model FROM ev),
  fam(provider, canonical_name, model, position) AS (VALUES {_V(views.FAMILIES)}),
  fk AS (SELECT provider, canonical_name, arg_min(model, position) AS model FROM fam SEMI JOIN known USING (provider, model) GROUP BY ALL),
  off(canonical, official) AS (VALUES {_V(views.OFFICIAL.items())}),
  pol(provider, model, multiplier, included) AS (VALUES {_V(views.POLICIES)}),
  rt AS (
    SELECT n.provider, n.model, n.canonical,
      CASE WHEN k1.model IS NOT NULL THEN k1.provider || '|' || k1.model WHEN k2.model IS NOT NULL THEN k2.provider || '|' || k2.model
           WHEN f1.model IS NOT NULL THEN f1.provider || '|' || f1.model WHEN k3.model IS NOT NULL THEN k3.provider || '|' || k3.model
           WHEN f2.model IS NOT NULL THEN f2.provider || '|' || f2.model END AS route,
      CASE WHEN n.model IS NULL THEN NULL WHEN k3.model IS NOT NULL THEN k3.provider || '|' || k3.model WHEN f2.model IS NOT NULL THEN f2.provider || '|' || f2.model END AS oroute
    FROM named n LEFT JOIN off ON n.canonical = off.canonical
    LEFT JOIN known k1 ON k1.provider = lower(n.provider) AND k1.model = lower(n.model) LEFT JOIN known k2 ON k2.provider = lower(n.provider) AND k2.model = n.canonical
    LEFT JOIN fk f1 ON f1.provider = lower(n.provider) AND f1.canonical_name = n.canonical
    LEFT JOIN known k3 ON k3.provider = off.official AND k3.model = n.canonical LEFT JOIN fk f2 ON f2.provider = off.official AND f2.canonical_name = n.canonical),
  er AS (SELECT provider || '|' || model AS route, ts, arg_max({_RATES}, sequence) AS price FROM ev GROUP BY ALL),
  first AS (SELECT provider || '|' || model AS route, arg_min({_RATES}, (ts, sequence)) AS price FROM ev GROUP BY ALL),
  p1 AS (SELECT c.*, rt.route, rt.oroute FROM cu c JOIN rt ON c.provider IS NOT DISTINCT FROM rt.provider AND c.model IS NOT DISTINCT FROM rt.model),
  p2 AS (SELECT p1.*, coalesce(er.price, first.price) AS pp FROM p1 ASOF LEFT JOIN er ON p1.route = er.route AND p1.ts >= er.ts LEFT JOIN first ON p1.route = first.route),
  p3 AS (SELECT p2.*, coalesce(er.price, first.price) AS op FROM p2 ASOF LEFT JOIN er ON p2.oroute = er.route AND p2.ts >= er.ts LEFT JOIN first ON p2.oroute = first.route),
  priced AS (
    SELECT p3.*, CAST(coalesce(m.multiplier, w.multiplier, '1') AS DECIMAL(10,4)) AS multiplier, coalesce(m.included, w.included, FALSE) AS included0,
      coalesce(m.included, w.included, FALSE) OR coalesce(pp.input = 0 AND pp.output = 0 AND coalesce(pp.reasoning, 0) = 0 AND pp.cache_read = 0 AND coalesce(pp.cache_write, 0) = 0, FALSE) AS free
    FROM p3 LEFT JOIN pol w ON w.provider = p3.provider AND w.model IS NULL LEFT JOIN pol m ON m.provider = p3.provider AND m.model = p3.canonical)
"""


def _total(price: str) -> str:
    """Millionths of a dollar, exact."""
    parts = ("prompt", "input"), ("completion", "output"), ("reasoning", "reasoning"), ("cache_read", "cache_read"), ("cache_write", "cache_write")
    rate = {"reasoning": f"coalesce({price}.reasoning, {price}.output)", "cache_write": f"coalesce({price}.cache_write, {price}.input)"}
    return "(" + " + ".join(f"CAST({t} AS DECIMAL(11,0)) * CAST({rate.get(r, f'{price}.{r}')} AS DECIMAL(12,6))" for t, r in parts) + ")"


_COST = {
    "actual": f"CASE WHEN free THEN 0 ELSE CAST({_total('pp')} AS DECIMAL(27,6)) * multiplier END",
    "mixed": f"CASE WHEN free THEN {_total('op')} ELSE {_total('pp')} END",
    "official": _total("op"),
}


def _priced(spark, sf_dir) -> DataFrame:
    usage = views.usage(spark, sf_dir)
    pairs = names.resolve_pairs(usage.select("provider", "model").distinct(), views.ALIASES)
    u = pricing.price_usage(usage, views.price_events(spark, sf_dir), views.families(spark), views.official(spark), pairs=pairs)
    return pricing.policy(u, views.policies(spark))


@_query("asof_prices", f"WITH RECURSIVE {_PRICED} SELECT origin_key, round(CAST(pp.input AS DOUBLE), 6) AS provider_input, round(CAST(pp.cache_write AS DOUBLE), 6) AS provider_cache_write, round(CAST(op.output AS DOUBLE), 6) AS official_output, round(CAST(multiplier AS DOUBLE), 4) AS multiplier, included0 AS included FROM priced")
def asof_prices(spark, sf_dir):
    f = lambda c, n: F.round(F.col(c).cast("double"), n)
    return _priced(spark, sf_dir).select(
        "origin_key", f("provider_price.input", 6).alias("provider_input"), f("provider_price.cache_write", 6).alias("provider_cache_write"), f("official_price.output", 6).alias("official_output"), f("multiplier", 4).alias("multiplier"), "included"
    )


def _micros(cost: Column) -> Column:
    # 30 digits times 7 keep the scale of 15, and what a long holds
    return F.floor(cost.cast("decimal(30,15)") * 1_000_000).cast("long")


def _cost_query(mode: str):
    @_query(f"cost_{mode}", f"WITH RECURSIVE {_PRICED} SELECT coalesce(provider, '-') AS key_provider, canonical AS key_model, CAST(floor(coalesce(sum({_COST[mode]}), 0)) AS BIGINT) AS cost_micros, count({_COST[mode]}) AS priced FROM priced GROUP BY ALL")
    def run(spark, sf_dir):
        c = pricing.cost(_priced(spark, sf_dir), mode)
        total = report.added(*report.COSTS)
        return c.groupBy(F.coalesce("provider", F.lit("-")).alias("key_provider"), F.col("canonical").alias("key_model")).agg(
            _micros(F.coalesce(F.sum(total), F.lit(0))).alias("cost_micros"), F.count(total).alias("priced")
        )


for _m in ("actual", "mixed", "official"):
    _cost_query(_m)


@_query("cost_split", f"WITH RECURSIVE {_PRICED} SELECT source AS key_source, coalesce(provider, '-') AS split, CAST(floor(sum({_COST['mixed']})) AS BIGINT) AS cost_micros FROM priced WHERE {_COST['mixed']} IS NOT NULL GROUP BY ALL")
def cost_split(spark, sf_dir):
    s = report.cost_split(pricing.cost(_priced(spark, sf_dir), "mixed"), ["source"], "provider")
    return s.select("key_source", "split", _micros(F.col("cost")).alias("cost_micros"))


@_query(
    "cost_split_columns",
    f"""WITH RECURSIVE {_PRICED}, s AS (SELECT source, coalesce(provider, '-') AS split, sum({_COST['official']}) AS cost FROM priced WHERE {_COST['official']} IS NOT NULL GROUP BY ALL),
      top AS (SELECT split, row_number() OVER (ORDER BY sum(cost) DESC, split) AS n FROM s GROUP BY split)
      SELECT source AS key_source, {", ".join(f"CAST(floor(coalesce(sum(CASE WHEN n = {i} THEN cost END), 0)) AS BIGINT) AS cost_{i}" for i in (1, 2, 3))} FROM s JOIN top USING (split) GROUP BY source""",
)
def cost_split_columns(spark, sf_dir):
    s = report.cost_per_columns(report.cost_split(pricing.cost(_priced(spark, sf_dir), "official"), ["source"], "provider"))
    return s.select("key_source", *[_micros(F.col(f"cost_{i}")).alias(f"cost_{i}") for i in (1, 2, 3)])


@_query(
    "asof_at_scale",
    """WITH us AS (SELECT l_orderkey, l_linenumber, l_shipdate AS ts, o_orderpriority || '|m' || CAST(o_custkey % 50 AS VARCHAR) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
      e AS (SELECT o_orderdate AS ts, o_orderpriority || '|m' || CAST(o_custkey % 50 AS VARCHAR) AS r, o_orderkey AS seq, CAST(o_totalprice / 10000 AS DECIMAL(18,6)) AS price FROM orders WHERE o_orderstatus <> 'F'),
      p AS (SELECT r, ts, arg_max(price, seq) AS price FROM e GROUP BY ALL), f AS (SELECT r, arg_min(price, (ts, seq)) AS price FROM e GROUP BY r)
      SELECT us.r AS route, count(*) AS n, CAST(sum(coalesce(p.price, f.price)) AS DOUBLE) AS price FROM us ASOF LEFT JOIN p ON us.r = p.r AND us.ts >= p.ts LEFT JOIN f ON us.r = f.r GROUP BY us.r""",
)
def asof_at_scale(spark, sf_dir):
    li, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    route = F.concat("o_orderpriority", F.lit("|m"), (F.col("o_custkey") % 50).cast("string")).alias("route")
    us = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(route, F.col("l_shipdate").cast("timestamp").alias("ts"))
    ev = o.where("o_orderstatus <> 'F'").select(route, F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("sequence"), (F.col("o_totalprice") / 10000).cast("decimal(18,6)").alias("price"))
    return pricing.asof(us, ev, ["route"], "price", ["sequence"]).groupBy("route").agg(F.count("*").alias("n"), F.sum("price").cast("double").alias("price"))


# --- activity -------------------------------------------------------------

_DAILY = f"""usage AS ({views.USAGE_DUCK}), d AS (SELECT CAST(ts AS DATE) AS date, sum(prompt + cache_read + cache_write + completion + reasoning) AS v, bool_or(input_estimated OR output_estimated) AS e FROM usage GROUP BY 1),
  series AS (SELECT CAST(c.d AS DATE) AS date, CAST(coalesce(v, 0) AS BIGINT) AS value, coalesce(e, FALSE) AND coalesce(v, 0) > 0 AS estimated
    FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-20', TIMESTAMP '2024-02-10', INTERVAL 1 DAY)) AS d) c LEFT JOIN d ON CAST(c.d AS DATE) = d.date)"""


def _daily(spark, sf_dir):
    return activity.daily(views.usage(spark, sf_dir), "2023-12-20", "2024-02-10")


@_query("activity_daily", f"WITH {_DAILY}, l AS (SELECT *, cume_dist() OVER (ORDER BY value) AS c FROM series WHERE value > 0) SELECT s.date, s.value, s.estimated, CAST(coalesce(ceil(4 * c), 0) AS INT) AS level FROM series s LEFT JOIN l USING (date)")
def activity_daily(spark, sf_dir):
    return activity.levels(_daily(spark, sf_dir))


@_query(
    "activity_summary",
    f"""WITH {_DAILY}, n AS (SELECT *, row_number() OVER (ORDER BY date) AS n FROM series), i AS (SELECT n - row_number() OVER (ORDER BY n) AS g FROM n WHERE value > 0), s AS (SELECT count(*) AS c FROM i GROUP BY g)
      SELECT CAST((SELECT sum(value) FROM series) AS BIGINT) AS total, (SELECT count(*) FROM series WHERE value > 0) AS active, (SELECT max(c) FROM s) AS streak,
        (SELECT date FROM series ORDER BY value DESC, date LIMIT 1) AS best, (SELECT max(value) FROM series) AS best_value""",
)
def activity_summary(spark, sf_dir):
    return activity.summary(_daily(spark, sf_dir))


@_query(
    "activity_calendar",
    f"""WITH {_DAILY}, f AS (SELECT min(date) AS f FROM series)
      SELECT date, CAST(floor(date_diff('day', f - CAST(dayofweek(f) AS INT), date) / 7) AS INT) AS week, CAST(dayofweek(date) AS INT) AS weekday,
        CASE WHEN lag(date) OVER (ORDER BY date) IS NULL OR month(lag(date) OVER (ORDER BY date)) <> month(date) THEN strftime(date, '%b') END AS label FROM series, f""",
)
def activity_calendar(spark, sf_dir):
    return activity.calendar_grid(_daily(spark, sf_dir))


@_query(
    "activity_hourly",
    f"""WITH usage AS ({views.USAGE_DUCK}), h AS (SELECT CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-09 10:30:00')) / 3600000000) AS BIGINT) AS bucket, sum(input_bytes + output_bytes) AS v FROM usage GROUP BY 1)
      SELECT b.b AS bucket, TIMESTAMP '2024-01-09 10:30:00' + b.b * INTERVAL 1 HOUR AS at, CAST(coalesce(v, 0) AS BIGINT) AS value, coalesce(v, 0) > 0 AS estimated
      FROM (SELECT unnest(range(36)) AS b) b LEFT JOIN h ON h.bucket = b.b""",
)
def activity_hourly(spark, sf_dir):
    return activity.hourly(views.usage(spark, sf_dir), "2024-01-09 10:41:00", 36, "bytes", "Asia/Kolkata")


# --- price history --------------------------------------------------------

_PF = ["input", "output", "cache_read"]
_STATES = f"e AS ({views.EVENTS_DUCK}), st AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY provider, model, commit_seq ORDER BY sequence DESC) = 1)"
_CHANGES = f"""{_STATES}, s AS (SELECT *, CASE WHEN op = 'upsert' THEN {{'i': input, 'o': output, 'c': cache_read}} END AS now FROM st),
  c0 AS (SELECT *, lag(now) OVER (PARTITION BY provider, model ORDER BY commit_seq) AS was FROM s),
  ch AS (SELECT op, ts, commit_seq, provider, model, now.i AS input, now.o AS output, now.c AS cache_read, row_number() OVER (ORDER BY commit_seq, provider, model, op) AS sequence FROM c0 WHERE now IS DISTINCT FROM was)"""


def _states(spark, sf_dir):
    e = views.price_events(spark, sf_dir)
    last = e.groupBy("provider", "model", "commit_seq").agg(F.max_by(F.struct("op", "ts", *_PF), F.col("sequence")).alias("x"))
    return last.select("provider", "model", "commit_seq", "x.ts", (F.col("x.op") == "upsert").alias("present"), *[f"x.{f}" for f in _PF])


def _changes(spark, sf_dir):
    return price_history.price_changes(_states(spark, sf_dir), _PF)


def _plain(df: DataFrame, cols=_PF) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


_P = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in _PF)


@_query("price_changes", f"WITH {_CHANGES} SELECT op, ts, commit_seq, provider, model, {_P}, CAST(sequence AS INT) AS sequence FROM ch")
def price_changes(spark, sf_dir):
    return _plain(_changes(spark, sf_dir)).withColumn("sequence", F.col("sequence").cast("int"))


@_query("price_changes_since", f"WITH {_CHANGES} SELECT op, ts, commit_seq, provider, model, {_P}, CAST(sequence AS INT) AS sequence FROM ch")
def price_changes_since(spark, sf_dir):
    known = _changes(spark, sf_dir).where("commit_seq <= 30").withColumn("sequence", F.col("sequence").cast("long"))
    return _plain(price_history.price_changes_since(_states(spark, sf_dir), known, 30, _PF)).withColumn("sequence", F.col("sequence").cast("int"))


@_query("latest_snapshot", f"WITH {_CHANGES} SELECT provider, model, ts, {_P} FROM ch QUALIFY row_number() OVER (PARTITION BY provider, model ORDER BY sequence DESC) = 1 AND op = 'upsert'")
def latest_snapshot(spark, sf_dir):
    return _plain(price_history.latest_state(_changes(spark, sf_dir), _PF))


@_query(
    "daily_snapshots",
    f"""WITH {_CHANGES}, d AS (SELECT CAST(unnest(generate_series((SELECT min(ts) FROM ch WHERE op = 'upsert'), TIMESTAMP '2024-02-19', INTERVAL 1 DAY)) AS DATE) AS date),
      x AS (SELECT d.date, ch.* FROM d JOIN ch ON CAST(ch.ts AS DATE) <= d.date QUALIFY row_number() OVER (PARTITION BY d.date, provider, model ORDER BY sequence DESC) = 1)
      SELECT date, provider, model, {_P} FROM x WHERE op = 'upsert'""",
)
def daily_snapshots(spark, sf_dir):
    return _plain(price_history.daily_snapshots(_changes(spark, sf_dir), _PF, "2024-02-20"))


@_query(
    "route_catalog",
    f"""WITH {_CHANGES} SELECT provider, model, count(*) AS events, arg_max(op, sequence) <> 'delete' AS active, max(ts) AS updated, {", ".join(f"bool_or({f} IS NOT NULL) AS has_{f}" for f in _PF)} FROM ch GROUP BY ALL""",
)
def route_catalog(spark, sf_dir):
    return price_history.route_catalog(_changes(spark, sf_dir), _PF)


@_query(
    "recent_routes",
    f"""WITH {_CHANGES}, c AS (SELECT provider, model, count(*) AS events, arg_max(op, sequence) <> 'delete' AS active, max(ts) AS updated FROM ch GROUP BY ALL)
      SELECT provider, model, CAST(row_number() OVER (PARTITION BY provider ORDER BY active DESC, updated DESC, model) AS INT) AS rank FROM c WHERE events > 1 QUALIFY rank <= 3""",
)
def recent_routes(spark, sf_dir):
    return price_history.recent_routes(price_history.route_catalog(_changes(spark, sf_dir), _PF), 3, only_changed=True).select("provider", "model", "rank")


_SERIES = f"""{_CHANGES}, n AS (SELECT *, row_number() OVER w AS n, row_number() OVER w + max(epoch_ms(ts) - rn) OVER w AS plot_ts FROM (SELECT *, row_number() OVER (PARTITION BY provider, model ORDER BY ts, sequence) AS rn FROM ch) WINDOW w AS (PARTITION BY provider, model ORDER BY ts, sequence)),
  l AS (SELECT provider, model, ts, sequence, plot_ts, unnest(['input', 'output', 'cache_read']) AS field, unnest([CASE WHEN op <> 'delete' THEN input END, CASE WHEN op <> 'delete' THEN output END, CASE WHEN op <> 'delete' THEN cache_read END]) AS new FROM n),
  sr AS (SELECT *, lag(new) OVER (PARTITION BY provider, model, field ORDER BY ts, sequence) AS previous FROM l QUALIFY new IS DISTINCT FROM previous)"""


def _series(spark, sf_dir):
    return price_history.route_series(_changes(spark, sf_dir), _PF)


@_query("route_series", f"WITH {_SERIES} SELECT provider, model, field, ts, CAST(sequence AS INT) AS sequence, CAST(plot_ts AS BIGINT) AS plot_ts, round(CAST(previous AS DOUBLE), 6) AS previous, round(CAST(new AS DOUBLE), 6) AS new FROM sr")
def route_series(spark, sf_dir):
    return _plain(_series(spark, sf_dir), ["previous", "new"]).withColumn("sequence", F.col("sequence").cast("int"))


@_query("change_markers", f"WITH {_SERIES} SELECT provider, model, field, CAST(plot_ts AS BIGINT) AS plot_ts, CASE WHEN previous IS NULL THEN 'start' WHEN new IS NULL THEN 'remove' ELSE 'change' END AS marker, round(CAST(coalesce(new, previous, 0) AS DOUBLE), 6) AS shown FROM sr")
def change_markers(spark, sf_dir):
    return _plain(price_history.markers(_series(spark, sf_dir)), ["shown"])


@_query(
    "aligned_series",
    f"""WITH {_SERIES}, i AS (SELECT * FROM sr WHERE field = 'input'), t AS (SELECT plot_ts FROM i UNION SELECT plot_ts - 1 FROM i WHERE new IS NULL UNION SELECT 1709251200000),
      r AS (SELECT DISTINCT provider, model, field FROM i), g AS (SELECT r.*, t.plot_ts FROM r, t)
      SELECT g.provider, g.model, g.field, CAST(g.plot_ts AS BIGINT) AS plot_ts, round(CAST(i.new AS DOUBLE), 6) AS value FROM g ASOF LEFT JOIN i ON g.provider = i.provider AND g.model = i.model AND g.plot_ts >= i.plot_ts""",
)
def aligned_series(spark, sf_dir):
    return _plain(price_history.aligned(_series(spark, sf_dir).where("field = 'input'"), 1_709_251_200_000), ["value"])


# --- streams --------------------------------------------------------------

#: Files of one arrival, which are read together: so many at least, and more, up to one for each task, where all hold FILE_ROWS rows.
FILES, FILE_ROWS = 4, 100


@_query(
    "hourly_stream",
    f"""WITH usage AS ({views.USAGE_DUCK}), b AS (SELECT *, least(CAST(floor(extract(day FROM ts) / 8) AS INT) + CASE reasoning % 50 WHEN 7 THEN 2 WHEN 8 THEN 1 ELSE 0 END, 4) AS batch, date_trunc('hour', ts) AS hour FROM usage),
      seen AS (SELECT batch, max(ts) AS upto FROM b GROUP BY 1), mark AS (SELECT x.batch, max(y.upto) - INTERVAL 2 HOUR AS mark FROM seen x LEFT JOIN seen y ON y.batch < x.batch - 1 GROUP BY 1),
      kept AS (SELECT b.* FROM b JOIN mark USING (batch) WHERE mark IS NULL OR hour + INTERVAL 1 HOUR > mark)
      SELECT hour, source, CAST(sum(prompt + cache_read + cache_write + completion + reasoning) AS BIGINT) AS tokens, count(*) AS records FROM kept
      WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM b) GROUP BY 1, 2""",
)
def hourly_stream(spark, sf_dir):
    """Hours of a stream of five arrivals of eight days each, some rows one or two arrivals late.

    Hours that the watermark has not passed are open. A row is late by the watermark that the
    arrival before the last one left, as hours are closed after an arrival's rows are in.
    """
    usage = views.usage(spark, sf_dir)
    batch = F.least(F.floor(F.dayofmonth("ts") / 8) + F.when(F.col("reasoning") % 50 == 7, 2).when(F.col("reasoning") % 50 == 8, 1).otherwise(0), F.lit(4))
    made = stored(usage.withColumn("batch", batch.cast("int")), "days", "batch")  # the input is read once
    sizes = [r["count"] for r in made.where("batch is not null").groupBy("batch").count().collect()]  # five at most
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    files = max(FILES, min(tasks, min(sizes) // FILE_ROWS)) if len(sizes) == 5 else FILES
    source, into = folder(spark, "arriving"), folder(spark, "hours")
    for k in range(5):  # one after the other, as they would arrive
        made.where(F.col("batch") == k).drop("batch").repartition(files).write.mode("append").parquet(source)
    removed(made)
    stream = spark.readStream.schema(usage.schema).option("maxFilesPerTrigger", files).parquet(source)
    usage_stream.closed_hours(stream, into, folder(spark, "hours-state")).awaitTermination()
    return spark.read.parquet(into)
