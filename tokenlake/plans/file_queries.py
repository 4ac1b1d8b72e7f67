"""Queries of files, sinks, catalogs, documents, transcripts and walkers, over rows that Spark derives from the driver's tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_text
from ..functions.storage import dealt, folder
from ..operators import catalog, incremental, report
from ..sources import chat, collect, decoders, lines, price_files, transcripts, workspaces
from ..streaming import usage as streaming
from . import queries as core
from . import views
from .decoder_queries import _js, _st

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RATES = ("input", "output", "reasoning", "cache_read", "cache_write")
_doubles = lambda cols: [F.round(F.col(c).cast("double"), 6).alias(c) for c in cols]
_sql_doubles = lambda cols, of="{c}": ", ".join(f"round(CAST({of.format(c=c)} AS DOUBLE), 6) AS {c}" for c in cols)


# --- price files ----------------------------------------------------------


@_query(
    "price_event_files",
    f"SELECT sequence, provider, model, ts, round(CAST(input AS DOUBLE), 6) AS input, round(CAST(output AS DOUBLE), 6) AS output, round(CAST(reasoning AS DOUBLE), 6) AS reasoning, round(CAST(coalesce(cache_read, 0) AS DOUBLE), 6) AS cache_read, round(CAST(cache_write AS DOUBLE), 6) AS cache_write FROM ({views.EVENTS_DUCK}) WHERE op = 'upsert'",
)
def price_event_files(spark, sf_dir):
    """A change stream written as files and read as prices."""
    path = folder(spark, "changes")
    price_files.write_changes(views.price_events(spark, sf_dir), path)
    return price_files.read_price_events(spark, path).select("sequence", "provider", "model", "ts", *_doubles(_RATES))


@_query("family_files", "SELECT lower(p_brand) AS provider, lower(p_type) AS canonical_name, lower(p_name || ' ' || p_partkey) AS model FROM part WHERE p_partkey % 3 > 0")
def family_files(spark, sf_dir):
    """Family routes written as a file and read; those without a name go."""
    path = folder(spark, "families")
    rows = _table(spark, sf_dir, "part").select(F.concat(F.lit(" "), "p_brand").alias("provider"), F.concat_ws(" ", "p_name", "p_partkey").alias("model"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("canonical_name"), F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("release_date"))
    price_files.write_families(rows, path)
    return price_files.read_families(spark, path).select("provider", "canonical_name", "model")


def _pricing_layers(spark, sf_dir) -> dict[str, DataFrame]:
    """Two layers of pricing files, made of suppliers: the second sets fields and prices anew for some."""
    s = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_suppkey").alias("k"))
    own = lambda on, x, i: F.map_from_entries(F.collect_list(F.when(on, F.struct("name", F.struct(x.alias("multiplier"), i.alias("included"), F.create_map(F.lit("Big"), F.struct(F.lit("3").alias("multiplier"))).alias("models"))))))
    price = lambda on, i, w: F.collect_list(F.when(on, F.struct(F.col("name").alias("provider"), F.concat(F.lit("M"), (F.col("k") % 5).cast("string")).alias("model"), i.cast("string").alias("input"), w.cast("string").alias("cache_write"))))
    none, yes, k = F.lit(None).cast("string"), F.lit(True), F.col("k")
    name = F.create_map(F.lit("Big"), F.struct(F.lit("acme").alias("provider"), F.array(F.lit("big-1")).alias("aliases")))
    files = s.groupBy(F.floor(k / 100).alias("part"))  # a file for each hundred suppliers
    layers = [
        files.agg(F.to_json(F.struct(own(yes, (k % 9 + 1).cast("string"), F.lit(None).cast("boolean")).alias("providers"), price(yes, k + 1, F.lit(None)).alias("prices"))).alias("value")),
        files.agg(F.to_json(F.struct(own(k % 2 == 0, none, k % 4 == 0).alias("providers"), F.first(name).alias("models"), price(k % 3 == 0, k + 2, k).alias("prices"))).alias("value")),
    ]
    paths = []
    for layer in layers:
        paths.append(folder(spark, "pricing"))
        layer.repartition("part").write.partitionBy("part").text(paths[-1])
    return workspaces.read_pricing(spark, paths)


_LAYERS = "s AS (SELECT 's' || s_suppkey AS provider, s_suppkey AS k FROM supplier)"


@_query(
    "pricing_policies",
    f"""WITH {_LAYERS} SELECT provider, NULL AS model, CAST(k % 9 + 1 AS DOUBLE) AS multiplier, CASE WHEN k % 2 = 0 THEN CAST(k % 4 = 0 AS VARCHAR) END AS included FROM s
      UNION ALL SELECT provider, 'big', 3.0, NULL FROM s""",
)
def pricing_policies(spark, sf_dir):
    p = _pricing_layers(spark, sf_dir)["policies"]
    return p.select("provider", "model", F.col("multiplier").cast("double").alias("multiplier"), F.col("included").cast("string").alias("included"))


@_query(
    "pricing_prices",
    f"""WITH {_LAYERS} SELECT provider, 'm' || (k % 5) AS model, CAST(CASE WHEN k % 3 = 0 THEN k + 2 ELSE k + 1 END AS DOUBLE) AS input, 0.0 AS output, CAST(NULL AS DOUBLE) AS reasoning, 0.0 AS cache_read, CAST(CASE WHEN k % 3 = 0 THEN k END AS DOUBLE) AS cache_write FROM s""",
)
def pricing_prices(spark, sf_dir):
    return _pricing_layers(spark, sf_dir)["prices"].select("provider", "model", *_doubles(_RATES))


@_query("snapshot_files", core.ORACLE_SQL["daily_snapshots"])
def snapshot_files(spark, sf_dir):
    """Daily snapshots, a folder for each day, and read back."""
    path = folder(spark, "snapshots")
    daily = core.QUERIES["daily_snapshots"](spark, sf_dir)
    price_files.write_snapshots(daily, path)
    return spark.read.csv(path, header=True, schema=", ".join(f"{c} {'double' if c in core._PF else 'string'}" for c in daily.columns if c != "date") + ", date date").select(*daily.columns)


@_query("latest_file", core.ORACLE_SQL["latest_snapshot"])
def latest_file(spark, sf_dir):
    path = folder(spark, "latest")
    latest = core.QUERIES["latest_snapshot"](spark, sf_dir)
    price_files.write_latest(latest, path)
    return spark.read.csv(path, header=True, schema=latest.schema)


_REPORT_JSON = core._report_sql(["source", "project"])


@_query(
    "report_json_lines",
    f"""WITH r AS ({_REPORT_JSON}) SELECT key_source AS source, key_project AS project, input_bytes AS input, output_bytes AS output, reasoning, calls, sessions, input_estimated FROM r""",
)
def report_json_lines(spark, sf_dir):
    """Report rows as JSON lines in bytes, written and read back."""
    path = folder(spark, "report")
    price_files.report_json(core._report(spark, sf_dir, ["source", "project"]), "bytes").write.text(path)
    kinds = "keys struct<source:string,project:string>, input long, output long, reasoning long, calls long, sessions long, input_estimated boolean"
    return spark.read.schema(kinds).json(path).select("keys.*", "input", "output", "reasoning", "calls", "sessions", "input_estimated")


@_query(
    "cost_map",
    f"""WITH RECURSIVE {core._PRICED}, s AS (SELECT source, coalesce(provider, '-') AS split, CAST(floor(sum({core._COST["mixed"]})) AS BIGINT) AS c FROM priced WHERE {core._COST["mixed"]} IS NOT NULL GROUP BY ALL)
      SELECT source AS key_source, string_agg(split || '=' || c, ',' ORDER BY split) AS cost_per FROM s GROUP BY source""",
)
def cost_map(spark, sf_dir):
    """Costs of each source by provider, as a map."""
    from ..operators import pricing

    s = report.cost_split(pricing.cost(core._priced(spark, sf_dir), "mixed"), ["source"], "provider")
    m = report.cost_per_map(s)
    text = F.array_join(F.transform(F.map_entries("cost_per"), lambda e: F.concat(e["key"], F.lit("="), core._micros(e["value"]).cast("string"))), ",")
    return m.select("key_source", text.alias("cost_per"))


@_query(
    "report_period",
    f"WITH usage AS ({views.USAGE_DUCK}) SELECT source, count(*) AS records FROM usage WHERE ts >= TIMESTAMP '2024-01-21 23:00:00' AND ts <= TIMESTAMP '2024-01-25 10:00:00' GROUP BY source",
)
def report_period(spark, sf_dir):
    """This week, which began on Monday at midnight, an hour east of Greenwich."""
    u = report.filter_period(views.usage(spark, sf_dir), "week", "2024-01-25 10:00:00", "Etc/GMT-1")
    return u.groupBy("source").agg(F.count("*").alias("records"))


# --- catalog --------------------------------------------------------------

_SCOPED = {("openai", "solo-1"): "gpt-5"}
_ROLLING = {"gemini-3-flash"}


def _catalog_routes(spark, sf_dir) -> DataFrame:
    """Routes whose models are wrapped in prefixes and suffixes, by part."""
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.floor(k / n).cast("int") % len(values) + 1))
    model = F.concat(pick(["", "openai/", "anthropic-", "x/y/"], 1), pick(["gpt-5", "Claude-Sonnet-4-5", "gemini-3-flash", "solo-1", "other"], 4), pick(["", "-thinking", "-20250101", "-latest"], 20), pick(["", "", "-preview"], 80))
    return _table(spark, sf_dir, "part").select(k.alias("id"), pick(["openai", "acme"], 7).alias("provider"), model.alias("model"))


_A = lambda values, n: f"list_extract([{', '.join(repr(v) for v in values)}], CAST(floor(p_partkey / {n}) AS INT) % {len(values)} + 1)"
_PREFIX = "|".join(catalog.PREFIXES)
_RESOLVED = f"""
  al(a, c) AS (VALUES {", ".join(f"('{a}', '{c}')" for a, c in views.ALIASES.items())}),
  rt AS (SELECT p_partkey AS id, {_A(["openai", "acme"], 7)} AS provider, {_A(["", "openai/", "anthropic-", "x/y/"], 1)} || {_A(["gpt-5", "Claude-Sonnet-4-5", "gemini-3-flash", "solo-1", "other"], 4)} || {_A(["", "-thinking", "-20250101", "-latest"], 20)} || {_A(["", "", "-preview"], 80)} AS model FROM part),
  names AS (SELECT DISTINCT model, lower(trim(model)) AS n FROM rt),
  walk AS (
    SELECT model, n AS cur, 0 AS i, CAST(NULL AS VARCHAR) AS rule FROM names
    UNION ALL
    SELECT model, nxt, i + 1, CASE WHEN nxt <> cur AND (nxt = 'solo-1' OR nxt IN (SELECT a FROM al)) THEN list_extract(['provider_prefix', 'slash_prefix', 'date_suffix', 'mode_suffix', 'variant_suffix', 'version_separator'], i % 6 + 1) END
    FROM (SELECT *, CASE i % 6 WHEN 0 THEN regexp_replace(cur, '^({_PREFIX})-', '') WHEN 1 THEN regexp_replace(cur, '^[^/]*/(.)', '\\1') WHEN 2 THEN regexp_replace(regexp_replace(cur, '[-@]\\d{{8}}$', ''), '-\\d{{6}}$', '')
        WHEN 3 THEN regexp_replace(cur, '(:thinking|-thinking|-think|-fast)$', '') WHEN 4 THEN regexp_replace(cur, '(-latest|-chat|-preview)$', '')
        ELSE coalesce((SELECT min(a) FROM al WHERE a <> cur AND regexp_replace(a, '(\\d)\\.(\\d)', '\\1-\\2') = cur), cur) END AS nxt FROM walk WHERE rule IS NULL AND i < 36)),
  heur AS (SELECT model, max(rule) AS rule, max_by(cur, i) AS cur FROM walk GROUP BY model),
  res AS (
    SELECT rt.id, rt.provider, rt.model,
      CASE WHEN rt.provider = 'openai' AND n.n = 'solo-1' THEN 'gpt-5' WHEN n.n = 'solo-1' THEN NULL WHEN e.c IS NOT NULL THEN e.c WHEN h.rule IS NOT NULL THEN g.c END AS canonical_name,
      CASE WHEN n.n = 'solo-1' AND rt.provider <> 'openai' THEN 'unknown' WHEN n.n = 'solo-1' OR e.c IS NOT NULL THEN CASE WHEN n.n = rt.model THEN 'exact' ELSE 'normalized' END WHEN h.rule IS NOT NULL AND g.c IS NOT NULL THEN 'heuristic' ELSE 'unknown' END AS confidence,
      CASE WHEN n.n = 'solo-1' AND rt.provider <> 'openai' THEN NULL WHEN n.n = 'solo-1' THEN 'source_alias' WHEN e.c IS NOT NULL THEN CASE WHEN n.n = rt.model THEN 'catalog_alias' ELSE 'normalization' END WHEN h.rule IS NOT NULL AND g.c IS NOT NULL THEN h.rule END AS matched_by
    FROM rt JOIN names n USING (model) LEFT JOIN al e ON e.a = n.n LEFT JOIN heur h USING (model) LEFT JOIN al g ON g.a = h.cur)
"""


@_query("catalog_resolution", f"WITH RECURSIVE {_RESOLVED} SELECT id, canonical_name, confidence, matched_by FROM res")
def catalog_resolution(spark, sf_dir):
    return catalog.resolve_catalog(_catalog_routes(spark, sf_dir), views.ALIASES, _SCOPED, _ROLLING).select("id", "canonical_name", "confidence", "matched_by")


@_query(
    "resolution_audit",
    f"WITH RECURSIVE {_RESOLVED} SELECT provider, count(*) AS routes, {', '.join(f'count(*) FILTER (confidence = {k!r}) AS {k}' for k in ('exact', 'normalized', 'heuristic', 'unknown'))} FROM res GROUP BY ROLLUP (provider)",
)
def resolution_audit(spark, sf_dir):
    return catalog.resolution_audit(catalog.resolve_catalog(_catalog_routes(spark, sf_dir), views.ALIASES, _SCOPED, _ROLLING)).drop("total")


#: (vendor, provider, prefix of models or None)
_SOURCES = (("v-open", "openai", None), ("v-gpt", "openai", "gpt"), ("v-solo", "openai", "solo-"), ("v-host", "acme", "x/y/"), ("v-all", "acme", "x/"))
_SOURCES_SQL = "(VALUES " + ", ".join(f"('{v}', '{p}', '{x or ''}')" for v, p, x in _SOURCES) + ") AS s(vendor, sp, prefix)"


def _sources(spark) -> DataFrame:
    return spark.createDataFrame(list(_SOURCES), "vendor string, provider string, model_prefix string")


def _resolved(spark, sf_dir) -> DataFrame:
    return catalog.resolve_catalog(_catalog_routes(spark, sf_dir), views.ALIASES, _SCOPED, _ROLLING)


@_query(
    "official_audit",
    f"""WITH RECURSIVE {_RESOLVED}, f AS (SELECT DISTINCT id, provider, confidence FROM (SELECT res.* FROM res JOIN {_SOURCES_SQL} ON res.provider = s.sp AND starts_with(res.model, s.prefix)))
      SELECT provider, count(*) AS routes, {', '.join(f'count(*) FILTER (confidence = {k!r}) AS {k}' for k in ('exact', 'normalized', 'heuristic', 'unknown'))} FROM f GROUP BY ROLLUP (provider)""",
)
def official_audit(spark, sf_dir):
    """Confidence of the routes of official sources; a source may be some of a provider's models."""
    return catalog.resolution_audit(_resolved(spark, sf_dir), sources=_sources(spark)).drop("total")


@_query(
    "unmatched_routes",
    f"""WITH RECURSIVE {_RESOLVED} SELECT id, provider, model, arg_max(s.vendor, length(s.prefix)) AS vendor FROM res JOIN {_SOURCES_SQL} ON res.provider = s.sp AND starts_with(res.model, s.prefix) WHERE confidence = 'unknown' GROUP BY ALL""",
)
def unmatched_routes(spark, sf_dir):
    return catalog.unmatched_routes(_resolved(spark, sf_dir), _sources(spark)).select("id", "provider", "model", "vendor")


@_query(
    "alias_conflicts",
    """WITH a AS (SELECT CASE WHEN p_partkey % 3 > 0 THEN lower(p_brand) END AS provider, lower(p_name) AS alias, p_type || (p_partkey % 2) AS t FROM part)
      SELECT provider, alias, 'two targets' AS conflict FROM a GROUP BY provider, alias HAVING count(DISTINCT t) > 1
      UNION ALL SELECT DISTINCT provider, alias, 'scoped and global' FROM a WHERE provider IS NOT NULL AND alias IN (SELECT alias FROM a WHERE provider IS NULL)""",
)
def alias_conflicts(spark, sf_dir):
    k = F.col("p_partkey")
    a = _table(spark, sf_dir, "part").select(F.when(k % 3 > 0, F.col("p_brand")).alias("provider"), F.col("p_name").alias("alias"), F.concat("p_type", (k % 2).cast("string")).alias("canonical_name"))
    return catalog.alias_conflicts(a)


@_query("route_search", "SELECT p_brand AS provider, p_name || ' ' || p_partkey AS model, p_type AS family FROM part WHERE p_partkey % 4 > 0 AND contains(lower(p_brand || '|' || p_name || ' ' || p_partkey || '|' || p_type), 'ec') ORDER BY provider, model LIMIT 100 OFFSET 100")
def route_search(spark, sf_dir):
    """The second page of resolved routes that hold a text; a page is the feature."""
    return catalog.search_routes(_part_routes(spark, sf_dir), "EC", resolved_only=True, page=1).select("provider", "model", "family")


def _part_routes(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_brand").alias("provider"), F.concat_ws(" ", "p_name", "p_partkey").alias("model"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_type")).alias("canonical_name"), F.col("p_type").alias("family"))


@_query(
    "route_facets",
    """WITH r AS (SELECT p_brand AS provider, p_type AS family, p_partkey % 4 > 0 AND contains(lower(p_brand || '|' || p_name || ' ' || p_partkey || '|' || p_type), 'e') AS ok FROM part)
      SELECT 'provider' AS facet, provider AS value, count(*) FILTER (ok AND coalesce(family = 'ECONOMY', FALSE)) AS routes, provider = 'Brand#12' AS chosen FROM r GROUP BY provider
      UNION ALL SELECT 'family', family, count(*) FILTER (ok AND coalesce(provider = 'Brand#12', FALSE)), family = 'ECONOMY' FROM r GROUP BY family""",
)
def route_facets(spark, sf_dir):
    """Providers and families that a search of resolved routes may be narrowed to, one of each chosen."""
    return catalog.route_facets(_part_routes(spark, sf_dir), "E", provider="Brand#12", family="ECONOMY", resolved_only=True)


@_query(
    "report_bounds",
    f"""SELECT origin_key FROM ({views.USAGE_DUCK}) WHERE ts >= TIMESTAMP '2024-01-04 23:00:00' AND ts < TIMESTAMP '2024-01-20 23:00:00'""",
)
def report_bounds(spark, sf_dir):
    """A span back from now outranks a period; a date as upper bound is a whole day of its zone."""
    now = datetime(2024, 1, 25, 23, tzinfo=timezone.utc)
    return report.filter_time(views.usage(spark, sf_dir), "3w", "2024-01-20", period="today", now=now, tz="Europe/Paris").select("origin_key")


@_query(
    "collected_sources",
    """WITH n AS (SELECT conv_id % 5 AS k, conv_id, turn, role, text FROM conversations),
      a AS (SELECT conv_id FROM n WHERE role = 'assistant' AND k = 0), p AS (SELECT conv_id FROM n WHERE role = 'assistant' AND k = 1)
      SELECT source, state, files, incomplete, records FROM (
        SELECT 'claude' AS source, 'ok' AS state, (SELECT count(DISTINCT conv_id) FROM n WHERE k = 0) AS files, (SELECT count(DISTINCT conv_id) FROM n WHERE k = 0 AND conv_id % 10 = 0) AS incomplete, (SELECT count(*) FROM a) AS records
        UNION ALL SELECT 'pi-agent', 'ok', (SELECT count(DISTINCT conv_id) FROM n WHERE k = 1), 0, (SELECT count(*) FROM p)
        UNION ALL SELECT 'codex', 'missing', 0, 0, 0 UNION ALL SELECT 'opencode', 'failed', 0, 0, 0 UNION ALL SELECT 'copilot-cli', 'ok', (SELECT count(DISTINCT conv_id) FROM n WHERE k = 2), (SELECT count(DISTINCT conv_id) FROM n WHERE k = 2), 0)""",
)
def collected_sources(spark, sf_dir):
    """Five sources: logs with cut lines, whole logs, no folder, tables that are none, logs that are no JSON at all."""
    c = _table(spark, sf_dir, "conversations")
    said = _js(type="assistant", message=_st(model="m", usage=_st(input_tokens=1)))
    told = _js(type="user", message=_st(role="user", content=F.col("text")))
    forms = {
        0: ("claude", F.when(F.col("role") == "assistant", said).otherwise(told), F.when((F.col("conv_id") % 10 == 0), F.lit('{"cut')).otherwise(F.lit(""))),
        1: ("pi-agent", F.when(F.col("role") == "assistant", _js(type="message", message=_st(role="assistant", content=F.col("text"), usage=_st(input=1)))).otherwise(_js(type="other")), F.lit("")),
        2: ("copilot-cli", F.lit("no json"), F.lit("")),
    }
    folders = {}
    for k, (source, line, end) in forms.items():
        logs = c.where(F.col("conv_id") % 5 == k).select("conv_id", "turn", line.alias("line"), end.alias("end"))
        whole = logs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("l"), F.max("end").alias("end"))
        folders[source] = folder(spark, f"logs-{source}")
        # a folder a conversation; a session's log is one file
        dealt(whole.select("conv_id", F.concat_ws("\n", F.transform("l", lambda x: x["line"]), F.col("end")).alias("value")), "conv_id").write.partitionBy("conv_id").text(folders[source])
    tables = folder(spark, "tables")
    c.select("text").write.text(f"{tables}/message.parquet")
    paths = {"claude": f"{folders['claude']}/*", "codex": folder(spark, "no-logs"), "pi-agent": f"{folders['pi-agent']}/*", "opencode": tables, "copilot-cli": f"{folders['copilot-cli']}/*"}
    records, status = collect.collect(spark, paths)
    counts = records.groupBy("source").agg(F.count("*").alias("records"))
    return status.select("source", "state", "files", "incomplete").join(counts, "source", "left").na.fill(0, ["files", "incomplete", "records"])


# --- documents ------------------------------------------------------------

_PATH = "CASE WHEN p_partkey % 3 = 0 THEN 'models/' || p_partkey || '.toml' ELSE 'providers/' || p_type || '/models/' || replace(p_name, ' ', '/') || '/' || p_partkey || '.toml' END"


@_query("route_identity", f"SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS provider, CASE WHEN p_partkey % 3 > 0 THEN replace(p_name, ' ', '/') || '/' || p_partkey END AS model FROM part")
def route_identity(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_PATH).alias("path"))
    provider, model = catalog.route_identity(F.col("path"))
    return rows.select("id", provider.alias("provider"), model.alias("model"))


@_query(
    "document_prices",
    f"""SELECT o_orderkey AS id, {_sql_doubles(["input", "output", "cache_read", "cache_write"], "CASE WHEN o_orderkey % 5 > 0 THEN {c} END")}
      FROM (SELECT o_orderkey, o_totalprice / 1000 AS input, o_totalprice / 500 AS output, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 END AS cache_read, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 11 END AS cache_write FROM orders)""",
)
def document_prices(spark, sf_dir):
    """Prices in documents, some under their older names."""
    k, t = F.col("o_orderkey"), F.col("o_totalprice")
    money = lambda c: F.format_string("%.6f", c).cast("decimal(18,6)")
    cost = _st(input=money(t / 1000), output=money(t / 500), cache_read=F.when(k % 4 == 0, k % 7), inputCached=F.when(k % 4 == 2, k % 7), output_cached=F.when(k % 3 == 0, k % 11))
    docs = _table(spark, sf_dir, "orders").select(k.alias("id"), F.to_json(F.struct(F.when(k % 5 > 0, cost).alias("cost"))).alias("doc"))
    return catalog.extract_prices(docs).select("id", *_doubles(["input", "output", "cache_read", "cache_write"]))


def _versions(spark, sf_dir) -> DataFrame:
    """Routes over shared bases: part k builds on base k % 20, which changes at commit 10; every seventh part goes at commit 15; every fifth links to its neighbour."""
    k = F.col("p_partkey")
    p = _table(spark, sf_dir, "part").select(k, "p_retailprice")
    none = F.lit(None).cast("string")
    route = lambda n: F.concat(F.lit("providers/p/models/m"), n.cast("string"), F.lit(".toml"))
    own = F.to_json(F.struct(F.concat(F.lit("b"), (k % 20).cast("string")).alias("base_model"), F.array(F.when(k % 2 == 0, F.lit("cost.output")).otherwise("none")).alias("base_model_omit"), _st(input=k).alias("cost")))
    link = k % 5 == 4
    first = p.select(F.lit(1).alias("commit_seq"), route(k).alias("path"), F.when(~link, own).alias("doc"), F.when(link, route(k - 1)).alias("target"))
    gone = p.where(k % 7 == 0).select(F.lit(15), route(k), none, none)
    base = lambda at, n: p.where(k < 20).select(F.lit(at), F.concat(F.lit("models/b"), k.cast("string"), F.lit(".toml")), _js(release_date=F.concat(F.lit("2024-"), F.lpad((k % 14).cast("string"), 2, "0")), cost=_st(input=F.lit(-1), output=k + n, reasoning=k)), none)
    return first.union(gone).union(base(0, 100)).union(base(10, 200))


_SPANS = """
  p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 4 THEN p_partkey - 1 ELSE p_partkey END AS d FROM part),
  cuts AS (SELECT k, d, unnest(list_sort(list_distinct([1, 10] || CASE WHEN d % 7 = 0 THEN [15] ELSE [] END || CASE WHEN k % 7 = 0 THEN [15] ELSE [] END))) AS since FROM p),
  spans AS (SELECT *, lead(since) OVER (PARTITION BY k ORDER BY since) AS until FROM cuts),
  live AS (SELECT * FROM spans WHERE since < 15 OR (k % 7 > 0 AND d % 7 > 0))
"""


@_query(
    "resolved_documents",
    f"""WITH {_SPANS} SELECT 'm' || k AS model, CAST(since AS BIGINT) AS since, CAST(coalesce(until, {catalog.LAST_COMMIT}) AS BIGINT) AS until, CAST(d AS DOUBLE) AS input,
      CAST(CASE WHEN d % 2 > 0 THEN d % 20 + CASE WHEN since >= 10 THEN 200 ELSE 100 END END AS DOUBLE) AS output, CAST(d % 20 AS DOUBLE) AS reasoning FROM live""",
)
def resolved_documents(spark, sf_dir):
    """Documents over their bases, by span of commits."""
    r = catalog.resolve_docs(_versions(spark, sf_dir)).where("doc is not null")
    at = lambda f: F.get_json_object("doc", f"$.cost.{f}").cast("double").alias(f)
    return r.select(catalog.route_identity(F.col("path"))[1].alias("model"), "since", "until", at("input"), at("output"), at("reasoning"))


@_query(
    "family_mapping",
    f"""WITH {_SPANS}, l AS (SELECT DISTINCT k, d FROM live) SELECT 'p' AS provider, 'm' || k AS model, CAST(NULL AS VARCHAR) AS canonical_name, CASE WHEN d % 20 % 14 BETWEEN 1 AND 12 THEN '2024-' || lpad(CAST(d % 20 % 14 AS VARCHAR), 2, '0') END AS release_date FROM l""",
)
def family_mapping(spark, sf_dir):
    return catalog.families(_versions(spark, sf_dir), views.ALIASES, _SCOPED).select("provider", "model", "canonical_name", "release_date")


# --- transcripts and walkers ----------------------------------------------

_LOG = f"log AS ({views.LOG_DUCK})"


def _log_lines(spark, sf_dir, value: Column) -> DataFrame:
    log = views.session_log(spark, sf_dir)
    return log.select("source_file", F.col("line_no").alias("line_no"), (F.col("line_no") * 1000).cast("long").alias("byte_offset"), value.alias("value")).where("value is not null")


_item = lambda role: _js(type="response_item", payload=_st(type="message", role=role, content=F.array(_st(type="text", text=F.col("text")), _st(type="text", text="end"))))


def _codex(spark, sf_dir) -> DataFrame:
    call = _js(type="response_item", payload=_st(type="function_call", name="run", arguments=F.col("text"), call_id="c"))
    return transcripts.transcript_codex(_log_lines(spark, sf_dir, F.when(F.col("role") == "system", call).otherwise(_item(F.col("role")))))


@_query("transcript_codex", f"WITH {_LOG} SELECT source_file, line_no, CASE role WHEN 'system' THEN 'tool_call' ELSE role END AS role, CASE role WHEN 'system' THEN 'run: ' || text ELSE text || chr(10) || 'end' END AS text FROM log")
def transcript_codex(spark, sf_dir):
    return _codex(spark, sf_dir).select("source_file", "line_no", "role", "text")


@_query("transcript_files", f"WITH {_LOG} SELECT source_file AS session_file, count(*) AS n, CAST(sum(length(text) + CASE role WHEN 'system' THEN 5 ELSE 4 END) AS BIGINT) AS chars FROM log GROUP BY 1")
def transcript_files(spark, sf_dir):
    """Transcripts written, a folder for each session, and read back."""
    path = folder(spark, "transcripts")
    transcripts.write_transcripts(_codex(spark, sf_dir), path)
    back = spark.read.schema("text string, session_file string").json(path)
    return back.groupBy("session_file").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).cast("long").alias("chars"))


@_query(
    "transcript_events",
    f"""WITH {_LOG} SELECT source_file, line_no, 0 AS part, role, text FROM log WHERE role <> 'system'
      UNION ALL SELECT source_file, line_no, 1, 'tool_call', 'run: {{}}' FROM log WHERE role = 'assistant'
      UNION ALL SELECT source_file, line_no, 0, 'tool', text FROM log WHERE role = 'system'""",
)
def transcript_events(spark, sf_dir):
    """Messages, calls that the message requested, each once, and results."""
    call = F.concat_ws("-", F.lit("c"), F.col("line_no").cast("string"))
    said = _js(type="assistant.message", data=_st(content=F.col("text"), toolRequests=F.array(_st(toolCallId=call, name="run", arguments="{}"))))
    value = F.when(F.col("role") == "assistant", said).when(F.col("role") == "user", _js(type="user.message", data=_st(content=F.col("text")))).otherwise(_js(type="tool.execution_complete", data=_st(toolCallId="x", result=_st(content=F.col("text")))))
    made = _log_lines(spark, sf_dir, value)
    again = views.session_log(spark, sf_dir).where("role = 'assistant'").select("source_file", (F.col("line_no") + 1000).alias("line_no"), F.lit(0).cast("long").alias("byte_offset"), _js(type="tool.execution_start", data=_st(toolCallId=call, toolName="run", arguments="{}")).alias("value"))
    return transcripts.transcript_events(made.unionByName(again)).select("source_file", "line_no", F.col("part").cast("int").alias("part"), "role", "text")


def _chat_lines(spark, sf_dir) -> DataFrame:
    """A snapshot without requests, then a patch for each user turn: a request with its text, a tool call and an answer; its tokens come later."""
    log = views.session_log(spark, sf_dir)
    n = F.col("line_no").cast("int")
    head = log.select("source_file").distinct().select("source_file", F.lit(-1).cast("long").alias("line_no"), F.lit('{"kind":0,"v":{"sessionId":"s","requests":[]}}').alias("value"))
    raw = F.concat(F.lit('{"kind":2,"k":["requests",'), n.cast("string"), F.lit('],"v":'), _chat_request(n), F.lit("}"))
    return head.unionByName(log.where("role = 'user'").select("source_file", F.col("line_no").cast("long").alias("line_no"), raw.alias("value"))).withColumn("byte_offset", F.lit(0).cast("long"))


def _chat_request(n: Column) -> Column:
    """The JSON of a request, whose response items differ in their fields."""
    quoted = F.expr("substring(to_json(named_struct('t', text)), 6, length(to_json(named_struct('t', text))) - 6)")
    parts = [
        '{"requestId":"', F.format_string("r%05d", n), '","timestamp":', (F.lit(10**6) - n).cast("string"), ',"message":{"text":', quoted,
        '},"response":[{"kind":"toolInvocationSerialized","toolCallId":"a","toolId":"find","invocationMessage":{"value":"looking"}},{"value":"said"}],'
        '"result":{"metadata":{"toolCallRounds":[{"response":"ok","toolCalls":[{"id":"a","name":"find","arguments":"{}"},{"id":"b","name":"run","arguments":"{}"}]}],"toolCallResults":{"a":{"content":[{"value":"found"}]}}}}}',
    ]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@_query(
    "transcript_chat",
    f"""WITH {_LOG}, u AS (SELECT source_file, CAST(row_number() OVER (PARTITION BY source_file ORDER BY line_no DESC) - 1 AS INT) AS n, text FROM log WHERE role = 'user'),
      t(part, role, said, display) AS (VALUES (0, 'user', NULL, NULL), (1, 'tool_call', 'find', 'looking'), (2, 'tool_call_result', 'found', 'looking'), (3, 'assistant', 'said', NULL), (4, 'tool_call', 'run: {{}}', NULL), (5, 'tool_call_result', 'ok', 'ok'))
      SELECT u.source_file, u.n, t.part, t.role, coalesce(t.said, u.text) AS text, t.display FROM u, t""",
)
def transcript_chat(spark, sf_dir):
    return chat.transcript_chat(_chat_lines(spark, sf_dir)).select("source_file", F.col("n").cast("int").alias("n"), F.col("part").cast("int").alias("part"), "role", "text", "display")


@_query(
    "decode_chat",
    f"""WITH {_LOG} SELECT source_file, 'event:r' || lpad(CAST(line_no AS VARCHAR), 5, '0') || ':slot:0' AS origin_key, CAST(ceil((chars + 5) / 4) AS BIGINT) AS prompt, CAST(ceil(15 / 4) AS BIGINT) AS completion, CAST(2 AS BIGINT) AS calls, 's' AS session_id FROM log WHERE role = 'user'""",
)
def decode_chat(spark, sf_dir):
    return chat.decode_chat(_chat_lines(spark, sf_dir)).select("source_file", "origin_key", "prompt", "completion", "calls", "session_id")


_NESTED = lambda: _js(text=F.col("text"), value="v", content=F.array(_st(text=F.col("role"), x="x"), _st(text="z", x="y")))


@_query(
    "json_texts",
    f"""WITH {_LOG} SELECT source_file, line_no, text || chr(10) || 'v' || chr(10) || role || chr(10) || 'x' || chr(10) || 'z' || chr(10) || 'y' AS every, text AS plain, text AS rich, text || chr(10) || 'v' || chr(10) || role || chr(10) || 'z' AS nested,
      role || chr(10) || 'z' AS message, CAST(bytes + 1 + length(role) + 3 AS BIGINT) AS bytes FROM log""",
)
def json_texts(spark, sf_dir):
    """Texts of nested JSON under every walk."""
    log = views.session_log(spark, sf_dir).withColumn("j", _NESTED())
    walk = lambda mode, of="j": json_text.json_text(F.col(of), mode)
    out = log.withColumn("c", F.get_json_object("j", "$.content")).select("source_file", "line_no", walk("all").alias("a"), walk("text").alias("t"), walk("rich").alias("r"), walk("nested").alias("n"), walk("message", "c").alias("m"))
    return out.select("source_file", "line_no", F.col("a.text").alias("every"), F.col("t.text").alias("plain"), F.col("r.text").alias("rich"), F.col("n.text").alias("nested"), F.col("m.text").alias("message"), F.col("a.bytes").alias("bytes"))


# --- keys, forks, shares --------------------------------------------------


@_query(
    "origin_keys",
    f"""WITH {_LOG}, b AS (SELECT *, CASE WHEN role = 'user' THEN 'event:u:slot:0' ELSE 'offset:' || line_no * 1000 || ':slot:0' END AS base FROM log)
      SELECT source_file, line_no, base || CASE WHEN n > 1 THEN ':duplicate:' || (n - 1) ELSE '' END AS origin_key FROM (SELECT *, row_number() OVER (PARTITION BY source_file, base ORDER BY line_no) AS n FROM b)""",
)
def origin_keys(spark, sf_dir):
    made = _log_lines(spark, sf_dir, F.col("role")).withColumn("id", F.when(F.col("value") == "user", F.lit("u")))
    return lines.with_origin_key(made, "id").select("source_file", "line_no", "origin_key")


_U7 = lambda n: F.format_string("%08x-0000-7000-8000-000000000000", n)


@_query(
    "decode_fork",
    f"""WITH {_LOG} SELECT source_file, CAST(bytes AS BIGINT) AS completion, 'sub_agent' AS session_kind FROM log WHERE role = 'assistant' AND line_no >= 3""",
)
def decode_fork(spark, sf_dir):
    """Rollouts of forked sessions: turns before the fork (line 3) are inherited and give no records."""
    log = views.session_log(spark, sf_dir)
    n = F.col("line_no").cast("int")
    head = log.select("source_file").distinct().select("source_file", F.lit(-1).cast("long").alias("line_no"), _js(type="session_meta", payload=_st(id=_U7(F.lit(3)), forked_from_id="f")).alias("value"))
    turn = log.select("source_file", (n * 10).cast("long").alias("line_no"), _js(type="turn_context", payload=_st(turn_id=_U7(n), model="m")).alias("value"))
    count = log.where("role = 'assistant'").select("source_file", (n * 10 + 5).cast("long").alias("line_no"), _js(type="event_msg", payload=_st(type="token_count", info=_st(last_token_usage=_st(input_tokens=1, cached_input_tokens=0, output_tokens=F.col("bytes"), reasoning_output_tokens=0)))).alias("value"))
    made = head.unionByName(turn).unionByName(count).withColumn("byte_offset", F.col("line_no") * 1000)
    return decoders.decode_codex(made).select("source_file", "completion", "session_kind")


@_query(
    "apportioned_bytes",
    f"""WITH {_LOG}, s AS (SELECT source_file, sum(CASE WHEN role <> 'assistant' THEN bytes ELSE 0 END) AS ib, sum(CASE WHEN role = 'assistant' THEN bytes ELSE 0 END) AS ob, count(*) AS n FROM log GROUP BY 1), m(model, tokens) AS (VALUES ('a', 16), ('b', 30))
      SELECT source_file, model, CAST(round(ib * (tokens / 46)) AS BIGINT) AS input_bytes, CAST(round(ob * (tokens / 46)) AS BIGINT) AS output_bytes, CAST(n AS BIGINT) AS calls FROM s, m""",
)
def apportioned_bytes(spark, sf_dir):
    """A stream's bytes over its shutdown records: one share of all tokens for input and output, caches left out."""
    log = views.session_log(spark, sf_dir)
    a = F.col("role") == "assistant"
    totals = log.groupBy("source_file").agg(F.sum(F.when(a, 0).otherwise(F.col("bytes"))).alias("input_bytes"), F.sum(F.when(a, F.col("bytes")).otherwise(0)).alias("output_bytes"), F.lit(0).alias("rounds"), F.count("*").alias("calls"))
    files = log.select("source_file").distinct()
    both = F.array(_st(model="a", p=10, c=2, r=4, cr=99), _st(model="b", p=0, c=30, r=0, cr=0))
    records = files.select("source_file", F.explode(both).alias("x")).select("source_file", "x.model", F.col("x.p").alias("prompt"), F.col("x.c").alias("completion"), F.col("x.r").alias("reasoning"), F.col("x.cr").alias("cache_read"))
    return decoders.apportion(decoders.completed(records), totals).select("source_file", "model", "input_bytes", "output_bytes", "calls")


@_query(
    "pi_plugin",
    f"""WITH {_LOG} SELECT source_file, 'p' AS provider, 'x/y' AS model, CAST(line_no AS BIGINT) AS completion, CAST(octet_length(encode(prompt)) AS BIGINT) AS input_bytes, CAST(ceil(length(prompt) / 4) AS BIGINT) AS prompt
      FROM (SELECT *, '{decoders.SUMMARY_HEAD.replace("'", "''")}' || chr(10) || '[Result 1]' || chr(10) || 'Query: ' || text || chr(10) || 'Provider: unknown' || chr(10) || 'Answer: (no answer text returned)' || chr(10) || 'Sources:' || chr(10) || '1. t — u' || chr(10) || chr(10) || '</search_results>' AS prompt FROM log WHERE role = 'user')""",
)
def pi_plugin(spark, sf_dir):
    """Search summaries in tool results; those that fell back give no record."""
    query = _st(query=F.col("text"), answer="", sources=F.array(_st(title="t", url="u")))
    summary = _st(text="s", workflow="summary-review", model="p/x/y", tokenEstimate=F.col("line_no"), fallbackUsed=F.col("role") != "user")
    return decoders.decode_pi_plugin(_log_lines(spark, sf_dir, _js(type="message", message=_st(role="toolResult", details=_st(curatedQueries=F.array(query), summary=summary))))).select("source_file", "provider", "model", "completion", "input_bytes", "prompt")


# --- incremental, streams -------------------------------------------------


@_query("changed_files", "SELECT 'f' || o_orderkey AS path, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS INT) AS mtime FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def changed_files(spark, sf_dir):
    k = F.col("o_orderkey")
    o = _table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), k.cast("string")).alias("path"), F.when(k % 5 == 0, 2).otherwise(1).alias("mtime"), k.alias("size"))
    known = o.where(F.col("size") % 7 > 0).withColumn("mtime", F.lit(1))
    return incremental.changed_files(o, known).select("path", "mtime")


@_query("hourly_totals", f"WITH usage AS ({views.USAGE_DUCK}) SELECT date_trunc('hour', ts) AS hour, source, CAST(sum(prompt + cache_read + cache_write + completion + reasoning) AS BIGINT) AS tokens, count(*) AS records FROM usage GROUP BY ALL")
def hourly_totals(spark, sf_dir):
    return streaming.hourly_totals(views.usage(spark, sf_dir))


@_query(
    "ingest_growing",
    """SELECT conv_id // 10 AS part, CAST(0 AS BIGINT) AS retried, count(*) AS records, CAST(sum(1 + coalesce(length(text), 0)) AS BIGINT) AS tokens
      FROM conversations WHERE role = 'assistant' AND (conv_id // 10) % 7 <> 6 GROUP BY 1""",
)
def ingest_growing(spark, sf_dir):
    """A folder of logs in two states, each brought into a table: files that stay, grow, come and go; the second batch is tried twice."""
    path, table = folder(spark, "growing"), f"usage_growing_{uuid.uuid4().hex}"
    c = _table(spark, sf_dir, "conversations")
    said = _js(type="assistant", message=_st(model="m", usage=_st(input_tokens=1 + F.coalesce(F.length("text"), F.lit(0)))))
    told = _js(type="user", message=_st(role="user", content=F.col("text")))
    part = F.floor(F.col("conv_id") / 10)
    logs = c.select(part.alias("part"), "conv_id", "turn", F.when(F.col("role") == "assistant", said).otherwise(told).alias("value"))
    k = F.col("part") % 7

    def write(rows: DataFrame, mode: str) -> None:
        ordered = dealt(rows, "part").sortWithinPartitions("part", "conv_id", "turn").select("part", "value")
        ordered.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("part").text(path)

    # at first parts 4 and 5 lack, and 2 and 3 end early; in the end part 6 is one that says nothing
    write(logs.where((k < 2) | (k == 6) | (k.isin(2, 3) & (F.coalesce("turn", F.lit(0)) < 2))), "error")
    streaming.sync(spark, path, decoders.decode_claude, table, 0)
    mute = logs.where(k == 6).groupBy("part").agg(F.lit(0).alias("conv_id"), F.lit(0).alias("turn"), F.first(F.lit("{}")).alias("value"))
    write(logs.where(k.between(2, 5)).unionByName(mute), "overwrite")
    streaming.sync(spark, path, decoders.decode_claude, table, 1)
    retried = streaming.sync(spark, path, decoders.decode_claude, table, 1)
    of = F.regexp_extract("source_file", "part=([0-9-]+)/", 1).cast("long").alias("part")
    return spark.table(table).groupBy(of).agg(F.lit(retried).cast("long").alias("retried"), F.count("*").alias("records"), F.sum("prompt").cast("long").alias("tokens"))


@_query("workspace_folders", "SELECT 'w' || c_custkey AS w, '/home/a b/' || c_mktsegment || '+' || c_custkey AS project_cwd, c_mktsegment || '+' || c_custkey AS project_name FROM customer")
def workspace_folders(spark, sf_dir):
    """Workspaces from the JSON of their folders, percent-encoded."""
    rows = _table(spark, sf_dir, "customer").select(F.concat(F.lit("/x/w"), F.col("c_custkey").cast("string"), F.lit("/workspace.json")).alias("path"), _js(folder=F.concat(F.lit("file:///home/a%20b/"), "c_mktsegment", F.lit("+"), F.col("c_custkey").cast("string"))).alias("value"))
    out = workspaces.folders(rows)
    return out.select(F.regexp_extract("workspace_dir", "([^/]*)$", 1).alias("w"), "project_cwd", "project_name")


@_query(
    "log_lines",
    f"""WITH {_LOG} SELECT 'p' || CAST(regexp_extract(source_file, '(\\d+)', 1) AS BIGINT) % 8 AS part, count(*) AS n, CAST(sum(octet_length(encode(text)) - 0) AS BIGINT) AS bytes FROM log GROUP BY 1""",
)
def log_lines(spark, sf_dir):
    """Lines of files, written from the conversations, read with their offsets."""
    path = folder(spark, "logs")
    log = views.session_log(spark, sf_dir)
    part = F.concat(F.lit("p"), (F.regexp_extract("source_file", r"(\d+)", 1).cast("long") % 8).cast("string"))
    log.select(part.alias("part"), _js(text=F.col("text")).alias("value")).repartition("part").write.partitionBy("part").text(path)
    got = lines.lines(spark, f"{path}/*")
    text = F.get_json_object("value", "$.text")
    return got.groupBy(F.regexp_extract("source_file", "part=([^/]*)/", 1).alias("part")).agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).cast("long").alias("bytes"))
