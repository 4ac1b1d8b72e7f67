"""Catalog resolution, conflicts, audits and document prices on small inputs."""

import pytest
from pyspark.sql import functions as F

from tokenlake.operators import catalog

ALIASES = {"gpt-5": "gpt-5", "claude-sonnet-4.5": "claude-sonnet-4.5", "gemini-flash-latest": "gemini-flash-latest"}
SCOPED = {("azure", "dep-1"): "gpt-5"}


def test_resolve(spark):
    cases = {
        ("x", "gpt-5"): ("gpt-5", "exact", "catalog_alias"), ("x", " GPT-5 "): ("gpt-5", "normalized", "normalization"), ("azure", "dep-1"): ("gpt-5", "exact", "source_alias"),
        ("x", "dep-1"): (None, "unknown", None), ("x", "openai/gpt-5-2025-08-07"): ("gpt-5", "heuristic", "date_suffix"), ("x", "anthropic-claude-sonnet-4-5-thinking"): ("claude-sonnet-4.5", "heuristic", "version_separator"),
        ("x", None): (None, "unknown", None), ("x", "nothing"): (None, "unknown", None), ("x", "xai-gpt-5"): ("gpt-5", "heuristic", "provider_prefix"), ("x", "x/dep-1"): (None, "unknown", None), ("x", ""): (None, "unknown", None),
    }
    df = spark.createDataFrame(list(cases), "provider string, model string")
    out = catalog.resolve_catalog(df, ALIASES, SCOPED, {"gemini-flash-latest"})
    assert {(r["provider"], r["model"]): (r["canonical_name"], r["confidence"], r["matched_by"]) for r in out.collect()} == cases
    audit = {r["provider"]: r for r in catalog.resolution_audit(out).collect()}
    assert audit[None]["routes"] == len(cases) and audit["x"]["heuristic"] == 3 and audit["azure"]["exact"] == 1
    assert catalog.resolve_catalog(df.limit(1).withColumn("model", F.lit("gemini-flash-latest")), ALIASES, SCOPED, {"gemini-flash-latest"}).first()["is_rolling"]


def test_conflicts(spark):
    df = spark.createDataFrame([(None, "a", "m1"), (None, "A ", "m2"), ("p", "b", "m1"), (None, "b", "m1"), ("p", "c", "m1")], "provider string, alias string, canonical_name string")
    assert sorted((r["alias"], r["conflict"]) for r in catalog.alias_conflicts(df).collect()) == [("a", "two targets"), ("b", "scoped and global")]


def test_prices(spark):
    docs = [("providers/p/models/a/b.toml", '{"cost":{"input":1.25,"output":1e1,"inputCached":0.1,"audio_input":0}}'), ("models/x.toml", '{"name":"x"}')]
    df = spark.createDataFrame(docs, "path string, doc string")
    p, m = catalog.route_identity(F.col("path"))
    rows = catalog.extract_prices(df.select("*", p.alias("provider"), m.alias("model"))).collect()
    assert (rows[0]["provider"], rows[0]["model"]) == ("p", "a/b") and (rows[1]["provider"], rows[1]["input"]) == (None, None)
    assert [float(rows[0][c]) for c in ("input", "output", "cache_read", "input_audio")] == [1.25, 10.0, 0.1, 0.0] and rows[0]["cache_write"] is None
    for bad in ('{"cost":{"input":1}}', '{"cost":{"input":-1,"output":1}}', '{"cost":{"input":"x","output":1}}'):
        with pytest.raises(Exception, match="price"):
            catalog.extract_prices(spark.createDataFrame([("p", bad)], "path string, doc string")).collect()


def test_search(spark):
    df = spark.createDataFrame([("p", f"m{i:03d}", "C" if i % 2 else None, "f") for i in range(250)], "provider string, model string, canonical_name string, family string")
    assert [r["model"] for r in catalog.search_routes(df, "M1", page=0, size=3).collect()] == ["m100", "m101", "m102"]
    assert catalog.search_routes(df, resolved_only=True, page=1).count() == 25
