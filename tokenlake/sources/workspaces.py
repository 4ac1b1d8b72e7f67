"""Workspace folders and pricing overrides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def workspaces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(workspace_dir, project_cwd, project_name) of workspace.json files."""
    return folders(spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def folders(files: DataFrame) -> DataFrame:
    """The same of files (path, value)."""
    rows = files.select("path", F.get_json_object("value", "$.folder").alias("folder"))
    plain = F.regexp_replace(F.regexp_replace("folder", "^file://", ""), r"\+", "%2B")  # '+' is itself in a path
    cwd = F.coalesce(F.try_url_decode(plain), F.regexp_replace("folder", "^file://", ""))
    out = rows.where("folder is not null").select(F.regexp_replace("path", "/[^/]*$", "").alias("workspace_dir"), cwd.alias("project_cwd"))
    return out.withColumn("project_name", F.substring_index(F.regexp_replace("project_cwd", "/+$", ""), "/", -1))


_RATES = ("input", "output", "reasoning", "cache_read", "cache_write")
_SCHEMA = (
    "providers map<string,struct<multiplier:string,included:boolean,source:boolean,models:map<string,struct<multiplier:string,included:boolean>>>>, "
    "models map<string,struct<provider:string,aliases:array<string>>>, prices array<struct<provider:string,model:string,input:string,output:string,reasoning:string,cache_read:string,cache_write:string>>"
)


def read_pricing(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Layered pricing files as policies, models and prices: later files win, field by field for providers."""
    layers = [spark.read.schema(_SCHEMA).json(p, multiLine=True).withColumn("layer", F.lit(i)) for i, p in enumerate(paths)]
    every = reduce(DataFrame.unionByName, layers)
    number = lambda c: F.col(c).cast("decimal(18,9)")
    providers = every.select("layer", F.explode("providers").alias("name", "p")).withColumn("provider", F.lower(F.trim("name")))
    whole = providers.groupBy("provider").agg(
        F.max_by("p.multiplier", F.when(F.col("p.multiplier").isNotNull(), F.col("layer"))).alias("multiplier"), F.max_by("p.included", F.when(F.col("p.included").isNotNull(), F.col("layer"))).alias("included")
    )
    own = providers.select("layer", "provider", F.explode("p.models").alias("m", "x")).groupBy("provider", F.lower(F.trim("m")).alias("model")).agg(
        F.max_by("x.multiplier", F.when(F.col("x.multiplier").isNotNull(), F.col("layer"))).alias("multiplier"), F.max_by("x.included", F.when(F.col("x.included").isNotNull(), F.col("layer"))).alias("included")
    )
    policies = whole.select("provider", F.lit(None).cast("string").alias("model"), "multiplier", "included").unionByName(own)
    models = every.select("layer", F.explode("models").alias("name", "m")).groupBy(F.lower(F.trim("name")).alias("canonical")).agg(F.max_by("m", "layer").alias("m")).select("canonical", F.col("m.provider").alias("official"), "m.aliases")
    prices = every.select("layer", F.posexplode("prices").alias("i", "p"))
    prices = prices.groupBy(F.lower(F.trim("p.provider")).alias("provider"), F.lower(F.trim("p.model")).alias("model")).agg(F.max_by("p", F.struct("layer", "i")).alias("p"))
    zero = F.lit(0).cast("decimal(18,9)")
    prices = prices.select("provider", "model", *[(F.coalesce(number(f"p.{r}"), zero) if r in ("input", "output", "cache_read") else number(f"p.{r}")).alias(r) for r in _RATES])
    return {"policies": policies.withColumn("multiplier", F.col("multiplier").cast("decimal(6,3)")), "models": models, "prices": prices}
