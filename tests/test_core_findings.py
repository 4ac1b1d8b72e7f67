"""Faults that a review found in large tables, on small ones."""

from decimal import Decimal

from tokenlake.functions.storage import dealt, folder
from tokenlake.operators import catalog, report
from tokenlake.plans import queries


def test_costs_keep_every_digit(spark):
    """F1-F3: parts are added, summed and cut to millionths without a digit lost."""
    parts = ", ".join(f"CAST('0.000000000001' AS DECIMAL(38,15)) AS {c}" for c in report.COSTS)
    priced = spark.sql(f"SELECT 'codex' AS source, 'p' AS provider, {parts} FROM range(6)")
    assert report.cost_split(priced, ["source"], "provider").first()["cost"] == Decimal("0.00000000003")
    assert report.with_cost(priced).first()["cost"] == Decimal("0.000000000005")
    nearly = spark.sql("SELECT CAST('7.000000999999999' AS DECIMAL(38,15)) AS c")
    assert nearly.select(queries._micros(nearly["c"])).first()[0] == 7_000_000


def test_files_of_keys_are_written_by_all_tasks(spark, tmp_path):
    """F5, F6, F8: few rows with many keys are not joined into one task."""
    from pyspark.sql import functions as F

    rows = spark.range(200).select((F.col("id") % 40).alias("k"), F.lit("x").alias("value"))
    tasks = dealt(rows, "k").select("k", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == 40 and len({r["task"] for r in tasks}) > 1
    dealt(rows, "k").write.partitionBy("k").text(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("k=*/*.txt"))) == 40


def test_names_are_resolved_once(spark):
    """the rules run on distinct names, every route gets its result, nulls too."""
    data = [(i, [None, "acme"][i % 2], [None, "x/gpt-5-latest", "other"][i % 3]) for i in range(60)]
    routes = spark.createDataFrame(data, "id long, provider string, model string")
    out = catalog.resolve_catalog(routes, {"gpt-5": "gpt-5"}, {})
    got = {r["id"]: (r["provider"], r["model"], r["canonical_name"], r["confidence"]) for r in out.collect()}
    assert got == {i: (p, m, "gpt-5" if m and "gpt" in m else None, "heuristic" if m and "gpt" in m else "unknown") for i, p, m in data}
    assert "Join" in out._jdf.queryExecution().optimizedPlan().toString()


def test_arrivals_are_written_by_all_tasks(spark, monkeypatch):
    """an arrival of many rows has a file from each task, however many there are."""
    at = {}
    made = lambda s, name: at.setdefault(name, folder(s, name))
    monkeypatch.setattr(queries, "folder", made)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = queries.hourly_stream(spark, "/root/testdata/sf0.1").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows == 3585 and len(spark.read.parquet(at["arriving"]).inputFiles()) == 5 * 7
