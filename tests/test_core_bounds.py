"""Time bounds, sources with faults, order of commits, facets, texts as JSON."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tokenlake.functions import bounds, json_text
from tokenlake.operators import activity, catalog, price_history
from tokenlake.sources import collect

NOW = datetime(2024, 3, 31, 12, 30, tzinfo=timezone.utc)  # clocks in Berlin went forward this morning
AT = lambda *a: datetime(*a, tzinfo=timezone.utc)


@pytest.mark.parametrize(("text", "tz", "want"), [
    ("2024-03-31", "UTC", AT(2024, 3, 31)), ("2024-03-31", "Europe/Berlin", AT(2024, 3, 30, 23)), ("2024-04-01", "Europe/Berlin", AT(2024, 3, 31, 22)),
    ("2024-03-31T10:00:00+02:00", "UTC", AT(2024, 3, 31, 8)), ("2024-03-31T10:00:00Z", "Asia/Tokyo", AT(2024, 3, 31, 10)), ("2024-03-31 10:00:00", "Asia/Tokyo", AT(2024, 3, 31, 1)),
    ("1h", "UTC", AT(2024, 3, 31, 11, 30)), ("30m", "UTC", AT(2024, 3, 31, 12)), ("2 weeks", "UTC", AT(2024, 3, 17, 12, 30)), ("1mo", "UTC", AT(2024, 3, 1, 12, 30)), ("1Y", "UTC", AT(2023, 4, 1, 12, 30)),
    ("2018-11-04", "America/Sao_Paulo", AT(2018, 11, 4)),  # no midnight on this day
    ("2024-11-03", "America/Havana", AT(2024, 11, 3, 4)),  # two midnights: the earlier
])
def test_when(text, tz, want):
    assert bounds.when(text, NOW, tz) == want


def test_periods_and_ends():
    assert bounds.period("today", NOW, "Europe/Berlin") == AT(2024, 3, 30, 23)
    assert bounds.period("Week", NOW, "Europe/Berlin") == AT(2024, 3, 24, 23)
    assert bounds.period("month", NOW, "Europe/Berlin") == AT(2024, 2, 29, 23)
    assert bounds.period("1m", NOW) == AT(2024, 3, 1, 12, 30) and bounds.period("90m", NOW) == AT(2024, 3, 31, 11)
    assert bounds.until("2024-03-31", NOW, "Europe/Berlin") == (AT(2024, 3, 31, 22), False)
    assert bounds.until("1h", NOW) == (AT(2024, 3, 31, 11, 30), True)
    for bad in ("", "soon", "5x", "2024-13-01", "h", "2024-03-31T99:00:00Z"):
        with pytest.raises(ValueError, match="no time"):
            bounds.when(bad, NOW)


def test_sources_with_faults(spark, tmp_path):
    line = {"type": "assistant", "uuid": "a", "message": {"usage": {"input_tokens": 4}}}
    good, cut, junk, empty = (tmp_path / x for x in ("good", "cut", "junk", "empty"))
    for p in (good, cut, junk, empty):
        p.mkdir()
    (good / "a.jsonl").write_text(json.dumps(line) + "\n")
    (cut / "b.jsonl").write_text(json.dumps({"type": "message", "message": {"role": "assistant", "usage": {"input": 2}}}) + '\n{"cut')
    (junk / "c.jsonl").write_bytes(bytes(range(256)) * 10)
    (empty / "d.jsonl").write_text("")
    records, status = collect.collect(spark, {"claude": str(good), "pi-agent": str(cut), "copilot-cli": str(junk), "codex": str(empty), "opencode": str(tmp_path / "none"), "other": str(good)})
    assert sorted((r["source"], r["prompt"]) for r in records.collect()) == [("claude", 4), ("pi-agent", 2)]
    got = {r["source"]: (r["state"], r["files"], r["incomplete"]) for r in status.collect()}
    assert got == {"claude": ("ok", 1, 0), "pi-agent": ("ok", 1, 1), "copilot-cli": ("ok", 1, 1), "codex": ("ok", 0, 0), "opencode": ("missing", None, None), "other": ("unknown", None, None)}


def test_dates_that_fall(spark):
    rows = [("upsert", "2024-01-02", 1, "p", "m", 1.0, 1), ("upsert", "2024-01-05", 2, "p", "m", 2.0, 2), ("upsert", "2024-01-04", 3, "p", "m", 3.0, 3)]
    df = spark.createDataFrame(rows, "op string, ts string, commit_seq int, provider string, model string, input double, sequence long").withColumn("ts", F.to_timestamp("ts"))
    assert price_history.daily_snapshots(df.where("sequence < 3"), ["input"], "2024-01-07").count() == 5
    with pytest.raises(Exception, match="decrease from 2024-01-05 to 2024-01-04"):
        price_history.daily_snapshots(df, ["input"], "2024-01-07").collect()
    quiet = df.where("sequence < 3")  # a commit without changes counts, too
    with pytest.raises(Exception, match="decrease"):
        price_history.daily_snapshots(quiet, ["input"], "2024-01-07", commits=df.select("commit_seq", "ts")).collect()


def test_facets(spark):
    rows = [("p1", "m1", "c", "f1"), ("p1", "m2", None, "f1"), ("p1", "m3", "c", "f2"), ("p2", "m4", "c", "f2"), ("p3", "x", "c", None)]
    df = spark.createDataFrame(rows, "provider string, model string, canonical_name string, family string")
    got = {(r["facet"], r["value"]): (r["routes"], r["chosen"]) for r in catalog.route_facets(df, "m", provider="p1", family="f2", resolved_only=True).collect()}
    assert got == {("provider", "p1"): (1, True), ("provider", "p2"): (1, False), ("provider", "p3"): (0, False), ("family", "f1"): (1, False), ("family", "f2"): (1, True)}


def test_as_text():
    assert json_text.as_text("plain") == "plain" and json_text.as_text({"a": ["é", 1]}) == '{"a":["é",1]}' and json_text.as_text(None) == "null"


def test_resolution():
    assert [activity.resolution(*x) for x in ((29.9, 2), (30, 30), (31 * 24, 31))] == ["hourly", "daily", "calendar"]
    assert activity.resolution(5, 1, heatmap=True) == "daily"
