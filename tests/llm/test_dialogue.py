"""Conversation repair against a plain table of best edits."""

import hashlib
import random

import pytest

from tests.llm import brute
from tokenlake.llm import dialogue, queries
from tokenlake.llm.common import Scratch

R = random.Random(3)
TEXTS = ["Yes.", "No!", "Why?", "cut off", "", "  \n", None, "A. b", "ends. \t", "\x1f"]
ROLES = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "ux", "User"]


def conversation(c, n):
    return [(c, R.choice([None, *range(n + 2)]) if R.random() < 0.3 else i, R.choice(ROLES[: R.choice([3, 5, 10])]), R.choice(TEXTS)) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    out = [r for c in range(250) for r in conversation(c, R.randint(1, 9))]
    out += conversation(None, 6) + conversation(1000, 700) + [(1001, i, "user", "Same.") for i in range(900)] + [(1002, 5, "user", "One row.")] * 50
    out += [(1003, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(400)] + [(1004, None, "user", None)] * 3 + [(1005, 0, "system", "Only.")]
    return out


def df_of(spark, rows, parts=5):
    data = [(*r, "x", 1) for r in rows]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, said string, n int").repartition(parts)


def check(got, want):
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r["conv_id"]


@pytest.mark.parametrize(("parts", "held"), [(1, 20_000), (7, 20_000), (4, 10)])
def test_against_plain_edits(spark, rows, parts, held, monkeypatch):
    monkeypatch.setattr(dialogue, "HELD", held)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = dialogue.repair(df_of(spark, rows), Scratch(spark, "t")).collect()
        damaged, n = dialogue.damaged(df_of(spark, rows))
        again = dialogue.repair(damaged, Scratch(spark, "t"), n).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    check(got, brute.repaired(plain, {r[0] for r in rows}))
    check(again, brute.repaired(*brute.damaged(rows)))


def test_runs_by_powers():
    """A run's powers are its rows one by one; unrolled choices cost what the powers say."""
    for symbol in range(9):
        one = dialogue.IDENTITY
        for n in range(1, 70):
            one = dialogue.times(one, dialogue.power(symbol, 0))
            assert dialogue.of_run(symbol, n) == one
            assert dialogue.advance(symbol, n, dialogue.AT_END) == dialogue.before(one, dialogue.AT_END)
        for n in (1, 31, 32, 33, 64, 100, 1000):
            for state in range(4):
                made = list(dialogue.unroll(symbol, n, state, dialogue.AT_END))
                cost, cut = 0, symbol % 2 if symbol < 8 else 0
                for edits, _ in made:
                    cost += sum({"D": 3, "I": 2, "K": cut, "R": 2 + cut}[e] for e in edits)
                cost += dialogue.AT_END[made[-1][1]]
                assert len(made) == n and cost == dialogue.advance(symbol, n, dialogue.AT_END)[state]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: (*v[:7], hashlib.sha256(v[7].encode()).hexdigest()) for c, v in brute.repaired(*brute.damaged(rows)).items()}
    got = queries.op12_conversation_repair(spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    check(got.collect(), want)


def test_empty(spark, rows):
    assert dialogue.repair(df_of(spark, rows).limit(0), Scratch(spark, "t")).count() == 0
