"""Cross-tokenizer alignment against whole texts through both tokenizers."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tokenlake.llm import alignment, queries
from tokenlake.llm import chunks as ch
from tokenlake.llm.common import Scratch

R = random.Random(11)
PARTS = ["the", " ", "  ", "\n", "\t", "Öl", "漢字", "𝄞", "don't", "<|endoftext|>", "<s>", "<0x0A>", "12,5", "...", " ", "​", " ", "\x1c", "é", "x" * 40, "á", "\r\n", "　", "ﬁ", "'s", " a", "\x85", "᠎", "﻿", "\x00"]


def odd(n):
    return "".join(R.choice(PARTS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    out = [None, "", " ", "   ", "\n", " a", "a ", "a  b", "a\n b", "a \n  b ", "has ▁ mark", "<|endoftext|>", "a <|endoftext|> b", "word " * 3000, "漢" * 3000, "y" * 20_000]
    out += [odd(R.randint(1, 30)) for _ in range(300)]
    return out + ["the same row"] * 3 + ["to be, or not to be"] * 2


@pytest.fixture(scope="module")
def docs(spark, texts):
    data = [(None if i == 20 else i, t, "x", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, row string, key int, n_a int").repartition(3)


def same(got, texts, want):
    assert len(got) == len(texts)
    for r in got:
        i = 20 if r["row"]["doc_id"] is None else r["row"]["doc_id"]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) == want[i], repr(texts[i])


@pytest.fixture(scope="module")
def want(texts):
    return brute.aligned(texts)


def test_all_pairs_hot(spark, docs, texts, want):
    same(alignment.align(docs, Scratch(spark, "t"), ["doc_id", "row", "key"]).collect(), texts, want)


@pytest.mark.parametrize("hot", [0, 40])
def test_rare_pairs_joined_and_chunks_forgotten(spark, docs, texts, want, hot, monkeypatch):
    monkeypatch.setattr(alignment, "HOT", hot)
    same(alignment.align(docs, Scratch(spark, "t"), ["doc_id"]).collect(), texts, want)


def test_chunks_forgotten(texts, want):
    """What a worker keeps is bounded: totals are handed on before chunks are forgotten."""
    some = [t for t in texts if t][:200]
    aligner = alignment.Aligner("/opt/tokenizers")
    total = alignment._Totals(aligner)
    counts = {}
    for i in range(0, len(some), 20):
        places = aligner.look_up([ch.chunks(t) for t in some[i : i + 20]])
        total.add(places)
        for p, n in zip(*total.take()):
            counts[int(p)] = counts.get(int(p), 0) + int(n)
        aligner.forget()
    whole = alignment.Aligner("/opt/tokenizers")
    places = whole.look_up([ch.chunks(t) for t in some])
    once = alignment._Totals(whole)
    once.add(places)
    assert counts == {int(p): int(n) for p, n in zip(*once.take())}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: w for r, w in zip(rows, brute.aligned([r["text"] for r in rows]))}
    got = queries.op13_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert tuple(r)[1:7] == w[:6]
        assert r["groups_sha256"] == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")


def test_empty(spark, docs):
    got = alignment.align(docs.limit(0), Scratch(spark, "t"), ["doc_id"])
    assert got.count() == 0 and got.where(F.col("groups") == "").count() == 0
