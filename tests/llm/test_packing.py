"""Best-fit packing: ids against whole texts, sequences against the rules, bounds against all packings."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_alignment import odd
from tokenlake.llm import chunks as ch
from tokenlake.llm import packing, queries
from tokenlake.llm.common import Scratch

R = random.Random(8)


@pytest.fixture(scope="module")
def texts():
    out = [None, "", " ", "a  b", " \n x ", "<|endoftext|>", "a <|endoftext|>b", "\n <|endoftext|> c", "word " * 3000, "漢" * 2000, "z" * 9000, " ".join(["w"] * 1023), " ".join(["w"] * 1024)]
    out += [odd(R.randint(1, 400)) for _ in range(150)] + ["<|endoftext|>".join([odd(5), odd(9)]) for _ in range(20)]
    return out + ["copied text"] * 30


def brute(texts, n=1024):
    """(place of text, piece) -> (start, length, crc32)."""
    tok = ch.byte_tokenizer(ch.FOLDER, False)
    out = {}
    for i, t in enumerate(texts):
        ids = (tok.encode(t, add_special_tokens=False).ids if t else []) + [2]
        first = len(ids) % n or n
        cuts = [0] + list(range(first, len(ids) + 1, n))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out[i, k] = (a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])))
    return out


def fits(rows, n=1024):
    """Sequences without gaps or overlaps; their number."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for got in by.values():
        at = 0
        for o, size in sorted(got):
            assert o == at
            at += size
        assert at <= n
    return len(by)


@pytest.mark.parametrize("items", [20, 50_000])
def test_pieces_and_sequences(spark, texts, items):
    data = [(None if i == 3 else i, t, 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, length int, key int").repartition(3)
    cut = packing.pieces(docs, ["doc_id", "length", "key"])
    rows = packing.pack(cut, Scratch(spark, "t"), items=items).collect()
    want = brute(texts)
    assert len(rows) == len(want)
    for r in rows:
        i = 3 if r["row"]["doc_id"] is None else r["row"]["doc_id"]
        assert (r["start"], r["length"], zlib.crc32(bytes(r["ids"]))) == want[i, r["piece"]], repr(texts[i])
    n = fits(rows)
    bound = packing.lower_bound(np.array([r["length"] for r in rows]))
    assert bound <= n <= (bound + 1 if items > 20 else 1.1 * bound)  # twenty pieces leave little choice
    assert all(len(r["ids"]) <= 4096 for r in packing.sequences(packing.pack(cut, Scratch(spark, "t"))).collect())


def test_encoder_forgets(texts, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    some, tok = packing.Encoder(ch.FOLDER), ch.byte_tokenizer(ch.FOLDER, False)
    for t in texts * 2:
        assert some.encode([t])[0] == np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


def least(sizes, n):
    """The least number of sequences, by trying all."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for r in set(bins):
            if r >= sizes[i]:
                b = list(bins)
                b[b.index(r)] -= sizes[i]
                put(i + 1, b)
        put(i + 1, [*bins, n - sizes[i]])

    put(0, [])
    return best


def test_bounds_hold():
    met = 0
    for _ in range(300):
        n = R.choice([10, 16, 24])
        sizes = np.array(sorted((R.randint(1, n) for _ in range(R.randint(1, 9))), reverse=True))
        (at, certified), bound, true = packing.fewest(sizes, n), packing.lower_bound(sizes, n), least(sizes.tolist(), n)
        assert bound <= true <= at.max() + 1 and certified == (bound == at.max() + 1)
        for a in (packing.best_fit(sizes, n), packing.closest_fit(sizes, n, 5), at):
            assert len(a) == len(sizes) and np.bincount(a, sizes).max() <= n and set(a) == set(range(a.max() + 1))
        met += bound == true
    assert met > 270
    x = np.array([600] * 10 + [500] * 5)
    assert packing.lower_bound(x) == 13 and packing.best_fit(x).max() + 1 == 13


def test_feasible():
    """What fits in a sequence is worth no more than one, whatever the function."""
    n = 24
    rows, worth = packing.feasible_functions(n)
    for _ in range(2000):
        room, sizes = n, []
        while room and R.random() < 0.9:
            sizes.append(R.randint(1, room))
            room -= sizes[-1]
        assert (rows[:, sizes].sum(1) <= worth).all()


def test_exchange_lowers_the_count(spark):
    """Partitions with gaps exchange pieces until one is left; every sequence of a certified partition is counted as proven."""
    r = random.Random(1)
    data = [(i, r.choice([r.randint(1, 1023), r.randint(300, 520)])) for i in range(6000)]
    df = spark.createDataFrame(data, "id long, length long")
    rows = packing.pack(df, Scratch(spark, "t"), items=300).collect()
    assert sorted(x["id"] for x in rows) == list(range(6000))
    sizes = np.array(sorted((x for _, x in data), reverse=True))
    together = packing.fewest(sizes)[0].max() + 1
    assert packing.lower_bound(sizes) <= fits(rows) <= together * 1.01
    again = packing.pack(df, Scratch(spark, "t"), items=300).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op11_packing(spark, sf)
    assert got.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    keys = list(docs)
    want = brute([docs[k] for k in keys])
    assert {(keys.index(r["doc_id"]), r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    assert fits(rows) <= packing.lower_bound(np.array([r["length"] for r in rows])) + 1


def test_empty(spark):
    df = packing.pieces(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"])
    assert packing.pack(df.withColumn("n", F.lit(1)), Scratch(spark, "t")).count() == 0
