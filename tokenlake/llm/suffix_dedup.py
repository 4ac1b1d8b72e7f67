"""Exact substring dedup: removes every byte of a ``LENGTH``-byte string that starts elsewhere too.

Anchor fingerprints, in place of prefix doubling, on sampled suffixes. A suffix array over all bytes
would shuffle some 16 bytes for each byte; here only anchors are ranked. The
anchor of a start is the first least 16-byte fingerprint in the WINDOW
positions from it. It lies within the string of LENGTH bytes from the start
and depends on these bytes only, so equal strings have equal anchors; and
some 64 starts in a row share one. A name at an offset is the fingerprint of
that many bytes:

1. offset LENGTH - WINDOW, from the anchors: Spark groups positions by name,
   and runs of starts whose anchor's name is unique leave;
2. offset LENGTH, from the first start of each surviving run: the run is named
   anew by the pair of both names, and its first start is now known to be
   repeated or not. Where two neighbouring runs both begin with a repeated
   start, all between is covered;
3. in the other surviving runs (the ends of repeated passages), every start is
   named by the pair, together with all runs whose anchors have the same name
   of step 1, so that both copies are in the count.

The starts with pairs that occur twice give the covered bytes. A name is a
64-bit polynomial fingerprint; a pair has 128 bits in step 2 and 96 in step 3,
so that among 10^13 starts a chance equality has a probability below 10^-2.
Texts are named by hash and length; of a text's copies in one task one is
ranked, and any text with two rows is removed whole if it has LENGTH bytes.

Edge cases: a null text has no bytes; texts of fewer than LENGTH bytes lose
nothing; overlapping occurrences within a document count; repeated rows are
copies; texts over PIECE bytes are ranked in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import Scratch, bounded_batches

LENGTH, WINDOW, GRAM = 400, 128, 16
PIECE = 1 << 20
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(99))
_VALUE = _rng.integers(0, 2**64, 256, dtype=U64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    if len(_kept.get(base, ())) < n:
        p = np.full(max(n, 4096), base, U64)
        p[0] = 1
        _kept[base] = np.multiply.accumulate(p)
    return _kept[base][:n]


class Prints:
    """Fingerprints of any substring of a text of at most about PIECE bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sum = np.zeros(n + 1, U64)
        np.cumsum(_VALUE[data] * _powers(_BASE, n), out=self.sum[1:])
        self.inverse = _powers(_INVERSE, n + 1)

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        return tb.mix((self.sum[at + length] - self.sum[at]) * self.inverse[at])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sum) - length
        return tb.mix((self.sum[length:] - self.sum[:n]) * self.inverse[:n])


def anchors(p: Prints) -> np.ndarray:
    """For each start of LENGTH bytes, its anchor: the first least fingerprint in the window from it."""
    n = len(p.sum) - LENGTH  # starts
    low = p.every(GRAM)[: n + WINDOW - 1]
    at = np.arange(len(low), dtype=np.int32)
    step = 1
    while step < WINDOW:
        later = low[step:] < low[:-step]
        at = np.where(later, at[step:], at[:-step])
        low = np.where(later, low[step:], low[:-step])
        step *= 2
    return at[:n]


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(begin, core begin, core end) of pieces of starts; all that a start needs lies behind it."""
    for core in range(0, max(1, len(data)), PIECE):
        yield core, core, min(len(data), core + PIECE)


def ranked_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts with one anchor: first start, how many, the anchor's rank at LENGTH - WINDOW, the first start's at LENGTH."""
    out = []
    for begin, core, end in _pieces(data):
        part = data[begin : end + LENGTH - 1]
        if len(part) < LENGTH or len(data) - core < LENGTH:
            continue
        p = Prints(part)
        at = anchors(p)[core - begin : end - begin]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        lo = first + core - begin
        out.append((first + core, np.diff(np.append(first, len(at))), p.of(at[first], LENGTH - WINDOW), p.of(lo, LENGTH)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def _bytes_of(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8)


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()
    for b in batches:
        rows, size = [], 0
        for i, text in enumerate(b.column("bytes")):
            key = (b.column("id")[i].as_py(), len(text.as_buffer()))
            if key not in seen:
                seen.add(key)
                rows.append((key, ranked_anchors(_bytes_of(text))))
                size += len(rows[-1][1][0])
            if size > 100_000:
                yield _as_rows(rows)
                rows, size = [], 0
        if rows:
            yield _as_rows(rows)


def _as_rows(rows: list) -> pa.RecordBatch:
    n = [len(x[0]) for _, x in rows]
    ids = np.repeat(np.array([k[0] for k, _ in rows], np.int64), n)
    lens = np.repeat(np.array([k[1] for k, _ in rows], np.int32), n)
    pos, gap, k, h = (np.concatenate([x[c] for _, x in rows]) for c in range(4))
    return pa.record_batch(
        [pa.array(ids), pa.array(lens), pa.array(pos.astype(np.int32)), pa.array(gap.astype(np.int32)), pa.array(k.astype(U64).view(np.int64)), pa.array(h.astype(U64).view(np.int64))],
        names=["id", "len", "pos", "gap", "k", "h"],
    )


def _open_gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a text's surviving anchors: the ranks of those with an open gap."""
    for b in batches:
        out = []
        for a in b.column("anchors"):
            x = sorted((r["pos"], r["gap"], r["k"], r["again"]) for r in a.as_py())
            again = {p: g for p, _, _, g in x}
            out.extend(k for p, gap, k, g in x if not (g and (gap == 1 or again.get(p + gap))))
        yield pa.record_batch([pa.array(sorted(set(out)), pa.int64())], names=["k"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, len, start, name at LENGTH, 32 bits of the anchor's name) of all starts in the given gaps; and each text once more, compressed."""
    press, seen = zstandard.ZstdCompressor(level=3), set()
    for b in batches:
        for i in range(b.num_rows):
            key, length = b.column("id")[i].as_py(), b.column("len")[i].as_py()
            if (key, length) in seen:
                continue
            seen.add((key, length))
            data = _bytes_of(b.column("bytes")[i])
            ends = b.column("ends")[i].as_py() or []
            at = np.concatenate([np.arange(e["pos"], e["pos"] + e["gap"]) for e in ends]) if ends else np.zeros(0, np.int64)
            of = np.repeat(np.array([e["k"] for e in ends], np.int64), [e["gap"] for e in ends]).astype(np.int32)  # runs don't meet
            within = at + LENGTH <= len(data)
            at, of = at[within], of[within]
            ranks = np.zeros(len(at), U64)
            for begin, core, end in _pieces(data) if len(at) else ():
                mine = (at >= core) & (at < end)
                if mine.any():
                    ranks[mine] = Prints(data[begin : end + LENGTH]).of(at[mine] - begin, LENGTH)
            n = len(at) + 1
            yield pa.record_batch(
                [
                    pa.array(np.full(n, key, np.int64)), pa.array(np.full(n, length, np.int32)), pa.array(np.append(at, -1).astype(np.int32)),
                    pa.array(np.append(ranks, U64(0)).view(np.int64)), pa.array(np.append(of, np.int32(0))), pa.array([None] * (n - 1) + [press.compress(data.tobytes())], pa.binary()),
                ],
                names=["id", "len", "start", "h", "of", "ztext"],
            )


def spans_of(starts: np.ndarray) -> np.ndarray:
    """Sorted distinct starts as maximal [begin, end) runs of covered bytes."""
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > starts[:-1] + LENGTH
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(starts)) - 1
    return np.stack([starts[heads], starts[last] + LENGTH], 1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inflate = zstandard.ZstdDecompressor()
    for b in batches:
        removed, shas, spans = [], [], []
        for z, s in zip(b.column("ztext"), b.column("starts")):
            data = inflate.decompress(z.as_py())
            runs = spans_of(np.unique(np.array(s.as_py(), np.int64)))
            kept, at = hashlib.sha256(), 0
            for x, y in runs.tolist():
                kept.update(data[at:x])
                at = y
            kept.update(data[at:])
            removed.append(int((runs[:, 1] - runs[:, 0]).sum()))
            shas.append(kept.hexdigest())
            spans.append([{"begin": x, "end": y} for x, y in runs.tolist()])
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        yield pa.record_batch([b.column("id"), b.column("len"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, kind)], names=["id", "len", "n_removed", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame, scratch: Scratch, keep: list[str]) -> DataFrame:
    """Columns row (struct of the kept columns), n_bytes, n_removed, n_spans, kept_sha256, spans."""
    bounded_batches(docs.sparkSession)
    raw = F.encode(F.coalesce(docs["text"].cast("string"), F.lit("")), "UTF-8")
    df = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), raw.alias("bytes")).withColumns({"id": F.xxhash64("bytes"), "len": F.octet_length("bytes")})
    texts = df.where(F.col("len") >= LENGTH).select("id", "len", "bytes")
    copies = scratch.write(texts.select("id", "len").groupBy("id", "len").agg(F.count("*").alias("copies")).where(F.col("copies") > 1), "copies")

    ranked = scratch.write(texts.mapInArrow(_rank, "id long, len int, pos int, gap int, k long, h long"), "ranked")
    again = scratch.write(ranked.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("k"), "again")
    left = scratch.write(ranked.join(again, ["k"], "left_semi"), "survivors")
    scratch.drop(ranked)
    full = scratch.write(left.groupBy("k", "h").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("k", "h", F.lit(True).alias("again")), "full")
    flagged = scratch.write(left.join(full, ["k", "h"], "left").select("id", "len", "pos", "gap", "k", F.coalesce("again", F.lit(False)).alias("again")), "flagged")
    scratch.drop(left)

    by_text = flagged.groupBy("id", "len").agg(F.collect_set(F.struct("pos", "gap", "k", "again")).alias("anchors"))
    open_ = scratch.write(by_text.select("anchors").mapInArrow(_open_gaps, "k long").distinct(), "open")
    ends = flagged.join(open_, ["k"], "left_semi").groupBy("id", "len").agg(F.collect_set(F.struct("pos", "gap", "k")).alias("ends"))
    # texts with an anchor that repeats or an open gap; a text with copies is removed whole, but its starts count
    involved = flagged.select("id", "len").distinct().join(ends, ["id", "len"], "left")
    involved = scratch.write(involved, "involved")
    starts = scratch.write(texts.join(involved, ["id", "len"], "inner").select("id", "len", "bytes", "ends").mapInArrow(_starts, "id long, len int, start int, h long, of int, ztext binary"), "starts")
    some = starts.where(F.col("start") >= 0)
    twice = scratch.write(some.groupBy("h", "of").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("h", "of"), "twice")
    covered = some.select("id", "len", "start", "h", "of").join(twice, ["h", "of"], "left_semi").select("id", "len", "start")
    covered = covered.union(flagged.where("again").select("id", "len", F.col("pos").alias("start"))).groupBy("id", "len").agg(F.collect_set("start").alias("starts"))
    held = starts.where(F.col("start") < 0).groupBy("id", "len").agg(F.max("ztext").alias("ztext"))
    alone = covered.join(copies, ["id", "len"], "left_anti")
    cut = alone.join(held, ["id", "len"], "inner").select("id", "len", "ztext", "starts")
    cut = scratch.write(cut.mapInArrow(_cut, "id long, len int, n_removed long, kept_sha256 string, spans array<struct<begin:long,end:long>>"), "cut")

    rows = df.select("row", "id", "len", F.sha2("bytes", 256).alias("whole"))
    out = rows.join(copies, ["id", "len"], "left").join(cut, ["id", "len"], "left")
    gone = F.col("copies").isNotNull()
    whole_span = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("len").cast("long").alias("end")))
    return out.select(
        "row",
        F.col("len").cast("long").alias("n_bytes"),
        F.when(gone, F.col("len").cast("long")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(gone, whole_span).otherwise(F.coalesce("spans", F.array().cast("array<struct<begin:long,end:long>>"))).alias("spans"),
    )
