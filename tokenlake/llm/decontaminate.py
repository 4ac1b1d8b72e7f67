"""Benchmark decontamination with suffix arrays of the training text.

Every task turns its documents into shards of about SHARD bytes and builds
each shard's suffix array over words (prefix doubling on word ranks, numpy).
Every suffix of every benchmark item is then binary-searched in the shard,
all suffixes at once: the range of suffixes that start with its first WINDOW
words gives all verbatim occurrences and their places. Occurrences of
consecutive windows on one diagonal are one match, whose length is the
longest verbatim match there. No document leaves its row, so there is no
shuffle and no hot key.

The benchmark goes to the tasks as word hashes, a block of about BENCH_BLOCK
bytes of text at a time: the documents make one pass for each block, carrying
what earlier blocks hit, so driver and workers hold one block of a benchmark
of any size. A benchmark of one block takes one pass and no written table.

Edge cases: null and wordless documents have no words and are clean; an item
without words is no item; an item of fewer than WINDOW words is one window of
all its words; repeated items count once by id, items with a null id hit
words but are not named; an empty benchmark leaves all clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import Scratch, map_texts

WINDOW = 13
SHARD = 2_500_000
BENCH_BLOCK = 16_000_000

#: of one pass: hit words as maximal [begin, end) runs, items found, the longest match and the number of matches
PASS_FIELDS = "n_words long, begins array<long>, ends array<long>, items array<string>, longest long, longest_item long, longest_at long, matches long"


def suffix_array(chars: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of all texts (words chars[first[k]:first[k+1]]) sorted by their first ``depth`` words."""
    n = len(chars)
    end = np.repeat(first[1:], np.diff(first))
    rank = np.unique(chars, return_inverse=True)[1].astype(np.int64) + 1
    step, at = 1, np.arange(n)
    while step < depth and rank.max(initial=0) < n:
        after = at + step
        inside = after < end
        second = np.zeros(n, np.int64)
        second[inside] = rank[after[inside]]
        rank = np.unique(rank * (n + 1) + second, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    return np.argsort(rank, kind="stable")


def search(chars: np.ndarray, end: np.ndarray, order: np.ndarray, pattern: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern[s : s + l], the range [lo, hi) of sorted suffixes that begin with it."""

    def bound(after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            suffix = order[mid]
            less = np.zeros(len(open_), bool)  # the suffix sorts before the wanted place
            tied = np.arange(len(open_))
            for j in range(int(lens.max())):
                tied = tied[lens[open_[tied]] > j]
                if not tied.size:
                    break
                at = suffix[tied] + j
                over = at >= end[suffix[tied]]
                less[tied[over]] = True  # a text that ends is smaller
                tied, at = tied[~over], at[~over]
                x, y = chars[at], pattern[starts[open_[tied]] + j]
                less[tied] = x < y
                tied = tied[x == y]
            if after:
                less |= _ties(chars, end, suffix, pattern, starts[open_], lens[open_])
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return lo

    return bound(False), bound(True)


def _ties(chars, end, suffix, pattern, starts, lens) -> np.ndarray:
    """Whether each suffix begins with its pattern."""
    same = suffix + lens <= end[suffix]
    for j in range(int(lens.max())):
        left = np.flatnonzero(same & (lens > j))
        if not left.size:
            break
        same[left] = chars[suffix[left] + j] == pattern[starts[left] + j]
    return same


class Block:
    """One block of the benchmark: item words, and its distinct windows."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        texts = pa.array([t for _, t in rows], pa.string())
        self.ids = [i for i, _ in rows]
        parts, firsts, done = [], [0], 0
        for _, _, data, offs in tb.blocks(texts):
            h, first = tb.words(data, offs, tb.LETTERS)
            parts.append(h)
            firsts.extend((first[1:] + done).tolist())
            done += len(h)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        first = np.array(firsts)
        counts = np.diff(first)
        self.lens_by_item = np.minimum(counts, WINDOW)
        n = np.where(counts > 0, np.maximum(counts - WINDOW + 1, 1), 0)
        self.item = np.repeat(np.arange(len(rows)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.start = first[:-1][self.item] + inside
        self.len = self.lens_by_item[self.item]


def _judge(texts: pa.Array, b: Block) -> list[pa.Array]:
    cols: list[list] = [[] for _ in range(8)]
    for i, j, data, offs in tb.blocks(texts, SHARD):
        chars, first = tb.words(data, offs, tb.LETTERS)
        k, n = j - i, len(chars)
        counts = np.diff(first)
        doc_of, end = np.repeat(np.arange(k), counts), np.repeat(first[1:], counts)
        edge = np.zeros(n + 1, np.int64)  # +1 where a hit begins, -1 behind it
        found: dict[int, set] = {}
        longest, item_of, place, matches = np.zeros(k, np.int64), [None] * k, [None] * k, np.zeros(k, np.int64)
        some = np.zeros(0, np.int64)
        if len(b.start) and n:
            order = suffix_array(chars, first, WINDOW)
            lo, hi = search(chars, end, order, b.words, b.start, b.len)
            some = np.flatnonzero(hi > lo)
        if some.size:
            reps = (hi - lo)[some]
            which = np.repeat(some, reps)
            p = order[np.repeat(lo[some], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
            np.add.at(edge, p, 1)
            np.subtract.at(edge, p + b.len[which], 1)
            docs, items = doc_of[p], b.item[which]
            pairs = np.unique(docs * len(b.ids) + items)
            for d, it in zip((pairs // len(b.ids)).tolist(), (pairs % len(b.ids)).tolist()):
                if b.ids[it] is not None:
                    found.setdefault(d, set()).add(str(b.ids[it]))
            # windows that follow each other in item and document are one match
            diag = items * (2 * n + 2 * len(b.words)) + (p - b.start[which] + len(b.words))
            by = np.lexsort((p, diag))
            p, d2, w = p[by], diag[by], which[by]
            new = np.ones(len(p), bool)
            new[1:] = (d2[1:] != d2[:-1]) | (p[1:] != p[:-1] + 1) | (doc_of[p[1:]] != doc_of[p[:-1]])
            heads = np.flatnonzero(new)
            length = np.diff(np.append(heads, len(p))) - 1 + b.len[w[heads]]
            dd = doc_of[p[heads]]
            np.add.at(matches, dd, 1)
            top = np.lexsort((p[heads], -length, dd))
            _, f = np.unique(dd[top], return_index=True)
            for x in top[f].tolist():
                d = int(dd[x])
                longest[d], item_of[d], place[d] = length[x], b.ids[int(b.item[w[heads[x]]])], int(p[heads[x]] - first[d])
        hit = np.cumsum(edge[:n]) > 0
        begin, behind = hit.copy(), hit.copy()
        same_doc = doc_of[1:] == doc_of[:-1]
        begin[1:] &= ~(hit[:-1] & same_doc)
        behind[:-1] &= ~(hit[1:] & same_doc)
        at, stop = np.flatnonzero(begin), np.flatnonzero(behind) + 1
        runs = np.searchsorted(doc_of[at], np.arange(k + 1))
        for d in range(k):
            x, y = runs[d], runs[d + 1]
            cols[1].append((at[x:y] - first[d]).tolist())
            cols[2].append((stop[x:y] - first[d]).tolist())
            cols[3].append(sorted(found.get(d, ())))
        for c, v in ((0, counts), (4, longest), (7, matches)):
            cols[c].extend(v.tolist())
        cols[5].extend(item_of)
        cols[6].extend(place)
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.int64()] * 4]
    return [pa.array(c, t) for c, t in zip(cols, types)]


def bench_blocks(benchmark: DataFrame, size: int) -> list[DataFrame]:
    """The benchmark's distinct items in blocks of about ``size`` bytes of text."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // size))
    deal = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.where(deal == k) for k in range(n)]


def _merged(a: Column, b: Column) -> Column:
    """What two passes over a document found, together."""
    longer = b["longest"] > a["longest"]
    return F.struct(
        a["n_words"].alias("n_words"),
        F.concat(a["begins"], b["begins"]).alias("begins"),
        F.concat(a["ends"], b["ends"]).alias("ends"),
        F.array_union(a["items"], b["items"]).alias("items"),
        *[F.when(longer, b[c]).otherwise(a[c]).alias(c) for c in ("longest", "longest_item", "longest_at")],
        (a["matches"] + b["matches"]).alias("matches"),
    )


def _summary(out: Column) -> Column:
    """Runs and items as the counts and the digest of the result."""
    zero = F.lit(0).cast("long")
    runs = F.array_sort(F.zip_with(out["begins"], out["ends"], lambda x, y: F.struct(x.alias("b"), y.alias("e"))))
    n_hit = F.aggregate(
        runs,
        F.struct(zero.alias("to"), zero.alias("n")),
        lambda t, r: F.struct(F.greatest(t["to"], r["e"]).alias("to"), (t["n"] + F.greatest(zero, r["e"] - F.greatest(t["to"], r["b"]))).alias("n")),
        lambda t: t["n"],
    )
    return F.struct(
        out["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(out["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(out["items"]), ",").cast("binary"), 256).alias("items_sha256"),
        *[out[c].alias(c) for c in ("longest", "longest_item", "longest_at", "matches")],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: bool = False, block: int = BENCH_BLOCK) -> DataFrame:
    """Columns row, out and text on demand; out has n_words, n_hit, n_items, items_sha256 and the longest match's words, item and place."""
    blocks = bench_blocks(benchmark, block)
    scratch = Scratch(docs.sparkSession, "decontamination") if len(blocks) > 1 else None
    sent = done = None
    for k, items in enumerate(blocks):
        if k:  # the last pass is written, so its block can go
            done = scratch.write(done, "pass")
            sent.unpersist()
        sent = docs.sparkSession.sparkContext.broadcast(Block([tuple(r) for r in items.collect()]))
        with_text = text or k + 1 < len(blocks)
        found = _pass(docs, sent, keep, with_text) if k == 0 else _pass(done, sent, ["row", "out"], with_text)
        bodies = ["text"] if with_text else []
        done = found if k == 0 else found.select("row.row", *bodies, _merged(F.col("row.out"), F.col("out")).alias("out"))
    return done.select("row", *bodies, _summary(F.col("out")).alias("out"))


def _pass(docs: DataFrame, sent: Broadcast, keep: list[str], text: bool) -> DataFrame:
    return map_texts(docs, lambda texts: _judge(texts, sent.value), PASS_FIELDS, keep, text)


def contaminated(out: Column) -> Column:
    return (out["n_hit"] > 0) & (20 * out["n_hit"] >= out["n_words"])
