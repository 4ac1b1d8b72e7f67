"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Documents become pieces of at most a sequence's length: longer ones are cut
from their end, so that only the first piece is shorter. Full pieces are
sequences. The others are dealt at random over partitions of about ITEMS
pieces; each packs its own by best-fit decreasing and compares its number of
sequences with the greatest of the lower bounds of several hundred dual feasible
functions. Where that leaves a gap, it also packs them sequence by sequence, each
filled by the pieces that come closest, and keeps the better. In a partition that meets its bound no packing takes fewer; it is
done but for the rest in its emptiest sequence. One with a gap keeps its full
sequences and exchanges all other pieces, with the others' and with those
rests: they are dealt anew over fewer partitions and packed again, until one
partition is left.
All that a partition needs is keys and lengths, about ITEMS of them.

Edge cases: a null or empty text is the end id alone; null and repeated ids and
repeated rows are documents of their own; an empty table gives an empty
result; other columns are carried in a struct, so their names never clash; a
text of any length is taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as ch
from .common import Scratch, bounded_batches

LENGTH, END = 1024, 2
#: Pieces of a partition; rounds of exchange.
ITEMS, ROUNDS = 50_000, 16
#: Remembered chunks of a worker, in two generations; characters encoded in one call.
REMEMBERED, JOINED = 400_000, 50_000
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers; chunks are encoded once while remembered."""

    def __init__(self, folder: str):
        self.tokenizer = ch.byte_tokenizer(folder, specials_are_text=False)
        self.size = np.array([len(e) for e in ch.byte_entries(self.tokenizer)], np.int64)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, new: list[str]) -> None:
        some, size = [], 0
        for c in new:
            if not ch.joinable(c):
                self.young[c] = self._ids(" " + c).tobytes()
                continue
            some.append(c)
            size += len(c)
            if size > JOINED:
                self._together(some)
                some, size = [], 0
        if some:
            self._together(some)

    def _together(self, some: list[str]) -> None:
        ids = self._ids(" " + " ".join(some))
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(c.encode()) + 1 for c in some]), "right").tolist()
        for c, i, j in zip(some, [0, *ends], ends):
            self.young[c] = ids[i:j].tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        cut = [ch.chunks(t) if t and SPECIAL not in t else None for t in texts]
        new = []
        for c in {c for t in cut if t for c in t[1:]}.difference(self.young):
            if c in self.old:
                self.young[c] = self.old[c]
            else:
                new.append(c)
        self._learn(sorted(new))
        out = []
        for t, c in zip(texts, cut):
            if c is None:
                out.append(self._ids(t).tobytes() if t else b"")
            else:  # a special token in a text has its own id and is found before the text is split
                out.append(self._ids(c[0]).tobytes() + b"".join(map(self.young.__getitem__, c[1:])))
        return out


_kept: dict[str, Encoder] = {}


def _pieces(batches: Iterator[pa.RecordBatch], folder: str, length: int, end: int) -> Iterator[pa.RecordBatch]:
    encoder = _kept.get(folder) or _kept.setdefault(folder, Encoder(folder))
    stop = np.array([end], "<u4").tobytes()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < 2_000_000):
                size += len(texts[j] or "")
                j += 1
            row, piece, start, ids = [], [], [], []
            for r, got in enumerate(encoder.encode(texts[i:j]), i):
                got += stop
                n = len(got) // 4
                cuts = [0, *range(n % length or length, n + 1, length)]
                row += [r] * (len(cuts) - 1)
                piece += range(len(cuts) - 1)
                start += cuts[:-1]
                ids += [got[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]
            yield pa.record_batch(
                [batch.column("row").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["row", "piece", "start", "length", "ids"],
            )
            i = j


def pieces(docs: DataFrame, keep: list[str], folder: str = ch.FOLDER, length: int = LENGTH, end: int = END) -> DataFrame:
    """row (struct of the kept columns), piece, start, length and ids (little-endian unsigned 32-bit) of each piece of docs.text."""
    bounded_batches(docs.sparkSession)
    row = F.struct(*[docs[c] for c in keep]) if keep else F.struct(F.lit(True).alias("_"))
    df = docs.select(row.alias("row"), docs["text"].cast("string").alias("text"))
    schema = f"row {df.schema['row'].dataType.simpleString()}, piece int, start long, length long, ids binary"
    return df.mapInArrow(lambda it: _pieces(it, folder, length, end), schema)


@lru_cache(8)
def feasible_functions(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Dual feasible functions of lengths 0 to ``length`` as whole numbers (functions x lengths), and what a full sequence is worth in each.

    Sizes themselves; those over 1 - e as whole and those under e as nothing, for each e up
    to a half; rounding down to k-ths unless a size is a whole number of (k+1)-ths; and the rounding of the cut sizes.
    """
    x = np.arange(length + 1)
    rows, worth = [x], [length]

    def rounded(size: np.ndarray, k: int) -> np.ndarray:
        return np.where((k + 1) * size % length == 0, k * size, (k + 1) * size // length * length)

    for e in range(1, length // 2 + 1):
        cut = np.where(x > length - e, length, np.where(x >= e, x, 0))
        rows.append(cut)
        worth.append(length)
        if e % 16 == 0:
            for k in (1, 2, 3, 4, 5):
                rows.append(rounded(cut, k))
                worth.append(k * length)
    for k in range(1, 65):
        rows.append(rounded(x, k))
        worth.append(k * length)
    return np.array(rows, np.int64), np.array(worth, np.int64)


def lower_bound(lengths: np.ndarray, length: int = LENGTH) -> int:
    """No packing takes fewer sequences."""
    rows, worth = feasible_functions(length)
    return int((-(-(rows @ np.bincount(lengths, minlength=length + 1)) // worth)).max())


def best_fit(lengths: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The sequence of each piece; lengths are in decreasing order."""
    room: list[list[int]] = [[] for _ in range(length + 1)]
    some, n, out = 0, 0, []  # some: a bit for each room that sequences have
    for size in lengths.tolist():
        fits = some >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                some ^= 1 << left
        else:
            left, at, n = length, n, n + 1
        left -= size
        if left:
            room[left].append(at)
            some |= 1 << left
        out.append(at)
    return np.array(out, np.int64)


def closest_fit(lengths: np.ndarray, length: int = LENGTH, tries: int = 1000) -> np.ndarray:
    """The sequence of each piece, as best_fit(), filling one sequence after the other.

    Each begins with the longest piece left; the rest is filled by the pieces
    that come closest, long ones first, so that short ones last. ``tries`` bounds the search in one
    sequence, not what is packed.
    """
    ends = np.searchsorted(-lengths, -np.arange(length + 1), "right")  # behind the last piece of each size
    begins = np.searchsorted(-lengths, -np.arange(length + 1), "left")
    count = (ends - begins).tolist()
    some = sum(1 << size for size, c in enumerate(count) if c)
    out, filled, n, tried = np.zeros(len(lengths), np.int64), begins.tolist(), 0, 0

    def move(size: int, by: int) -> None:
        nonlocal some
        before = count[size]
        count[size] += by
        if not before or not count[size]:
            some ^= 1 << size

    def fill(room: int, most: int, now: list[int]) -> None:
        """Search pieces for a room, none longer than ``most``."""
        nonlocal best, tried
        fits = some & ((1 << min(room, most) + 1) - 1)
        while fits and tried < tries:
            size = fits.bit_length() - 1
            tried += 1
            move(size, -1)
            now.append(size)
            if room - size < best[0]:
                best = (room - size, list(now))
            if best[0] and room > size:
                fill(room - size, size, now)
            move(now.pop(), 1)
            if not best[0]:
                return
            fits &= (1 << size) - 1

    while some:
        first = some.bit_length() - 1
        move(first, -1)
        best, tried = (length - first, []), 0
        fill(length - first, length, [])
        for size in best[1]:
            move(size, -1)
        for size in [first, *best[1]]:
            out[filled[size]] = n
            filled[size] += 1
        n += 1
    return out


def fewest(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, bool]:
    """(the sequence of each piece, whether the lower bound is met): best fit, and where that leaves a gap, the better of it and the closest fit."""
    at, bound = best_fit(lengths, length), lower_bound(lengths, length)
    for tries in (100, 1000):
        if at.max() + 1 == bound:
            break
        other = closest_fit(lengths, length, tries)
        at = min(at, other, key=lambda x: (x.max(), -(np.bincount(x, lengths) == length).sum()))
    return at, bool(at.max() + 1 == bound)


def _packed(batches: Iterator[pa.RecordBatch], length: int, turn: int) -> Iterator[pa.RecordBatch]:
    got = [(b.column("key").to_numpy(), b.column("length").to_numpy()) for b in batches if b.num_rows]
    if not got:
        return
    keys, sizes = (np.concatenate(x) for x in zip(*got))
    order = np.lexsort([keys, -sizes])  # the same whatever order the rows came in
    keys, sizes = keys[order], sizes[order]
    at, certified = fewest(sizes, length)
    used = np.bincount(at, sizes).astype(np.int64)
    by = np.argsort(at, kind="stable")
    keys, sizes, at = keys[by], sizes[by], at[by]
    begin = np.cumsum(used) - used
    offset = np.cumsum(sizes) - sizes - begin[at]
    settled = used[at] == length
    if certified:
        settled |= at != used.argmin()
    sequence = (turn << 54) | (TaskContext.get().partitionId() << 28) | at
    for i in range(0, len(at), 10_000):
        s = slice(i, i + 10_000)
        yield pa.record_batch(
            [pa.array(keys[s]), pa.array(sizes[s]), pa.array(sequence[s]), pa.array(offset[s]), pa.array(settled[s]), pa.array(np.full(len(at[s]), certified))],
            names=["key", "length", "sequence_id", "offset", "settled", "certified"],
        )


def pack(pieces: DataFrame, scratch: Scratch, length: int = LENGTH, items: int = ITEMS) -> DataFrame:
    """pieces (any columns, ``length`` among them) with sequence_id and offset, and whether its partition's count met the bound (certified)."""
    spark = pieces.sparkSession
    keyed = scratch.write(pieces.withColumn("key", F.monotonically_increasing_id()), "pieces")
    left = keyed.where(F.col("length") < length).select("key", "length")
    schema = "key long, length long, sequence_id long, offset long, settled boolean, certified boolean"
    done = keyed.where(F.col("length") == length).select("key", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    n = left.count()
    for turn in range(ROUNDS):
        parts = math.ceil(n / items)
        if not n:
            break
        dealt = left.repartition(parts, F.xxhash64("key", F.lit(turn)))
        made = scratch.write(dealt.mapInArrow(lambda it, turn=turn: _packed(it, length, turn), schema), "round")
        open_ = made.where(~F.col("settled"))
        last = open_.count()
        ends = not last or parts == 1 or turn == ROUNDS - 1
        done = done.unionByName((made if ends else made.where("settled")).select("key", "sequence_id", "offset", "certified"))
        if ends:
            break
        left, n = open_.select("key", "length"), last
    return keyed.join(done, "key").drop("key")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence, from packed pieces that have ids; a sequence has at most its length of pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
