"""Tokens of two tokenizers aligned by bytes, with the counts of linked id pairs.

A is a byte-level BPE over a space and the text, B a sentencepiece model over
the text, which adds that space itself. A's character offsets and B's spans
are coarse cuts: where a token ends with its span, the span gives its last
byte. Tokens that share a character (parts of a multibyte character, bytes of
a byte fallback) have no span of their own; their ends come from the decoded
bytes. Byte offsets where tokens of both end cut them into groups; each stretch between
two neighbouring ends of either lies in one token of A and one of B, and is
their link.

Chunks of text (chunks.py) are aligned once for each worker while remembered,
since both tokenizers end a token at each chunk's end. Rows keep their linked
pairs with counts in a written table; the corpus-wide counts are summed by
chunk within a task, by pair within Spark. The HOT most frequent pairs, a
bounded table, go to the tasks; rarer ones are joined by pair and summed by
row, so that no frequent pair meets one task.

Edge cases: a text that is null, empty, or that either tokenizer does not give
back byte by byte (U+2581 in it, say) has no tokens: zeros and no groups. Strings of special tokens
are plain text. Null and repeated ids and repeated rows are rows of their
own; an empty table gives an empty result; other columns are carried in a
struct, so their names never clash. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as ch
from .common import Scratch, bounded_batches

#: Pairs that go to the tasks as one sorted table of 17 bytes a pair.
HOT = 400_000
#: Remembered chunks of a worker, in two generations; characters encoded in one call; characters of text in one block.
REMEMBERED, JOINED, BLOCK = 300_000, 50_000, 1_500_000
SPACE = "▁"
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Aligner:
    """Both tokenizers, and what the chunks seen so far came to."""

    def __init__(self, folder: str):
        from sentencepiece import SentencePieceProcessor

        self.a = ch.byte_tokenizer(folder, specials_are_text=True)
        self.b = SentencePieceProcessor(model_file=ch.path(folder, "piece_bpe_32k.model"))
        self.a_bytes, self.b_bytes = _Entries(ch.byte_entries(self.a)), _Entries([self._piece(i) for i in range(self.b.get_piece_size())])
        n = max(len(self.a_bytes.size), len(self.b_bytes.size))
        text = [str(i).encode() for i in range(n)]
        self.digits = np.zeros((n, max(map(len, text)) + 1), np.uint8)
        for i, t in enumerate(text):
            self.digits[i, 1 : 1 + len(t)] = list(t)
        self.n_digits = np.array([len(t) for t in text])
        self.forget()

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return self.b.id_to_piece(i).replace(SPACE, " ").encode()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.sums = np.zeros((0, 4), np.int64)  # of tokens, groups and links; a chunk not given back has -1
        self.off = np.zeros(1, np.int64)  # where a chunk's pairs begin
        self.pairs = np.zeros(0, np.int64)  # A's id times 65536 plus B's id

    def learn(self, new: list[str]) -> None:
        """Align chunks not seen so far."""
        plain = [c for c in new if ch.joinable(c) and SPACE not in c]
        parts, some, size = [], [], 0
        for c in plain:
            some.append(c)
            size += len(c)
            if size > JOINED:
                parts.append((some, self._together(some)))
                some, size = [], 0
        if some:
            parts.append((some, self._together(some)))
        known = set(plain)
        parts += [([c], self._together([c])) for c in new if c not in known]
        for some, made in parts:
            if made is None and len(some) > 1:  # a chunk of these is not given back
                one = [self._together([c]) for c in some]
            else:
                one = [made]
            for got in one:
                sums, groups, pairs, counts = got or (np.full((1, 4), -1, np.int64), [b""], np.zeros(0, np.int64), np.zeros(1, np.int64))
                self._sums.append(sums)
                self._pairs.append(pairs)
                self._counts.append(counts)
                self.groups += groups
            for c in some:
                self.at[c] = len(self.at)

    def look_up(self, texts: list[list[str]]) -> np.ndarray:
        """Places of the chunks of texts, learned where need be."""
        new = list(dict.fromkeys(c for t in texts for c in t if c not in self.at))
        if new:
            self._sums, self._pairs, self._counts = [self.sums], [self.pairs], [np.diff(self.off)]
            self.learn(new)
            self.sums, self.pairs = np.concatenate(self._sums), np.concatenate(self._pairs)
            self.off = np.concatenate([[0], np.cumsum(np.concatenate(self._counts))])
        return np.fromiter(map(self.at.__getitem__, chain.from_iterable(texts)), np.int64)

    def _together(self, some: list[str]) -> tuple | None:
        """(sums, groups, pairs, pairs of each) of chunks joined by spaces; None if either tokenizer does not give them back."""
        text = " ".join(some)
        data = np.frombuffer((" " + text).encode(), np.uint8)
        a, a_ends = self._a(" " + text)
        b, b_ends = self._b(text)
        if not (self.a_bytes.joined(a, data) and self.b_bytes.joined(b, data)):
            return None
        ends = np.union1d(a_ends, b_ends)
        link_a, link_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        a_cut, b_cut = np.isin(a_ends, b_ends, assume_unique=True), np.isin(b_ends, a_ends, assume_unique=True)
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        stop = np.cumsum([len(c.encode()) + 1 for c in some])
        upto = np.stack([np.searchsorted(a_ends, stop, "right"), np.searchsorted(b_ends, stop, "right"), np.searchsorted(a_ends[a_cut], stop, "right"), np.searchsorted(ends, stop, "right")], 1)
        # the groups as text: each token has its place among all, a sign and its digits
        n_a, n_b = np.bincount(a_group), np.bincount(b_group)
        place_a = np.arange(len(a)) + (np.cumsum(n_b) - n_b)[a_group]
        place_b = np.arange(len(b)) + np.cumsum(n_a)[b_group]
        line = np.zeros((len(a) + len(b), self.digits.shape[1]), np.uint8)
        line[place_a], line[place_b] = self.digits[a], self.digits[b]
        line[place_a, 0] = np.where(np.diff(a_group, prepend=-1) > 0, ord(";"), ord(","))
        line[place_b, 0] = np.where(np.diff(b_group, prepend=-1) > 0, ord("|"), ord(","))
        width = np.zeros(len(line) + 1, np.int64)
        width[1 + place_a], width[1 + place_b] = self.n_digits[a] + 1, self.n_digits[b] + 1
        at = np.cumsum(width)[np.concatenate([[0], upto[:, 0] + upto[:, 1]])].tolist()
        written = line[line > 0].tobytes()
        sums = np.diff(upto, axis=0, prepend=0)
        return sums, [written[i + 1 : j] for i, j in zip(at, at[1:])], (a[link_a] << 16) | b[link_b], sums[:, 3]

    def _a(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A's ids and where their bytes end, from its character offsets."""
        made = self.a.encode(text, add_special_tokens=False)
        ids = np.array(made.ids, np.int64)
        spans = np.fromiter(chain.from_iterable(made.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        upto = np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))])
        shared = np.zeros(len(ids), bool)  # with the next token
        shared[:-1] = spans[1:, 0] < spans[:-1, 1]
        return ids, np.where(shared, np.cumsum(self.a_bytes.size[ids]), upto[spans[:, 1]])

    def _b(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """B's ids and where their bytes end, the added space included, from its spans of bytes."""
        pieces = self.b.encode(text, return_type="proto").pieces
        got = np.fromiter(chain.from_iterable((p.id, p.begin, p.end) for p in pieces), np.int64).reshape(-1, 3)
        ids, begin, end = got[:, 0], got[:, 1], got[:, 2]
        # bytes of a fallback: all but a character's last have an empty span, so the last one's is of several tokens
        return ids, np.where(begin == end, np.cumsum(self.b_bytes.size[ids]), end + 1)


class _Entries:
    """The bytes of a vocabulary's entries, one after the other."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray, data: np.ndarray) -> bool:
        """Whether the entries of ids come to data."""
        size = self.size[ids]
        if size.sum() != len(data):
            return False
        end = np.cumsum(size)
        return bool((self.data[np.repeat(self.begin[ids] - end + size, size) + np.arange(len(data))] == data).all())


_kept: dict[str, Aligner] = {}


def _aligner(folder: str) -> Aligner:
    """One of each worker."""
    if folder not in _kept:
        _kept[folder] = Aligner(folder)
    return _kept[folder]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers from begin on, size of them, one range after the other."""
    end = np.cumsum(size)
    return np.repeat(begin - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)


class _Totals:
    """Counts of pairs of a task, kept as counts of chunks until the aligner forgets them."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.seen = aligner, np.zeros(0, np.int64)

    def add(self, places: np.ndarray) -> None:
        if len(self.seen) < len(self.aligner.sums):
            self.seen = np.concatenate([self.seen, np.zeros(len(self.aligner.sums) - len(self.seen), np.int64)])
        self.seen += np.bincount(places, minlength=len(self.seen))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, counts), then from nothing again."""
        some = np.flatnonzero(self.seen)
        size = np.diff(self.aligner.off)[some]
        pairs, which = np.unique(self.aligner.pairs[_ranges(self.aligner.off[some], size)], return_inverse=True)
        counts = np.bincount(which, np.repeat(self.seen[some], size), minlength=len(pairs)).astype(np.int64)
        self.seen = np.zeros(0, np.int64)
        return pairs, counts


def _lists(values: np.ndarray, size: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values, kind))


def _batch(kept: pa.Array | None, rows: int, keys, sums, groups, doc_pairs, total_pairs, row_type: pa.DataType) -> pa.RecordBatch:
    """A batch of rows, or of one row without them that has counts of pairs."""
    values, counts, size = doc_pairs
    t_pairs, t_counts = total_pairs
    return pa.record_batch(
        [
            kept if kept is not None else pa.nulls(rows, row_type),
            pa.array(keys, pa.int64()),
            *[pa.array(sums[:, i], pa.int64()) for i in range(4)],
            pa.array(groups, pa.string()),
            _lists(values >> 16, size, pa.int32()), _lists(values & 65535, size, pa.int32()), _lists(counts, size, pa.int32()),
            _lists(t_pairs, np.array([len(t_pairs)] * rows), pa.int64()), _lists(t_counts, np.array([len(t_pairs)] * rows), pa.int64()),
        ],
        names=["row", "key", *_COUNTS, "groups", "a", "b", "n", "pairs", "counts"],
    )


def _rows(batches: Iterator[pa.RecordBatch], folder: str, digest: bool) -> Iterator[pa.RecordBatch]:
    aligner, n, row_type = _aligner(folder), 0, None
    totals = _Totals(aligner)
    none = np.zeros(0, np.int64)
    first = TaskContext.get().partitionId() << 40

    def summed() -> pa.RecordBatch:
        got = totals.take()
        return _batch(None, 1, [None], np.zeros((1, 4), np.int64), [None], (none, none, np.zeros(1, np.int64)), got, row_type)

    for batch in batches:
        row_type = batch.schema.field("row").type
        texts = batch.column("text").to_pylist()
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < BLOCK):
                size += len(texts[j] or "")
                j += 1
            if len(aligner.at) > 2 * REMEMBERED:
                yield summed()
                aligner.forget()
            cut = [ch.chunks(t) if t else [] for t in texts[i:j]]
            places = aligner.look_up(cut)
            per = np.array([len(c) for c in cut])
            doc = np.repeat(np.arange(j - i), per)
            bad = np.bincount(doc[aligner.sums[places, 0] < 0], minlength=j - i) > 0
            good = ~bad[doc]
            places, doc = places[good], doc[good]
            totals.add(places)
            sums = np.stack([np.bincount(doc, aligner.sums[places, k], minlength=j - i) for k in range(4)], 1).astype(np.int64)
            size = np.diff(aligner.off)[places]
            coded = (np.repeat(doc, size) << 32) | aligner.pairs[_ranges(aligner.off[places], size)]
            pairs, counts = np.unique(coded, return_counts=True)
            groups, p = [], 0
            has = np.bincount(doc, minlength=j - i).tolist()
            plain = places.tolist()
            for k in has:
                joined = b";".join([aligner.groups[x] for x in plain[p : p + k]])
                p += k
                groups.append((hashlib.sha256(joined).hexdigest() if digest else joined.decode()) if k else "")
            links = np.bincount(pairs >> 32, minlength=j - i)
            keys = first + n + np.arange(i, j)
            empty = (none, none)
            yield _batch(batch.column("row").slice(i, j - i), j - i, keys, sums, groups, (pairs & 0xFFFFFFFF, counts, links), empty, row_type)
            i = j
        n += len(texts)
    if row_type is not None:
        yield summed()


def align(docs: DataFrame, scratch: Scratch, keep: list[str], digest: bool = False, folder: str = ch.FOLDER) -> DataFrame:
    """docs (text and the kept columns, as struct row) with n_a, n_b, n_groups, n_links, groups, n_best, count_sum.

    groups is ``a1,a2|b1;a3|b2`` as decimal ids; with ``digest`` its sha256 in lowercase hex.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    row = F.struct(*[docs[c] for c in keep]) if keep else F.struct(F.lit(True).alias("_"))
    df = docs.select(row.alias("row"), docs["text"].cast("string").alias("text"))
    schema = f"row {df.schema['row'].dataType.simpleString()}, key long, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, n array<int>, pairs array<long>, counts array<long>"
    made = scratch.write(df.mapInArrow(lambda it: _rows(it, folder, digest), schema), "aligned")
    of_task = made.where(F.col("key").isNull()).select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    summed = scratch.write(of_task.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count")), "pairs")
    # as many rows as B has ids
    most = summed.groupBy(F.col("pair").bitwiseAND(65535).alias("b")).agg(F.max("count").alias("most"))
    table = scratch.write(
        summed.withColumn("b", F.col("pair").bitwiseAND(65535)).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "counts"
    )
    least = _threshold(table)
    hot = table.where(F.col("count") >= least).orderBy("pair").toPandas() if least else table.orderBy("pair").toPandas()
    sent = spark.sparkContext.broadcast((hot["pair"].to_numpy(np.int64), hot["count"].to_numpy(np.int64), hot["best"].to_numpy(bool)))
    rows = made.where(F.col("key").isNotNull()).select("row", "key", *_COUNTS, "groups", "a", "b", "n")
    schema = f"row {df.schema['row'].dataType.simpleString()}, key long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long, pairs array<long>, counts array<long>"
    judged = rows.mapInArrow(lambda it: _judged(it, sent), schema)
    if not least:
        return judged.drop("key", "pairs", "counts")
    judged = scratch.write(judged, "judged")
    rest = judged.select("key", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("key", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("links"))
    rare = (
        rest.join(table.where(F.col("count") < least), "pair").groupBy("key")
        .agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("count")).alias("more_sum"))
    )
    added = {"n_best": "more_best", "count_sum": "more_sum"}
    return (
        judged.drop("pairs", "counts").join(rare, "key", "left")
        .withColumns({c: F.col(c) + F.coalesce(m, F.lit(0)) for c, m in added.items()}).drop("key", *added.values())
    )


def _threshold(table: DataFrame) -> int:
    """The least count of a hot pair, so that at most HOT pairs are hot; 0 if all are."""
    if table.count() <= HOT:
        return 0
    # powers of 2 ** (1/8): a few hundred rows at any size
    step = F.floor(F.log2("count") * 8).cast("long").alias("step")
    steps = table.groupBy(step).agg(F.count("*").alias("n"), F.min("count").alias("least")).orderBy(F.desc("step")).collect()
    room, least = HOT, steps[0]["least"] if steps[0]["n"] <= HOT else steps[0]["least"] + (1 << 62)
    for s in steps:
        room -= s["n"]
        if room < 0:
            break
        least = s["least"]
    return least


def _judged(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """n_best and count_sum of the hot pairs, and the rows' other pairs."""
    pairs, counts, best = sent.value
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, n = (batch.column(c) for c in "abn")
        size = np.diff(a.offsets.to_numpy())
        mine = (a.flatten().to_numpy(zero_copy_only=False).astype(np.int64) << 16) | b.flatten().to_numpy(zero_copy_only=False)
        links = n.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(batch.num_rows), size)
        at = np.minimum(np.searchsorted(pairs, mine), max(len(pairs) - 1, 0))
        known = pairs[at] == mine if len(pairs) else np.zeros(len(mine), bool)
        n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        np.add.at(n_best, doc[known], np.where(best[at[known]], links[known], 0))
        np.add.at(total, doc[known], counts[at[known]] * links[known])
        rest = np.bincount(doc[~known], minlength=batch.num_rows)
        yield pa.record_batch(
            [*[batch.column(c) for c in ("row", "key", *_COUNTS, "groups")], pa.array(n_best), pa.array(total), _lists(mine[~known], rest, pa.int64()), _lists(links[~known], rest, pa.int64())],
            names=["row", "key", *_COUNTS, "groups", "n_best", "count_sum", "pairs", "counts"],
        )
