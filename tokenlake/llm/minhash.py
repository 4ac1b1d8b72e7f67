"""MinHash near-duplicates: universal hash minima, banding, checked links, components.

1. Each text gives the set of its 5-word shingles (64-bit hashes), the minima
   of 128 universal hash functions over it, and a 128-bit digest of the set.
2. Texts of equal sets form a class; all that follows runs on classes, so
   thousands of copies cost as much as one.
3. Minima are cut into 32 bands of 4. In each bucket (band and values) every
   class is paired with one class only, the bucket's hub: the member that
   shares most buckets with others. That makes as many pairs as members. Two
   sets of similarity 0.75 share no bucket with probability
   (1 - 0.75^4)^32 = 5e-6.
4. A pair counts as a link after two checks: at least MIN_AGREE of the 128
   minima agree (a pair of 0.75 fails that with probability 1e-6), and the
   full sets meet 100 * intersection >= 75 * union. Each class first checks
   the hub it shares most buckets with; of the other hubs only those that lie
   in another component then.
5. Buckets whose members are still in different components could hold links
   that no hub showed. Their members are compared in blocks, minima first,
   then full sets; only links that join components come out. The blocks of a
   bucket's largest component do not meet one another, so a hot bucket costs
   its members times those outside that component. Pairs within a
   component are not looked at, and no bucket is capped.
6. Components come from alternating large-star and small-star.

Edge cases: without words or text a document has an empty set, is linked
with nothing and keeps its own id; repeated rows and equal texts are linked
(similarity 1); a null id takes part in links, but the smallest known id
names the component, and a component of null ids only has a null name and
keeps all rows; of rows that repeat the naming id, all count as kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import Scratch, bounded_batches
from .components import components

SHINGLE, BANDS, ROWS = 5, 32, 4
HASHES = BANDS * ROWS
MIN_AGREE = 72
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 2_000_000

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The 128 minima, 16 bits kept of each."""
    low = np.full(HASHES, np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 512):
        h = _A[:, None] * shingles[None, i : i + 512]
        h += _B[:, None]
        np.minimum(low, h.min(axis=1), out=low)
    return (tb.mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts, rows = batch.column("text"), batch.column("row_id")
        for i, j, data, offs in tb.blocks(texts):
            hashes, first = tb.words(data, offs, tb.NOT_BLANK)
            ns, d1, d2, sigs, zs = [], [], [], [], []
            for k in range(j - i):
                s = tb.shingles(hashes[first[k] : first[k + 1]], SHINGLE)
                ns.append(len(s))
                m = tb.mix(s + tb.U64(1))
                d1.append(int(m.sum(dtype=np.uint64).view(np.int64)))
                d2.append(int(np.bitwise_xor.reduce(tb.mix(m + tb.U64(77)), initial=np.uint64(0)).view(np.int64)))
                sigs.append(minima(s).tobytes() if len(s) else None)
                zs.append(press.compress(data[offs[k] : offs[k + 1]].tobytes()) if len(s) else None)
            yield pa.record_batch(
                [rows.slice(i, j - i), batch.column("doc_id").slice(i, j - i), pa.array(ns, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(zs, pa.binary())],
                names=["row_id", "doc_id", "n_shingles", "d1", "d2", "sig", "ztext"],
            )


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (u, v, zu, zv), those whose full sets are similar enough."""
    inflate, kept = zstandard.ZstdDecompressor(), {}

    def sets(key: int, z: bytes) -> np.ndarray:
        if key not in kept:
            if len(kept) > 64:
                kept.clear()
            data = np.frombuffer(inflate.decompress(z), np.uint8)
            kept[key] = tb.shingles(tb.words(data, np.array([0, len(data)]), tb.NOT_BLANK)[0], SHINGLE)
        return kept[key]

    for b in batches:
        us, vs = b.column("u").to_pylist(), b.column("v").to_pylist()
        ok = []
        for u, v, zu, zv in zip(us, vs, b.column("zu"), b.column("zv")):
            x, y = sets(u, zu.as_py()), sets(v, zv.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= 75 * (len(x) + len(y) - both))
        keep = [i for i, x in enumerate(ok) if x]
        yield pa.record_batch([pa.array([us[i] for i in keep], pa.int64()), pa.array([vs[i] for i in keep], pa.int64())], names=["u", "v"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("su", "sv"))
            keep = pa.array((x == y).sum(axis=1) >= MIN_AGREE)
            yield pa.record_batch([b.column("u").filter(keep), b.column("v").filter(keep)], names=["u", "v"])


def _meet(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of blocks of the incidence matrix."""
    n = len(sets)
    which = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[col]
    which, col = which[keep], number[col[keep]]
    by = np.argsort(col, kind="stable")
    which, col = which[by], col[by]
    out = np.zeros((n, n), np.float64)
    for c in range(0, int(shared.sum()), 2048):
        lo, hi = np.searchsorted(col, (c, c + 2048))
        m = np.zeros((n, 2048), np.float32)
        m[which[lo:hi], col[lo:hi] - c] = 1
        out += m @ m.T
    return out


def _block_links(pdf):
    """Of one or two blocks of a bucket: links that join different components, no more than join them.

    A pair is looked at only in the first band in which its minima agree.
    """
    import pandas as pd

    ids, roots, half = pdf["id"].to_numpy(), pdf["root"].to_numpy(), pdf["half"].to_numpy()
    band, alone = int(pdf["band"].iloc[0]), bool(pdf["x"].iloc[0] == pdf["y"].iloc[0])
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(-1, BANDS, ROWS)
    left = np.arange(len(ids)) if alone else np.flatnonzero(half == 0)
    right = left if alone else np.flatnonzero(half == 1)
    pairs = []
    for i in left:
        other = right[(roots[right] != roots[i]) & (ids[right] > ids[i] if alone else True)]
        same = sig[other] == sig[i]
        close = same.sum(axis=(1, 2)) >= MIN_AGREE
        other, same = other[close], same[close]
        other = other[same.all(axis=2).argmax(axis=1) == band]
        if len(other):
            pairs.append((i, other))
    us, vs = [], []
    if pairs:
        some = np.unique(np.concatenate([np.array([i for i, _ in pairs]), *[o for _, o in pairs]]))
        inflate, sets = zstandard.ZstdDecompressor(), []
        for z in pdf["ztext"].to_numpy()[some]:
            data = np.frombuffer(inflate.decompress(z), np.uint8)
            sets.append(tb.shingles(tb.words(data, np.array([0, len(data)]), tb.NOT_BLANK)[0], SHINGLE))
        meet, size = _meet(sets), np.array([len(s) for s in sets])
        top: dict[int, int] = {}

        def find(r: int) -> int:
            while top.get(r, r) != r:
                r = top[r]
            return r

        for i, other in pairs:
            a, b = np.searchsorted(some, i), np.searchsorted(some, other)
            both = meet[a, b]
            for j in other[100 * both >= 75 * (size[a] + size[b] - both)]:
                p, q = find(int(roots[i])), find(int(roots[j]))
                if p != q:
                    top[max(p, q)] = min(p, q)
                    us.append(ids[i])
                    vs.append(ids[j])
    return pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})


class _Classes:
    def __init__(self, table: DataFrame, scratch: Scratch):
        self.texts, self.sigs, self.scratch = table.select("row_id", "ztext"), table.select("row_id", "sig"), scratch

    def agreeing(self, pairs: DataFrame) -> DataFrame:
        s = self.sigs
        return (
            pairs.join(s.select(F.col("row_id").alias("u"), F.col("sig").alias("su")), "u")
            .join(s.select(F.col("row_id").alias("v"), F.col("sig").alias("sv")), "v")
            .select("u", "v", "su", "sv")
            .mapInArrow(_agreeing, "u long, v long")
        )

    def linked(self, pairs: DataFrame, name: str) -> DataFrame:
        t = self.texts
        return self.scratch.write(
            pairs.join(t.select(F.col("row_id").alias("u"), F.col("ztext").alias("zu")), "u")
            .join(t.select(F.col("row_id").alias("v"), F.col("ztext").alias("zv")), "v")
            .select("u", "v", "zu", "zv")
            .mapInArrow(_checked, "u long, v long"),
            name,
        )


def _rooted(df: DataFrame, roots: DataFrame, key: str, name: str) -> DataFrame:
    r = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return df.join(r, F.col(key) == F.col("_n"), "left").withColumn(name, F.coalesce("_r", key)).drop("_n", "_r")


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """row_id, doc_id, n_shingles, component_id, kept and first (one row of each component), a row for each row of docs."""
    ids = docs.select("doc_id", "text").withColumn("row_id", F.monotonically_increasing_id())
    return near_duplicates_of(ids, scratch)


def near_duplicates_of(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for rows that have a row_id already (row_id, doc_id, text)."""
    bounded_batches(rows.sparkSession)
    fields = "row_id long, doc_id long, n_shingles long, d1 long, d2 long, sig binary, ztext binary"
    made = scratch.write(rows.select("row_id", F.col("doc_id").cast("long"), "text").mapInArrow(_features, fields), "features")
    some = made.where(F.col("n_shingles") > 0)

    members = some.select("row_id", "d1", "d2", "n_shingles")
    # aggregates are written before they are joined, so that Spark can split hot keys in the join
    classes = scratch.write(members.groupBy("d1", "d2", "n_shingles").agg(F.min("row_id").alias("class")), "sets")
    member_of = scratch.write(
        members.join(classes.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("n_shingles").alias("e3"), "class"), (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n_shingles") == F.col("e3"))).select("row_id", "class"),
        "classes",
    )
    reps = member_of.where(F.col("row_id") == F.col("class")).select("class")
    table = some.select("row_id", "sig", "ztext")
    cls = _Classes(table, scratch)
    sig_of_rep = scratch.write(some.select("row_id", "sig").join(reps, F.col("row_id") == F.col("class"), "left_semi"), "sigs")
    cls.sigs = sig_of_rep

    width = 2 * ROWS
    keys = [F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring("sig", b * width + 1, width)).alias("key")) for b in range(BANDS)]
    bands = sig_of_rep.select(F.col("row_id").alias("id"), F.explode(F.array(*keys)).alias("k")).select("id", "k.*")
    sizes = scratch.write(bands.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1), "buckets")
    held = scratch.write(bands.join(sizes, ["band", "key"]), "held")
    # the member that meets most others is the most likely to be linked with all of a bucket
    central = held.groupBy("id").agg(F.sum("n").alias("w"))
    hubs = scratch.write(held.join(central, "id").groupBy("band", "key").agg(F.max_by("id", F.struct("w", "id")).alias("v")), "hubs")
    pairs = scratch.write(
        held.join(hubs, ["band", "key"]).select(F.col("id").alias("u"), "v").where(F.col("u") != F.col("v")).groupBy("u", "v").agg(F.count("*").alias("shared")),
        "pairs",
    )
    best = pairs.groupBy("u").agg(F.max_by("v", F.struct("shared", "v")).alias("v"))
    links = cls.linked(cls.agreeing(best), "links")
    roots = scratch.write(components(links, scratch), "roots")

    def apart(df: DataFrame) -> DataFrame:
        return _rooted(_rooted(df, roots, "u", "ru"), roots, "v", "rv").where(F.col("ru") != F.col("rv")).select("u", "v")

    more = cls.linked(cls.agreeing(apart(pairs.select("u", "v"))), "links")
    links = scratch.write(links.union(more), "links")
    roots = scratch.write(components(links, scratch), "roots")

    # buckets that still hold several components
    rooted = scratch.write(
        _rooted(held.select("band", "key", "id"), roots, "id", "root").join(some.select(F.col("row_id").alias("id"), F.col("n_shingles")), "id"), "rooted"
    )
    by_root = scratch.write(rooted.groupBy("band", "key", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")), "by-root")
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK_MEMBERS), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    main = F.max_by(F.struct("root", "n", "s"), F.struct("n", "root")).alias("main")
    open_ = by_root.groupBy("band", "key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("roots"), main).where("roots > 1 and n > 2")
    # a bucket of more than a block: first the blocks of its main component, which do not meet one another, then the others'
    split = blocks(F.col("n"), F.col("s")) > 1
    mains = F.when(split, blocks(F.col("main.n"), F.col("main.s"))).otherwise(0)
    others = F.when(split, blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s"))).otherwise(1)
    open_ = scratch.write(open_.select("band", "key", F.col("main.root").alias("main"), mains.alias("mains"), others.alias("others")), "open")
    mine = rooted.join(open_, ["band", "key"]).withColumn("inner", (F.col("mains") > 0) & (F.col("root") == F.col("main")))
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    mine = mine.withColumn("p", F.when(F.col("inner"), deal(F.col("mains"))).otherwise(F.col("mains") + deal(F.col("others"))))
    met = F.sequence(F.when(F.col("inner"), F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1)
    meets = F.transform(met, lambda q: F.struct(F.least("p", q).alias("x"), F.greatest("p", q).alias("y")))
    dealt = mine.select("band", "key", "id", "root", "p", F.explode(meets).alias("xy")).select(
        "band", "key", "id", "root", "xy.x", "xy.y", F.when(F.col("p") == F.col("xy.x"), 0).otherwise(1).alias("half")
    )
    rest = dealt.join(some.select(F.col("row_id").alias("id"), "sig", "ztext"), "id").groupBy("band", "key", "x", "y").applyInPandas(_block_links, "u long, v long")
    found = scratch.write(rest.distinct(), "links")
    if found.limit(1).count():
        links = scratch.write(links.union(found), "links")
        roots = scratch.write(components(links, scratch), "roots")

    of_row = _rooted(member_of, roots, "class", "root").select(F.col("row_id").alias("_row"), "root")
    named = made.select("row_id", "doc_id", "n_shingles").join(of_row, F.col("row_id") == F.col("_row"), "left").drop("_row")
    named = scratch.write(named.withColumn("root", F.coalesce("root", "row_id")), "rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")
    first = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min_by("row_id", order).alias("_first")).withColumnRenamed("root", "_root")
    first = scratch.write(first, "names")
    return named.join(first, F.col("root") == F.col("_root")).select(
        "row_id", "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
        (F.col("row_id") == F.col("_first")).alias("first"),
    )


def one_of_each(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs, one for each component: the smallest id's, or of equal ids the first.

    docs must be stored (a table or files), as its rows are numbered twice.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("row_id"))
    judged = near_duplicates_of(rows.select("row_id", "row.doc_id", "row.text"), scratch)
    first = scratch.write(judged.where("first").select("row_id"), "first")
    return rows.join(first, "row_id", "left_semi").select("row.*")
