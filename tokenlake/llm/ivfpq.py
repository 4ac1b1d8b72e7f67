"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

1. Equal vectors become one class, indexed once, with the k + 1 smallest ids
   of its rows: no other of its rows can be among a query's k nearest.
2. Coarse centroids and residual codebooks are fitted on at most SAMPLE
   classes (chosen by a hash of the vector); every class is indexed: it goes
   to the list of its nearest centroid with the codes of its residual.
3. The number of lists to probe and the length R of a query's shortlist are
   calibrated on the sample, for its true neighbours to lie in those lists
   and among the R least asymmetric distances.
4. Neighbouring short lists share a bin of at most BLOCK classes; longer lists
   are cut into blocks of about BLOCK, and a bin's queries into chunks, so a
   list that holds a third of all rows is spread over many groups. A first round over codes alone finds, with asymmetric distance tables, the
   distance within which R classes of a query's lists lie.
5. A second round measures exactly, on the original vectors, all classes
   within that distance, however many have the same code. The best of
   each block go on to the final ranking of each query.

Rows whose vector is null, zero, empty, or has a null or non-finite
component, or has not the most common length, take no part. Equal distances
go to the smaller id. Repeated rows are separate rows; only the query's own
row is left out. A null id is the last of equals. Other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

SAMPLE = 20_000
BLOCK, CHUNK = 8192, 256
SHORT = 40  # the least shortlist
STEPS = 64  # places of a block's order that the first round reports
MAX_LISTS = 4096
TARGET, SHORT_TARGET = 0.97, 0.99


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c**2).sum(1)[None, :] - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        some = n > 0
        c[some] = s[some] / n[some, None]
        if (~some).any():  # empty lists restart at random rows
            c[~some] = x[rng.choice(len(x), int((~some).sum()))]
    return c


class Index:
    """Centroids and codebooks; encodes rows and ranks codes for queries."""

    def __init__(self, x: np.ndarray, n_rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.dim = x.shape[1]
        self.lists = _kmeans(x, min(MAX_LISTS, max(1, round(math.sqrt(n_rows))), max(1, len(x) // 8)), 10, rng).astype(np.float32)
        m = max(1, self.dim // 4)
        edges = np.linspace(0, self.dim, m + 1).round().astype(int)
        self.parts = list(zip(edges[:-1], edges[1:]))
        r = x - self.lists[self.nearest(x, 1)[:, 0]]
        self.books = [_kmeans(r[:, a:b], 256, 8, rng).astype(np.float32) for a, b in self.parts]

    def calibrate(self, x: np.ndarray, k: int, target: float, n_queries: int = 256) -> int:
        """How many lists to probe so that ``target`` of the sample's true neighbours lie in them."""
        q = x[:n_queries]
        d = (x**2).sum(1)[None, :] - 2 * q @ x.T
        d[np.arange(len(q)), np.arange(len(q))] = np.inf
        if len(x) <= k + 1:
            return len(self.lists)
        true = np.argpartition(d, k, axis=1)[:, :k]
        order = np.argsort((self.lists**2).sum(1)[None, :] - 2 * q @ self.lists.T, axis=1)
        place = np.argsort(order, axis=1)
        ranks = np.sort(np.take_along_axis(place, self.nearest(x, 1)[:, 0][true], axis=1).ravel())
        return int(ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)))]) + 1

    def shortlist(self, x: np.ndarray, n_rows: int, k: int, target: float, n_queries: int = 256) -> int:
        """How many least asymmetric distances hold ``target`` of the true neighbours, among n_rows like the sample.

        The sample's counterpart of the k nearest of n_rows is a smaller number of its rows, and a place in its order counts
        for n_rows / len(x) places. Half is added, as the sample lies nearer to its own centroids than other rows do.
        """
        if len(x) <= k + 1:
            return max(SHORT, n_rows)
        q, scale = x[:n_queries], n_rows / len(x)
        lists = self.nearest(x, 1)[:, 0]
        codes = self.encode(x, lists)
        near = self.lists[lists]
        for part, ((s, e), b) in enumerate(zip(self.parts, self.books)):
            near[:, s:e] += b[codes[:, part]]
        worst, of = [], max(1, min(k, round(k / scale)))
        for i in range(len(q)):
            d, a = ((x - q[i]) ** 2).sum(1), ((near - q[i]) ** 2).sum(1)
            d[i] = a[i] = np.inf
            worst.append(np.searchsorted(np.sort(a), a[np.argpartition(d, of)[:of]], side="right"))
        ranks = np.sort(np.concatenate(worst))
        return max(SHORT, math.ceil(1.5 * scale * ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)))]))

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        d = (self.lists**2).sum(1)[None, :] - 2 * x @ self.lists.T
        if n == 1:
            return np.argmin(d, axis=1)[:, None]
        n = min(n, d.shape[1])
        return np.argpartition(d, n - 1, axis=1)[:, :n]

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = x - self.lists[lists]
        return np.stack(
            [np.argmin((b**2).sum(1)[None, :] - 2 * r[:, s:e] @ b.T, axis=1).astype(np.uint8) for (s, e), b in zip(self.parts, self.books)], axis=1
        )

    def adc(self, q: np.ndarray, a_list: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to coded rows of one list, by one table for each query and part."""
        r = q - self.lists[a_list]
        out = np.zeros((len(q), len(codes)), np.float32)
        for k, ((s, e), b) in enumerate(zip(self.parts, self.books)):
            t = ((r[:, None, s:e] - b[None]) ** 2).sum(2)
            out += t[:, codes[:, k]]
        return out


#: Squares of larger (or smaller) differences leave the range of doubles; codes keep vectors of such sizes in single precision.
FAR = 100


def scaled(x: np.ndarray, shift: int) -> np.ndarray:
    """x times a power of two, in single precision, for codes."""
    return np.ldexp(x.astype(np.float64), shift).astype(np.float32)


def exact_distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, of finite vectors of any size."""
    most = max(np.abs(x).max(initial=0.0), np.abs(q).max(initial=0.0))
    e = int(np.frexp(most)[1])
    if abs(e) <= FAR:
        return np.sqrt(((x - q) ** 2).sum(1))
    # a power of two is exact but for what vanishes beside the largest
    return np.ldexp(np.sqrt(((np.ldexp(x, -e) - np.ldexp(q, -e)) ** 2).sum(1)), e)


def usable(vec: Column) -> Column:
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(vec, lambda v: v != 0)


def bins_of(centroids: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A bin for each list, of at most ``most`` classes or one list, and the classes of each bin; lists along the main axis."""
    mid = centroids - centroids.mean(0)
    order = np.argsort(mid @ np.linalg.svd(mid, full_matrices=False)[2][0], kind="stable")
    bins, held = np.zeros(len(sizes), np.int32), [0]
    for a_list in order.tolist():
        if held[-1] and held[-1] + sizes[a_list] > most:
            held.append(0)
        held[-1] += int(sizes[a_list])
        bins[a_list] = len(held) - 1
    return bins, np.array(held)


def least_distances(d: np.ndarray, short: int) -> list[list[float]]:
    """Of each row of d in rising order, every step-th finite value: each stands for ``step`` more classes within it."""
    step = max(1, short // STEPS)
    most = min(d.shape[1], step * -(-short // step))
    if most < d.shape[1]:
        d = np.partition(d, most - 1, axis=1)[:, :most]
    return [row[np.isfinite(row)].tolist() for row in np.sort(d, axis=1)[:, step - 1 :: step]]


def search(table: DataFrame, scratch: Scratch, *, is_query, k: int = 10, target: float = TARGET, least_probe: int = 8, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that is_query (a Column on ``id``)."""
    kind = "float" if table.schema[vector].dataType.elementType.simpleString() == "float" else "double"
    rows = table.select(F.col(id).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("x")).where(usable(F.col("x")))
    dims = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = scratch.write(rows.where(F.size("x") == dims["dim"]).withColumn("uid", F.monotonically_increasing_id()), "rows")
    by_id = Window.partitionBy("x").orderBy(F.col("id").asc_nulls_last(), "uid")
    first = rows.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    classes = first.groupBy("x").agg(F.min("uid").alias("class"), F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("unnamed"), "id", "uid"))).alias("members"))
    classes = scratch.write(classes, "classes")
    n, most = classes.agg(F.count("*"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v).cast("double"))))).first()
    size = int(np.frexp(most or 1.0)[1])
    shift = -size if abs(size) > FAR // 4 else 0  # codes square them in single precision
    share = min(1.0, SAMPLE / n)
    picked = classes.where(F.pmod(F.xxhash64("x"), F.lit(1_000_003)) < F.lit(round(share * 1_000_003)))
    sample = np.array([r["x"] for r in picked.orderBy(F.xxhash64("x"), "x").select("x").limit(2 * SAMPLE).collect()], np.float64)
    if not len(sample):
        sample = np.array([classes.agg(F.min("x")).first()[0]], np.float64)
    sample = scaled(sample, shift)
    fitted = Index(sample, n)
    n_probe = min(len(fitted.lists), max(least_probe, fitted.calibrate(sample, k, target)))
    short = fitted.shortlist(sample, n, k, SHORT_TARGET)
    wanted = -(-short // max(1, short // STEPS))  # so many reported places stand for the shortlist
    index = table.sparkSession.sparkContext.broadcast(fitted)
    stack = lambda col: np.stack(col.to_numpy())

    def encode(frames):
        ix = index.value
        for f in frames:
            if len(f):
                x = scaled(stack(f["x"]), shift)
                lists = ix.nearest(x, 1)[:, 0]
                yield f[["class"]].assign(list=lists.astype(np.int32), code=[c.tobytes() for c in ix.encode(x, lists)])

    coded = scratch.write(classes.select("class", "x").mapInPandas(encode, "class long, list int, code binary"), "codes")
    sizes = np.zeros(len(fitted.lists), np.int64)
    for r in coded.groupBy("list").count().collect():  # MAX_LISTS rows at most
        sizes[r["list"]] = r["count"]
    bins, held = bins_of(fitted.lists, sizes, BLOCK)
    spread = table.sparkSession.createDataFrame([(i, int(b), max(1, -(-int(held[b]) // BLOCK))) for i, b in enumerate(bins)], "list int, bin int, blocks int")

    def probes(frames):
        ix = index.value
        for f in frames:
            if len(f):
                near = np.sort(ix.nearest(scaled(stack(f["x"]), shift), n_probe), axis=1)
                out: dict[str, list] = {"uid": [], "bin": [], "lists": []}
                for uid, lists in zip(f["uid"], near):
                    of = bins[lists]
                    for b in np.unique(of):
                        out["uid"].append(uid)
                        out["bin"].append(b)
                        out["lists"].append(lists[of == b].astype(np.int32))
                yield pd.DataFrame(out)

    queries = rows.where(is_query(F.col("id"))).select("uid", "id", "x")
    asked = scratch.write(queries.select("uid", "x").mapInPandas(probes, "uid long, bin int, lists array<int>"), "probes")
    per_bin = asked.groupBy("bin").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    per_bin = F.broadcast(spread.join(per_bin, "bin"))  # a row for each list
    span = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    deal = lambda by, c: F.pmod(F.xxhash64(by), F.col(c)).cast("int")
    left = coded.join(per_bin, "list").withColumns({"block": deal("class", "blocks"), "chunk": F.explode(span("chunks"))}).drop("blocks", "chunks")
    right = asked.join(F.broadcast(per_bin.drop("list").distinct()), "bin").withColumns({"chunk": deal("uid", "chunks"), "block": F.explode(span("blocks"))}).drop("blocks", "chunks").join(queries, "uid")
    keys = ["bin", "block", "chunk"]

    def distances(found: pd.DataFrame, asking: pd.DataFrame) -> np.ndarray:
        """Of each query to each class, infinite where its list is not probed."""
        codes = np.frombuffer(b"".join(found["code"]), np.uint8).reshape(len(found), -1)
        q, of = scaled(stack(asking["x"]), shift), found["list"].to_numpy()
        who = np.repeat(np.arange(len(q)), asking["lists"].map(len).to_numpy())
        where = np.concatenate(asking["lists"].to_list())
        d = np.full((len(q), len(of)), np.inf, np.float32)
        for a_list in np.unique(of).tolist():
            i, j = who[where == a_list], np.flatnonzero(of == a_list)
            if len(i):
                d[np.ix_(i, j)] = index.value.adc(q[i], a_list, codes[j])
        return d

    def rank(key, found: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(asking):
            return pd.DataFrame({"uid": [], "within": []})
        return pd.DataFrame({"uid": asking["uid"], "within": least_distances(distances(found, asking), short)})

    reported = left.groupBy(*keys).cogroup(right.select("uid", "x", "lists", *keys).groupBy(*keys)).applyInPandas(rank, "uid long, within array<float>")
    least = Window.partitionBy("uid").orderBy("within")
    reported = reported.select("uid", F.explode("within").alias("within")).withColumn("place", F.row_number().over(least)).where(F.col("place") <= wanted)
    # queries with fewer classes in their lists measure all of these
    reach = reported.groupBy("uid").agg(F.when(F.count("*") == wanted, F.max("within")).alias("reach"))
    reach = scratch.write(reach, "reach")

    def measure(key, found: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_uid": [], "query_id": [], "class": [], "score": []}
        if len(found) and len(asking):
            d, reach_of = distances(found, asking), asking["reach"].fillna(np.inf).to_numpy(np.float32)
            close = np.isfinite(d) & (d <= reach_of[:, None])
            x, q = stack(found["x"]).astype(np.float64), stack(asking["x"]).astype(np.float64)
            of, size = found["class"].to_numpy(), found["size"].to_numpy()
            for i, (uid, qid) in enumerate(zip(asking["uid"], asking["id"])):
                some = np.flatnonzero(close[i])
                exact = exact_distances(x[some], q[i])
                by = np.argsort(exact, kind="stable")
                enough = np.searchsorted(np.cumsum(size[some[by]]), k + 1)  # one may be the query itself
                if enough < len(by):
                    by = by[: np.searchsorted(exact[by], exact[by[enough]], side="right")]
                out["query_uid"].extend([uid] * len(by))
                out["query_id"].extend([qid] * len(by))
                out["class"].extend(of[some[by]])
                out["score"].extend(exact[by])
        return pd.DataFrame(out)

    vectors = left.join(classes.select("class", "x", F.size("members").alias("size")), "class")
    right = right.join(reach, "uid", "left")
    found = vectors.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(measure, "query_uid long, query_id long, class long, score double")
    best = Window.partitionBy("query_uid").orderBy("score")
    found = found.withColumn("place", F.rank().over(best)).where(F.col("place") <= k + 1).join(classes.select("class", F.explode("members").alias("m")), "class")
    found = found.where(F.col("m.uid") != F.col("query_uid"))
    w = Window.partitionBy("query_uid").orderBy("score", "m.unnamed", "m.id", "m.uid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("m.id").alias("vec_id"), "score")
