"""Language-model scores: a causal self-attention model in numpy, beside a word base.

Base: words are counted over all training documents; each document's base score
needs the counts of its own words. The HOT most frequent words go to the tasks
as a bounded table and are settled there; all other words are joined by their
64-bit hash and summed by document, so neither a frequent word nor a long
vocabulary meets one task or the driver.

Model: words are cut into subword ids of a public tokenizer. One layer of
causal softmax self-attention with learned biases by distance predicts each
next id from a window of WINDOW ids; windows overlap by half, and only the later
half is scored, so that every id is scored once with at least WINDOW / 2 ids of
context (from the document's start: all of them). Windows of many documents
form batches with a causal mask. P(id) is P(group of classes) P(class | group)
P(id | class); the first two are softmaxes of the layer's output added to the
logs of their shares after the previous id. The counts of ids and of pairs of
ids come from all training documents. The attention weights start from a fit on
at most SAMPLE_DOCS of them and are then trained on every window of every training
document, each once: in rounds, in which tasks train on their rows and the mean
of their weights, by ids seen, goes on. So they depend on how rows are dealt, a little.

Edge cases: a null or empty text has one token, its end; null ids are scored
and learned from, not held out; repeated rows are rows of their own; an empty
table gives an empty result; of other columns only doc_id and text are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import Scratch, bounded_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
HOT = 200_000
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 50_000
WINDOW, SCORED = 32, 16
DIM, HIDDEN, OWN, TAIL, GROUP, EMBED = 16, 32, 1000, 24, 64, 2048
BATCH = 256
#: Rounds in which all training documents are learned from, the first one's rate; weights are summed as whole numbers of 1 / UNIT.
PASSES, RATE, UNIT = 4, 0.002, 1 << 20
FLUSH = 1_000_000
BLOCK = 1_500_000
_LOW = np.frombuffer(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)), np.uint8)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def load_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Subwords:
    """Subword ids of words, remembered by the words' hashes. The id after the last is the document's end."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.end = ranks, max(ranks.values()) + 1
        self._enc = None
        self._forget()

    def __getstate__(self):
        return self.ranks

    def __setstate__(self, ranks):
        self.__init__(ranks)

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted, with each word's place in ids
        self.off, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)

    def learn(self, hashes: np.ndarray, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offset, length) of each word's ids, and all ids; hashes are sorted, word k is data[lo[k] : hi[k]]."""
        if self._enc is None:
            import tiktoken

            self._enc = tiktoken.Encoding("own", pat_str=r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=self.ranks, special_tokens={})
            self._stop = self._enc.encode_ordinary("\n")[0]
        if len(self.hashes) > FLUSH:
            self._forget()
        at, known = self._find(hashes)
        if not known.all():
            new = np.flatnonzero(~known)
            ids, lens = self._encode(data, lo[new], hi[new])
            both = np.concatenate([self.hashes, hashes[new]])
            by = np.argsort(both, kind="stable")
            off = len(self.ids) + np.cumsum(lens) - lens
            self.hashes, self.off, self.length = both[by], np.concatenate([self.off, off])[by], np.concatenate([self.length, lens])[by]
            self.ids = np.concatenate([self.ids, ids])
            at, _ = self._find(hashes)
        return self.off[at], self.length[at], self.ids

    def _encode(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has."""
        size = hi - lo + 2  # a blank before, a stop behind
        begin = np.cumsum(size) - size
        text = np.full(int(size.sum()), 32, np.uint8)
        text[begin + size - 1] = 10
        inner = np.repeat(lo - begin - 1, size - 2) + np.delete(np.arange(len(text)), np.concatenate([begin, begin + size - 1]))
        text[np.delete(np.arange(len(text)), np.concatenate([begin, begin + size - 1]))] = _LOW[data[inner]]
        ids = np.array(self._enc.encode_to_numpy(text.tobytes().decode("utf-8", "replace")), np.int32)
        stops = np.flatnonzero(ids == self._stop)
        if len(stops) == len(lo):
            return np.delete(ids, stops), np.diff(stops, prepend=-1) - 1
        # a rare blank inside a word has joined a stop: word by word
        parts = [self._enc.encode_ordinary(" " + _LOW[data[a:b]].tobytes().decode("utf-8", "replace")) for a, b in zip(lo.tolist(), hi.tolist())]
        return np.concatenate([np.array(x, np.int32) for x in parts]), np.array([len(x) for x in parts])


def _words(texts: pa.Array) -> Iterator[tuple]:
    """Blocks: first row, rows, distinct hashes, where one word of each is (bytes, starts, ends), which of them each word is, first word of each row."""
    for i, j, data, offs in tb.blocks(texts, BLOCK):
        lo, hi = tb.spans(data, offs, tb.NOT_BLANK)
        hashes = tb.hashes(data, lo, hi)
        by = np.argsort(hashes)
        new = np.diff(hashes[by], prepend=~hashes[by[:1]]) != 0
        place, which = by[new], np.empty(len(by), np.int64)
        which[by] = np.cumsum(new) - 1
        yield i, j - i, hashes[place], (data, lo[place], hi[place]), which, np.searchsorted(lo, offs)


#: A pair of subword ids is the first times this, plus the second; the id after the end starts a document.
PAIR = 1 << 20


def _sum_pairs(pairs: dict[int, np.ndarray]) -> np.ndarray:
    both = np.concatenate(list(pairs.values()), axis=1)
    some, inv = np.unique(both[0], return_inverse=True)
    return np.stack([some, np.bincount(inv, weights=both[1]).astype(np.int64)])


def _counting(subwords):
    """Task: (kind 0, word hash, count), (1, subword id, count), (2, 0, documents), (3, pair of subword ids, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords.value
        ids = np.zeros(sub.end + 1, np.int64)
        docs, kept, size = 0, [], 0
        pairs: dict[int, np.ndarray] = {}

        def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

        def merged() -> pa.RecordBatch:
            h, n = np.concatenate([a for a, _ in kept]), np.concatenate([b for _, b in kept])
            some, which = np.unique(h, return_inverse=True)
            return rows(0, some.view(np.int64), np.bincount(which, weights=n))

        for b in batches:
            for _, n, some, word, which, _first in _words(b.column("text")):
                docs += n
                if not len(some):
                    continue
                count = np.bincount(which, minlength=len(some))
                off, length, all_ids = sub.learn(some, *word)
                flat = np.repeat(off - (np.cumsum(length) - length), length) + np.arange(length.sum())
                ids += np.bincount(all_ids[flat], weights=np.repeat(count, length), minlength=len(ids)).astype(np.int64)
                # pairs within words, then from each word to the next or the document's end
                within = np.ones(len(flat), bool)
                within[np.cumsum(length) - length] = False
                at = np.flatnonzero(within)
                inner = all_ids[flat[at - 1]].astype(np.int64) * PAIR + all_ids[flat[at]]
                head, tail = all_ids[off].astype(np.int64), all_ids[off + length - 1].astype(np.int64)
                nxt = np.append(head[which[1:]], sub.end)
                full = _first[1:][np.diff(_first) > 0] - 1
                nxt[full] = sub.end
                outer = np.concatenate([tail[which] * PAIR + nxt, (sub.end + 1) * PAIR + head[which[_first[:-1][np.diff(_first) > 0]]]])
                by = np.argsort(inner)
                some_pairs, first_of = np.unique(inner[by], return_index=True)
                weights = np.add.reduceat(np.repeat(count, length)[at][by], first_of) if len(by) else np.zeros(0, np.int64)
                pairs[len(pairs)] = np.stack([some_pairs, weights.astype(np.int64)])
                pairs[len(pairs)] = np.stack(np.unique(outer, return_counts=True))
                if len(pairs) > 16:
                    pairs = {0: _sum_pairs(pairs)}
                kept.append((some, count))
                size += len(some)
                if size > FLUSH // 2:
                    yield merged()
                    kept, size = [], 0
        if kept:
            yield merged()
        ids[sub.end] += docs
        at = np.flatnonzero(ids)
        yield rows(1, at, ids[at])
        yield rows(2, np.zeros(1), np.array([docs]))
        if pairs:
            yield rows(3, *_sum_pairs(pairs))

    return run


class Attention:
    """Causal self-attention over subword ids; the next id's class by a two-level softmax.

    Classes lie in groups of GROUP: P(id) = P(group) P(class | group) P(id | class). Either softmax
    starts from the log of the class's share after the previous id, counted over the corpus.
    """

    def __init__(self, id_counts: np.ndarray, seed: int = 3):
        n = len(id_counts)
        order = np.argsort(-id_counts, kind="stable")
        end = n - 1
        own = [end, *order[order != end][: OWN - 1].tolist()]
        rest = order[~np.isin(order, own)]
        mass = np.cumsum(id_counts[rest] + 0.05)
        self.klass = np.zeros(n, np.int32)
        self.klass[own] = np.arange(len(own))
        self.klass[rest] = len(own) + np.minimum((mass / mass[-1] * TAIL).astype(int), TAIL - 1) if len(rest) else 0
        self.n_groups = -(-(len(own) + TAIL) // GROUP)
        self.n_classes = self.n_groups * GROUP
        smooth = id_counts + 0.05
        total = np.bincount(self.klass, weights=smooth, minlength=self.n_classes) + 1e-9
        self.inside = np.log(smooth / total[self.klass]).astype(np.float32)
        # inputs: frequent ids have vectors of their own, others share their class's
        self.input = np.zeros(n, np.int32)
        top = order[:EMBED]
        self.input[:] = EMBED + self.klass
        self.input[top] = np.arange(len(top))
        self.start, self.pad = EMBED + self.n_classes, EMBED + self.n_classes + 1
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        self.p = {
            "E": 0.5 * r.standard_normal((self.pad + 1, DIM)).astype(np.float32), "B": np.zeros((SCORED, WINDOW), np.float32),
            "Wq": g(DIM, DIM), "Wk": g(DIM, DIM), "Wv": g(DIM, DIM), "W1": g(2 * DIM, HIDDEN), "b1": np.zeros(HIDDEN, np.float32),
            "Wg": 0.1 * g(HIDDEN, self.n_groups), "Wc": 0.1 * g(self.n_groups, HIDDEN, GROUP),
        }
        self.prior = (total / total.sum()).astype(np.float32)
        self.follow(*(np.zeros(0, np.int64),) * 3)
        at = np.arange(WINDOW)
        self.later = np.where(at[None, :] <= (WINDOW - SCORED + np.arange(SCORED))[:, None], 0, -1e4).astype(np.float32)
        self.tables = None

    def follow(self, before: np.ndarray, klass: np.ndarray, n: np.ndarray, weight: float = 8.0) -> None:
        """Set P(class | previous input) from counts of pairs; kept as logs of P(group) and P(class | group)."""
        pairs = np.zeros((self.pad + 1, self.n_classes), np.float32)
        np.add.at(pairs, (before, klass), n.astype(np.float32))
        pairs = (pairs + weight * self.prior) / (pairs.sum(1, keepdims=True) + weight)
        pairs = pairs.reshape(len(pairs), self.n_groups, GROUP)
        groups = pairs.sum(2)
        self.log_class = np.log(pairs / groups[:, :, None]).astype(np.float32)
        self.log_group = np.log(groups).astype(np.float32)

    def laid_out(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, targets (-1: none) and document of each place. A document (which ends with the end id) has padding before it
        and up to a multiple of SCORED places, so that windows are the stretches of WINDOW places from each multiple of SCORED."""
        n = np.diff(first)
        lead = WINDOW - SCORED
        size = lead + -(-n // SCORED) * SCORED
        begin = np.concatenate([[0], np.cumsum(size)])
        inputs, targets = np.full(begin[-1], self.pad, np.int32), np.full(begin[-1], -1, np.int32)
        at = np.arange(first[-1]) + np.repeat(begin[:-1] + lead - first[:-1], n)
        targets[at] = ids
        inputs[at] = self.start
        more = np.delete(np.arange(first[-1]), first[:-1])
        inputs[at[more]] = self.input[ids[more - 1]]
        return inputs, targets, np.repeat(np.arange(len(n)), size)

    def close(self) -> None:
        """Tables of what each input contributes by itself: its key, value and 1; its query and part of the hidden layer."""
        p = self.p
        e = p["E"]
        kv = np.concatenate([e @ p["Wk"], e @ p["Wv"], np.ones((len(e), 1), np.float32)], axis=1)
        kv[self.pad, DIM:] = 0  # adds nothing to a mean
        own = np.concatenate([e @ p["Wq"] * np.float32(1 / np.sqrt(DIM)), e @ p["W1"][:DIM] + p["b1"]], axis=1)
        self.tables = kv, own, p["B"] + self.later
        length = lambda x: float(np.sqrt((x**2).sum(1).max()))
        self.bounded = length(own[:, :DIM]) * length(kv[:, :DIM]) + float(p["B"].max()) < 80

    def _hidden(self, inputs: np.ndarray) -> np.ndarray:
        """The hidden layer at all places but the first lead, from the tables."""
        kv_of, own_of, bias = self.tables
        lead = WINDOW - SCORED
        n = (len(inputs) - lead) // SCORED
        kv = np.take(kv_of, inputs, axis=0)
        own = np.take(own_of, inputs[lead:], axis=0)
        step, item = kv.strides
        seen = np.lib.stride_tricks.as_strided(kv, (n, WINDOW, 2 * DIM + 1), (SCORED * step, step, item))
        a = own[:, :DIM].reshape(n, SCORED, DIM) @ seen[:, :, :DIM].transpose(0, 2, 1)
        a += bias
        np.exp(a if self.bounded else np.minimum(a, np.float32(80)), out=a)
        c = (a @ seen[:, :, DIM:]).reshape(-1, DIM + 1)
        h = (c[:, :DIM] / (c[:, DIM:] + np.float32(1e-6))) @ self.p["W1"][DIM:]
        h += own[:, DIM:]
        return np.maximum(h, 0, out=h)

    def log10(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each document."""
        out = np.zeros(len(first) - 1)
        inputs, targets, doc = self.laid_out(ids, first)
        lead = WINDOW - SCORED
        for i in range(0, len(inputs) - lead, BATCH * SCORED):
            x = inputs[i : i + BATCH * SCORED + lead]
            t, d = targets[i + lead : i + lead + BATCH * SCORED], doc[i + lead : i + lead + BATCH * SCORED]
            lp = self._log_probabilities(self._hidden(x), x[lead:], t)
            out[d[0] : d[-1] + 1] += np.bincount(d - d[0], weights=lp)
        return out / np.log(10)

    def _log_probabilities(self, h: np.ndarray, before: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Natural logs of P(target) at each place; 0 where there is none."""
        k = self.klass[t]
        g, c = k // GROUP, k % GROUP
        lp = self.inside[t]
        logits = np.take(self.log_group, before, axis=0)
        logits += h @ self.p["Wg"]
        lp += _picked(logits, g)
        by = np.argsort(g.astype(np.uint8 if self.n_groups < 256 else np.int32), kind="stable")
        cuts = np.searchsorted(g[by], np.arange(self.n_groups + 1)).tolist()
        h = np.take(h, by, axis=0)
        logits = np.take(self.log_class.reshape(-1, GROUP), (before * self.n_groups + g)[by], axis=0)
        for j, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            if hi > lo:
                logits[lo:hi] += h[lo:hi] @ self.p["Wc"][j]
        lp[by] += _picked(logits, c[by])
        lp[t < 0] = 0
        return lp

    def train(self, ids: np.ndarray, first: np.ndarray, steps: int = 1500, batch: int = 64, rate: float = 0.01, seed: int = 4) -> float:
        """Adam; gives the last mean loss by id."""
        inputs, targets, _ = self.laid_out(ids, first)
        if not len(inputs):
            self.close()
            return 0.0
        window = np.lib.stride_tricks.sliding_window_view
        inputs, targets = window(inputs, WINDOW)[::SCORED], window(targets, WINDOW)[::SCORED, WINDOW - SCORED :]
        some = np.flatnonzero((targets >= 0).any(axis=1))
        r = np.random.default_rng(seed)
        adam, loss = Adam(self.p), 0.0
        for step in range(1, steps + 1):
            pick = some[r.integers(0, len(some), batch)]
            seen, g = self._gradients(inputs[pick], targets[pick].ravel())
            loss = 0.98 * loss + 0.02 * seen if step > 1 else seen
            adam.step(g, rate * min(1.0, step / 50) * (0.05 + 0.95 * (1 - step / steps)))
        self.close()
        return loss

    def windows(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs (windows x WINDOW) and targets (windows x SCORED) of every window that scores an id."""
        inputs, targets, _ = self.laid_out(ids, first)
        view = np.lib.stride_tricks.sliding_window_view
        inputs, targets = view(inputs, WINDOW)[::SCORED], view(targets, WINDOW)[::SCORED, WINDOW - SCORED :]
        some = (targets >= 0).any(axis=1)
        return inputs[some], targets[some]

    def _gradients(self, x_in: np.ndarray, t: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss by id of a batch of windows, and its gradients.

        As in close(), what an input contributes by itself comes from tables over all inputs.
        """
        p, lead, scale = self.p, WINDOW - SCORED, 1 / float(np.sqrt(DIM))
        e, (b, n) = p["E"], (len(x_in), len(t))
        # forward
        by_kv, by_own = np.concatenate([p["Wk"], p["Wv"]], axis=1), np.concatenate([p["Wq"] * scale, p["W1"][:DIM]], axis=1)
        kv_of = np.concatenate([e @ by_kv, np.ones((len(e), 1), e.dtype)], axis=1)
        kv_of[self.pad, DIM:] = 0  # adds nothing to a mean
        own_of = e @ by_own
        before = np.ascontiguousarray(x_in[:, lead:]).ravel()
        kv, own = np.take(kv_of, x_in, axis=0), np.take(own_of, before, axis=0)
        k, v1, q = kv[:, :, :DIM], kv[:, :, DIM:], own[:, :DIM].reshape(b, SCORED, DIM)
        a = q @ k.transpose(0, 2, 1)
        a += p["B"] + self.later
        np.exp(np.minimum(a, 80, out=a) if a.max(initial=0) > 80 else a, out=a)
        c = (a @ v1).reshape(n, DIM + 1)
        share = 1 / (c[:, DIM:] + np.float32(1e-6))
        context = c[:, :DIM] * share
        h = context @ p["W1"][DIM:]
        h += own[:, DIM:]
        h += p["b1"]
        np.maximum(h, 0, out=h)
        # places in order of their groups, so that a group is one product
        kl = self.klass[t]
        g_of = kl // GROUP
        by = np.argsort(g_of.astype(np.uint8 if self.n_groups < 256 else np.int32), kind="stable")
        cuts = np.searchsorted(g_of[by], np.arange(self.n_groups + 1)).tolist()
        groups = [(j, slice(lo, hi)) for j, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo]
        hs, g_of, c_of, before_by = np.take(h, by, axis=0), g_of[by], kl[by] % GROUP, before[by]
        live = (t[by] >= 0).astype(h.dtype)
        live /= max(1.0, float(live.sum()))
        dg = hs @ p["Wg"]
        dg += np.take(self.log_group, before_by, axis=0)
        dc = np.empty((n, GROUP), h.dtype)
        for j, s in groups:
            np.matmul(hs[s], p["Wc"][j], out=dc[s])
        dc += np.take(self.log_class.reshape(-1, GROUP), before_by * self.n_groups + g_of, axis=0)
        loss = -float(_softmax_step(dg, g_of, live) + _softmax_step(dc, c_of, live))
        # backward
        g = {"Wg": hs.T @ dg, "Wc": np.zeros_like(p["Wc"])}
        dhs = dg @ p["Wg"].T
        more = np.empty_like(hs)
        for j, s in groups:
            np.matmul(hs[s].T, dc[s], out=g["Wc"][j])
            np.matmul(dc[s], p["Wc"][j].T, out=more[s])
        dhs += more
        dhs *= hs > 0
        d_own = np.empty((n, DIM + HIDDEN), h.dtype)
        d_own[by, DIM:] = dhs
        dh = d_own[:, DIM:]
        g["b1"] = dhs.sum(0)
        dc = dh @ p["W1"][DIM:].T
        dc *= share
        d_sums = np.empty((n, DIM + 1), h.dtype)  # of the weighted values and of the weights
        d_sums[:, :DIM] = dc
        np.negative(np.einsum("ij,ij->i", dc, context), out=d_sums[:, DIM])
        d_sums = d_sums.reshape(b, SCORED, DIM + 1)
        d_kv = np.empty((b, WINDOW, 2 * DIM), h.dtype)
        d_kv[:, :, DIM:] = a.transpose(0, 2, 1) @ d_sums[:, :, :DIM]
        a *= d_sums @ v1.transpose(0, 2, 1)
        g["B"] = a.sum(0)
        d_own[:, :DIM] = (a @ k).reshape(n, DIM)
        d_kv[:, :, :DIM] = a.transpose(0, 2, 1) @ q
        d_kv[x_in == self.pad, DIM:] = 0
        d_kv = d_kv.reshape(-1, 2 * DIM)
        wk_v, wq_1 = np.take(e, x_in.ravel(), axis=0).T @ d_kv, np.take(e, before, axis=0).T @ d_own
        g["Wk"], g["Wv"], g["Wq"], g["W1"] = wk_v[:, :DIM], wk_v[:, DIM:], wq_1[:, :DIM] * scale, np.concatenate([wq_1[:, DIM:], context.T @ dh])
        dx = (d_kv @ by_kv.T).reshape(b, WINDOW, DIM)
        dx[:, lead:] += (d_own @ by_own.T).reshape(b, SCORED, DIM)
        g["E"] = _by_input(x_in.ravel(), dx.reshape(-1, DIM), len(e))
        return loss, g


class Adam:
    """Adam over named arrays, which it changes in place."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.n = p, 0
        self.m1, self.m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        for name, grad in g.items():
            m1, m2 = self.m1[name], self.m2[name]
            m1 *= 0.9
            m1 += 0.1 * grad
            m2 *= 0.99
            m2 += 0.01 * (grad * grad)
            root = m2 / (1 - 0.99**self.n)
            np.sqrt(root, out=root)
            root += 1e-8
            np.divide(m1, root, out=root)
            root *= rate / (1 - 0.9**self.n)
            self.p[name] -= root


def _by_input(of: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by input, of n inputs."""
    by = np.argsort(of.astype(np.uint16) if n <= 1 << 16 else of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[by], prepend=-1))
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[of[by[cuts]]] = np.add.reduceat(np.take(rows, by, axis=0), cuts)
    return out


def _softmax_step(logits: np.ndarray, at: np.ndarray, weight: np.ndarray) -> float:
    """The weighted sum of the log softmax at one place of each row; logits become the gradients of minus that sum."""
    if logits.max(initial=0) > 60:
        logits -= logits.max(axis=1, keepdims=True)
    place = np.arange(len(at)) * logits.shape[1] + at
    own = np.take(logits, place)
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    logits *= (weight / total)[:, None]
    logits.ravel()[place] -= weight
    return float(weight @ (own - np.log(total)))


_ONES = np.ones(GROUP, np.float32)


def _picked(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log softmax of each row at one place; changes logits."""
    if logits.max(initial=0) > 60:
        logits -= logits.max(axis=1, keepdims=True)
    own = np.take(logits, np.arange(len(at)) * logits.shape[1] + at)
    np.exp(logits, out=logits)
    return own - np.log(logits @ _ONES[: logits.shape[1]] if logits.shape[1] <= GROUP else logits.sum(axis=1))


def _stream(sub: Subwords, some, word, which, first) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of a block's documents, each with its end, and where documents begin."""
    n_docs = len(first) - 1
    if not len(some):
        return np.full(n_docs, sub.end, np.int64), np.arange(n_docs + 1)
    off, length, ids = sub.learn(some, *word)
    lens = length[which]
    run = np.concatenate([[0], np.cumsum(lens)])
    begin = run[first] + np.arange(n_docs + 1)
    out = np.full(begin[-1], sub.end, np.int64)
    flat = np.repeat(off[which] - run[:-1], lens) + np.arange(run[-1])
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    out[np.arange(run[-1]) + np.repeat(doc, lens)] = ids[flat]
    return out, begin


def _scoring(subwords, attention, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, model, (keys, logs) = subwords.value, attention.value, hot.value
        for b in batches:
            for i, n, some, word, which, first in _words(b.column("text")):
                ids, begin = _stream(sub, some, word, which, first)
                score = model.log10(ids, begin)
                doc = np.repeat(np.arange(n), np.diff(first))
                at = np.minimum(np.searchsorted(keys, some), max(0, len(keys) - 1))
                is_hot = (keys[at] == some) if len(keys) else np.zeros(len(some), bool)
                value = np.where(is_hot, logs[at], 0) if len(keys) else np.zeros(len(some))
                base = np.bincount(doc, weights=value[which], minlength=n).astype(float)  # without words it gives integers
                known = np.bincount(doc, weights=is_hot[which], minlength=n).astype(np.int64)
                cold = ~is_hot[which]
                pair, count = np.unique(doc[cold] * max(1, len(some)) + which[cold], return_counts=True)
                d, w = pair // max(1, len(some)), pair % max(1, len(some))
                cut = pa.array(np.searchsorted(d, np.arange(n + 1)).astype(np.int32))
                yield pa.record_batch(
                    [
                        b.column("rid").slice(i, n), b.column("doc_id").slice(i, n), pa.array(np.diff(first).astype(np.int64) + 1), pa.array(known), pa.array(base), pa.array(score),
                        pa.ListArray.from_arrays(cut, pa.array(some[w].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(count.astype(np.int32))),
                    ],
                    names=["rid", "doc_id", "n_tokens", "known", "base", "score", "words", "counts"],
                )

    return run


def sample(learned: DataFrame, n_docs: int) -> DataFrame:
    """text and ``ends`` of a bounded sample by hash; a text over SAMPLE_BYTES gives a passage of whole words, which ends where the text does or not."""
    share = min(1.0, 1.5 * SAMPLE_DOCS / max(1, n_docs))
    some = learned.where(F.pmod(F.xxhash64(F.lit("lm"), "doc_id", "text"), F.lit(1_000_000)) < F.lit(round(share * 1_000_000)))
    some = some.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chars, size = F.char_length("text").cast("long"), F.octet_length("text").cast("long")
    length = F.floor(chars * F.lit(SAMPLE_BYTES) / F.greatest(F.lit(1), size)).cast("int")
    at = F.pmod(F.xxhash64(F.lit("place"), "doc_id", "text"), F.greatest(F.lit(1), chars - length + 1).cast("long")).cast("int")
    some = some.withColumns({"_long": size > SAMPLE_BYTES, "_at": at, "_length": length, "ends": (size <= SAMPLE_BYTES) | (at + length == chars)})
    passage = F.substring("text", F.col("_at") + 1, F.col("_length"))
    passage = F.when(F.col("_at") > 0, F.regexp_replace(passage, r"^\S+\s", "")).otherwise(passage)
    passage = F.when(F.col("ends"), passage).otherwise(F.regexp_replace(passage, r"\s\S+$", ""))
    # the least by hash, however the rows are dealt
    some = some.select(F.xxhash64(F.lit("order"), "doc_id", "text").alias("h"), F.when(F.col("_long"), passage).otherwise(F.col("text")).alias("text"), "ends")
    return some.orderBy("h", "text").limit(SAMPLE_DOCS).select("text", "ends")


def _without_ends(ids: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stream without the end ids of passages that stop inside their document."""
    cut = ~ends & (np.diff(begin) > 1)
    keep = np.ones(len(ids), bool)
    keep[begin[1:][cut] - 1] = False
    return ids[keep], begin - np.concatenate([[0], np.cumsum(cut)])


def _refining(subwords, attention, rate: float):
    """Task: one pass of Adam over every window of its rows, from the given weights; (place, weight x targets in units of UNIT), and (-1, targets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, model = subwords.value, copy(attention.value)
        model.p = {k: v.copy() for k, v in model.p.items()}  # a worker's next task starts from the broadcast again
        adam, r, n = Adam(model.p), np.random.default_rng(5), 0
        left: list[tuple[np.ndarray, np.ndarray]] = []

        def steps(last: bool) -> None:
            x, t = (np.concatenate(c) for c in zip(*left))
            left.clear()
            by = r.permutation(len(x))
            full = len(x) if last else len(x) // BATCH * BATCH
            for i in range(0, full, BATCH):
                some = by[i : min(i + BATCH, full)]
                # a last, smaller batch counts as its share
                adam.step(model._gradients(x[some], t[some].ravel())[1], rate * min(1.0, (adam.n + 1) / 20) * len(some) / BATCH)
            if full < len(x):
                left.append((x[by[full:]], t[by[full:]]))

        for b in batches:
            for _, _n, some, word, which, first in _words(b.column("text")):
                left.append(model.windows(*_stream(sub, some, word, which, first)))
                n += int((left[-1][1] >= 0).sum())
                if sum(len(x) for x, _ in left) >= BATCH:
                    steps(False)
        if left:
            steps(True)
        if n:
            flat = np.concatenate([model.p[k].ravel() for k in sorted(model.p)]).astype(float)
            v = np.append(np.round(flat * UNIT).astype(np.int64) * n, n)
            yield pa.record_batch([pa.array(np.append(np.arange(len(flat)), -1).astype(np.int32)), pa.array(v)], names=["place", "v"])

    return run


def refine(learned: DataFrame, sub, model: Attention) -> int:
    """Train the model further on all windows of all texts of ``learned``, each once; gives the number of ids learned from.

    In each of PASSES rounds the tasks train on their rows of that round, from the same weights,
    and the mean of their weights, by the ids they saw, goes on; no row goes elsewhere, and the driver gets one model a round.
    """
    sc, seen = learned.sparkSession.sparkContext, 0
    part = F.pmod(F.xxhash64(F.lit("round"), "doc_id", "text"), F.lit(PASSES))
    for k in range(PASSES):
        attention = sc.broadcast(model)
        rows = learned.where(part == k).select(F.coalesce("text", F.lit("")).alias("text"))
        made = rows.mapInArrow(_refining(sub, attention, RATE * (1 - k / PASSES)), "place int, v long").groupBy("place").agg(F.sum("v").alias("v")).toArrow()
        attention.destroy()
        if not made.num_rows:
            continue
        by = np.argsort(made.column("place").to_numpy())
        n, *flat = made.column("v").to_numpy()[by]
        flat, at = np.array(flat, float) / (UNIT * float(n)), 0
        for name in sorted(model.p):
            size = model.p[name].size
            model.p[name] = flat[at : at + size].reshape(model.p[name].shape).astype(np.float32)
            at += size
        seen += int(n)
    model.close()
    return seen


def score(docs: DataFrame, scratch: Scratch, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learned = rows.where(~held_out(F.col("doc_id")))
    sub = sc.broadcast(Subwords(load_ranks(tokenizer)))
    end = sub.value.end
    counted = learned.select("text").mapInArrow(_counting(sub), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counted = scratch.write(counted, "counts")
    words = counted.where("kind = 0").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    id_counts = np.zeros(end + 1, np.int64)
    n_docs = 0
    for r in counted.where("kind in (1, 2)").collect():  # a row for each subword id
        if r["kind"] == 1:
            id_counts[r["key"]] = r["n"]
        else:
            n_docs = r["n"]
    n_all, n_distinct = total + n_docs, distinct + (n_docs > 0)
    below = n_all + 0.1 * (n_distinct + 1)
    top = words.orderBy(F.desc("n"), "key").limit(HOT).toArrow()
    keys = top.column("key").to_numpy().astype(np.int64).view(np.uint64)
    logs = np.log10((top.column("n").to_numpy().astype(float) + 0.1) / below)
    by = np.argsort(keys)
    hot = sc.broadcast((keys[by], logs[by]))

    # the attention weights: they start from a bounded sample and learn from all training documents
    fit = sample(learned, n_docs).toArrow()
    texts, ends = fit.column("text").combine_chunks(), fit.column("ends").to_numpy()
    model = Attention(id_counts)
    kinds = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(model.input, model.klass))] + [(end + 1, model.start, 0)], "id long, input int, class int")
    before, then = F.broadcast(kinds.select(F.col("id").alias("b"), "input")), F.broadcast(kinds.select(F.col("id").alias("t"), "class"))
    follow = counted.where("kind = 3").join(before, F.expr(f"key div {PAIR}") == F.col("b")).join(then, F.col("key") % PAIR == F.col("t"))
    follow = follow.groupBy("input", "class").agg(F.sum("n").alias("n")).toArrow()  # at most inputs times classes
    model.follow(*(follow.column(c).to_numpy() for c in ("input", "class", "n")))
    parts, begins = [], []
    for i, n, some, word, which, first in _words(texts):
        ids, begin = _without_ends(*_stream(sub.value, some, word, which, first), ends[i : i + n])
        begins.append(begin[:-1] + sum(map(len, parts)))
        parts.append(ids)
    if parts:
        ids = np.concatenate(parts)
        model.train(ids, np.concatenate([*begins, [len(ids)]]))
    refine(learned, sub, model)
    attention = sc.broadcast(model)

    fields = "rid long, doc_id long, n_tokens long, known long, base double, score double, words array<long>, counts array<int>"
    made = scratch.write(rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "text").mapInArrow(_scoring(sub, attention, hot), fields), "scored")
    cold = made.select("rid", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("rid", F.col("w.words").alias("key"), F.col("w.counts").alias("m"))
    c = F.coalesce("n", F.lit(0))
    summed = (
        cold.join(words, "key", "left")
        .groupBy("rid")
        .agg(F.sum(F.col("m") * F.log10((c + 0.1) / F.lit(below))).alias("more"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("more_known"))
        .withColumnRenamed("rid", "_rid")
    )
    end_log = float(np.log10((n_docs + 0.1) / below)) if below else 0.0
    return made.join(summed, F.col("rid") == F.col("_rid"), "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(n_docs > 0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(end_log)).alias("base_score"),
        "score",
    )
