"""Faults of the training-data operators that a review found."""

import numpy as np

from tokenlake.llm import langmodel
from tokenlake.llm import textbytes as tb


def test_language_model_learns_from_every_document(spark):
    """all windows of all training documents train the weights, long ones and those outside the first fit too."""
    texts = ["the cat sat on the mat " * 40, "a b c", "", None, " ".join(f"w{i % 7} and" for i in range(4000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sub = spark.sparkContext.broadcast(langmodel.Subwords(langmodel.load_ranks()))
    made = list(langmodel._counting(sub)(iter(df.select("text").toArrow().to_batches())))
    counts = {b.column("kind")[0].as_py(): b for b in made}[1]
    ids = np.zeros(sub.value.end + 1, np.int64)
    ids[counts.column("key").to_numpy()] = counts.column("n").to_numpy()
    model = langmodel.Attention(ids)
    model.close()

    def scored() -> float:
        import pyarrow as pa

        done = langmodel._words(pa.array([t or "" for t in texts]))
        return sum(float(model.log10(*langmodel._stream(sub.value, some, word, which, first)).sum()) for _, _, some, word, which, first in done)

    before = scored()
    assert langmodel.refine(df, sub, model) == ids.sum()
    assert scored() > before


def test_language_model_gradients():
    r = np.random.default_rng(1)
    m = langmodel.Attention(r.integers(1, 50, 200))
    ids = np.append(r.integers(0, 199, 60), 199)
    x, t = m.windows(ids, np.array([0, len(ids)]))
    m.p, m.log_class, m.log_group = {k: v.astype(float) for k, v in m.p.items()}, m.log_class.astype(float), m.log_group.astype(float)
    _, g = m._gradients(x, t.ravel())
    for name in m.p:
        at = np.unravel_index(np.argmax(abs(g[name])), g[name].shape)
        kept, found = m.p[name][at], []
        for e in (1e-5, -1e-5):
            m.p[name][at] = kept + e
            found.append(m._gradients(x, t.ravel())[0])
        m.p[name][at] = kept
        assert abs((found[0] - found[1]) / 2e-5 - g[name][at]) < 1e-3 * abs(g[name][at]) + 1e-6


def test_word_hashes_by_running_sums(monkeypatch):
    """op8: a word's hash is the sum over its own bytes, in any stretch, whatever stands before it."""
    monkeypatch.setattr(tb, "STRETCH", 50)
    texts = [b"The cat", b"", b"sat" * 40, b" on\t", b"the " * 30, b"cat"]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    lo, hi = tb.spans(data, offs, tb.NOT_BLANK)
    found = [data[a:b].tobytes() for a, b in zip(lo, hi)]
    assert found == [w for t in texts for w in t.split()]
    plain = [sum(int(tb._BYTE[c]) * pow(int(tb._BASE), i, 2**64) for i, c in enumerate(w)) + len(w) for w in found]
    want = tb.mix(np.array([x % 2**64 for x in plain], np.uint64))
    got, first = tb.words(data, offs, tb.NOT_BLANK)
    assert (got == want).all() and (tb.hashes(data, lo, hi) == want).all()
    assert first.tolist() == np.cumsum([0, *(len(t.split()) for t in texts)]).tolist()
