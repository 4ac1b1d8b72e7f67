"""Edge cases of the training-data operators: odd markup, clashing names, long values, empty partitions."""

import numpy as np
from pyspark.sql import functions as F

from tokenlake.llm import html_pages, html_tree, langmodel, mixing, pii, queries, suffix_dedup, toxicity, url_filter
from tokenlake.llm.common import Scratch

from . import brute

PARAGRAPHS = ["The first paragraph tells of the harbour, its boats and the people who mend them.", "A second one follows, with what the council said about it last year.", "The third ends the story, and names nobody at all, to be sure."]


def _page(*inner):
    return "<html><body><nav><a href=/a>Home</a> <a href=/b>News</a></nav><article>" + "".join(inner) + "</article><footer>© 2024 All rights reserved</footer></body></html>"


def test_html_odd_markup(spark):
    p = PARAGRAPHS
    pages = {
        1: _page(f"<p title=it's>{p[0]}</p><img alt=it's>", f"<p data-x=a\"b>{p[1]}</p>", f"<p>{p[2]}</p>"),
        2: _page(f"<p title='a > b'>{p[0]}</p>", f'<p title="c > d">{p[1]}</p>', f"<p>{p[2]}</p>"),
        3: _page(f"<p>{p[0]}</p><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, as the harbour master has shown before.</p>", f"<p>{p[2]}</p>"),
    }
    model = html_tree.train(html_pages.labelled_pages())
    df = spark.createDataFrame([*pages.items(), (4, None), (5, ""), (1, pages[1]), (6, _page(*(f"<p>{x}</p>" for x in p * 2000)))], "page_id long, html string").withColumn("text", F.lit("own"))
    out = [(r["page_id"], r["made"]) for r in df.select("page_id", html_tree.extract(F.col("html"), model).alias("made")).collect()]
    got = dict(out)
    assert got[1] == got[2] == "\n".join(p) and [t for i, t in out if i == 1] == [got[1]] * 2
    assert got[3].split("\n")[1].startswith("So x=2 holds") and got[4] == got[5] == "" and got[6].count("\n") == 5999
    assert df.limit(0).select(html_tree.extract(F.col("html"), model)).count() == 0


def test_url_clashing_columns(spark):
    df = spark.createDataFrame([("http://a.com/en/1", "h", "p", "r", "a", 1), ("http://a.org/" + "x" * 100_000, None, None, None, None, 2)], "url string, host string, path string, rule string, action string, k int")
    out = url_filter.filter_urls(df, "url", queries.URL_RULES).orderBy("row.k").collect()
    assert [(r["row"]["host"], r["row"]["rule"], r["host"], r["rule"], r["action"]) for r in out] == [("h", "r", "a.com", "com/en/", "block"), (None, None, "a.org", None, "allow")]


def test_partial_repetition_keeps_lines(spark):
    df = spark.createDataFrame([(i, f" one\ntwo\t three\n\nfour {i}", s) for i, s in enumerate("aaaaaaab")], "doc_id long, text string, source string")
    mixed = mixing.mix(df, Scratch(spark, "t"), keep=["doc_id"], text=True)
    texts = {r["row"]["doc_id"]: r["text"] for r in mixed.collect()}
    for r in mixing.repetitions(mixed).collect():
        assert texts[r["row"]["doc_id"]].startswith(r["text"]) and len(r["text"].split()) == r["words"]


def test_pii_long_and_plain_numbers(spark):
    long = "ab" * 400
    values = [f"{long}@example.com", "2125550123", "12125550123"]
    df = spark.createDataFrame([(i, f"see {v} here") for i, v in enumerate(values)], "doc_id long, text string")
    out = {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii.replace(df, Scratch(spark, "t"), "k").select("row.doc_id", "text", "n_entities").collect()}
    assert all(n == 1 and values[i] not in t for i, (t, n) in out.items()) and long[:20] not in out[0][0]
    plain = ["order 12345678901", "v 1.2.3.4", "version 10.0.0.1", "v1.2.3.4", "ticket #2125550123", "99999999999"]
    df = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in pii.replace(df, Scratch(spark, "t"), "k").select("row.doc_id", "text").collect()} == dict(enumerate(plain))


def test_toxicity_long_runs():
    word = "x" * 1000 + "idiot" + "y" * 1000
    pieces = toxicity.tokens(word)
    assert all(len(p) <= toxicity.LONG for p in pieces) and any("idiot" in p for p in pieces)
    at, whole = 0, pieces[0]
    for p in pieces[1:]:
        at += toxicity.LONG - toxicity.OVERLAP
        whole = whole[:at] + p
    assert whole == word


def test_suffix_dedup_over_pieces(spark):
    r = np.random.default_rng(1)
    word = lambda n: "".join(chr(97 + x) for x in r.integers(0, 26, n))
    shared = word(900)
    piece = suffix_dedup.PIECE
    rows = [(1, word(piece - 300) + shared + word(piece)), (2, "q" + shared[100:800]), (3, word(500)), (4, "ab" * 300), (5, None)]
    out = {x["doc_id"]: x for x in suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), ["doc_id"]).select("row.doc_id", "n_removed", "n_spans").collect()}
    assert {k: (v["n_removed"], v["n_spans"]) for k, v in out.items()} == {1: (700, 1), 2: (700, 1), 3: (0, 0), 4: (600, 1), 5: (0, 0)}


# --- language model ---------------------------------------------------------


def _toy_model(n_ids: int = 80):
    r = np.random.default_rng(2)
    m = langmodel.Attention(r.integers(0, 50, n_ids))
    ids = r.integers(0, n_ids - 1, 700)
    ends = np.array([0, 1, 40, 300, 301, 700])
    ids[ends[1:] - 1] = n_ids - 1
    m.follow(m.input[ids[:-1]], m.klass[ids[1:]], np.ones(len(ids) - 1))
    m.train(ids, ends, steps=30)
    return m, ids, ends


def _plain_score(m, ids: np.ndarray) -> float:
    """One document's log10 probability by loops over its ids, from the trained weights."""
    p, total, lead = m.p, 0.0, langmodel.WINDOW - langmodel.SCORED
    inputs = [m.start, *m.input[ids[:-1]]]
    for i, target in enumerate(ids):
        first = max(0, i // langmodel.SCORED * langmodel.SCORED - lead)
        place = i % langmodel.SCORED
        x = p["E"][inputs[first : i + 1]].astype(float)
        q = x[-1] @ p["Wq"]
        at = [lead + j - i // langmodel.SCORED * langmodel.SCORED for j in range(first, i + 1)]
        a = np.exp((x @ p["Wk"]) @ q / np.sqrt(langmodel.DIM) + p["B"][place][at])
        z = np.concatenate([x[-1], (a / a.sum()) @ (x @ p["Wv"])])
        h = np.maximum(z @ p["W1"] + p["b1"], 0)
        g, c = divmod(int(m.klass[target]), langmodel.GROUP)
        lg = h @ p["Wg"] + m.log_group[inputs[i]]
        lc = h @ p["Wc"][g] + m.log_class[inputs[i], g]
        total += lg[g] - np.log(np.exp(lg).sum()) + lc[c] - np.log(np.exp(lc).sum()) + m.inside[target]
    return total / np.log(10)


def test_lm_against_plain_forward():
    m, ids, ends = _toy_model()
    want = [_plain_score(m, ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    assert np.allclose(m.log10(ids, ends), want, rtol=1e-4)
    # documents are scored apart, whatever stands beside them
    assert np.allclose(m.log10(ids[40:300], np.array([0, 260])), want[2], rtol=1e-4)


def test_lm_is_a_distribution():
    m, ids, _ = _toy_model()
    n = len(m.klass)
    every = np.concatenate([np.append(ids[1:20], t) for t in range(n)])
    logs = m.log10(every, np.arange(n + 1) * 20) - m.log10(ids[1:20], np.array([0, 19]))
    assert abs((10**logs).sum() - 1) < 1e-3


def test_lm_tables_without_words(spark):
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").repartition(4)
    out = langmodel.score(none, Scratch(spark, "t")).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out) == [(1, 1), (2, 1)] and all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in out)
    assert langmodel.score(none.limit(0), Scratch(spark, "t")).count() == 0
    rows = [(i, t) for i, t in enumerate(["one two two", None, "", "  ", "two three"] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(1), "rid": F.lit(2)}).repartition(15, "doc_id")
    got = {r["doc_id"]: (r["n_tokens"], round(r["base_score"], 6)) for r in langmodel.score(df, Scratch(spark, "t")).collect()}
    assert got == brute.lm_base(rows) and len(got) == 15 and got[0][0] == 4 and got[3][0] == 1


def test_lm_same_model_however_dealt(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a = {tuple(r) for r in langmodel.sample(df, 200).collect()}
    b = {tuple(r) for r in langmodel.sample(df.repartition(7), 200).collect()}
    assert a == b


# --- pipeline ---------------------------------------------------------------


def _odd_documents(spark):
    text = "a plain text of some words that nobody would drop for any reason at all"
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (None, None, None, None, None), (2, None, "en", "s", 0), (3, "", None, "s", 0), (4, "other words of Dr. Jones, who lives at jones@example.org, are here", "en", None, 5), (5, "w " * 30_000, "xx", "t", 60_000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").withColumns({c: F.lit(c) for c in ("new", "words", "repetition", "row", "out", "taken", "size")})


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        odd, empty = str(tmp_path / f"odd{k}"), str(tmp_path / f"empty{k}")
        _odd_documents(spark).write.parquet(odd)
        _odd_documents(spark).limit(0).write.parquet(empty)
        docs = spark.read.parquet(odd)
        out = stage(spark, docs, sf)
        rows = out.collect()
        ids = sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x))
        assert all(r["new"] == "new" and r["row"] == "row" and r["words"] == "words" for r in rows), name
        assert out.columns[: len(docs.columns)] == docs.columns, name
        if name == "near_duplicates":
            assert ids == [1, 2, 3, 4, 5, None]
        elif name == "mixing":
            assert set(ids) <= {1, 4, 5} and set(out.columns) - set(docs.columns) == {"mix_words", "mix_repetition"}
        else:
            assert ids == [1, 1, 2, 3, 4, 5, None], name
        if name == "pii":
            assert all("jones@example.org" not in (r["text"] or "") for r in rows)
        assert stage(spark, spark.read.parquet(empty), sf).count() == 0, name
