"""The registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, dialogue, html_pages, html_tree, ivfpq, langmodel, minhash, mixing, packing, pii, suffix_dedup, toxicity, url_filter
from .chunks import FOLDER
from .common import Scratch, table

#: The contract's rules; they outrank the method's own.
URL_RULES = (
    url_filter.host_rule("block", "com", "/en/"),
    url_filter.host_rule("allow", "example.com", "/en/7"),
    url_filter.host_rule("allow", "net", "/de/"),
    url_filter.host_rule("block", "example.net", "/de/8"),
    url_filter.host_rule("block", "org", "/es/"),
)


def tokenizers(spark: SparkSession) -> str:
    """The folder of the public tokenizers' files."""
    return spark.conf.get("spark.tokenlake.tokenizers", FOLDER)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = html_tree.train(html_pages.labelled_pages(), bare=html_pages.labelled_pages(200, seed=2, bare=True))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.select("page_id", "url", html_tree.extract(F.col("html"), model).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.filter_urls(pages, "url", URL_RULES + url_filter.DEFAULT_RULES)
    contract = [r.name for r in URL_RULES]
    return judged.select("row.page_id", "host", "path", F.when(F.col("rule").isin(contract), F.col("rule")).alias("rule"), F.col("action").alias("verdict"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, Scratch(spark, "op3"), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, Scratch(spark, "op4")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), ["doc_id"])
    out = F.col("out")
    return judged.select("row.doc_id", *[out[c].alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256")], decontaminate.contaminated(out).alias("contaminated"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("row.doc_id", "out.score").select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.repeated_spans(docs, Scratch(spark, "op7"), ["doc_id"]).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.score(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op8"), spark.conf.get("spark.tokenlake.tokenizer", langmodel.TOKENIZER))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, Scratch(spark, "op9"), pii.key_of(spark)).select("row.doc_id", "text", "n_entities")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.search(table(spark, sf_dir, "embeddings"), Scratch(spark, "op10"), is_query=lambda i: i % 100 == 0)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, ["doc_id"], tokenizers(spark)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed = packing.pack(cut, Scratch(spark, "op11"))
    return packed.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = dialogue.damaged(table(spark, sf_dir, "conversations"))
    return dialogue.repair(rows, Scratch(spark, "op12"), n, digest=True).withColumnRenamed("repaired", "repaired_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = alignment.align(docs, Scratch(spark, "op13"), ["doc_id"], digest=True, folder=tokenizers(spark))
    return got.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_url_filters": op2_url_filters,
    "op3_mixing": op3_mixing,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_pii": op9_pii,
    "op10_ann": op10_ann,
    "op11_packing": op11_packing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_alignment": op13_alignment,
}

_WORDS = ", ".join(f"'{r.name}'" for r in url_filter.DEFAULT_RULES)

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": rf"""
        WITH p AS (
          SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
          FROM pages),
        r(h, p, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                                   ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        best AS (
          SELECT p.host, p.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.action, length(r.h || r.p)) AS action
          FROM (SELECT DISTINCT host, path FROM p) p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
          GROUP BY p.host, p.path)
        SELECT p.page_id, p.host, p.path, best.rule,
               coalesce(best.action, CASE WHEN list_has_any(string_split_regex(p.host, '[^a-z0-9]+'), [{_WORDS}]) THEN 'block' ELSE 'allow' END) AS verdict
        FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path
    """,
    "op3_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                 CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
          FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
        w AS (SELECT source, source_size, CAST((rk - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap,
                     row_number() OVER (ORDER BY 3.0 * source_size / ((rk - 1) % 3 + 1), rk) AS k FROM s),
        l AS (SELECT k, weight, cap,
                     ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY k DESC) AS level FROM w),
        t AS (SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, k) FROM l WHERE level * weight <= cap)) AS target FROM w),
        g AS (SELECT source, h, sum(size) AS words FROM d WHERE size > 0 GROUP BY source, h),
        c AS (SELECT g.source, g.h, g.words, floor(t.target / t.source_size) AS whole, t.target - floor(t.target / t.source_size) * t.source_size AS goal,
                     sum(g.words) OVER (PARTITION BY g.source ORDER BY g.h) AS run
              FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source)
        SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, t.source_size, t.target,
               CAST(CASE WHEN d.size = 0 THEN 0 ELSE c.whole * d.size + CASE WHEN c.run <= c.goal THEN d.size WHEN c.run - c.words < c.goal
                    THEN floor(d.size * ((c.goal - (c.run - c.words)) / c.words)) ELSE 0 END END AS BIGINT) AS taken
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
    """,
    "op4_minhash_dedup": r"""
        WITH RECURSIVE d AS (
          SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        l AS (SELECT a.r AS u, b.r AS v FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r
              HAVING 100 * count(*) >= 75 * ((SELECT n FROM n WHERE r = a.r) + (SELECT n FROM n WHERE r = b.r) - count(*))),
        reach AS (SELECT r AS u, r AS v FROM d UNION SELECT reach.u, l.v FROM reach JOIN l ON reach.v = l.u),
        c AS (SELECT reach.u, min(d.doc_id) AS component_id FROM reach JOIN d ON reach.v = d.r GROUP BY reach.u)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM d JOIN c ON d.r = c.u LEFT JOIN n ON n.r = d.r
    """,
    "op5_decontamination": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id,
                 coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
               FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
        dw AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
               FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
        m AS (SELECT dw.r, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
        h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
        t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
               coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN t ON d.r = t.r
    """,
    "op12_conversation_repair": r"""
        WITH RECURSIVE crc AS (
          SELECT list(v ORDER BY b) AS t FROM (
            SELECT b, list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b) AS v FROM range(256) x(b))),
        k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        c AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % 20 AS f
          FROM k, crc),
        d AS (
          SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
                 CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
          FROM c WHERE f <> 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM p),
        r AS (
          SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev,
                 CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
        stats AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                 count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY conv_id),
        ins(q, k, q2) AS (VALUES ('0', 0, '0'), ('0', 1, 'u'), ('0', 2, 'a'), ('s', 0, 's'), ('s', 1, 'u'), ('s', 2, 'a'), ('u', 0, 'u'), ('u', 1, 'a'), ('a', 0, 'a'), ('a', 1, 'u')),
        does(q, edit, ini, q2) AS (
          VALUES ('0', 'K', 's', 's'), ('0', 'K', 'u', 'u'), ('s', 'K', 'u', 'u'), ('a', 'K', 'u', 'u'), ('u', 'K', 'a', 'a'),
                 ('0', 'R', '', 'u'), ('s', 'R', '', 'u'), ('a', 'R', '', 'u'), ('u', 'R', '', 'a'), ('0', 'D', '', '0'), ('s', 'D', '', 's'), ('u', 'D', '', 'u'), ('a', 'D', '', 'a')),
        walk AS (
          SELECT conv_id, CAST(0 AS BIGINT) AS i, '0' AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS lines FROM stats
          UNION ALL
          SELECT conv_id, i, q, b.cost, b.audit, b.lines FROM (
            SELECT r.conv_id, r.i, does.q2 AS q,
                   arg_min({'cost': CAST(w.cost + 2 * ins.k + CASE does.edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN does.edit <> 'D' AND r.fault = 'truncated' THEN 1 ELSE 0 END AS BIGINT),
                            'audit': w.audit || repeat('I', ins.k) || does.edit,
                            'lines': w.lines || CASE WHEN ins.k = 0 THEN '' WHEN ins.k = 2 OR ins.q2 = 'u' THEN E'user:
' ELSE '' END || CASE WHEN ins.k > 0 AND ins.q2 = 'a' THEN E'assistant:
' ELSE '' END
                              || CASE does.edit WHEN 'D' THEN '' WHEN 'K' THEN r.role || ':' || r.text || E'
' ELSE CASE does.q2 WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || r.text || E'
' END},
                           {'c': w.cost + 2 * ins.k + CASE does.edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN does.edit <> 'D' AND r.fault = 'truncated' THEN 1 ELSE 0 END,
                            'a': w.audit || repeat('I', ins.k) || does.edit}) AS b
            FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN ins ON ins.q = w.q
                 JOIN does ON does.q = ins.q2 AND (does.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate')) AND (does.edit <> 'K' OR does.ini = r.ini)
            GROUP BY r.conv_id, r.i, does.q2)),
        ended AS (
          SELECT w.conv_id, w.cost + CASE w.q WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END AS cost, w.audit || CASE w.q WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit,
                 w.lines || CASE w.q WHEN 's' THEN E'user:
assistant:
' WHEN 'u' THEN E'assistant:
' ELSE '' END AS lines
          FROM walk w JOIN stats s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i),
        best AS (SELECT conv_id, arg_min({'cost': cost, 'audit': audit, 'lines': lines}, {'c': cost, 'a': audit}) AS b FROM ended GROUP BY conv_id)
        SELECT a.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated,
               coalesce(s.illegal, 0) AS illegal, coalesce(b.b.cost, 0) AS cost, coalesce(b.b.audit, '') AS audit, sha256(coalesce(regexp_replace(b.b.lines, '
$', ''), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM c) a LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
    """,
}
