"""Registered queries of the pipeline's operators, over their whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factgraph.llm import (alignment, best_positions, debruijn, html_blocks, kmeans_tree, mixing, ngram_join, ordinal, packing,
                           quality_rules, sharding, suffix_dedup, warc)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(_table(spark, sf_dir, "documents"))


def _pages(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": _documents(mixing.positions),
    "op2_quality_rules": _documents(quality_rules.judge),
    "op3_warc_records": _pages(warc.round_trip),
    "op4_html_text": _pages(html_blocks.extract),
    "op5_repeated_strings": _documents(suffix_dedup.removals),
    "op6_shard_rows": _documents(sharding.shard),
    "op7_pack_tokens": _documents(packing.pack),
    "op8_ngram_links": _documents(ngram_join.links),
    "op9_near_vectors": lambda spark, sf_dir: kmeans_tree.neighbours(_table(spark, sf_dir, "embeddings")),
    "op10_ordinal_grades": lambda spark, sf_dir: ordinal.grade(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")),
    "op11_best_positions": lambda spark, sf_dir: best_positions.search(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")),
    "op12_repeated_words": _documents(debruijn.removals),
    "op13_align_tokens": _documents(alignment.alignment),
}

SQL: dict[str, str] = {
    "op3_warc_records": """
        WITH p AS (
            SELECT page_id, coalesce(url, '') AS url, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                   sha1(coalesce(html, '')) AS payload_digest
            FROM pages),
        w AS (SELECT payload_digest, max(page_id) AS first_id, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, url, payload_bytes, payload_digest,
               CASE WHEN n > 1 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit'
                    ELSE 'response' END AS record_type,
               CASE WHEN n > 1 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM p LEFT JOIN w USING (payload_digest)""",
    "op5_repeated_strings": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h,
                   octet_length(encode(coalesce(text, ''))) AS n
            FROM documents),
        w AS (SELECT r, p, md5_number(substr(h, 2 * p + 1, 400)) AS m
              FROM (SELECT r, h, unnest(range(0, n - 199)) AS p FROM d WHERE n >= 200)),
        twice AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
        hit AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS step FROM w SEMI JOIN twice USING (m)),
        run AS (SELECT r, p, sum(CASE WHEN step <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS k FROM hit),
        span AS (SELECT r, k, min(p) AS a, max(p) + 200 AS b FROM run GROUP BY r, k),
        gap AS (SELECT r, k, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY k), 0) AS c FROM span),
        cut AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans,
                       string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY k) || substr(any_value(h), 2 * max(b) + 1) AS left_hex
                FROM gap JOIN d USING (r) GROUP BY r)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(left_hex, h))) AS kept_sha256
        FROM d LEFT JOIN cut USING (r)""",
    "op8_ngram_links": """
        WITH RECURSIVE d AS (
            SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT r, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
            FROM d WHERE len(w) > 0),
        n AS (SELECT r, count(*) AS size FROM s GROUP BY r),
        p AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY x.r, y.r),
        copy AS (SELECT x.r AS a, y.r AS b FROM d x JOIN d y ON coalesce(x.text, '') = coalesce(y.text, '') AND x.r <> y.r),
        e AS (
            SELECT p.a, p.b FROM p JOIN n na ON na.r = p.a JOIN n nb ON nb.r = p.b
            WHERE 10 * p.k >= 8 * (na.size + nb.size - p.k)
            UNION SELECT a, b FROM copy),
        reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
        class AS (SELECT a, min(doc_id) AS class_id FROM reach JOIN d ON d.r = reach.b GROUP BY a)
        SELECT doc_id, class_id, (SELECT count(*) FROM e WHERE e.a = d.r) AS n_links,
               (SELECT count(DISTINCT o.text) FROM e JOIN d o ON o.r = e.b WHERE e.a = d.r AND o.text <> d.text) AS n_text_links
        FROM d JOIN class ON class.a = d.r""",
    "op11_best_positions": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents),
        i AS (
            SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
            FROM benchmark),
        q AS (SELECT item, item_id, t, count(*) AS times FROM i GROUP BY ALL),
        c AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
        tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) SEMI JOIN q USING (t) GROUP BY ALL),
        w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, c GROUP BY t, n_docs),
        s AS (
            SELECT item, item_id, doc_id, r, sum(times * weight * ((1000000000 * tf) // (
                       1000 * tf + 8 * (25 + (75 * len(d.w) * n_docs) // n_terms))))::BIGINT AS score
            FROM tf JOIN q USING (t) JOIN w USING (t) JOIN d USING (r), c GROUP BY ALL)
        SELECT item_id, row_number() OVER best AS rank, doc_id, score FROM s WHERE score > 0
        WINDOW best AS (PARTITION BY item ORDER BY score DESC, doc_id) QUALIFY rank <= 10""",
    "op12_repeated_words": """
        WITH d AS (
            SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        g AS (SELECT r, p, md5_number(array_to_string(w[p:p + 19], ' ')) AS m
              FROM (SELECT r, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
        hit AS (SELECT r, p FROM g QUALIFY row_number() OVER (PARTITION BY m ORDER BY r, p) > 1),
        gone AS (SELECT DISTINCT r, unnest(range(p, p + 20)) AS i FROM hit),
        word AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t FROM d WHERE r IN (SELECT r FROM hit)),
        cut AS (SELECT r, string_agg(t, ' ' ORDER BY i) FILTER (WHERE gone.i IS NULL) AS kept, count(gone.i) AS n
                FROM word LEFT JOIN gone USING (r, i) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
               sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
        FROM d LEFT JOIN cut USING (r)""",
}
