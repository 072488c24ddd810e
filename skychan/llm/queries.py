"""The queries of this package and, where SQL can express them, their DuckDB equivalents."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skychan.llm.common import table
from skychan.llm.crf_secrets import secrets
from skychan.llm.curriculum import taken
from skychan.llm.drr_pack import packed
from skychan.llm.exact_dedup import exact_groups
from skychan.llm.gru_lm import scored
from skychan.llm.html_extract import main_text
from skychan.llm.mph_index import indexed_ids
from skychan.llm.ri_classifier import quality
from skychan.llm.segment_topk import top_k
from skychan.llm.spelling import variants
from skychan.llm.url_cascade import judged
from skychan.llm.voronoi_join import linked
from skychan.llm.whitening import whitened

#: Rules of op13: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents")).drop("_digest", "_component")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("_digest")


def op10_id_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed_ids(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html, op2_jaccard, op3_packing, op4_topk, op5_lm, op6_quality, op7_secrets, op8_mixing, op9_exact_dedup, op10_id_index,
                               op11_spelling, op12_whitening, op13_urls)}

SQL: dict[str, str] = {
    "op2_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        p AS (
            SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g
            FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM p a JOIN p b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
        r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.y) AS component_id
        FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.x = w.doc_id GROUP BY ALL""",
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op8_mixing": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o, md5(text) AS g,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3]::DOUBLE AS w
            FROM d GROUP BY source),
        l AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
            FROM s WINDOW f AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size, w, least(3.0 * source_size, max(level) OVER () * w) AS target FROM l),
        q AS (
            SELECT d.*, t.source_size, t.target, t.w,
                   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        h AS (  -- share of the source's whole demand at the middle word of each copy
            SELECT *, [CASE WHEN target > 0 THEN (pos + size / 2::DOUBLE + j * source_size) / target ELSE 1.0 END::DOUBLE FOR j IN [0, 1, 2]] AS shares FROM q),
        c AS (  -- when the integral of the schedule, lines from a0 over 1 to a2, reaches it
            SELECT *, list_transform(list_filter(shares, lambda s: s < 1), lambda s: CASE
                WHEN s * 1.0 <= (a0 + 1) / 4 THEN 2 * s / (a0 + sqrt(greatest(0, a0 * a0 + 4 * (1 - a0) * s)))
                ELSE 0.5 + 2 * (s - (a0 + 1) / 4) / (1 + sqrt(greatest(0, 1 + 4 * (a2 - 1) * (s - (a0 + 1) / 4)))) END) AS times
            FROM (SELECT *, CASE w WHEN 5 THEN 0.8 WHEN 2 THEN 1.0 ELSE 1.2 END::DOUBLE AS a0, CASE w WHEN 5 THEN 1.2 WHEN 2 THEN 1.0 ELSE 0.8 END::DOUBLE AS a2 FROM h)),
        k AS (SELECT *, len(times) AS whole FROM c),
        e AS (SELECT *, target - sum(size * whole) OVER (PARTITION BY source) AS rest FROM k),
        b AS (
            SELECT source, min({'off': abs(size - abs(rest)), 'pos': pos}) AS b FROM e
            WHERE size > 0 AND size < 2 * abs(rest) AND CASE WHEN rest > 0 THEN whole < 3 ELSE whole > 0 END GROUP BY source),
        f AS (SELECT e.*, CASE WHEN b.b.pos = pos AND size > 0 THEN CAST(sign(rest) AS INT) ELSE 0 END AS turn FROM e LEFT JOIN b ON e.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(size * (whole + turn) AS BIGINT) AS taken,
               round(CASE WHEN whole + turn = 0 THEN NULL WHEN whole = 0 THEN 1.0 ELSE times[1] END, 6)::DOUBLE AS position
        FROM f""",
    "op13_urls": r"""
        WITH p AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(h, s, v))
        SELECT page_id, host, path, (SELECT max_by(h || s, length(h || s)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)) AS rule,
               coalesce((SELECT max_by(v, length(h || s)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)), 'allow') AS verdict
        FROM p""",
}
