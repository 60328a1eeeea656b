"""The registered queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import byte_bpe, centroids, content_sort, divergence, fingerprints, language_id, line_dedup, mixing, ngram_join, substring_dedup, token_counts, url_reputation, vector_links


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out():
    """Rows that no classifier may learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit_languages(docs, ~held_out())
    return language_id.identify_languages(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    return mixing.mix(mixing.written(docs, "mix-sizes")).drop("source")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.content_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")


def op5_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.vector_groups(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = url_reputation.article_outcomes(pages, _table(spark, sf_dir, "labels"))
    return url_reputation.judge_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.without_repeats(docs, keep_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.without_later_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_token_counts, op3_mix_sources, op4_exact_dedup, op5_vector_links, op6_url_filter, op7_substring_dedup, op8_ngram_join, op9_byte_bpe, op10_line_dedup, op11_centroid_clusters, op12_document_fingerprints, op13_source_divergence)}

def _concentration_sql(units: str) -> str:
    """Beta-binomial concentration of a level's units, by moments, from 2 to 200."""
    return f"""(SELECT CASE WHEN sum(n) IS NULL OR count(*) < 2 OR max(m) * (1 - max(m)) <= 0 THEN 20.0::DOUBLE ELSE 1 / least(greatest(
        greatest(sum(n * pow(good::DOUBLE / n - m, 2)) - (count(*) - 1) * max(m) * (1 - max(m)), 0) / greatest(sum(n) - sum(n * n)::DOUBLE / sum(n), 1e-9::DOUBLE) / (max(m) * (1 - max(m))), 1.0::DOUBLE / 201), 1.0::DOUBLE / 3) - 1 END
        FROM {units}, t WHERE n > 0)"""


_UPPER = "mean + 1.645::DOUBLE * sqrt(mean * (1 - mean) / (n + k + 1))"


def _cluster_sql(rounds: int = 3) -> str:
    """Lloyd rounds over (cluster, component, value) rows; floors of means of whole numbers."""
    near = "SELECT any_value(vec_id) AS vec_id, n, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT x.vec_id, x.n, c.cluster, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN {c} c USING (i) GROUP BY ALL) GROUP BY n"
    steps = [f"""a{r} AS ({near.format(c=f"c{r}")}),
        c{r + 1} AS (SELECT c.cluster, c.i, coalesce((SELECT (s - ((s % m) + m) % m) // m FROM (SELECT sum(x.x)::BIGINT AS s, count(*)::BIGINT AS m FROM a{r} a JOIN x ON x.n = a.n WHERE a.cluster = c.cluster AND x.i = c.i) WHERE m > 0), c.x) AS x FROM c{r} c)""" for r in range(rounds)]
    return f"""
        WITH e AS (SELECT vec_id, embedding, row_number() OVER () AS n FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v::DOUBLE))) = 0),
        x AS (SELECT vec_id, n, unnest(range(64)) AS i, floor(64 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM e),
        f AS (SELECT n, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM e ORDER BY cluster LIMIT 16),
        c0 AS (SELECT f.cluster, x.i, x.x FROM f JOIN x USING (n)),
        {", ".join(steps)},
        o AS ({near.format(c=f"c{rounds}")}),
        h AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
        SELECT vec_id, o.cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY o.cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256 FROM o JOIN h ON h.cluster = o.cluster"""


ORACLE_SQL = {
    "op11_centroid_clusters": _cluster_sql(),
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT k) >= 3),
        l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
        s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
        p AS (SELECT s.lang, s.source, kept.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.n + l.v) AS p, 1 + 1000000000::HUGEINT * (kept.n + 1) // (l.n + l.v) AS q
              FROM s JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = kept.term),
        t AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source)
        SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM t UNION ALL FROM r)
        QUALIFY part = 'pair' OR rank <= 200""",
    "op6_url_filter": rf"""
        WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        j AS (SELECT doc_id, bool_and(CASE WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0 END) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
        o AS (SELECT host, good FROM p JOIN j ON try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1), '') AS BIGINT) = doc_id WHERE good IS NOT NULL),
        h AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix, count(*) AS n, sum(good::INT) AS good FROM o GROUP BY 1),
        d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY 1, 2),
        s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY 1),
        t AS (SELECT (coalesce(sum(good), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0::DOUBLE) AS m FROM s),
        ks AS (SELECT {_concentration_sql("s")} AS k), kd AS (SELECT {_concentration_sql("d")} AS k), kh AS (SELECT {_concentration_sql("h")} AS k),
        sm AS (SELECT suffix, n, k, (good + m * k) / (n + k) AS mean FROM s, ks, t),
        dm AS (SELECT domain, d.n, kd.k, (d.good + sm.mean * kd.k) / (d.n + kd.k) AS mean FROM d JOIN sm ON sm.suffix = d.suffix, kd),
        hm AS (SELECT host, h.n, kh.k, (h.good + dm.mean * kh.k) / (h.n + kh.k) AS mean FROM h JOIN dm ON dm.domain = h.domain, kh),
        u AS (SELECT p.*, coalesce((SELECT any_value({_UPPER}) FROM hm WHERE hm.host = p.host), (SELECT any_value({_UPPER}) FROM dm WHERE dm.domain = array_to_string(string_split(p.host, '.')[-2:], '.')),
              (SELECT any_value({_UPPER}) FROM sm WHERE sm.suffix = string_split(p.host, '.')[-1]), (SELECT m + 1.645::DOUBLE * sqrt(m * (1 - m) / 21) FROM t)) AS bound FROM p),
        r AS (SELECT *, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/' WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM u)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound < 0.8::DOUBLE * (SELECT m FROM t) THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op3_mix_sources": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size) * 2.0::DOUBLE AS stop FROM d GROUP BY source),
        w AS (SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
        l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(stop) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        t AS (SELECT *, (SELECT level FROM l WHERE level * weight <= stop ORDER BY stop / weight, source NULLS LAST LIMIT 1) AS open_level FROM l),
        g AS (SELECT source, source_size, coalesce(least(stop, open_level * weight), stop)::DOUBLE AS target FROM t),
        p AS (SELECT d.doc_id, d.size, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
              coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || d.doc_id), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
              FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size::BIGINT AS size, source_size, target,
               CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - ahead)) END::BIGINT AS taken FROM p""",
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256 FROM d""",
}
