"""The corpus queries: thin digests of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontaminate, jaccard_join, langid, period_runs, quality_rules, quote_links, run_index, secret_ledger, source_mix, token_counts, token_files, warc_assembly
from .common import fresh_path, table


def op1_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.thread(table(spark, sf_dir, "conversations"))


def op2_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.remove_repeats(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_assembly.digest_rows(warc_assembly.round_trip(table(spark, sf_dir, "pages")))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.plan(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.report_in_two_scans(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op11_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return period_runs.digest_rows(period_runs.detect(docs.withColumn("text", period_runs.with_loops(docs["doc_id"], docs["text"]))))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = table(spark, sf_dir, "documents"), fresh_path(spark, "token-files")
    token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_files.digest_rows(token_files.read(spark, path, docs.schema["doc_id"].dataType.simpleString()))


OP6_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM totals
), levels AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM weighed WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), rates AS (
  SELECT source, source_size, CAST(least(CAST(cap AS DOUBLE), coalesce(weight * max(CASE WHEN level * weight <= cap THEN level END) OVER (), CAST(cap AS DOUBLE))) AS DOUBLE) AS target FROM levels
), drawn AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, CASE WHEN r.source_size = 0 THEN 0.0::DOUBLE ELSE r.target / r.source_size END AS rate,
         CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE AS draw
  FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM drawn
"""

OP5_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p
), e AS (
  SELECT page_id, payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS top,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM e
"""

OP12_SQL = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, generate_subscripts(p, 1) AS piece, unnest(p) AS body
  FROM (SELECT doc_id, lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)
), lists AS (
  SELECT lang, regexp_extract_all(body, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM lists, (VALUES (1), (2), (3)) s(m)) GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE m = 1 GROUP BY lang
), candidates AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE m > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, x.f AS l, y.f AS r, (1000000 * c.a * c.a) // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
), cut AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), covers AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longest FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM candidates WHERE m = 3) GROUP BY ALL
), kept AS (
  SELECT cut.* FROM cut LEFT JOIN covers USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_quote_links, op2_run_index, op3_langid, op4_token_counts, op5_warc_assembly, op6_source_mix, op7_jaccard_join, op8_secret_ledger,
        op9_decontaminate, op10_quality_rules, op11_period_runs, op12_collocations, op13_token_files,
    )
}
ORACLES = {"op5_warc_assembly": OP5_SQL, "op6_source_mix": OP6_SQL, "op12_collocations": OP12_SQL}
