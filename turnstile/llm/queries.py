"""Queries of the dealt operators: each applies one to the whole documents table.

``QUERIES`` maps names to builders ``(spark, sf_dir) -> DataFrame``, ``SQL``
names to DuckDB statements of the same rows where SQL can express them; the
others are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, filter_audit, jaccard, langid, lm_score, manifest, mixing, packing, pii, quality, sharding, simhash, token_counts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.ExactDedup(documents(spark, sf_dir)).assign()


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(documents(spark, sf_dir))
    return found.drop("grp").withColumn("distance", F.round("distance", 6))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(documents(spark, sf_dir)).report()


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.NearDedup(documents(spark, sf_dir)).assign()


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(documents(spark, sf_dir))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.JaccardJoin(documents(spark, sf_dir)).assign()


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return filter_audit.FilterAudit(documents(spark, sf_dir)).report(labels)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    found = manifest.Manifest(documents(spark, sf_dir), ("doc_id", "source", "lang", "n_chars", "text"), claimed={
        "n_chars": F.when(tampered, more).otherwise(F.col("n_chars").cast("decimal(20,0)"))})
    return found.proofs().drop("proof")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_token_counts, op3_quality_rules, op4_sharding, op5_pii, op6_packing,
                            op7_mixing, op8_language_id, op9_simhash, op10_lm_scores, op11_jaccard_join,
                            op12_filter_audit, op13_manifest)}

#: Statements of the same rows in DuckDB.
SQL = {
    # equal texts by grouping on the normalised text
    "op1_exact_dedup": r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
    g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
    SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)""",
    # masks of failed filters, then every order from the counts of masks
    "op12_filter_audit": r"""
    WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    least AS (SELECT x, min(doc_id) AS first_id FROM t GROUP BY x),
    marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
        + 4 * (100 * len(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x))::INT
        + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, first_id IS NOT NULL)::INT AS mask,
        coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
        FROM t JOIN least USING (x) LEFT JOIN marks USING (doc_id)),
    c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
    orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
        FROM l a, l b, l c, l d, l e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    steps AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
        FROM orders, unnest([1, 2, 3, 4, 5]) s(step))
    SELECT part, filter_order, step::INT AS step,
      coalesce(sum(n) FILTER (mask & bit = 0 AND mask & before = 0), 0)::BIGINT AS kept,
      coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
      coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
      coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
      coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
      coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
      coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
    FROM c, steps GROUP BY part, filter_order, step""",
    # both trees level by level, then each leaf folded upwards with the sibling that it meets
    "op13_manifest": r"""
    WITH RECURSIVE hashed AS (
      SELECT row_number() OVER () AS r, doc_id, lang,
        crc32.c = 0 AS tampered,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
          || coalesce(strlen(lang) || ':' || lang, '-') AS head,
        n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail
      FROM documents, LATERAL (SELECT xor(4294967295, list_reduce([ord(x) FOR x IN string_split(doc_id::VARCHAR, '')],
        lambda c, o: list_reduce(list_concat([xor(c, o)], range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1))), 4294967295)) % 7 AS c) crc32),
    leaves AS (
      SELECT r, doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
        sha256(head || coalesce(strlen((n_chars + tampered::INT)::VARCHAR) || ':' || (n_chars + coalesce(tampered, false)::INT), '-') || tail) AS claim
      FROM hashed),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total
      FROM leaves),
    low(lang, lvl, pos, total, digest) AS (
      SELECT lang, 0, pos, total, leaf FROM placed
      UNION ALL
      SELECT lang, lvl + 1, pos // 2, any_value((total + 1) // 2), sha256(string_agg(digest, '' ORDER BY pos))
      FROM low WHERE total > 1 GROUP BY lang, lvl, pos // 2),
    subroots AS (
      SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS total
      FROM low WHERE total = 1),
    high(lvl, pos, total, digest) AS (
      SELECT 0, pos, total, subroot FROM subroots
      UNION ALL
      SELECT lvl + 1, pos // 2, any_value((total + 1) // 2), sha256(string_agg(digest, '' ORDER BY pos))
      FROM high WHERE total > 1 GROUP BY lvl, pos // 2),
    climb(r, lang, lvl, pos, total, node, proof) AS (
      SELECT r, lang, 0, pos, total, claim, '' FROM placed
      UNION ALL
      SELECT c.r, c.lang, c.lvl + 1, c.pos // 2, (c.total + 1) // 2,
        sha256(CASE WHEN c.pos % 2 = 0 THEN c.node || coalesce(s.digest, '') ELSE s.digest || c.node END), c.proof || coalesce(s.digest, '')
      FROM climb c LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM c.lang AND s.lvl = c.lvl AND s.pos = xor(c.pos, 1) WHERE c.total > 1),
    finish(r, lvl, pos, total, node, proof) AS (
      SELECT c.r, 0, s.pos, s.total, c.node, c.proof FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.total = 1
      UNION ALL
      SELECT c.r, c.lvl + 1, c.pos // 2, (c.total + 1) // 2,
        sha256(CASE WHEN c.pos % 2 = 0 THEN c.node || coalesce(s.digest, '') ELSE s.digest || c.node END), c.proof || coalesce(s.digest, '')
      FROM finish c LEFT JOIN high s ON s.lvl = c.lvl AND s.pos = xor(c.pos, 1) WHERE c.total > 1)
    SELECT p.doc_id, p.leaf, s.subroot, h.digest AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = h.digest AS verified
    FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN finish f ON f.r = p.r AND f.total = 1
    CROSS JOIN (SELECT digest FROM high WHERE total = 1) h"""}
