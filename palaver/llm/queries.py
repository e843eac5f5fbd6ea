"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exactdedup, fim, langid, licenses, mixing, neardup, pivots, repeats, secretscan, sharding, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), texts=False)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(_table(spark, sf_dir, "documents"))


def op11_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.vector_links(_table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license, op2_secrets, op3_mixing, op4_language, op5_sharding, op6_decontamination, op7_exact_dedup, op8_toxicity, op9_repeats, op10_near_dedup, op11_vector_links, op12_whitening, op13_fim, pipeline)
}

#: One step of CRC-32 by bit: shifted, and where a one falls out, with the reversed polynomial taken off.
_CRC_STEP = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"

ORACLES: dict[str, str] = {
    "op1_license": licenses.oracle(),
    "op13_fim": fim.ORACLE,
    "op5_sharding": f"""
        WITH RECURSIVE bits(i, k, x) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, {_CRC_STEP} FROM bits WHERE k < 8),
        tab AS (SELECT list(x ORDER BY i) AS tab FROM bits WHERE k = 8),
        texts AS (SELECT DISTINCT coalesce(text, '') AS x FROM documents),
        crcs AS (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS crc FROM texts, tab),
        base AS (SELECT doc_id, octet_length(encode(x)) + 1 AS size, crc, md5(x) AS t, md5(doc_id::VARCHAR) AS d FROM documents JOIN crcs ON coalesce(text, '') = x),
        tot AS (SELECT sum(size)::BIGINT AS total FROM base),
        hot AS (SELECT t FROM base, tot GROUP BY t, total HAVING sum(size) > 0.02 * total / 16),
        rows_ AS (SELECT base.*, t IN (SELECT t FROM hot) AS hot FROM base),
        placed AS (SELECT *, sum(size) OVER w - size AS start, row_number() OVER w - 1 AS nth FROM rows_ WINDOW w AS (ORDER BY hot DESC, t, d, doc_id ROWS UNBOUNDED PRECEDING)),
        grouped AS (SELECT *, CASE WHEN hot THEN start ELSE min(start) OVER g END AS first_, CASE WHEN hot THEN size ELSE sum(size) OVER g END AS bytes FROM placed WINDOW g AS (PARTITION BY t)),
        dealt AS (SELECT *, least(15, (2 * first_ + bytes) * 16 // (2 * total))::INT AS shard FROM grouped, tot)
        SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard, nth - min(nth) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM dealt""",
    "op3_mixing": """
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
        w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
        f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                     sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wrest FROM w),
        l AS (SELECT *, cap <= rest / wrest * w AS is_full, rest / wrest AS level FROM f),
        t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least(cap, max(CASE WHEN NOT is_full THEN level END) OVER () * w) END AS target FROM l),
        h AS (SELECT *, length(hex(floor(target)::BIGINT)) AS class FROM t),
        b AS (SELECT *, greatest(1, ceil(sum(target) OVER c / greatest(16000, 800 * count(*) OVER c)))::BIGINT AS block, sum(target) OVER c AS total, count(*) OVER c AS n FROM h WINDOW c AS (PARTITION BY class)),
        c AS (SELECT *, round(total / block)::BIGINT AS seats FROM b),
        q AS (SELECT source, class, target, seats, unnest(range(1, 2 + least(ceil(target / block * (1 + n / (2.0 * greatest(seats, 1)))) + 1, 2 * ceil(source_size / block::DOUBLE))::BIGINT - 1)) AS i FROM c WHERE target > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY target / (2 * i - 1) DESC, source NULLS LAST, i) AS rnk FROM q),
        g AS (SELECT source, least(15, (rnk - 1) * 16 // seats) AS shard FROM r WHERE rnk <= seats),
        p AS (SELECT source, count(*) AS won, [count(*) FILTER (shard <= 0), count(*) FILTER (shard <= 1), count(*) FILTER (shard <= 2), count(*) FILTER (shard <= 3), count(*) FILTER (shard <= 4), count(*) FILTER (shard <= 5),
                     count(*) FILTER (shard <= 6), count(*) FILTER (shard <= 7), count(*) FILTER (shard <= 8), count(*) FILTER (shard <= 9), count(*) FILTER (shard <= 10), count(*) FILTER (shard <= 11),
                     count(*) FILTER (shard <= 12), count(*) FILTER (shard <= 13), count(*) FILTER (shard <= 14), count(*)] AS upto FROM g GROUP BY 1),
        a AS (SELECT c.*, (c.source_size + c.block - 1) // c.block AS nb, least(coalesce(p.won, 0), 2 * ((c.source_size + c.block - 1) // c.block)) AS quota, p.upto FROM c LEFT JOIN p ON c.source IS NOT DISTINCT FROM p.source),
        e AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) - size AS start FROM d),
        o AS (SELECT e.doc_id, e.size, e.start, a.source_size, a.target, a.quota, a.block, a.upto,
                     (CASE WHEN nb = 0 THEN 0 ELSE (quota // nb) * e.size + greatest(0, least(e.start + e.size, (quota % nb) * block) - e.start) END)::BIGINT AS taken
              FROM e JOIN a ON e.source IS NOT DISTINCT FROM a.source)
        SELECT doc_id, size, source_size, target, taken, quota, CASE WHEN taken > 0 THEN len(list_filter(upto, lambda x: x <= start // block)) END::INT AS first_shard FROM o""",
    "op7_exact_dedup": """
        WITH d AS (
          SELECT doc_id, coalesce(length(text), 0) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER w = 1 AS kept, h AS text_sha256
        FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)""",
}
