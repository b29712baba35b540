"""Queries over the thirteen operators, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.bpe import encode_digests
from millrace.llm.decontaminate import contaminated
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.fm_dedup import substring_dedup
from millrace.llm.language_id import identify
from millrace.llm.licenses import scan_licenses
from millrace.llm.prefix_trie import grafted_trie
from millrace.llm.quality import score_quality
from millrace.llm.runs import periodic_runs, run_digests, with_repeats
from millrace.llm.simhash import simhash_components
from millrace.llm.suffix_dedup import suffix_dedup
from millrace.llm.token_counts import token_counts
from millrace.llm.warc import read_warc, write_warc
from millrace.session import shared_path, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = shared_path(spark)
    write_warc(table(spark, sf_dir, "pages"), archives)
    return read_warc(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grafted_trie(table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_repeats(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_simhash": op7_simhash,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_warc": op10_warc,
    "op11_quality": op11_quality,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS n,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS keep_id
            FROM d)
        SELECT doc_id, keep_id, group_size, n = 1 AS kept, text_sha256 FROM r
    """,
    "op10_warc": r"""
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
               true AS verified
        FROM f
    """,
    "op12_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
                   coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (  -- h: CRC-32 of the decimal digits, bit by bit
            SELECT conv_id, conv_id - conv_id % 5 AS base,
                   xor(4294967295, list_reduce(
                       list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                       lambda crc, b: list_reduce(
                           list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                           lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) % 9 AS h
            FROM (SELECT DISTINCT conv_id FROM t)),
        g AS (
            SELECT c.conv_id, 0 AS half, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
            UNION ALL
            SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY half, pos) AS depth FROM g),
        p AS (
            SELECT conv_id, depth, string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS k, strlen(text) AS bytes FROM r
            UNION ALL SELECT conv_id, 0, '', 0 FROM c),
        last AS (SELECT conv_id, max(depth) AS turns FROM p GROUP BY conv_id),
        n AS (
            SELECT k, depth, min(conv_id) AS node, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = turns), '')) AS ends_sha256
            FROM p JOIN last USING (conv_id) GROUP BY k, depth),
        way AS (SELECT p.conv_id, n.depth, n.node FROM p JOIN n ON p.k = n.k AND p.depth = n.depth),
        up AS (SELECT n.node, n.depth, w.node AS parent FROM n JOIN way w ON w.conv_id = n.node AND w.depth = n.depth - 1),
        kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY ALL),
        own AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (node, depth)),
        under AS (
            SELECT w.node, w.depth, count(*) FILTER (WHERE o.n_children = 0) AS n_leaves, sum(o.saved) AS saved_tokens
            FROM own o JOIN way w ON w.conv_id = o.node AND w.depth <= o.depth GROUP BY ALL)
        SELECT o.node AS conv_id, o.depth, up.parent AS parent_conv_id, o.n_convs, o.n_children, under.n_leaves,
               CAST(under.saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
        FROM own o JOIN under USING (node, depth) LEFT JOIN up USING (node, depth)
    """,
}
