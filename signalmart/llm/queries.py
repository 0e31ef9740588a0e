"""The registered query of every operator, over its whole table, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmart.llm import bpe, divergence_audit, exact_dedup, hd_language, jaccard_join, license_scan, line_dedup, merkle_manifest, packing, quality, sharding, suffix_dedup, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_hd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hd_language.identify(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.document_components(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every second document, by its id's checksum, the line ends are deleted before the witness is tried."""
    m = merkle_manifest
    columns = {name: F.col(name) for name in m.LEAF_COLUMNS}
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    other = m.leaf_digest(*(columns | {"text": F.replace("text", F.lit("\n"), F.lit(""))}).values())
    rows = m.manifest(table(spark, sf_dir, "documents"), carry={"tampered": F.when(tampered, F.unhex(other))})
    folded = rows.withColumn("folded", m.folded_root(F.coalesce("tampered", "leaf")))
    return folded.select(
        "doc_id", *[m.text_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], m.proof_digest().alias("proof_sha256"),
        m.text_of(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query for query in (
        op1_sharding, op2_quality, op3_hd_language, op4_best_fit_packing, op5_exact_dedup, op6_suffix_dedup, op7_jaccard_join, op8_license_scan, op9_warc, op10_bpe,
        op11_line_dedup, op12_merkle_manifest, op13_divergence_audit)
} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        keyed AS (
            SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
        judged AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM keyed)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op12_merkle_manifest": r"""
        WITH RECURSIVE fields AS (
            SELECT doc_id, coalesce('=' || source, '-') AS tree, text, lang,
                coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                -- CRC-32 of the id: a byte is taken in, then come eight shifts, marked by -1
                list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
                    lambda i: [CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
                    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END
                ) % 2 = 1 AS even
            FROM documents),
        leaves AS (
            SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS other, head FROM fields),
        placed AS (
            SELECT doc_id, tree, leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS other,
                row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n
            FROM leaves),
        nodes(tree, level, place, n, node) AS (
            SELECT tree, 0, place, n, leaf FROM placed
            UNION ALL
            SELECT tree, level + 1, place // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM nodes
            WHERE n > 1 GROUP BY tree, level, place // 3, n),
        subroots AS (
            SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
        tops(level, place, n, node) AS (
            SELECT 0, place, n, subroot FROM subroots
            UNION ALL
            SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM tops
            WHERE n > 1 GROUP BY level, place // 3, n),
        paths(doc_id, leaf, tree, level, place, n, proof, folded) AS (
            SELECT doc_id, leaf, tree, 0, place, n, '', other FROM placed
            UNION ALL
            SELECT p.doc_id, p.leaf, p.tree, p.level + 1, p.place // 3, (p.n + 2) // 3,
                p.proof || coalesce(string_agg(s.node, '' ORDER BY s.place) FILTER (s.place <> p.place), ''),
                sha256(string_agg(CASE WHEN s.place = p.place THEN p.folded ELSE s.node END, '' ORDER BY s.place))
            FROM paths p JOIN nodes s ON s.tree = p.tree AND s.level = p.level AND s.place // 3 = p.place // 3
            WHERE p.n > 1 GROUP BY p.doc_id, p.leaf, p.tree, p.level, p.place, p.n, p.proof, p.folded),
        climbs(doc_id, leaf, subroot, level, place, n, proof, folded) AS (
            SELECT p.doc_id, p.leaf, s.subroot, 0, s.place, s.n, p.proof, p.folded FROM paths p JOIN subroots s ON s.tree = p.tree WHERE p.n = 1
            UNION ALL
            SELECT p.doc_id, p.leaf, p.subroot, p.level + 1, p.place // 3, (p.n + 2) // 3,
                p.proof || coalesce(string_agg(s.node, '' ORDER BY s.place) FILTER (s.place <> p.place), ''),
                sha256(string_agg(CASE WHEN s.place = p.place THEN p.folded ELSE s.node END, '' ORDER BY s.place))
            FROM climbs p JOIN tops s ON s.level = p.level AND s.place // 3 = p.place // 3
            WHERE p.n > 1 GROUP BY p.doc_id, p.leaf, p.subroot, p.level, p.place, p.n, p.proof, p.folded)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
        FROM climbs, (SELECT node AS root FROM tops WHERE n = 1) WHERE n = 1
    """,
    "op13_divergence_audit": r"""
        WITH docs AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        kept AS (
            SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs) GROUP BY ALL HAVING count(*) >= 3),
        found AS (
            SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM docs) JOIN kept USING (lang, term)
            GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        group_totals AS (SELECT lang, source, sum(n) AS total FROM found GROUP BY ALL),
        lang_terms AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM found GROUP BY lang, term),
        dense AS (
            SELECT lang, source, term, coalesce(n, 0) AS n,
                1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (coalesce(total, 0) + v)::HUGEINT AS p
            FROM groups JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN found USING (lang, source, term)
            LEFT JOIN group_totals USING (lang, source)),
        overall AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (total + v)::HUGEINT AS q FROM lang_terms JOIN sizes USING (lang)),
        distances AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM dense JOIN overall USING (lang, term) WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
}
