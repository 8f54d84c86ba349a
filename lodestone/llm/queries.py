"""The queries of the corpus operators: (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import fingerprints, huffman, jaccard_join, language_id, media, mixing, oracles, packing, phrases, pii, resharding, structure, substring_dedup, warc
from lodestone.llm.common import materialize, read, scratch, settle

#: Old shards of the resharding query: a checksum of the source, so one of them is as hot as the hottest source.
OLD_SHARDS = 16
NEW_SHARDS = 24
#: Uses of a document at most when sources are mixed.
REPETITION_LIMIT = 1.5
#: How Parquet packs stored images and tensors.
MEDIA_CODEC = "zstd"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op2_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(read(spark, sf_dir, "documents"))


def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.report(docs, pii.train(docs))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), packing.word_encoder(tokenizer_path()))


def op5_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards that change are written to the shared folder and read back; what stays in an unchanged shard is read where it lies."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    checksum = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(OLD_SHARDS)).cast("int")
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text", size.alias("size"), checksum.alias("text_crc32"))
    out = resharding.reshard(docs, old, OLD_SHARDS, NEW_SHARDS, size=F.col("size"), order=[F.col("doc_id"), F.col("size"), F.col("text_crc32")]).drop("size", "text_crc32")
    path = scratch(spark, "shards")
    affected = resharding.rewrite(out, path)
    rows = out.drop("old_shard")
    if affected:
        written = spark.read.schema(rows.schema).parquet(path).select(*rows.columns)
        rows = written if set(range(max(OLD_SHARDS, NEW_SHARDS))) <= set(affected) else written.unionByName(rows.where(~F.col("shard").isin(affected)))
        settle(spark)
    return rows.select("doc_id", size.alias("size"), checksum.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), old.alias("old_shard"))


def op6_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images and then their tensors are written to the shared folder; what is said of them comes from there."""
    images = materialize(media.store(read(spark, sf_dir, "documents")), "media", MEDIA_CODEC)
    return media.featured(materialize(media.tensors(images), "tensors", MEDIA_CODEC))


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares are of the packing query's tokens, counted once."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    docs = materialize(mixing.counted(docs, packing.word_encoder(tokenizer_path())).drop("text"), "counted")
    mixed = mixing.mix(docs, F.col("_count"), repetition_limit=REPETITION_LIMIT)
    return mixed.select("doc_id", "source", "n_tokens", "weight", "epoch", "position")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read(spark, sf_dir, "pages"))


def op10_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify_documents(docs).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op11_pair_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents").select("lang", "text"))


def op12_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(read(spark, sf_dir, "documents"), huffman.byte_encoder(tokenizer_path("byte_bpe_50k.json")))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repair_damaged(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_recompression_dedup": op1_recompression_dedup,
    "op2_minhash_fingerprints": op2_minhash_fingerprints,
    "op3_skip_chain_pii": op3_skip_chain_pii,
    "op4_harmonic_packing": op4_harmonic_packing,
    "op5_flow_resharding": op5_flow_resharding,
    "op6_progressive_jpeg": op6_progressive_jpeg,
    "op7_temperature_mixing": op7_temperature_mixing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_ppm_language": op10_ppm_language,
    "op11_pair_naming": op11_pair_naming,
    "op12_huffman_ids": op12_huffman_ids,
    "op13_structure_repair": op13_structure_repair,
}

_WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLE_SQL: dict[str, str] = {
    "op1_recompression_dedup": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
     k AS (SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM w),
     v AS (SELECT doc_id, list_transform(range(1, len(ws) - 33), lambda i: md5(array_to_string(ws[i:i + 34], ' '))) AS keys FROM w WHERE len(ws) >= 35),
     win AS (SELECT doc_id, generate_subscripts(keys, 1) AS start, unnest(keys) AS key FROM v),
     rep AS (SELECT key FROM win GROUP BY key HAVING count(*) > 1),
     gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 35)) AS pos FROM win JOIN rep USING (key)),
     kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM k ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
     n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op8_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
     e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
     r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other),
     m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM m LEFT JOIN n USING (doc_id)""",
    "op9_warc_revisits": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id < p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
    "op11_pair_naming": oracles.PHRASES,
    "op13_structure_repair": oracles.CONVERSATIONS,
}
