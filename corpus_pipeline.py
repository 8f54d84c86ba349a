"""The corpus pipeline: language ID, near-duplicate removal, personal data, source mixing, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.

All stages take docs with the columns of ``documents``; others are dropped, whatever their names. An empty table gives an empty result. Texts of any length are
looked at whole. Repeated rows and rows with the same doc_id are rows of their own, but for the near-duplicate stage. Null langs and sources stay null, or are a language and
a source of their own where one is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard_join, language_id, mixing, packing, pii
from lodestone.llm.common import materialize, read
from lodestone.llm.queries import REPETITION_LIMIT, tokenizer_path
from lodestone.session import ship

#: Words that a worker remembers while it packs; fewer than the packing query's, as the stages share their workers.
CACHE_WORDS = 150_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A character of a word: anything but ASCII white space.
HAS_WORD = r"[^\x20\x09-\x0D]"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language (null text, or no letter; all of them if no document has a lang to learn from); ``lang`` becomes the predicted one. Equal scores go to the language that
    sorts first."""
    ship(spark)
    found = language_id.identify_documents(docs.select(*COLUMNS))
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: one with the smallest doc_id. Rows without a doc_id or a word are near nothing and stay."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    found = materialize(jaccard_join.near_duplicate_rows(docs.select("doc_id", "text")), "near")
    least = found.where("n_shingles > 0 and doc_id = component_id")
    chosen = least.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.count("*").alias("_rows")).select("row.*", "_rows")
    kept = docs.withColumn("text_key", F.xxhash64("text")).join(chosen, ["doc_id", "text_key"])
    if not chosen.where("_rows > 1").isEmpty():  # several rows have that doc_id: repeated ones among them give one
        kept = kept.where("_rows > 1").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("_rows = 1"))
    alone = docs.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(HAS_WORD), F.lit(False)))
    return kept.select(*COLUMNS).unionByName(alone.select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by placeholders; n_chars follows. Null and empty texts stay as they are, and so do all rows."""
    ship(spark)
    return pii.redact(docs.select(*COLUMNS), pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources again until no source is used more than REPETITION_LIMIT times. A null source is a source; a null text counts its closing id."""
    ship(spark)
    docs = materialize(mixing.counted(docs.select(*COLUMNS), packing.word_encoder(tokenizer_path(), CACHE_WORDS)), "counted")
    return mixing.mix(docs, F.col("_count"), repetition_limit=REPETITION_LIMIT).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens. Null texts are empty: their only token is the closing id."""
    ship(spark)
    return packing.pack(docs, packing.word_encoder(tokenizer_path(), CACHE_WORDS))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages learn models, verify sets and call a tokenizer, so SQL can't express them; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table ``documents``; each but the last is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
