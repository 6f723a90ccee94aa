"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it has kept. All but the last return the
columns of documents. Classifiers are fit on the labels of documents that are still there, none of the held-out folds.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumibase.llm import packing, quality, repeats, simhash, toxicity
from lumibase.llm.shared import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Scores from which on a document counts as good, or as toxic.
GOOD, TOXIC = 0.3, 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble doesn't reject."""
    scored = quality.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), label_col="quality", modulus=5, held_out=0, out="_score")
    return scored.where(F.col("_score") >= GOOD).select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar doesn't reject."""
    scored = toxicity.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), label_col="toxic", modulus=4, held_out=2, out="_score")
    return scored.where(F.col("_score") < TOXIC).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the row with the least id (and of these the least hash of its text);
    rows without an id come last, and rows that repeat both stay once."""
    found = materialize(simhash.near_duplicates(docs, threshold=4).select("doc_id", "row", "root"), "near-copies")
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"))
    key = lambda id_, row: F.xxhash64(id_.isNull(), id_, row)
    kept = least.select(key(F.col("least.doc_id"), F.col("least.row")).alias("key")).distinct()
    keyed = docs.select(*COLUMNS, key(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))).alias("key"))
    chosen = keyed.join(kept, "key", "left_semi")
    if not found.groupBy("doc_id", "row").count().where("count > 1").isEmpty():
        chosen = chosen.dropDuplicates(["key"])  # only where rows repeat both: it sorts whole texts once more
    return chosen.select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that a string of 100 bytes covers which also starts earlier; whole characters are
    removed, and n_chars counts what is left."""
    kept = repeats.remove_repeats(docs, least=100, whole_characters=True, carry=("lang", "source"))
    kept = kept.withColumn("text", F.col("kept").cast("string"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    pieces = packing.harmonic_pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("simhash near-dedup", one_of_near_copies),
    ("suffix-array dedup", without_repeats),
    ("packing", packed),
]

#: Learned models, merges and suffix order can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{n}")
    return docs
