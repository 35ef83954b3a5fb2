"""Documents from the raw table to subword ids, one operator a stage; each stage's result is written and read again.

Each function takes (spark, docs, sf_dir), works on all of docs, and returns a DataFrame; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, language_id, secret_scan, sentencepiece_codec, simhash_dedup
from quarry.llm.common import Table, read_table


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with the model's calibrated score or more; texts without a letter go."""
    model = language_id.train(docs, ~language_id.held_out(2, 4))
    return language_id.predict(docs, model).where("accepted").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id, of repeated rows one.

    Five-word shingles; links have a Jaccard similarity of 0.8 or more. Rows are told apart by their place in the table,
    so a doc_id that is null or shared by unlike texts loses none of them.
    """
    return simhash_dedup.without_near_copies(docs, words=5, similarity=0.8)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return secret_scan.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the piece ids of each text, and whether decoding gives the text back."""
    codec = sentencepiece_codec.Codec.load()
    out = sentencepiece_codec.encode_and_decode(docs, codec)
    return out.select("doc_id", "lang", "source", "ids", (F.col("decoded") == F.col("text")).alias("exact"))


STAGES = [
    ("language ID", keep_known_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("secret scans", mask_secrets),
    ("SentencePiece encoding and decoding", encode_pieces),
]
#: Trained and similarity stages have no SQL form; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    before: Table | None = None
    for _, stage in STAGES:
        table = Table(stage(spark, docs, sf_dir))
        docs = table.df
        if before:
            before.drop()
        before = table
    return docs
