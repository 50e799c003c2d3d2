"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; the last returns each document's ids.

Defined results of all stages: an empty table gives an empty table; very long texts are judged whole; extra columns pass
through, but for those that the last stage adds, which take the place of columns of their name. Null and empty texts are
clean: no stage drops them (equal rows of one id are one for the near duplicates), masking leaves them as they are, and
they have no ids. Toxicity and benchmark leaks are judged row by row, so repeated rows fare alike, and rows with a
null id as others do. Equal scores fare alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweir.llm import decontaminate, ngram_join, pieces, pii, toxicity
from tallyweir.llm.common import cut, table
from tallyweir.llm.queries import piece_model


#: Names of dropped rows that are broadcast, at most.
BROADCAST_BYTES = 16 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go. It learns from labels that are not held out."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the smallest id. Rows of one id but different texts are told apart. Rows without an id stay."""
    rows = docs.withColumn("_text", F.xxhash64(F.col("text").cast("string")))
    # a row's name; those without an id come last
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_text").alias("text")).alias("row"), "text")
    found = ngram_join.near_duplicates(named, "row")
    gone = cut(found.where("row <> component_id and not row.none").select(F.col("row.id").alias("doc_id"), F.col("row.text").alias("_text")).distinct(), "near-duplicates")
    size = gone.agg(F.coalesce(F.sum(F.octet_length(F.col("doc_id").cast("string")) + 16), F.lit(0)).alias("bytes")).first().bytes
    # names of rows that are few go to the texts; beyond that, texts are dealt by their rows' names
    left = rows.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, ["doc_id", "_text"], "left_anti")
    twice = left.where("doc_id is not null").groupBy("doc_id", "_text").count().where("count > 1").limit(1).count()
    if twice:
        # rows without an id are dealt by their text
        row = Window.partitionBy("doc_id", "_text").orderBy("text")
        left = left.withColumn("_row", F.row_number().over(row)).where("_row = 1 or doc_id is null").drop("_row")
    return left.select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; n_chars follows the text."""
    masked = pii.mask(docs, pii.train(docs))
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each whole text, and the hash of the text that they decode to."""
    encoded = pieces.encode(docs, piece_model()).withColumn("decoded_sha256", F.sha2(F.col("decoded"), 256))
    return encoded.drop("text", "decoded").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", mask_personal_data),
    ("sentencepiece", encode_pieces),
]

#: Lexicon automata, alignment and the like are no SQL: tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
