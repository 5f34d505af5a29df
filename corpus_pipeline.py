"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, PII, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the shared folder and
reads it back as the next stage's docs. All but the last return the columns of documents. Null and empty texts pass
all stages (they are not toxic, not alike to others and hold nothing) and have no pieces at the end; empty tables
give empty results. Rows with the same id share the fate of one another in the stages that drop by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm import decontamination, near_dedup, pieces, pii, toxicity
from maskwell.llm.common import read_table, remove, shared_folder, without
from maskwell.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled documents, scores below 0.5."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id."""
    return near_dedup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (a containment of 0.8 or more of its shingles)."""
    found = decontamination.contaminated(docs, read_table(spark, sf_dir, "benchmark"))
    return without(docs, found.select("doc_id"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what gives it away taken out of the texts; n_chars follows."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of all documents (little-endian u32), and whether decoding gives the text back."""
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", sanitise),
    ("sentence_pieces", encode),
]

#: SQL expresses neither the classifier nor the sketches; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table goes when the next one is written."""
    docs, folder, last = read_table(spark, sf_dir, "documents"), shared_folder(spark), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if last:
            remove(spark, f"{folder}/{last}")
        docs, last = spark.read.parquet(f"{folder}/{name}"), name
    return docs
