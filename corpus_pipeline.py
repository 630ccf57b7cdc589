"""A corpus pipeline of the package's training-data operators.

Documents go through a quality classifier (those it rejects go), near-duplicate
removal (of texts linked by a similarity of five-word shingles of 0.8 or more one stays), secret scans (what they find is replaced),
mixing of the sources to target weights (the column mix_order) and packing into
sequences numbered along it. Each stage's result is a table in the shared folder and the next one's input.

Rules: a null text counts as the empty text and stays null; a null doc_id comes before all others. Texts without words
are one group, of which the first by doc_id stays; of repeated rows one stays. A null source is a source of its own.
Other columns go along, but for mix_slot, mix_block and mix_order, which the mixing stage takes over. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consentry.llm import common, fm, mixing, packing, secrets, similar, tokens

#: The stages are trained models, fingerprints and automata, which SQL cannot express.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fm.keep_good(docs, fm.train(docs, labels, common.crc_fold(F.col("doc_id"), 5) == 0))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_first(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # files are not read in the order in which they were written, so the order goes along as a column
    return mixing.mix(docs).drop("mix_slot", "mix_block")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokens.tokenizer_path(), order="mix_order")


STAGES = [("quality_classifier", classify), ("simhash_near_dedup", near_dedup), ("secret_scans", redact), ("source_mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of sf_dir's documents."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
