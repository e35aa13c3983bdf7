"""A corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), docs being all that the stage before kept; all but the last
return the columns of documents. run() writes each stage's rows to the shared folder and reads them
back as the next one's docs.

An SQL oracle is not given: the vocabularies of the first and last stage are beyond SQL. Tests hold
the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common, minhash, mixing, pii, quality
from tesserae.llm.queries import packed, table, vocabulary
from tesserae.ship import shipped


@shipped
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    rated = quality.rate(docs, vocabulary("piece_bpe_32k.model"), prefix="_q_", keep_columns=True)
    return rated.where("_q_kept").select(*docs.columns)


#: Near duplicates of the corpus share four fifths of their runs of five words. With 12 hashes for each table's half, a
#: pair at that threshold is missed no more often than one at the operator's own threshold with 9.
NEAR = minhash.Settings(percent=80, m=12)


@shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.deduplicated(docs, NEAR)


@shipped
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind."""
    return pii.redacted(docs)


@shipped
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as often as the mix takes it: not at all, or up to three times.

    Documents without words take up nothing of the mix and stay once.
    """
    return mixing.repeated(docs)


@shipped
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, with their ids."""
    return packed(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("personal_data", personal_data), ("source_mix", source_mix), ("packing", pack)]
ORACLE_SQL = None


@shipped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage_{name}")
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
