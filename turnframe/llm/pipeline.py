"""Stages of the corpus pipeline: documents in, documents out.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of ``documents``.  Rows with null ids or texts go
through every stage: a null text has no features, no words and no size, so it
is graded by the thresholds alone, linked with nothing, not contaminated, and
taken no times by the mix.  Repeated rows are judged alike; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import find_contamination
from .jaccard_join import near_duplicates
from .mixing import mix_sources
from .quality_model import keep_good, train
from .staging import keyed as name_rows, materialize
from .token_files import token_files

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


BROADCAST_IDS = 1_000_000


def _few(rows: DataFrame) -> DataFrame:
    """A table of row numbers, sent to the tasks when it is counted to be
    small, so that no text has to move."""
    rows = materialize(rows, "stage-rows")
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal quality model keeps.  It is trained on
    the labelled documents among the stage's input."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_good(docs.select(*COLUMNS), model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest id
    (null last), and of equal ids the first row."""
    keyed, _ = name_rows(docs)
    numbered = near_duplicates(keyed.select(F.col("row").alias("doc_id"), "text"))
    groups = numbered.join(keyed.select(F.col("row"), F.col("doc_id").alias("id")),
                           numbered["doc_id"] == F.col("row")).select("row", "id", "component_id")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    return keyed.join(_few(first.select(F.col("first.row").alias("row"))), "row", "left_semi").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    keyed, _ = name_rows(docs)
    found = find_contamination(keyed.select(F.col("row").alias("doc_id"), "text"),
                               spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("row"))
    return keyed.join(_few(bad), "row", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole epochs first, then
    the sampled ones; the document a budget ends in goes in whole or not."""
    keyed, _ = name_rows(docs)
    plan = mix_sources(keyed.select(F.col("row").alias("doc_id"), "text", "source"), boundary="nearest")
    plan = _few(plan.select(F.col("doc_id").alias("row"), "copies").where("copies > 0"))
    return keyed.join(plan, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))) \
        .select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places and checksums in the token files, read back
    from the files."""
    import public_tokenizers

    return token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))
