"""Corpus pipeline: from ``documents`` to token files.

Each stage works on all that the stage before kept; the rows between stages
are Parquet tables in the shared folder, so a lost executor repeats a part of
one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnframe.llm import pipeline as _p
from turnframe.llm.queries import ORACLES as _SQL
from turnframe.llm.queries import QUERIES as _OPS
from turnframe.llm.staging import materialize

STAGES = [
    ("quality classifier", _p.quality_stage),
    ("n-gram Jaccard join", _p.near_duplicate_stage),
    ("benchmark decontamination", _p.decontamination_stage),
    ("mixing sources to target weights", _p.mixing_stage),
    ("token-ID / binary output", _p.token_stage),
]

# The trained classifier and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {**_OPS, "pipeline": run}
ORACLES: dict[str, str] = dict(_SQL)
