"""S-7 .. S-10, A-5: writers and the output check.

JSON is written by Spark's writer: values equal the reference's
``json.dumps(..., ensure_ascii=False)``, separators are compact (compare
parsed values, not bytes), and each dataset is a folder of part files
whose concatenation in name order is the reference's file order.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import checks
from ..operators.ordinals import global_ordinal
from ..session import materialize
from .exports import read_export_lines

SPLITS = ("train", "val", "test")


def write_turns(turns: DataFrame, path: str, order=("source_path", "line_start"), minimal: bool = False) -> None:
    """S-7: one JSON object per turn, in file then line order (the global
    sort keeps order across part files)."""
    cols = ["speaker", "text"] if minimal else ["timestamp", "speaker", "text", "source_file", "line_start"]
    sort = [F.split(F.col(c), "/") if c == "source_path" else F.col(c) for c in order if c in turns.columns]
    if order and not sort:
        raise ValueError(f"turns have none of the columns {list(order)} to be written by; order=() writes them as they come")
    ordered = turns.orderBy(*sort) if sort else turns
    ordered.select(*cols).write.mode("overwrite").json(path)


def write_splits(examples: DataFrame, out_dir: str, stats: DataFrame | None = None) -> dict[str, int]:
    """S-8: ``train``, ``val`` and ``test`` folders in chunk order (part files
    in name order); empty splits are still written.  The examples are materialised once (under
    the checkpoint folder) and the three writes read that copy.  A record
    is ``messages`` and, if there, ``meta``, after the keys of per-key
    datasets, which also come first in the order.  Returns the per-split
    counts; an input without examples is refused."""
    staged = materialize(examples, "examples")
    counts = {r["split"]: r["n"] for r in staged.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if stats is not None:
        row = stats.select("input_turns").first()
        checks.check_sizes(row["input_turns"] if row else 0, total)
    else:
        checks.check_sizes(1, total)
    record = [c for c in ("messages", "meta") if c in staged.columns]
    keys = [c for c in staged.columns if c not in ("chunk_index", "split", *record)]
    for name in SPLITS:
        # A global sort: part files are range-ordered, so reading them in
        # name order gives chunk order, and many tasks write in parallel.
        (staged.where(F.col("split") == name).orderBy(*keys, "chunk_index").select(*keys, *record)
         .write.mode("overwrite").json(f"{out_dir}/{name}"))
    return {name: int(counts.get(name, 0)) for name in SPLITS}


def write_stats(stats: DataFrame, out_dir: str) -> None:
    """S-9: the one-row statistics record as ``split_stats`` JSON."""
    stats.coalesce(1).write.mode("overwrite").json(f"{out_dir}/split_stats")


BATCH = "batch-"


def append_transcript(lines: DataFrame, path: str, line_col: str = "line") -> int:
    """S-10: append stripped non-blank lines, in transcript and line order,
    as the next numbered batch of a folder; returns its number.

    The batch is written aside (readers skip names that begin with ``_``) and
    put in place by one rename that fails if the number is taken, so a batch
    is there whole or not at all, and appenders at the same time get numbers
    of their own.  Part files in name order are the append order."""
    spark = lines.sparkSession
    order = [c for c in ("transcript_id", "line_no") if c in lines.columns]
    aside = f"{path}/_append-{uuid.uuid4().hex}"
    lines.orderBy(*order).select(F.col(line_col).alias("value")).write.text(aside)
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.FileContext.getFileContext(hadoop.Path(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    while True:
        number = 1 + max(_batches(spark, path), default=0)
        try:
            files.rename(hadoop.Path(aside), hadoop.Path(f"{path}/{BATCH}{number:010d}"), no_options)
            return number
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise


def _batches(spark: SparkSession, path: str) -> list[int]:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(hpath)] if fs.exists(hpath) else []
    return [int(n[len(BATCH):]) for n in names if n.startswith(BATCH)]


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """``(position, line)`` of all lines appended to a folder, numbered from
    0 in append order."""
    lines = read_export_lines(spark, path, glob=None)
    numbered, _ = global_ordinal(lines, ["source_path", "line_no"], "position", label="appended")
    return numbered.select("position", F.col("value").alias("line"))


def verify_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """A-5: lines per written split, 0 for an empty one."""
    counts = [spark.read.text(f"{out_dir}/{name}").agg(F.count(F.lit(1)).alias("rows"))
              .select(F.lit(name).alias("split"), "rows") for name in SPLITS]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
