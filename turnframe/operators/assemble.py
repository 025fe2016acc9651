"""W-1, A-1, P-2: assemble multi-line export messages.

Two physical routes with the same result:

* ``assemble_messages(lines)`` for a line table (any size of file): lines are
  dealt once by bounded blocks of a file, messages are joined inside their
  block, and only the fragments at the blocks' edges are stitched after it.
* ``parse_export_text(files)`` for whole files held one per row (the
  ``binaryFile`` route): all work happens inside the row with array
  functions, so there is no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.memo import with_once
from ..functions.text import NEWLINE_REGEX, drop_trailing_empty
from .headers import checked_timestamps, is_header, with_header
from .ordinals import DEFAULT_BLOCK

MESSAGE = ["source_path", "source_file", "line_start", "timestamp", "speaker", "text"]


def base_name(path_col):
    return F.element_at(F.split(path_col, "/"), -1)


def assemble_messages(lines: DataFrame, on_bad: str = "fail", block_lines: int = DEFAULT_BLOCK,
                      path_col: str = "source_path") -> DataFrame:
    """Lines ``(source_path, line_no, value)`` -> one row per message.

    Output: ``source_path, source_file, line_start, timestamp, speaker,
    text``.  Lines before a file's first header are dropped (P-2);
    continuation lines, blank ones included, are appended with "\\n".

    Lines move once, by (file, block of ``block_lines``).  Inside a block a
    window finds each line's header and the lines of one header are joined,
    both on that one partitioning.  Only the block's lines before its first
    header and those of its last header (at most two fragments a block) can
    belong to a message that crosses a block's edge; they alone are grouped
    again, by file.  The lines are neither staged nor read twice: both kinds
    of fragments come from the same exchange.
    """
    block = F.floor(F.col("line_no") / F.lit(block_lines)).alias("block")
    parsed = with_header(lines.select(F.col(path_col).alias("source_path"), "line_no", "value"))
    # flat columns, so that every reader of the exchange asks for the same ones
    parsed = parsed.select("source_path", block, "line_no", F.when(F.col("h.is_header"), F.col("line_no")).alias("head"),
                           F.col("h.ts").alias("ts"), F.col("h.speaker").alias("speaker"),
                           F.when(F.col("h.is_header"), F.col("h.text")).otherwise(F.col("value")).alias("part"))
    dealt = parsed.repartition("source_path", "block")
    inside = Window.partitionBy("source_path", "block").orderBy("line_no")
    owned = dealt.withColumn("line_start", F.max("head").over(inside.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("last_head", F.max("head").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part"))), lambda x: x["part"]), "\n")
    fragments = owned.groupBy("source_path", "block", "line_start", "last_head").agg(
        F.min(F.when(F.col("head").isNotNull(), F.struct("ts", "speaker"))).alias("hd"), joined.alias("text"))
    whole = fragments.where(F.col("line_start") < F.col("last_head")).select("source_path", "line_start", "hd", "text")
    edges = fragments.where(F.col("line_start").isNull() | (F.col("line_start") == F.col("last_head")))
    # a block's first fragment belongs to the last header of an earlier block
    earlier = Window.partitionBy("source_path").orderBy("block", F.col("line_start").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    edges = edges.withColumn("owner", F.max("line_start").over(earlier)).where(F.col("owner").isNotNull())
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line_start", "text"))), lambda x: x["text"]), "\n")
    stitched = edges.groupBy("source_path", "owner").agg(F.min("hd").alias("hd"), text.alias("text")) \
        .withColumnRenamed("owner", "line_start").select("source_path", "line_start", "hd", "text")
    where = F.concat(F.col("source_path"), F.lit(" line "), F.col("line_start").cast("string"))
    messages = whole.unionByName(stitched).select(
        "source_path",
        base_name(F.col("source_path")).alias("source_file"),
        F.col("line_start").cast("long").alias("line_start"),
        F.col("hd.ts").alias("__ts"),
        F.col("hd.speaker").alias("speaker"),
        "text",
    )
    return checked_timestamps(messages, where, on_bad).select(MESSAGE)


def parse_export_text(files: DataFrame, on_bad: str = "fail", path_col: str = "source_path",
                      text_col: str = "content") -> DataFrame:
    """Whole files ``(source_path, content)`` -> one row per message, map-only.

    Lines are split with Python's universal-newline rules; header positions
    are found with ``filter`` over the line array and every message takes the
    slice of lines up to the next header.
    """
    idx = F.transform(F.col("__lines"), lambda l, i: F.when(is_header(l), i + 1))
    heads = F.filter(idx, lambda x: x.isNotNull())
    msgs = F.transform(
        F.col("__heads"),
        lambda h, j: F.struct(
            h.alias("line_start"),
            F.get(F.col("__lines"), h - 1).alias("header"),
            F.slice(F.col("__lines"), h + 1,
                    F.coalesce(F.get(F.col("__heads"), j + 1), F.size(F.col("__lines")) + 1) - h - 1).alias("cont"),
        ),
    )
    exploded = (with_once(with_once(files.select(F.col(path_col).alias("source_path"),
                                                 F.split(F.col(text_col), NEWLINE_REGEX, -1).alias("__parts")),
                                    "__lines", drop_trailing_empty(F.col("__parts"))).drop("__parts"),
                          "__heads", heads)
                .select("source_path", F.explode(msgs.alias("m")).alias("m"))
                # Flat columns before the next Generate (nested-field pruning
                # across two Generates loses struct fields).
                .select("source_path", F.col("m.line_start").alias("__start"), F.col("m.header").alias("__header"),
                        F.col("m.cont").alias("__cont")))
    where = F.concat(F.col("source_path"), F.lit(" line "), F.col("line_start").cast("string"))
    with_h = with_header(exploded, "__header", known_header=True)
    messages = with_h.select(
        "source_path",
        base_name(F.col("source_path")).alias("source_file"),
        F.col("__start").cast("long").alias("line_start"),
        F.col("h.ts").alias("__ts"),
        F.col("h.speaker").alias("speaker"),
        F.array_join(F.concat(F.array(F.col("h.text")), F.col("__cont")), "\n").alias("text"),
    )
    return checked_timestamps(messages, where, on_bad).select(MESSAGE)
