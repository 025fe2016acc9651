"""E1 from files: export files -> turns and run counters.

``route="auto"`` reads small files whole (one row each, parsed inside the
row with array functions: no shuffle) and files above ``whole_file_limit``
bytes line by line (split across tasks, messages assembled with a bounded
block window and one grouping).  Both reads filter on file size inside
Spark (``length`` for ``binaryFile``, ``_metadata.file_size`` for text), so
no path list reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators.assemble import assemble_messages, parse_export_text
from ..operators.clean import clean_turns, counter_columns, parse_counters, with_drop_reason
from ..session import materialize
from ..sources.exports import count_input_files, export_files, export_index, read_export_lines, read_exports
from ..sources.sinks import write_turns

WHOLE_FILE_LIMIT = 64 << 20


@dataclass
class ParsedExports:
    input_files: int
    messages: DataFrame
    turns: DataFrame
    counters: DataFrame
    rejects: DataFrame | None = None


def parse_exports(spark: SparkSession, path: str, exclude_speakers=tuple(C.DEFAULT_EXCLUDE_SPEAKERS),
                  drop_system: bool = False, drop_media: bool = False, strip_edits: bool = False,
                  minimal: bool = False, on_bad: str = "fail", route: str = "auto",
                  whole_file_limit: int = WHOLE_FILE_LIMIT) -> ParsedExports:
    """Files -> messages -> kept turns, plus the counters row.  Flags
    default to off.  Minimal turns keep ``source_path`` and ``line_start``, by
    which the sink orders them, and which it does not write.

    ``on_bad``: a header date that does not exist fails the run (``fail``),
    gives a NULL timestamp (``null``), or goes to ``rejects`` and not into
    the turns (``quarantine``)."""
    files = export_files(spark, path)
    n_files = count_input_files(spark, path, files)
    if n_files == 0:
        raise FileNotFoundError(f"No .txt files found under: {path}")
    parts = []
    if route == "whole":
        parts.append(parse_export_text(read_exports(spark, path, files=files), on_bad=on_bad))
    elif route == "lines":
        parts.append(assemble_messages(read_export_lines(spark, path, files=files), on_bad=on_bad))
    elif route == "auto":
        # Small files are read whole through a length filter the binaryFile
        # source pushes down; large ones line by line through a file-size
        # filter on the text scan.  No path list reaches the driver.
        has_big = not export_index(spark, path, files).where(F.col("length") > whole_file_limit).isEmpty()
        parts.append(parse_export_text(
            read_exports(spark, path, max_length=whole_file_limit if has_big else None, files=files), on_bad=on_bad))
        if has_big:
            parts.append(assemble_messages(read_export_lines(spark, path, min_file_size=whole_file_limit, files=files),
                                           on_bad=on_bad))
    else:
        raise ValueError("route must be 'auto', 'whole' or 'lines'")
    messages = parts[0]
    for p in parts[1:]:
        messages = messages.unionByName(p)
    turns = clean_turns(messages, exclude_speakers, drop_system, drop_media, strip_edits, minimal=minimal,
                        keep_path=True)
    rejects = None
    if on_bad == "quarantine":
        rejects = header_rejects(messages)
        good = messages.where(F.col("timestamp").isNotNull())
        turns = clean_turns(good, exclude_speakers, drop_system, drop_media, strip_edits, minimal=minimal, keep_path=True)
    counters = parse_counters(messages, n_files, exclude_speakers, drop_system, drop_media, strip_edits)
    return ParsedExports(n_files, messages, turns, counters, rejects)


def write_parsed(messages: DataFrame, out_dir: str, input_files: int | None = None,
                 exclude_speakers=tuple(C.DEFAULT_EXCLUDE_SPEAKERS), drop_system: bool = False, drop_media: bool = False,
                 strip_edits: bool = False, minimal: bool = False) -> DataFrame:
    """Writes the kept turns (S-7) and returns the counters row (A-3) of that
    same run: the messages are parsed and classified once.

    The counters are metrics observed on the rows as they are staged.  The
    staging is a plain write without a shuffle behind the metrics, so each
    task's rows count once, however often a task runs; the sorted output is
    written from the staged rows."""
    tagged = with_drop_reason(messages, exclude_speakers, drop_system, drop_media, strip_edits)
    seen = Observation()
    staged = materialize(tagged.observe(seen, *counter_columns()), "tagged")
    kept = staged.where(F.col("drop_reason").isNull()).withColumn("text", F.col("clean_text"))
    write_turns(kept, out_dir, minimal=minimal)
    if input_files is None:
        input_files = staged.select("source_path").distinct().count()
    found = {"input_files": input_files, **seen.get}
    return messages.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


def header_rejects(messages: DataFrame) -> DataFrame:
    """Messages parsed with ``on_bad='quarantine'`` whose header date does
    not exist."""
    return messages.where(F.col("timestamp").isNull()).select("source_path", "line_start", "speaker", "text")
