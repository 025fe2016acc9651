"""Structured Streaming entry for E1: export files arriving in a folder
become turn records.

The parse stages hold no state across files, so each new file is read
whole (``wholetext``: one row per file, BOM kept) and parsed inside its row
with the same array-function parser as the batch whole-file route.  The
timeline, windows and split need the final number of turns and stay batch
(``plans.dataset.build_dataset`` over the sink's output).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import constants as C
from ..operators.assemble import parse_export_text
from ..operators.clean import FULL_COLUMNS, MINIMAL_COLUMNS, counter_columns, with_drop_reason
from ..plans.exports import header_rejects
from ..session import materialize
from ..sources.exports import metadata_path


def stream_export_messages(spark: SparkSession, in_dir: str, on_bad: str = "fail",
                           max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming messages (with ``drop_reason`` not yet applied) from the
    ``*.txt`` files below ``in_dir``, with the batch reader's defaults."""
    return parse_export_text(stream_export_files(spark, in_dir, max_files_per_trigger), on_bad=on_bad)


def stream_export_files(spark: SparkSession, in_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """One streaming row per export file: ``(source_path, content)``."""
    reader = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.text(in_dir, wholetext=True)
    return raw.select(metadata_path().alias("source_path"), F.make_valid_utf8(F.col("value")).alias("content"))


def running_file_count(files: DataFrame) -> DataFrame:
    """Streaming count of the export files (one row reaches it per file, so
    it is exact); the other counters are ``running_counters``."""
    return files.agg(F.count(F.lit(1)).alias("input_files"))


def stream_export_turns(spark: SparkSession, in_dir: str, exclude_speakers=tuple(C.DEFAULT_EXCLUDE_SPEAKERS),
                        drop_system: bool = False, drop_media: bool = False, strip_edits: bool = False,
                        minimal: bool = False, on_bad: str = "fail") -> DataFrame:
    """Streaming kept turns; stateless, so append mode needs no watermark."""
    msgs = stream_export_messages(spark, in_dir, on_bad)
    if on_bad == "quarantine":  # start_turns_stream writes the others as rejects
        msgs = msgs.where(F.col("timestamp").isNotNull())
    return _kept(msgs, exclude_speakers, drop_system, drop_media, strip_edits, minimal)


def _kept(messages: DataFrame, exclude_speakers=tuple(C.DEFAULT_EXCLUDE_SPEAKERS), drop_system: bool = False, drop_media: bool = False,
          strip_edits: bool = False, minimal: bool = False) -> DataFrame:
    tagged = with_drop_reason(messages, exclude_speakers, drop_system, drop_media, strip_edits)
    kept = tagged.where(F.col("drop_reason").isNull()).withColumn("text", F.col("clean_text"))
    cols = MINIMAL_COLUMNS if minimal else FULL_COLUMNS + ["source_path"]
    return kept.select(*cols)


def write_turns_and_rejects(files: DataFrame, batch_id: int, out_dir: str, rejects_dir: str, **flags) -> None:
    """One micro-batch of export files into both sinks: the kept turns, and
    the messages whose header date does not exist.  Each goes to a folder
    named by the batch, which a batch that runs again overwrites."""
    messages = materialize(parse_export_text(files, on_bad="quarantine"), "stream-messages")
    name = f"batch-{batch_id:010d}"
    _kept(messages.where(F.col("timestamp").isNotNull()), **flags).write.mode("overwrite").json(f"{out_dir}/{name}")
    header_rejects(messages).write.mode("overwrite").json(f"{rejects_dir}/{name}")


def start_turns_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                       available_now: bool = True, rejects_dir: str | None = None, **flags) -> StreamingQuery:
    """Write turns as JSON files; ``checkpoint`` must be a shared folder
    (exactly-once file sink).  ``available_now`` processes what is there
    and stops.  With ``on_bad='quarantine'`` every micro-batch is parsed once
    and written to two sinks, a folder a batch (read them with
    ``recursiveFileLookup``); ``rejects_dir`` defaults to ``<out_dir>-rejects``."""
    if flags.get("on_bad") == "quarantine":
        rest = {k: v for k, v in flags.items() if k != "on_bad"}
        rejects = rejects_dir or out_dir.rstrip("/") + "-rejects"
        writer = stream_export_files(spark, in_dir).writeStream.foreachBatch(
            lambda files, batch_id: write_turns_and_rejects(files, batch_id, out_dir, rejects, **rest))
    else:
        writer = stream_export_turns(spark, in_dir, **flags).writeStream.format("json").option("path", out_dir)
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def running_counters(messages: DataFrame, **flags) -> DataFrame:
    """Streaming A-3: the message counters as a running aggregate (complete
    mode); files are counted by ``running_file_count``."""
    tagged = with_drop_reason(messages, **flags)
    return tagged.agg(*counter_columns())
