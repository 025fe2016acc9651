"""E1 and E2 as Spark plans: export lines -> turns -> indexed timeline ->
windows -> examples with a split, plus the run statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import checks
from ..functions import constants as C
from ..functions.text import is_blank, strip
from ..operators.assemble import assemble_messages
from ..operators.clean import clean_turns
from ..operators.examples import build_examples, split_sizes, split_examples, split_label, split_stats
from ..operators.turns import turn_index_with_count
from ..operators.windows import DEFAULT_PAYLOAD, count_windows, layout, layout_columns


def export_turns(lines: DataFrame, exclude_speakers=tuple(C.DEFAULT_EXCLUDE_SPEAKERS), drop_system=True,
                 drop_media=True, strip_edits=True, on_bad: str = "fail") -> DataFrame:
    """E1: export lines -> kept turn records (with ``source_path`` for the
    tie-break of same-named files).  Defaults are the README's flags."""
    messages = assemble_messages(lines, on_bad=on_bad)
    return clean_turns(messages, exclude_speakers, drop_system, drop_media, strip_edits, keep_path=True)


def path_order(col: str = "source_path"):
    """Python orders paths by components, Spark by whole string."""
    return F.split(F.col(col), "/")


def input_order(columns: list[str]) -> list:
    """What orders turns that are equal on time, file name and line: the
    path of their export, or the file and line they were read from."""
    if "source_path" in columns:
        return [path_order()]
    if "input_line" in columns:
        return ([path_order("input_file")] if "input_file" in columns else []) + ["input_line"]
    raise ValueError("turns need source_path or input_line to order equal times; pass tiebreak=[...] (or [] if none are equal)")


@dataclass
class Dataset:
    indexed: DataFrame
    n: int | None
    windows: DataFrame
    examples: DataFrame
    stats: DataFrame
    rejects: DataFrame | None = None


def key_rejects(turns: DataFrame, keys: list[str], chunk_turns: int, stride: int, min_turns: int, val_ratio: float,
                test_ratio: float) -> DataFrame:
    """V-4, V-5 of per-key datasets: ``(keys, reason)`` of the keys without a
    valid turn, an example or a training row.  One aggregate a key, counted in
    part before it moves; the rest follows from its length."""
    n = turns.groupBy(*keys).agg(F.count_if(~is_blank(F.col("text"))).alias("n"))
    examples = layout_columns(F.col("n"), chunk_turns, stride, min_turns)["windows"]
    train_n, _, _ = split_sizes(F.col("examples"), val_ratio, test_ratio)
    reason = (F.when(F.col("n") == 0, "no turns").when(F.col("examples") == 0, "no examples").when(train_n <= 0, "no training rows"))
    return n.withColumn("examples", examples).withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*keys, "reason")


def build_dataset(turns: DataFrame, chunk_turns: int = C.DEFAULT_CHUNK_TURNS,
                  prompt_turns: int = C.DEFAULT_PROMPT_TURNS, stride: int = C.DEFAULT_STRIDE,
                  min_turns: int = C.DEFAULT_MIN_TURNS, val_ratio: float = C.DEFAULT_VAL_RATIO,
                  test_ratio: float = C.DEFAULT_TEST_RATIO, system_prompt: str = C.DEFAULT_SYSTEM_PROMPT,
                  include_metadata: bool = False, speaker_control: bool = False,
                  tiebreak=None, partition_by: list[str] | None = None,
                  dataset_checks: bool = True) -> Dataset:
    """E2: turns -> examples with ``split``.

    Steps: drop blank turns (the turn reader already does for JSON input),
    index the timeline (range-partitioned ordinal, materialised; its row
    count is the timeline length), build windows with one shuffle
    (``operators.windows.count_windows``), build messages with array
    functions, label splits from the closed-form example count.
    ``dataset_checks`` refuses an input without turns or examples (from the
    known length, no extra job); off, it gives empty examples.  With
    ``partition_by``, ``rejects`` names the keys that have none.
    """
    checks.check_settings(val_ratio, test_ratio, chunk_turns=chunk_turns, prompt_turns=prompt_turns, stride=stride,
                          min_turns=min_turns)
    keys = list(partition_by or [])
    given = turns
    # The reference re-reads turns: blank texts are dropped, fields stripped.
    turns = (turns.where(~is_blank(F.col("text")))
             .withColumn("speaker", strip(F.col("speaker"))).withColumn("text", strip(F.col("text"))))
    if tiebreak is None:
        tiebreak = input_order(turns.columns)
    indexed, total = turn_index_with_count(turns, tiebreak=tiebreak, partition_by=keys)
    stats = split_stats(indexed, chunk_turns, prompt_turns, stride, min_turns, speaker_control,
                        val_ratio, test_ratio, partition_by=keys)
    if keys:
        windows = count_windows(indexed, chunk_turns, stride, min_turns, partition_by=keys, payload=DEFAULT_PAYLOAD)
        ex = build_examples(windows, prompt_turns, system_prompt, speaker_control, include_metadata,
                            keep=keys + ["timeline_turns"])
        # Split sizes per key follow from the key's timeline length: no join.
        total = layout_columns(F.col("timeline_turns"), chunk_turns, stride, min_turns)["windows"]
        train_n, val_n, _ = split_sizes(total, val_ratio, test_ratio)
        ex = ex.withColumn("split", split_label(F.col("chunk_index"), train_n, val_n)).drop("timeline_turns")
        rejects = key_rejects(given, keys, chunk_turns, stride, min_turns, val_ratio, test_ratio)
        return Dataset(indexed, None, windows, ex, stats, rejects)
    n = total
    if dataset_checks:
        checks.check_sizes(n, layout(n, chunk_turns, stride, min_turns).windows)
    windows = count_windows(indexed, chunk_turns, stride, min_turns, n=n)
    ex = build_examples(windows, prompt_turns, system_prompt, speaker_control, include_metadata)
    ex = split_examples(ex, n, chunk_turns, stride, min_turns, val_ratio, test_ratio)
    return Dataset(indexed, n, windows, ex, stats)
