"""P-3 .. P-8, A-3: exclude speakers, clean and classify message text.

Rule order is the reference's: speaker exclusion first, then system text,
then media placeholders; classification looks at the text after strip and
(optional) edit-marker removal.  Each rule sits behind its own flag and the
flags default to off, as in the reference's command line; ``README_FLAGS``
is the setting its README uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.memo import memo_expr
from ..functions.text import is_media_placeholder, is_system_text, strip, strip_edit_marker

README_FLAGS = dict(drop_system=True, drop_media=True, strip_edits=True)

FULL_COLUMNS = ["timestamp", "speaker", "text", "source_file", "line_start"]
MINIMAL_COLUMNS = ["speaker", "text"]


def clean_text(text, strip_edits: bool):
    t = strip(text)
    return strip_edit_marker(t) if strip_edits else t


def with_drop_reason(messages: DataFrame, exclude_speakers=tuple(C.DEFAULT_EXCLUDE_SPEAKERS),
                     drop_system: bool = False, drop_media: bool = False,
                     strip_edits: bool = False) -> DataFrame:
    """Adds ``clean_text`` and ``drop_reason`` (NULL = kept,
    'speaker' | 'system' | 'media')."""
    names = tuple(exclude_speakers or ())
    ct = memo_expr(("clean_text", strip_edits), lambda: clean_text(F.col("text"), strip_edits))
    reason = memo_expr(("drop_reason", names, drop_system, drop_media),
                       lambda: drop_reason(names, drop_system, drop_media))
    # clean_text is produced by a one-element explode: the optimizer neither
    # inlines it into later projections nor pushes filters that use it below
    # it, so the strip and edit-marker work runs once per message instead of
    # once per rule and anchor.
    cols = [c for c in messages.columns if c != "clean_text"]
    once = messages.select(*cols, F.explode(F.array(ct)).alias("clean_text"))
    return once.withColumns({"drop_reason": reason})


def drop_reason(names, drop_system: bool, drop_media: bool):
    """First rule wins: speaker, then system text, then media placeholder
    (on ``clean_text``); NULL when kept."""
    rules = []
    if names:
        rules.append((F.col("speaker").isin(list(names)), "speaker"))
    if drop_system:
        rules.append((is_system_text(F.col("clean_text")), "system"))
    if drop_media:
        rules.append((is_media_placeholder(F.col("clean_text")), "media"))
    if not rules:
        return F.lit(None).cast("string")
    expr = F.when(rules[0][0], F.lit(rules[0][1]))
    for cond, name in rules[1:]:
        expr = expr.when(cond, F.lit(name))
    return expr


def clean_turns(messages: DataFrame, exclude_speakers=tuple(C.DEFAULT_EXCLUDE_SPEAKERS),
                drop_system: bool = False, drop_media: bool = False, strip_edits: bool = False,
                minimal: bool = False, keep_path: bool = False) -> DataFrame:
    """Kept messages as turn records (D3), or ``speaker, text`` when
    ``minimal`` (D4).  ``keep_path`` also keeps ``source_path`` (needed to
    order same-named files from different folders)."""
    tagged = with_drop_reason(messages, exclude_speakers, drop_system, drop_media, strip_edits)
    kept = tagged.where(F.col("drop_reason").isNull()).withColumn("text", F.col("clean_text"))
    cols = MINIMAL_COLUMNS if minimal else FULL_COLUMNS
    if keep_path:
        cols = cols + (["source_path", "line_start"] if minimal else ["source_path"])
    return kept.select(*cols)


def parse_counters(messages: DataFrame, input_files=None, exclude_speakers=tuple(C.DEFAULT_EXCLUDE_SPEAKERS),
                   drop_system: bool = False, drop_media: bool = False,
                   strip_edits: bool = False) -> DataFrame:
    """One row: ``input_files, raw_messages, dropped_speaker, dropped_system,
    dropped_media, written`` (the reference's counters) and
    ``bad_timestamps``.  ``input_files`` is the number of listed files
    (an empty file still counts); without it, distinct paths seen in
    ``messages`` are counted."""
    tagged = with_drop_reason(messages, exclude_speakers, drop_system, drop_media, strip_edits)
    if input_files is None:
        files = F.count_distinct("source_path")
    elif isinstance(input_files, int):
        # The file listing is driver metadata already; its size is one number.
        files = F.lit(input_files)
    else:
        files = F.lit(input_files.count())
    return tagged.agg(files.cast("long").alias("input_files"), *counter_columns())


def counter_columns() -> list:
    """The message counters as aggregates over rows with ``drop_reason``."""
    r = F.col("drop_reason")
    return [
        F.count(F.lit(1)).alias("raw_messages"),
        F.count_if(r == "speaker").alias("dropped_speaker"),
        F.count_if(r == "system").alias("dropped_system"),
        F.count_if(r == "media").alias("dropped_media"),
        F.count_if(r.isNull()).alias("written"),
        # Header dates the reference could not parse.  Evaluating the
        # timestamp here also fails the run under on_bad='fail', as a bad
        # date aborts the reference.
        F.count_if(F.col("timestamp").isNull()).alias("bad_timestamps"),
    ]
