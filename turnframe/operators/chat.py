"""Inference-side tables: F-14 .. F-17, F-20, F-22, W-8, P-13.

A transcript is a table ``(transcript_id, line_no, line)`` of non-blank
lines (D13), built from text pieces ``(transcript_id, seq, text)`` (a
whole file is one piece).  Prompts, the last-k view, live-line tagging and
appending generated text are all column expressions and aggregations over
that table; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.memo import with_once
from ..functions.text import SPLITLINES_REGEX, drop_trailing_empty, split_lines, strip
from .examples import chat_message, user_content
from .ordinals import running_before

PIECE_BLOCK = 1 << 12
LINE_BLOCK = 1 << 12


def _nonblank(arr: Column) -> Column:
    return F.filter(arr, lambda x: F.length(strip(x)) > 0)


def _piece_lines(pieces: DataFrame, id_col: str, seq_col: str, text_col: str) -> DataFrame:
    """Pieces with their kept lines and how many there are."""
    p = with_once(pieces.select(F.col(id_col).alias("transcript_id"), F.col(seq_col).alias("seq"),
                                F.col(text_col).alias("__text")),
                  "__parts", F.split(F.col("__text"), SPLITLINES_REGEX, -1))
    p = with_once(p.select("transcript_id", "seq", "__parts"), "lines",
                  _nonblank(drop_trailing_empty(F.col("__parts")))).drop("__parts")
    return p.withColumn("cnt", F.size("lines"))


def line_counts(pieces: DataFrame, id_col: str = "transcript_id", seq_col: str = "seq", text_col: str = "text") -> DataFrame:
    """``(transcript_id, last)``: the number of context lines, counted in the
    pieces without exploding them."""
    return _piece_lines(pieces, id_col, seq_col, text_col).groupBy("transcript_id").agg(F.sum("cnt").alias("last"))


def context_lines(pieces: DataFrame, id_col: str = "transcript_id", seq_col: str = "seq",
                  text_col: str = "text", last: int | None = None) -> DataFrame:
    """Pieces -> ``(transcript_id, line_no, line)``: ``str.splitlines()``,
    blank lines dropped, kept lines *not* stripped, ``line_no`` dense from 1
    in (piece, position) order.  The in-piece rank comes from filtering the
    line array; the offset of a piece is a running sum of line counts over
    the (small) piece table.  ``last`` keeps a transcript's last lines only:
    its total is known from that table, so earlier lines are cut off before
    the explode."""
    p = _piece_lines(pieces, id_col, seq_col, text_col)
    p = running_before(p, ["transcript_id"], F.floor(F.col("seq") / F.lit(PIECE_BLOCK)), [F.col("seq")],
                       F.col("cnt"), "offset", how="sum", total="n_lines" if last is not None else None)
    if last is not None:
        skip = F.greatest(F.lit(0), F.col("n_lines") - F.lit(last) - F.col("offset"))  # of this piece's lines
        p = p.where(skip < F.col("cnt")).withColumn("skip", skip.cast("int"))
        p = p.withColumn("lines", F.slice("lines", F.col("skip") + 1, F.col("cnt"))) \
            .withColumn("offset", F.col("offset") + F.col("skip"))
    return p.select("transcript_id", "offset", F.posexplode("lines").alias("pos", "line")).select(
        "transcript_id", (F.col("offset") + F.col("pos") + 1).cast("long").alias("line_no"), "line")


def transcript_text(lines: DataFrame, transcripts: DataFrame | None = None,
                    seed_line: str | None = None) -> DataFrame:
    """``(transcript_id, transcript)``: lines joined by "\\n" in order.

    Two-level: a partial string per block of ``LINE_BLOCK`` lines (the
    per-line work stays spread out), then the block strings in order.
    ``transcripts`` lists every id so that empty transcripts appear (with
    NULL); ``seed_line``, when non-blank, is the context of an empty one
    (autogen mode)."""
    blk = F.floor(F.col("line_no") / F.lit(LINE_BLOCK))
    partial = lines.groupBy("transcript_id", blk.alias("blk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]),
                     "\n").alias("part"))
    full = partial.groupBy("transcript_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("blk", "part"))), lambda x: x["part"]),
                     "\n").alias("transcript"))
    if transcripts is not None:
        full = transcripts.select("transcript_id").join(full, on="transcript_id", how="left")
    if seed_line is not None and seed_line.strip():
        full = full.withColumn("transcript", F.coalesce(F.col("transcript"), F.lit(seed_line.strip())))
    return full


def inference_prompt(transcript: Column, speaker: str | None = None) -> Column:
    """F-14: strip the joined transcript, ``(empty)`` if blank, then the
    prompt layout; a falsy speaker means no ``TARGET_SPEAKER`` line."""
    t = strip(F.coalesce(transcript, F.lit("")))
    t = F.when(F.length(t) == 0, F.lit(C.EMPTY_TRANSCRIPT)).otherwise(t)
    return user_content(t, F.lit(speaker) if speaker else None)


def inference_prompts(lines: DataFrame, transcripts: DataFrame | None = None, speaker: str | None = None,
                      seed_line: str | None = None) -> DataFrame:
    """F-14, F-15, F-20: ``(transcript_id, messages)`` with the fixed
    system message (not overridable here, as in the reference) and the
    user prompt; no assistant message."""
    full = transcript_text(lines, transcripts, seed_line)
    msgs = F.array(chat_message("system", F.lit(C.DEFAULT_SYSTEM_PROMPT)),
                   chat_message("user", inference_prompt(F.col("transcript"), speaker)))
    return full.select("transcript_id", msgs.alias("messages"))


def tag_live_line(line: Column) -> Column:
    """F-17: strip; NULL if blank; keep if it holds ':', else ``You: ``."""
    s = strip(line)
    return F.when(F.length(s) == 0, F.lit(None).cast("string")).when(
        F.instr(s, ":") > 0, s).otherwise(F.concat(F.lit(C.LIVE_LINE_PREFIX), s))


def tag_lines(df: DataFrame, line_col: str = "line") -> DataFrame:
    """Live input lines -> tagged context lines (blank ones dropped)."""
    return df.withColumn(line_col, tag_live_line(F.col(line_col))).where(F.col(line_col).isNotNull())


def generated_lines(generated: DataFrame, lines: DataFrame | None = None, id_col: str = "transcript_id",
                    text_col: str = "generated", round_col: str | None = None,
                    counts: DataFrame | None = None) -> DataFrame:
    """F-22: generated text -> new context lines appended after each
    transcript's last line: ``str.splitlines()``, each stripped, blank ones
    dropped, numbered after the existing lines (and after earlier rounds
    when ``round_col`` orders several generations per transcript; without it
    a transcript must have one).  The transcripts' lines come as ``lines``, or
    only their number as ``counts`` (see ``line_counts``)."""
    new = F.filter(F.transform(split_lines(F.col(text_col)), lambda x: strip(x)), lambda x: F.length(x) > 0)
    g = generated.select(F.col(id_col).alias("transcript_id"),
                         (F.col(round_col) if round_col else F.lit(0)).alias("round"), new.alias("new"))
    g = g.withColumn("cnt", F.size("new"))
    g = running_before(g, ["transcript_id"], F.floor(F.col("round") / F.lit(PIECE_BLOCK)), [F.col("round")],
                       F.col("cnt"), "before", how="sum")
    if counts is None:
        counts = lines.groupBy("transcript_id").agg(F.max("line_no").alias("last"))
    g = g.join(counts, on="transcript_id", how="left")
    base = F.coalesce(F.col("last"), F.lit(0)) + F.col("before")
    return g.select("transcript_id", base.alias("base"), F.posexplode("new").alias("pos", "line")).select(
        "transcript_id", (F.col("base") + F.col("pos") + 1).cast("long").alias("line_no"), "line")


def transcript_tail(lines: DataFrame, k: int = C.DEFAULT_TAIL_LINES) -> DataFrame:
    """W-8: the last ``k`` lines of every transcript, from its numbered
    lines: a per-transcript maximum (a partial aggregation) and a filter.
    From pieces, ``context_lines(pieces, last=k)`` needs no second read."""
    last = lines.groupBy("transcript_id").agg(F.max("line_no").alias("__last"))
    return (lines.join(last, on="transcript_id", how="inner")
            .where(F.col("line_no") > F.col("__last") - F.lit(k)).drop("__last"))
