"""W-3 .. W-6, U-2, A-6: overlapping fixed-count windows over the timeline.

Definition (the reference): starts ``0, s, 2s, ...`` while ``start <= n - min``;
each window is ``turns[start:start+chunk]`` and is kept if it has at least
``min`` turns; then one extra window at ``max(0, n - chunk)`` if that start
was not produced, emitted last.  Nothing at all when ``n < min``.

Closed form used here (checked against the definition in the tests):
``n < min or chunk < min`` -> none.  ``K = (n - min) div stride``; regular
windows ``k = 0..K`` start at ``k*stride`` with ``min(chunk, n - start)``
turns; the tail window ``k = K + 1`` starts at ``n - chunk`` with ``chunk``
turns iff ``n > chunk and (n - chunk) mod stride != 0``.  Turn ``i`` lies
in regular windows ``max(0, ceil((i - chunk + 1) / stride)) .. min(K, i div
stride)`` and in the tail iff ``i >= n - chunk``.

Two plans with the same result (``method``):

* ``"frames"`` (default): turns are grouped by ``idx div stride`` (a window
  starts at a group boundary and spans ``H = (chunk - 1) div stride + 1``
  groups).  Rows are hash-partitioned once by a block of groups; the first
  ``H - 1`` groups of each block are also copied to the previous block,
  which needs them for its last windows.  Inside a partition, groups are
  collected and a bounded window frame (``ROWS 0 .. H-1 FOLLOWING``)
  assembles each window.  About one copy of the turns is shuffled; blocks
  have a bounded size whatever the skew.
* ``"explode"``: every turn is exploded to the ids of the windows holding
  it (about ``chunk / stride`` copies) and grouped by window id (groups of
  at most ``chunk`` rows, map-side partial aggregation).

The tail window is one group of ``chunk`` turns.  ``n`` is a single number
(or one per key).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions

DEFAULT_PAYLOAD = ["timestamp", "speaker", "text", "source_file"]


@dataclass(frozen=True)
class Layout:
    n: int
    regular: int  # K + 1, or 0
    tail: bool

    @property
    def windows(self) -> int:
        return self.regular + int(self.tail)


def layout(n: int, chunk: int, stride: int, min_turns: int) -> Layout:
    if n < min_turns or chunk < min_turns:
        return Layout(n, 0, False)
    k = (n - min_turns) // stride
    tail = n > chunk and (n - chunk) % stride != 0
    return Layout(n, k + 1, tail)


def _div(a: Column, b: int) -> Column:
    """Exact integer division for a >= 0 (Spark's ``div``)."""
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")


def layout_columns(n: Column, chunk: int, stride: int, min_turns: int) -> dict[str, Column]:
    """The closed form as columns of a per-timeline ``n``."""
    valid = (n >= F.lit(min_turns)) & F.lit(chunk >= min_turns)
    k = _div(n - F.lit(min_turns), stride)
    tail = valid & (n > F.lit(chunk)) & (F.pmod(n - F.lit(chunk), F.lit(stride)) != 0)
    windows = F.when(valid, k + 1 + tail.cast("long")).otherwise(F.lit(0).cast("long"))
    return {"valid": valid, "K": k, "tail": tail, "windows": windows}


def window_members(indexed: DataFrame, n: Column | int, chunk: int, stride: int, min_turns: int,
                   idx_col: str = "turn_idx") -> DataFrame:
    """One row per (window, member turn): adds ``chunk_index``."""
    n_col = F.lit(n).cast("long") if isinstance(n, int) else n
    lay = layout_columns(n_col, chunk, stride, min_turns)
    i = F.col(idx_col)
    lo_raw = i - F.lit(chunk - 1)
    lo = F.when(lo_raw <= 0, F.lit(0).cast("long")).otherwise(_div(lo_raw + F.lit(stride - 1), stride))
    hi = F.least(lay["K"], _div(i, stride))
    empty = F.array().cast("array<bigint>")
    regular = F.when(lay["valid"] & (lo <= hi), F.sequence(lo, hi)).otherwise(empty)
    tail = F.when(lay["tail"] & (i >= n_col - F.lit(chunk)), F.array(lay["K"] + 1)).otherwise(empty)
    return indexed.withColumn("chunk_index", F.explode(F.concat(regular, tail)))


def timeline_lengths(indexed: DataFrame, partition_by: list[str] | None) -> tuple[DataFrame, Column | int]:
    """``(indexed, n)``: ``n`` is an int for one timeline (one aggregate
    number), or the column ``__n`` joined per key (one row per key, a
    partial aggregation)."""
    keys = list(partition_by or [])
    if not keys:
        return indexed, indexed.count()
    lengths = indexed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return indexed.join(lengths, on=keys, how="inner"), F.col("__n")


def count_windows(indexed: DataFrame, chunk: int, stride: int, min_turns: int,
                  partition_by: list[str] | None = None, payload: list[str] = DEFAULT_PAYLOAD,
                  idx_col: str = "turn_idx", n: int | None = None, method: str = "frames",
                  block_turns: int | None = None) -> DataFrame:
    """Windows ``(*partition_by, chunk_index, start_turn_index, n_turns,
    turns)`` where ``turns`` is ``array<struct<turn_idx, *payload>>`` in
    timeline order.  Pass ``n`` when the timeline length is already known."""
    keys = list(partition_by or [])
    if keys and "timeline_turns" in indexed.columns:
        indexed, n = indexed.withColumnRenamed("timeline_turns", "__n"), F.col("__n")
    elif keys or n is None:
        indexed, n = timeline_lengths(indexed, keys)
    member = F.struct(F.col(idx_col).alias("turn_idx"), *[F.col(c) for c in payload])
    extra = [] if isinstance(n, int) else ["__n"]
    base = indexed.select(*keys, idx_col, *payload, *extra)
    if method == "explode":
        exploded = window_members(base, n, chunk, stride, min_turns, idx_col)
        aggs = [F.collect_list(member).alias("turns")] + ([F.max("__n").alias("__n")] if extra else [])
        grouped = exploded.groupBy(*keys, "chunk_index").agg(*aggs)
    elif method == "frames":
        grouped = _frames(base, member, n, chunk, stride, min_turns, keys, idx_col, block_turns)
    else:
        raise ValueError("method must be 'frames' or 'explode'")
    # Frames are already in order (sorted groups collected in group order);
    # exploded members arrive in any order.
    turns = F.array_sort("turns") if method == "explode" else F.col("turns")
    # Per-key timelines keep their length, from which the split sizes follow.
    length = [F.col("__n").cast("long").alias("timeline_turns")] if extra else []
    return grouped.select(
        *keys, "chunk_index",
        F.element_at(turns, 1)["turn_idx"].alias("start_turn_index"),
        F.size(turns).cast("long").alias("n_turns"),
        turns.alias("turns"),
        *length,
    )


def _frames(base: DataFrame, member: Column, n: Column | int, chunk: int, stride: int, min_turns: int,
            keys: list[str], idx_col: str, block_turns: int | None) -> DataFrame:
    """``(*keys, chunk_index, turns)`` with one shuffle of the turns."""
    n_col = F.lit(n).cast("long") if isinstance(n, int) else F.col("__n")
    lay = layout_columns(n_col, chunk, stride, min_turns)
    h = (chunk - 1) // stride + 1                     # groups spanned by a window
    if block_turns is None:
        # Enough blocks to spread over the cores when n is known, at most
        # 2^16 turns per block, and at least 8 windows' worth of groups so
        # the halo copies stay under 1/8 of the rows.
        parts = shuffle_partitions(base.sparkSession)
        want = -(-n // (4 * parts)) if isinstance(n, int) else 1 << 16
        groups_per_block = max(8 * h, -(-min(1 << 16, max(want, 1)) // stride))
    else:
        groups_per_block = max(h, -(-block_turns // stride))
    i = F.col(idx_col)
    g = _div(i, stride)
    blk = _div(g, groups_per_block)
    # A turn is in some regular window only if it lies in the first `chunk`
    # turns of its group (matters when stride > chunk).
    regular_member = lay["valid"] & (i - g * F.lit(stride) < F.lit(chunk)) & (g <= lay["K"] + F.lit(h - 1))
    halo = (F.pmod(g, F.lit(groups_per_block)) < F.lit(h - 1)) & (blk > 0)
    tail_member = lay["tail"] & (i >= n_col - F.lit(chunk))
    target = lambda b, grp: F.array(F.struct(b.cast("long").alias("b"), grp.cast("long").alias("g")))
    none = F.array().cast("array<struct<b:bigint,g:bigint>>")
    # One scan: each turn goes to its own block, to the previous block if
    # that block's last windows need it, and to block -1 (the tail window).
    targets = F.concat(
        F.when(regular_member, target(blk, g)).otherwise(none),
        F.when(regular_member & halo, target(blk - 1, g)).otherwise(none),
        F.when(tail_member, target(F.lit(-1), lay["K"] + 1)).otherwise(none),
    )
    rows = base.select(*keys, F.explode(targets).alias("__t"), member.alias("__m"), lay["K"].alias("__K"),
                       n_col.alias("__n"))
    rows = rows.select(*keys, F.col("__t.b").alias("__blk"), F.col("__t.g").alias("__g"), "__m", "__K", "__n")
    groups = rows.repartition(*keys, "__blk").groupBy(*keys, "__blk", "__g").agg(
        F.array_sort(F.collect_list("__m")).alias("__ga"), F.max("__K").alias("__K"), F.max("__n").alias("__n"))
    frame = Window.partitionBy(*keys, "__blk").orderBy("__g").rowsBetween(0, h - 1)
    framed = groups.withColumn("__frame", F.collect_list("__ga").over(frame))
    own = (F.col("__blk") == -1) | ((_div(F.col("__g"), groups_per_block) == F.col("__blk"))
                                    & (F.col("__g") <= F.col("__K")))
    return framed.where(own).select(*keys, F.col("__g").alias("chunk_index"),
                                    F.slice(F.flatten("__frame"), 1, chunk).alias("turns"), "__n")
