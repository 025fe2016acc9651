"""Ordinals and running values without a window over a whole key.

A window partitioned by a file or conversation puts the whole key into one
task; a window without a partition puts everything into one task.  Both
fail when one key holds a large share of the rows.  The helpers here split
the order into bounded blocks, aggregate per block (map-side combined),
carry a running value over the small block table and finish with a window
whose partitions are single blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, partitions_for

DEFAULT_BLOCK = 1 << 16

def running_before(df: DataFrame, keys: list[str], block: Column, order: list[Column | str],
                   value: Column, out: str, how: str = "sum", inclusive: bool = False,
                   total: str | None = None) -> DataFrame:
    """Add ``out`` = aggregate (``sum`` or ``max``)
    of ``value`` over the rows of the same ``keys`` that come before this
    row in ``order`` (and the row itself when ``inclusive``).

    ``block`` must be a monotone coarsening of ``order`` (for example
    ``line_no div 65536``) so that a block has a bounded number of rows.
    Empty results are NULL for max and 0 for sum.  ``total`` names a column
    for the aggregate over all rows of the keys (from the block table, too).

    One shuffle of the rows (by key and block) for the in-block window;
    block totals are a partial aggregation of the same input (it is read
    twice, so callers stage expensive inputs first); the running value over
    earlier blocks is a window over the small block table.
    """
    if how not in ("sum", "max"):
        raise ValueError("how must be 'sum' or 'max'")
    agg = F.sum if how == "sum" else F.max
    blk, val = "__blk", "__val"
    base = df.withColumn(blk, block).withColumn(val, value)
    w_in = Window.partitionBy(*keys, blk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = base.groupBy(*keys, blk).agg(agg(val).alias("__tot"))
    base = base.withColumn("__inc", agg(val).over(w_in))
    w_blk = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn("__carry", agg("__tot").over(w_blk))
    if total:
        carry = carry.withColumn(total, agg("__tot").over(Window.partitionBy(*keys)))
    carry = carry.drop("__tot")
    joined = base.join(carry, on=[*keys, blk], how="left")
    if how == "max":
        mine = F.col("__inc") if inclusive else None
        if mine is None:
            raise ValueError("exclusive max is not supported")
        res = F.greatest(F.col("__carry"), mine)
    else:
        mine = F.coalesce(F.col("__inc"), F.lit(0))
        if not inclusive:
            mine = mine - F.coalesce(F.col(val), F.lit(0))
        res = F.coalesce(F.col("__carry"), F.lit(0)) + mine
    return joined.withColumn(out, res).drop(blk, val, "__inc", "__carry")


# Above this many range partitions the offsets are joined as a broadcast
# table instead of being inlined as a literal array.
INLINE_OFFSETS_MAX = 8192


def global_ordinal(df: DataFrame, order: list[Column | str], out: str,
                   num_partitions: int | None = None, label: str = "ordinal",
                   uniform: Column | None = None) -> tuple[DataFrame, int]:
    """``(df with out, row count)``: 0-based position of each row in the
    total order ``order`` (which must be unique, i.e. end with
    tie-breakers), without a single-partition sort.

    Range-partition on the full order key (balanced even when one leading
    value holds a third of the rows, because the key is unique), sort inside
    partitions, tag rows with ``monotonically_increasing_id`` (partition id
    in the high bits, position in the low bits) and materialise, so that
    the tags are fixed.  The per-partition counts have one row per range
    partition (a bound we choose), so they are collected and turned into
    offsets on the driver; the total is the timeline length.  ``uniform`` has
    to be alike on all rows (checked in the same job): rows for which it
    differs have no common order.
    """
    spark = df.sparkSession
    n_parts = num_partitions or partitions_for(df)
    ranged = df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    tagged = materialize(ranged.withColumn("__mid", F.monotonically_increasing_id()), label)
    pid = F.shiftrightunsigned(F.col("__mid"), 33)
    pos = F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    alike = F.lit(True) if uniform is None else uniform
    found = tagged.groupBy(pid.alias("p")).agg(F.count(F.lit(1)), F.min(alike), F.max(alike)).collect()
    if len({x for r in found for x in r[2:] if x is not None}) > 1:
        raise ValueError("times with and without a zone offset have no common order")
    counts = sorted((r[0], r[1]) for r in found)
    offsets, total = {}, 0
    for p_id, c in counts:
        offsets[p_id] = total
        total += c
    if not counts:
        return tagged.withColumn(out, pos).drop("__mid"), 0
    if len(counts) <= INLINE_OFFSETS_MAX:
        top = max(offsets)
        table = F.array(*[F.lit(offsets.get(i, 0)) for i in range(top + 1)])
        res = tagged.withColumn(out, F.get(table, pid.cast("int")) + pos)
        return res.drop("__mid"), total
    off_df = spark.createDataFrame(sorted(offsets.items()), "__pid long, __off long")
    res = (tagged.withColumn("__pid", pid).join(F.broadcast(off_df), on="__pid", how="inner")
           .withColumn(out, F.col("__off") + pos).drop("__pid", "__off", "__mid"))
    return res, total
