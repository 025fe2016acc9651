"""Tables that operators write once under the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root, clear_staged, materialize

__all__ = ["checkpoint_root", "clear_staged", "materialize", "word_count", "held_out_hash", "keyed", "join_groups"]

BROADCAST_GROUPS = 1_000_000
HOT_SHARE = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out_hash(doc_id: Column, buckets: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo ``buckets``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % buckets


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """The rows with a number of their own in ``row``, by which operators name
    them, and whether it is the doc_id.  If ids are null or repeated it is
    not, but a number that is fixed by writing the rows out."""
    unsure = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if unsure.isEmpty():
        return docs.withColumn("row", F.col("doc_id").cast("long")), True
    return materialize(docs.withColumn("row", F.monotonically_increasing_id()), "stage-input"), False


def texts(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, ids as long and texts as string."""
    kind = {"doc_id": "long", "item_id": "long", "page_id": "long"}
    return df.select(*[F.col(f"`{n}`").cast(kind.get(n, "string")).alias(n) for n in names])


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Rows with the columns of their group (nulls match), without ``size``,
    the number of rows of a group.

    Groups that are counted to be few go to the tasks.  Of more groups, only
    those with at least one of every ``HOT_SHARE`` rows do (so at most that
    many groups), and the rows of the others are shuffled: no task gets the
    rows of a hot group."""
    def matched(left, right, how="inner"):
        names = [c for c in right.columns if c not in (key, size)]
        right = right.select(F.col(key).alias("__key"), *names)
        return left.join(right, left[key].eqNullSafe(right["__key"]), how).drop("__key")

    if groups.count() <= BROADCAST_GROUPS:
        return matched(rows, F.broadcast(groups))
    total = groups.agg(F.sum(size)).first()[0]
    big = F.col(size) * HOT_SHARE >= total
    hot = materialize(groups.where(big), "hot-groups")
    cold = matched(rows, F.broadcast(hot.select(key, size)), "left_anti")
    return matched(rows, F.broadcast(hot)).unionByName(matched(cold, groups.where(~big)))
