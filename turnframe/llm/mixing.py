"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's size is its number of words.  Sources, ordered by code point
with null last, weigh 1, 2, 3, 1, 2, 3, ... (or as given) and share the total
size by weight, with a target of at most ``max_epochs`` times the source's own
size; what is over is shared again by weight among the rest.  A source whose
target is E whole times its size and a fraction takes every document E times
and then documents in the order of exponential keys -ln(u) / quality until
the fraction's budget of words is reached.  u is a hash of the document, so
reruns agree.

Only DataFrame operations.  Keys are mapped monotonically to bins of about
``BIN_ROWS`` documents; one aggregate by (source, bin) tells which bin the
budget ends in, all other bins are whole, and only that bin is sorted, so the
largest source is never ordered in one task.

Null text has size 0; documents of size 0 take nothing; null sources form one
source; equal rows tie by (key, doc_id) and are interchangeable; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import materialize, word_count

BIN_ROWS = 4096
MAX_EPOCHS = 3
BROADCAST_SOURCES = 10_000


def quality_weight(text, size):
    """Sampling weight of a document from 0.25 to 1: the fewer symbols a
    word, the higher."""
    symbols = F.coalesce(F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")), F.lit(0))
    return F.greatest(F.lit(0.25), F.lit(1.0) - symbols / F.greatest(size, F.lit(1)))


def sampling_keys(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size, key (exponential, scaled by quality weight) and
    place (the key mapped monotonically to 0..1)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                    F.col("text").cast("string").alias("text"))
    size = word_count(F.col("text"))
    # 52 bits of an md5, so that u is a double strictly between 0 and 1
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))
                                    .cast("binary")), 1, 13), 16, 10).cast("double")
    u = (bits + F.lit(0.5)) / F.lit(float(1 << 52))
    sized = d.withColumn("size", size).withColumn("w", quality_weight(F.col("text"), F.col("size")))
    keyed = sized.withColumn("key", -F.log(u) / F.col("w"))
    return keyed.select("doc_id", "source", "size", "key", (F.lit(1.0) - F.exp(-F.col("key"))).alias("place"))


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, weights: DataFrame | None = None) -> DataFrame:
    """sizes (source, n_docs, source_size) with its weight, cap and target.

    The shares are a water level: target = min(cap, level * weight) and the
    targets add up to the total, so one pass over the sources in the order of
    cap / weight finds the level.  This table has one row a source.
    """
    if weights is None:
        by_name = Window.orderBy(F.col("source").asc_nulls_last())
        sizes = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight"))
        sizes = sizes.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left") \
            .withColumn("weight", F.coalesce("weight", F.lit(0))).drop("w_source")
    sizes = sizes.withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc_nulls_last(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.withColumns({
        "total": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every),
        "caps_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    level = (F.col("total") - F.col("caps_before")) / (F.col("all_weight") - F.col("weight_before"))
    s = s.withColumn("level", level)
    over = F.col("level") * F.col("weight") > F.col("cap")
    # sources before the first that stays under its cap are capped
    first_free = F.min(F.when(~over, F.struct("caps_before", "level"))).over(every)["level"]
    s = s.withColumn("free_level", first_free)
    target = F.when(over | F.col("free_level").isNull(), F.col("cap").cast("double")) \
        .otherwise(F.col("free_level") * F.col("weight"))
    return s.select("source", "n_docs", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, max_epochs: int = MAX_EPOCHS, weights: DataFrame | None = None,
                boundary: str = "cut", seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words) and copies.

    ``boundary`` says what becomes of the document in which a source's budget
    ends: "cut" takes just the words that are left, "nearest" takes the whole
    document or none of it, whichever is nearer.
    """
    keyed = materialize(sampling_keys(docs, seed), "mix-keys")
    sizes = materialize(keyed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")),
                        "mix-sources")
    targets = source_targets(sizes, max_epochs, weights)
    size = F.col("source_size")
    epochs = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    plan = targets.withColumn("epochs", epochs) \
        .withColumn("budget", F.round(F.col("target") - F.col("epochs") * size).cast("long")) \
        .withColumn("bins", F.ceil(F.col("n_docs") / F.lit(BIN_ROWS)).cast("long")) \
        .withColumnRenamed("source", "p_source")
    plan = materialize(plan, "mix-plan")
    few = plan.count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda x: x)
    on = F.col("source").eqNullSafe(F.col("p_source"))
    d = keyed.join(hint(plan), on).withColumn(
        "bin", F.least(F.floor(F.col("place") * F.col("bins")), F.col("bins") - 1))
    by_bin = d.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.first("budget").alias("budget"))
    so_far = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = by_bin.withColumn("before", F.coalesce(F.sum("bin_size").over(so_far), F.lit(0))) \
        .where((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("bin_size")))
    ends = ends.select(F.col("source").alias("e_source"), F.col("bin").alias("end_bin"), "before")
    d = d.join(hint(materialize(ends, "mix-ends")), F.col("source").eqNullSafe(F.col("e_source")), "left")
    d = d.withColumn("end_bin", F.coalesce("end_bin", F.when(F.col("budget") > 0, F.col("bins")).otherwise(F.lit(-1))))
    cols = ["doc_id", "source", "size", "source_size", "target", "epochs"]
    whole = d.where(F.col("bin") != F.col("end_bin")).select(
        *cols, F.when(F.col("bin") < F.col("end_bin"), F.col("size")).otherwise(0).cast("long").alias("part"))
    in_bin = Window.partitionBy("source").orderBy("key", "doc_id") \
        .rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.col("before") - F.coalesce(F.sum("size").over(in_bin), F.lit(0))
    last = d.where(F.col("bin") == F.col("end_bin")).withColumn("left", left)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left"))) if boundary == "cut" \
        else F.when((F.col("left") > 0) & (2 * F.col("left") >= F.col("size")), F.col("size")).otherwise(0)
    both = whole.unionByName(last.select(*cols, part.cast("long").alias("part")))
    return both.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
                       (F.col("epochs") + F.when((F.col("part") > 0) & (F.col("part") == F.col("size")), 1)
                        .otherwise(0)).alias("copies"))


def op7(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
