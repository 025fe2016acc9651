"""Skew: one timestamp, file or key holding a large share of the rows must
not end up in one task, and results stay exact."""

from pyspark.sql import functions as F

from turnframe.operators.assemble import assemble_messages
from turnframe.operators.ordinals import global_ordinal
from turnframe.operators.turns import turn_index_with_count


def test_hot_timestamp_is_exact(spark):
    n = 6000
    rows = [(i, "2023-01-01T00:00:00" if i % 3 == 0 else f"2023-01-{1 + i % 28:02d}T01:{i % 60:02d}:00",
             "s", f"t{i}", "same.txt", i % 7) for i in range(n)]
    df = spark.createDataFrame(rows, "input_line long, timestamp string, speaker string, text string, "
                                     "source_file string, line_start long")
    idx, total = turn_index_with_count(df, tiebreak=["input_line"], num_partitions=6)
    assert total == n
    got = idx.orderBy("turn_idx").select("timestamp", "line_start", "input_line").collect()
    py = sorted(rows, key=lambda r: (r[1], r[4], r[5], r[0]))
    assert [tuple(r) for r in got] == [(p[1], p[5], p[0]) for p in py]
    assert sorted(r[0] for r in idx.select("turn_idx").collect()) == list(range(n))


def test_hot_leading_key_is_split_across_partitions(spark):
    n = 9000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
                               F.col("id").alias("tb"))
    # The range partitioning global_ordinal uses: on the whole unique key.
    ranged = df.repartitionByRange(6, "k", "tb")
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == n and max(sizes) <= n // 4, sizes
    ordered, total = global_ordinal(df, [F.col("k"), F.col("tb")], "pos", num_partitions=6)
    assert total == n
    got = [r["tb"] for r in ordered.orderBy("pos").collect()]
    assert got == sorted(range(n), key=lambda i: (0 if i % 3 == 0 else i, i))


def test_giant_file_windows_are_blockwise(spark):
    # One file with 50k lines and a header every 7 lines: assembly equals the
    # definition while every window partition is a block of at most 4096 lines.
    n = 50000
    h = "[1/2/23, 10:00:00] A: x{}"
    lines = spark.range(1, n + 1).select(
        F.lit("/big.txt").alias("source_path"), F.col("id").alias("line_no"),
        F.when(F.col("id") % 7 == 1, F.format_string(h.replace("{}", "%d"), F.col("id")))
         .otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("value"))
    msgs = assemble_messages(lines, block_lines=4096)
    rows = msgs.select("line_start", "text").collect()
    assert len(rows) == (n + 6) // 7
    by_start = {r[0]: r[1] for r in rows}
    assert by_start[8] == "x8\n" + "\n".join(f"c{i}" for i in range(9, 15))
    assert by_start[49995] == "x49995\n" + "\n".join(f"c{i}" for i in range(49996, n + 1))


def test_offsets_broadcast_branch(spark, monkeypatch):
    from turnframe.operators import ordinals
    monkeypatch.setattr(ordinals, "INLINE_OFFSETS_MAX", 2)
    n = 3000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"))
    ordered, total = global_ordinal(df, [F.col("k")], "pos", num_partitions=6)
    assert total == n
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan
    got = [(r["k"], r["pos"]) for r in ordered.collect()]
    assert sorted(got) == [(i, i) for i in range(n)]
