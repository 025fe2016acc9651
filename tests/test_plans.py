"""Plan shape: no single-partition exchange over row-level
data, no window partitioned by a whole file."""

from turnframe import fixtures as fx
from turnframe.operators.assemble import assemble_messages
from turnframe.operators.turns import turn_index, turn_index_with_count
from turnframe.plans.dataset import export_turns, path_order

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_turn_index_has_no_single_partition_over_rows(spark):
    ev = fx.fx_events(spark, SF).drop("ts")
    idx, n = turn_index_with_count(ev, tiebreak=["event_id"])
    assert n == 1000
    text = _plan(idx)
    assert "SinglePartition" not in text
    assert "Window" not in text
    # Offsets are a per-partition literal table: ordinals are 0..n-1.
    got = sorted(r[0] for r in idx.select("turn_idx").collect())
    assert got == list(range(n))


def test_assembly_moves_lines_once(spark):
    lines = spark.createDataFrame([("f", i, f"[1/2/23, 10:00:{i % 60:02d}] A: x") for i in range(50)],
                                  "source_path string, line_no long, value string")
    df = assemble_messages(lines, block_lines=8)
    plan = _plan(df)
    # both branches read one exchange of lines; the only other one holds the blocks' edges
    assert {x.split("hashpartitioning(")[1].split(")")[0].count(",") for x in plan.splitlines() if "Exchange hashpartitioning" in x} == {1, 2}
    assert plan.count("REPARTITION_BY_COL") == 2 and plan.count("Exchange hashpartitioning") == 3
    assert len(df.collect()) == 50
    final = assemble_messages(fx.fx_lines(spark, SF))
    final.collect()
    last = _plan(final).split("Initial Plan")[0]
    # the input (two readers of its own) is scanned once, not once a branch
    assert "ReusedExchange" in last and last.count("FileScan parquet") == 2


def test_turns_pipeline_runs(spark):
    t = export_turns(fx.fx_lines(spark, SF))
    idx = turn_index(t.where("length(text) > 0"), tiebreak=[path_order()])
    assert idx.count() == 83


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_expensive_expressions_evaluated_once(spark):
    from pyspark.sql import functions as F
    from turnframe.operators.clean import README_FLAGS, clean_turns
    from turnframe.operators.headers import with_header
    from turnframe.operators.turns import turns_from_json

    df = spark.createDataFrame([("a", "b", " x ", "f", 1, "p")], "timestamp string, speaker string, text string, "
                                                               "source_file string, line_start long, source_path string")
    assert _optimized(clean_turns(df, **README_FLAGS)).count("regexp_replace(") == 1
    lines = spark.createDataFrame([("f", 1, "[1/2/23, 10:00:00] A: x")], "source_path string, line_no long, value string")
    h = with_header(lines).select("h.ts", "h.speaker", "h.text").where(F.col("speaker") != "")
    assert _optimized(h).count("regexp_replace(") == 1
    js = spark.createDataFrame([(1, '{"timestamp": "t", "speaker": "s", "text": "x"}')], "line_no long, value string")
    assert _optimized(turns_from_json(js)).count("parseJson") == 1


def test_timeline_of_joined_turns_has_few_partitions(spark, tmpdir_path):
    from turnframe import fixtures as fx
    from turnframe.plans.dataset import build_dataset

    spark.range(20_000).selectExpr("id AS event_id", "timestamp'2023-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts",
                                   "id % 200 AS user_id", "'click' AS event_type", "concat('p', id) AS props") \
        .write.parquet(f"{tmpdir_path}/events.parquet")
    ds = build_dataset(fx.fx_key_events(spark, tmpdir_path), chunk_turns=64, prompt_turns=16, stride=8, min_turns=60,
                       partition_by=["user_id"], tiebreak=["event_id"])
    assert len(ds.indexed.inputFiles()) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [(r["user_id"], r["reason"]) for r in ds.rejects.orderBy("user_id").collect()] == [(u, "no turns") for u in (0, 50, 100, 150)]
