"""Count windows, examples and split (FIXTURES section 3; SURVEY 2.10)."""

import random

import pytest
from pyspark.sql import functions as F

from turnframe.operators.examples import build_examples, split_sizes
from turnframe.operators.windows import count_windows, layout


def _layout_spans(n, chunk, stride, min_turns):
    """(start, turns) of each window that ``layout`` announces."""
    lay = layout(n, chunk, stride, min_turns)
    spans = [(k * stride, min(chunk, n - k * stride)) for k in range(lay.regular)]
    return spans + [(n - chunk, chunk)] * lay.tail


# n, chunk, stride, least turns -> windows, worked out by hand
CASES = {
    (11, 32, 8, 12): [],
    (12, 32, 8, 12): [(0, 12)],
    (20, 32, 8, 12): [(0, 20), (8, 12)],
    (45, 32, 8, 12): [(0, 32), (8, 32), (16, 29), (24, 21), (32, 13), (13, 32)],
    (100, 32, 8, 12): [(k * 8, 32) for k in range(9)] + [(72, 28), (80, 20), (88, 12), (68, 32)],
    (50, 10, 5, 12): [],
    (7, 4, 3, 2): [(0, 4), (3, 4)],
    (8, 4, 3, 2): [(0, 4), (3, 4), (6, 2), (4, 4)],
}


def check_spans(spans, n, chunk, stride, min_turns):
    """What holds for the windows of any timeline."""
    if n < min_turns or chunk < min_turns:
        assert spans == []
        return
    grid = range(0, n - min_turns + 1, stride)
    starts = [s for s, _ in spans]
    assert starts[:len(grid)] == list(grid)
    assert all(k == min(chunk, n - s) >= min_turns for s, k in spans)
    # besides the grid there is at most one window, the last full one
    extra = starts[len(grid):]
    assert extra == ([] if max(0, n - chunk) in grid else [n - chunk])


def test_windows_of_any_timeline():
    for n in range(0, 60):
        for chunk in range(2, 13):
            for stride in range(1, 15):
                for min_turns in range(2, 13):
                    check_spans(_layout_spans(n, chunk, stride, min_turns), n, chunk, stride, min_turns)


@pytest.mark.parametrize("case", CASES)
def test_worked_out_windows(case):
    assert _layout_spans(*case) == CASES[case]


@pytest.mark.parametrize("total,ratios,sizes", [(66, (0.1, 0.1), (54, 6, 6)), (9, (0.1, 0.1), (9, 0, 0)), (100, (0.29, 0.1), (62, 28, 10))])
def test_split_sizes(spark, total, ratios, sizes):
    # 100 * 0.29 is under 29 in doubles
    assert tuple(spark.range(1).select(*split_sizes(F.lit(total).cast("long"), *ratios)).first()) == sizes


def _indexed(spark, n):
    rows = [(i, f"2023-01-01T00:00:{i % 60:02d}", f"s{i % 3}", f"t{i}", "f.txt") for i in range(n)]
    return spark.createDataFrame(rows, "turn_idx long, timestamp string, speaker string, text string, source_file string")


@pytest.mark.parametrize("seed", range(6))
def test_spark_windows_match_definition(spark, seed):
    rnd = random.Random(seed)
    n, chunk, stride = rnd.randint(0, 80), rnd.randint(2, 20), rnd.randint(1, 25)
    min_turns = rnd.randint(2, 20)
    w = count_windows(_indexed(spark, n), chunk, stride, min_turns)
    got = sorted((r["chunk_index"], r["start_turn_index"], r["n_turns"]) for r in w.collect())
    exp = [(k, s, ln) for k, (s, ln) in enumerate(_layout_spans(n, chunk, stride, min_turns))]
    assert got == exp
    # Members are consecutive turns.
    for r in w.collect():
        idx = [t["turn_idx"] for t in r["turns"]]
        assert idx == list(range(r["start_turn_index"], r["start_turn_index"] + r["n_turns"]))


def test_examples_layout(spark):
    w = count_windows(_indexed(spark, 45), 32, 8, 12)
    ex = build_examples(w, 16, "SYS", speaker_control=True, include_metadata=True)
    rows = {r["chunk_index"]: r for r in ex.collect()}
    tail = rows[5]
    assert tail["meta"]["start_turn_index"] == 13 and tail["meta"]["end_turn_index"] == 44
    r4 = rows[4]  # 13 turns: prompt min(16, 12) = 12, completion 1
    assert (r4["meta"]["prompt_turns"], r4["meta"]["completion_turns"]) == (12, 1)
    user = r4["messages"][1]["content"]
    assert user.startswith("Group chat transcript so far:\ns2: t32\n")
    assert "\n\nTARGET_SPEAKER=s2\nContinue the conversation naturally." in user
    assert r4["messages"][2]["content"] == "s2: t44"
    assert [m["role"] for m in r4["messages"]] == ["system", "user", "assistant"]


@pytest.mark.parametrize("seed", range(8))
def test_frames_equal_explode_and_definition(spark, seed):
    rnd = random.Random(100 + seed)
    n, chunk, stride = rnd.randint(0, 120), rnd.randint(2, 20), rnd.randint(1, 25)
    min_turns = rnd.randint(2, 20)
    block = rnd.choice([None, 1, 3, 7, 50])
    idx = _indexed(spark, n)
    exp = [(k, s, ln) for k, (s, ln) in enumerate(_layout_spans(n, chunk, stride, min_turns))]
    for method in ("frames", "explode"):
        w = count_windows(idx, chunk, stride, min_turns, method=method, block_turns=block)
        rows = w.collect()
        assert sorted((r["chunk_index"], r["start_turn_index"], r["n_turns"]) for r in rows) == exp, method
        for r in rows:
            assert [t["turn_idx"] for t in r["turns"]] == list(range(r["start_turn_index"],
                                                                     r["start_turn_index"] + r["n_turns"]))


def test_frames_per_key(spark):
    rows = [(k, i, "2023-01-01T00:00:00", "s", f"t{i}", "f") for k, m in ((1, 45), (2, 11), (3, 100)) for i in range(m)]
    df = spark.createDataFrame(rows, "key long, turn_idx long, timestamp string, speaker string, text string, "
                                     "source_file string")
    got = sorted((r["key"], r["chunk_index"], r["start_turn_index"], r["n_turns"])
                 for r in count_windows(df, 32, 8, 12, partition_by=["key"], block_turns=16).collect())
    exp = sorted((k, c, s, ln) for k, m in ((1, 45), (2, 11), (3, 100))
                 for c, (s, ln) in enumerate(_layout_spans(m, 32, 8, 12)))
    assert got == exp
