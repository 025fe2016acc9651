"""V-1 .. V-5: settings are refused before any Spark work; data checks."""

import pytest

from turnframe import checks
from turnframe.plans.dataset import build_dataset, input_order

GOOD = dict(chunk_turns=4, prompt_turns=1, stride=1, min_turns=2)


@pytest.mark.parametrize("val,test", [(-0.1, 0.1), (0.1, -0.1), (0.5, 0.5), (0.9, 0.2)])
def test_bad_ratios(val, test):
    with pytest.raises(checks.DatasetError, match="_ratio"):
        checks.check_settings(val, test, **GOOD)
    checks.check_settings(0.0, 0.0, **GOOD)


@pytest.mark.parametrize("name", sorted(checks.LEAST))
def test_too_small(name):
    with pytest.raises(checks.DatasetError, match=name):
        checks.check_settings(0.1, 0.1, **{**GOOD, name: checks.LEAST[name] - 1})


def test_prompt_not_below_chunk():
    with pytest.raises(checks.DatasetError, match="no turn to complete"):
        checks.check_settings(0.1, 0.1, chunk_turns=8, prompt_turns=8, stride=1, min_turns=2)


def test_all_problems_are_named():
    with pytest.raises(checks.DatasetError) as e:
        checks.check_settings(-1, 0.1, **{**GOOD, "stride": 0})
    assert "stride" in str(e.value) and "val_ratio" in str(e.value)


def test_dataset_checks(spark):
    rows = [("2023-01-01T00:00:%02d" % i, "A", f"t{i}", "f", i, i) for i in range(5)]
    turns = spark.createDataFrame(rows, "timestamp string, speaker string, text string, source_file string, "
                                        "line_start long, input_line long")
    with pytest.raises(checks.DatasetError, match="no example"):
        build_dataset(turns)
    with pytest.raises(checks.DatasetError, match="no usable turn"):
        build_dataset(turns.where("false"))
    kw = dict(chunk_turns=4, prompt_turns=2, stride=1, min_turns=2)
    ok = build_dataset(turns, **kw)
    assert ok.n == 5 and ok.examples.count() == 4
    assert build_dataset(turns.where("false"), dataset_checks=False).examples.count() == 0


def test_an_order_is_needed():
    with pytest.raises(ValueError, match="order equal times"):
        input_order(["timestamp", "text"])


def test_key_rejects(spark):
    rows = [(k, "2023-01-01T00:00:%02d" % i, "A", " " if k == "blank" else f"t{i}", "f", i, i)
            for k, n in (("one", 1), ("blank", 5), ("two", 2), ("many", 9), (None, 1)) for i in range(n)]
    turns = spark.createDataFrame(rows, "k string, timestamp string, speaker string, text string, source_file string, "
                                        "line_start long, input_line long")
    ds = build_dataset(turns, chunk_turns=4, prompt_turns=2, stride=1, min_turns=2, partition_by=["k"])
    assert {(r["k"], r["reason"]) for r in ds.rejects.collect()} == {("one", "no examples"), ("blank", "no turns"), (None, "no examples")}
    assert {r["k"] for r in ds.examples.select("k").distinct().collect()} == {"two", "many"}
