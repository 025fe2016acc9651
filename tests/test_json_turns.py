"""Typed turn records from JSONL."""

import pytest

from turnframe.operators.turns import json_rejects, turn_index, turns_from_json


def _turns(spark, lines, on_bad="fail"):
    df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(lines)], "line_no long, value string")
    return sorted((tuple(r) for r in turns_from_json(df, on_bad=on_bad).collect()), key=lambda t: t[-1])


def test_types_and_coercions(spark):
    ts = '"timestamp": "2023-01-01T00:00:00"'
    lines = [
        "{%s, \"speaker\": \" Ann \", \"text\": \" hi \", \"source_file\": \"a.txt\", \"line_start\": 5}" % ts,
        "{%s, \"speaker\": \"A\", \"text\": 123}" % ts,
        "{\"speaker\": \"A\", \"text\": \"x\"}",
        "{%s, \"speaker\": \"A\", \"text\": \"   \"}" % ts,
        "   ",
        "{%s, \"speaker\": \"A\", \"text\": \"y\", \"line_start\": \"12\", \"source_file\": null}" % ts,
        "{%s, \"speaker\": \"A\", \"text\": \"z\", \"line_start\": true, \"source_file\": 7}" % ts,
        "{%s, \"speaker\": \"A\", \"text\": \"w\", \"line_start\": 3.0}" % ts,
        "{%s, \"speaker\": \"\", \"text\": \"v\", \"line_start\": \"١٢\"}" % ts,
        "{%s, \"speaker\": \"A\", \"text\": \"first\", \"text\": \"last\"}" % ts,
    ]
    got = _turns(spark, lines)
    assert got == [
        ("2023-01-01T00:00:00", "Ann", "hi", "a.txt", 5, 1),
        ("2023-01-01T00:00:00", "A", "y", "None", 12, 6),
        ("2023-01-01T00:00:00", "A", "z", "7", 1, 7),
        ("2023-01-01T00:00:00", "A", "w", "unknown", 0, 8),
        ("2023-01-01T00:00:00", "", "v", "unknown", 12, 9),
        ("2023-01-01T00:00:00", "A", "last", "unknown", 0, 10),
    ]


def test_malformed_line_reports_line_number(spark):
    lines = ['{"timestamp": "2023-01-01T00:00:00", "speaker": "A", "text": "x"}', "{not json", "[1, 2]"]
    with pytest.raises(Exception, match="input line [23]: not"):
        _turns(spark, lines)
    with pytest.raises(ValueError, match="input line 2: not JSON"):
        _turns(spark, lines, on_bad="fail_first")
    assert len(_turns(spark, lines, on_bad="skip")) == 1


def test_superscript_digits_fail(spark):
    lines = ['{"timestamp": "2023-01-01T00:00:00", "speaker": "A", "text": "x", "line_start": "²"}']
    with pytest.raises(Exception, match="line_start is no integer"):
        _turns(spark, lines)


def test_rejects(spark):
    ts = '"timestamp": "2023-01-01T00:00:00", "speaker": "A", "text": "x"'
    lines = ["{%s}" % ts, "{not json", "[1]", "7", "", '{%s, "source_file": {"a": 1}}' % ts, '{%s, "source_file": [true]}' % ts,
             '{%s, "line_start": 12345678901234567890123}' % ts, '{%s, "line_start": "99999999999999999999"}' % ts,
             '{%s, "line_start": 1e3}' % ts, '{"text": 5, "source_file": []}', '{%s, "line_start": [1]}' % ts]
    df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(lines)], "line_no long, value string")
    rejects = {r["input_line"]: r["reject"] for r in json_rejects(df).collect()}
    assert {k: v.split()[0] for k, v in rejects.items()} == {2: "not", 3: "not", 4: "not", 6: "source_file", 7: "source_file",
                                                            8: "line_start", 9: "line_start"}
    assert rejects[2] == "not JSON" and rejects[3] == "not an object"
    kept = turns_from_json(df, on_bad="quarantine").collect()
    assert sorted((r["input_line"], r["line_start"]) for r in kept) == [(1, 0), (10, 0), (12, 0)]
    with pytest.raises(Exception, match="input line"):
        turns_from_json(df).collect()


def test_times_with_offsets(spark):
    def rows(*times):
        return spark.createDataFrame([(t, "A", f"t{i}", "f", 0, i) for i, t in enumerate(times)],
                                     "timestamp string, speaker string, text string, source_file string, line_start long, input_line long")
    aware = rows("2023-01-01T10:00:00+05:00", "2023-01-01T06:00:00+00:00", "2023-01-01T04:30:00Z")
    got = [r["text"] for r in turn_index(aware, tiebreak=["input_line"]).orderBy("turn_idx").collect()]
    assert got == ["t2", "t0", "t1"]
    with pytest.raises(ValueError, match="no common order"):
        turn_index(rows("2023-01-01T10:00:00+05:00", "2023-01-01T06:00:00"), tiebreak=["input_line"])


def test_full_ties_keep_input_order(spark):
    from turnframe.plans.dataset import build_dataset

    lines = spark.createDataFrame([(f"/{'ab'[i % 2]}/t.jsonl", i // 2 + 1, '{"timestamp": "2023-01-01T00:00:00", "speaker": "A", '
                                    '"text": "t%d"}' % i) for i in range(400)], "source_path string, line_no long, value string")
    ds = build_dataset(turns_from_json(lines.repartition(7)), chunk_turns=8, prompt_turns=2, stride=8, min_turns=2)
    got = [r["text"] for r in ds.indexed.orderBy("turn_idx").collect()]
    assert got == [f"t{i}" for i in range(0, 400, 2)] + [f"t{i}" for i in range(1, 400, 2)]


def test_timeline_order_is_stable(spark):
    rows = [("2023-01-01T00:00:01", "A", "t1", "b.txt", 1, 1), ("2023-01-01T00:00:00", "A", "t2", "b.txt", 2, 2),
            ("2023-01-01T00:00:00", "A", "t3", "a.txt", 9, 3), ("2023-01-01T00:00:00", "A", "t4", "a.txt", 9, 4),
            ("2023-01-01", "A", "t5", "z.txt", 0, 5)]
    df = spark.createDataFrame(rows, "timestamp string, speaker string, text string, source_file string, "
                                     "line_start long, input_line long")
    idx = turn_index(df, tiebreak=["input_line"], num_partitions=3)
    got = [r["text"] for r in idx.orderBy("turn_idx").collect()]
    # "2023-01-01" is the same instant as "...T00:00:00": ties go to source_file.
    assert got == ["t3", "t4", "t2", "t5", "t1"]
    assert sorted(r["turn_idx"] for r in idx.collect()) == [0, 1, 2, 3, 4]


def test_bad_timeline_timestamp_fails(spark):
    df = spark.createDataFrame([("yesterday", "A", "x", "f", 1, 1)],
                               "timestamp string, speaker string, text string, source_file string, line_start long, input_line long")
    with pytest.raises(Exception, match="no ISO time"):
        turn_index(df, tiebreak=["input_line"]).collect()


def test_duplicate_keys_without_session_setting(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "false")
    try:
        got = _turns(spark, ['{"timestamp": "2023-01-01T00:00:00", "speaker": "A", "text": "a", "text": "b"}'])
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    assert [g[2] for g in got] == ["b"]
