"""Header recognition and timestamps (FIXTURES section 3)."""

import pytest
from pyspark.sql import functions as F

from turnframe.operators.headers import checked_timestamps, with_header
from turnframe.operators.assemble import assemble_messages, parse_export_text

H = "[12/7/23, 09:15:50] "


def _headers(spark, lines):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, v string")
    out = with_header(df, "v").select(
        "i", "h.is_header", F.date_format("h.ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "h.speaker", "h.text")
    return [tuple(r)[1:] for r in out.orderBy("i").collect()]


def test_header_cases(spark):
    cases = [
        ("‎" + H + "Al B: hi: there", (True, "2023-12-07T09:15:50", "Al B", "hi: there")),
        (H + "Al joined", (False, None, None, None)),
        ("[12/7/23, 9:15:50 AM] Al: hi", (False, None, None, None)),
        ("[12/7/2023, 09:15:50] Al: x", (False, None, None, None)),
        (H + "A:b: c", (False, None, None, None)),
        (H + "A: ", (True, "2023-12-07T09:15:50", "A", "")),
        (H + "A:", (False, None, None, None)),
        ("‎‎" + H + "A: x", (False, None, None, None)),
        (" " + H + "A: x", (False, None, None, None)),
        ("[12/7/23, 09:15] A: x", (False, None, None, None)),
        (H + "A: x y\u0085z", (True, "2023-12-07T09:15:50", "A", "x y\u0085z")),
        (H + "   : spaces", (True, "2023-12-07T09:15:50", "", "spaces")),
        ("﻿" + H + "‎Meta AI: x", (True, "2023-12-07T09:15:50", "‎Meta AI", "x")),
    ]
    got = _headers(spark, [c[0] for c in cases])
    assert got == [c[1] for c in cases]


def test_timestamps(spark):
    cases = {
        "[12/7/23, 09:15:50] A: x": "2023-12-07T09:15:50",
        "[1/2/69, 0:00:00] A: x": "1969-01-02T00:00:00",
        "[1/2/68, 23:59:59] A: x": "2068-01-02T23:59:59",
        "[2/29/24, 10:00:00] A: x": "2024-02-29T10:00:00",
        "[13/2/23, 10:00:00] A: x": None,
        "[2/29/23, 10:00:00] A: x": None,
        "[2/2/23, 10:00:60] A: x": None,
        "[2/2/23, 24:00:00] A: x": None,
        "[0/2/23, 10:00:00] A: x": None,
        # Unicode digits: accepted by strptime in day, year and time (not month).
        "[2/1٣/٢٣, 1٠:00:00] A: x": "2023-02-13T10:00:00",
        "[٢/13/23, 10:00:00] A: x": None,
    }
    got = _headers(spark, list(cases))
    assert [g[1] for g in got] == list(cases.values())
    assert all(g[0] for g in got)


def test_bad_timestamp_fails(spark):
    df = spark.createDataFrame([("f.txt", 1, "[13/2/23, 10:00:00] A: x")], "source_path string, line_no long, value string")
    with pytest.raises(Exception, match="unparsable export timestamp"):
        assemble_messages(df).collect()
    rows = assemble_messages(df, on_bad="null").collect()
    assert rows[0]["timestamp"] is None


def test_assembly_both_routes(spark):
    text = ("preamble\n" + H + "A: one\ncont 1\n\n" + H + "B: two\n[x] not a header\n"
            + "[12/7/23, 09:16:00] C: three\r\nlast")
    files = spark.createDataFrame([("/d/a.txt", text), ("/d/b.txt", "")], "source_path string, content string")
    whole = sorted(tuple(r) for r in parse_export_text(files).collect())
    from turnframe.sources.exports import explode_lines
    lines = explode_lines(files)
    by_line = sorted(tuple(r) for r in assemble_messages(lines, block_lines=2).collect())
    assert whole == by_line
    assert [(r[2], r[4], r[5]) for r in whole] == [
        (2, "A", "one\ncont 1\n"), (5, "B", "two\n[x] not a header"), (7, "C", "three\nlast")]


def test_assembly_across_blocks(spark):
    # One header then many continuation lines: the owner is carried across blocks.
    lines = [("/f.txt", 1, "junk"), ("/f.txt", 2, H + "A: start")] + [("/f.txt", i, f"l{i}") for i in range(3, 40)]
    df = spark.createDataFrame(lines, "source_path string, line_no long, value string")
    rows = assemble_messages(df, block_lines=4).collect()
    assert len(rows) == 1
    assert rows[0]["text"] == "start\n" + "\n".join(f"l{i}" for i in range(3, 40))


def test_missing_timestamps(spark):
    df = spark.createDataFrame([(None,)], "__ts timestamp_ntz")
    for on_bad in ("null", "quarantine"):
        assert checked_timestamps(df, F.lit("x"), on_bad).first()["timestamp"] is None
    with pytest.raises(Exception, match="unparsable export timestamp at x"):
        checked_timestamps(df, F.lit("x"), "fail").collect()
    with pytest.raises(ValueError, match="on_bad"):
        checked_timestamps(df, F.lit("x"), "ignore")


@pytest.mark.parametrize("route", ["whole", "lines"])
def test_bad_date_of_a_dropped_or_minimal_message_fails(spark, route):
    from turnframe.operators.clean import clean_turns
    from turnframe.sources.exports import explode_lines

    text = "[1/2/23, 10:00:00] A: fine\n[13/45/23, 10:00:00] Meta AI: dropped anyway"
    files = spark.createDataFrame([("/d/a.txt", text)], "source_path string, content string")
    parse = parse_export_text if route == "whole" else lambda f, **kw: assemble_messages(explode_lines(f), **kw)
    for minimal in (False, True):
        with pytest.raises(Exception, match="unparsable export timestamp"):
            clean_turns(parse(files), minimal=minimal).collect()
        assert clean_turns(parse(files, on_bad="null"), minimal=minimal).count() == 1


def test_bad_timestamp_fails_counters(spark):
    from turnframe.operators.clean import parse_counters
    df = spark.createDataFrame([("f.txt", 1, "[13/2/23, 10:00:00] A: x"), ("f.txt", 2, "[1/2/23, 10:00:00] B: y")],
                               "source_path string, line_no long, value string")
    with pytest.raises(Exception, match="unparsable export timestamp"):
        parse_counters(assemble_messages(df)).collect()
    row = parse_counters(assemble_messages(df, on_bad="null")).first()
    assert (row["raw_messages"], row["bad_timestamps"]) == (2, 1)


def test_iso_grammar(spark):
    """Every form of date, time and offset against datetime.fromisoformat."""
    from datetime import datetime

    from turnframe.functions.timestamps import is_aware, iso_sort_key

    dates = ["2023-12-07", "20231207", "2023-W49", "2023W49", "2023-W49-4", "2023W494", "2020-W53-7", "2021-W53-1", "2023-W00-1", "2023-W54",
             "2023-12", "2023", "2023-13-01", "2023-02-29", "2024-02-29", "0000-01-01", "2023-1-1", " 2023-12-07", "２０２３-12-07",
             "2023-W49-8", "2023-W49-0", "2023-1207", "202312-07", "2023-W494", ""]
    times = ["", "T09", "T09:15", "T09:15:50", "T0915", "T091550", "T09:15:50.1", " 09:15:50,123456", "T09:15:50.1234567", "T091550.5", "x09:15",
             "\n09:15", "T25:00", "T09:60", "T09:15:60", "T09:1550", "T0915:50", "T9:15", "T"]
    zones = ["", "Z", "+02:00", "-0530", "+14", "+02:00:30", "+020030.5", "+24:00", "+02:60", "z", "+2", "-00:00"]
    values = [d + t + z for d in dates for t in times for z in (zones if t else [""])]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    key = F.date_format(iso_sort_key(F.col("v")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    for r in df.select("v", key.alias("k"), is_aware(F.col("v")).alias("aware")).collect():
        try:
            t = datetime.fromisoformat(r["v"])
        except ValueError:
            assert r["k"] is None, r["v"]
            continue
        at = (t - t.utcoffset()).replace(tzinfo=None) if t.tzinfo else t
        assert (r["k"], r["aware"]) == (at.strftime("%Y-%m-%d %H:%M:%S.%f"), t.tzinfo is not None), r["v"]
