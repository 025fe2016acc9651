"""Python str semantics as Spark expressions."""

from pyspark.sql import functions as F

from turnframe.functions.text import (WHITESPACE, is_media_placeholder, is_system_text, split_lines,
                                      split_newlines, strip, strip_edit_marker)


def _eval(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(fn(F.col("s"))).collect()]


def test_whitespace_set_is_python_isspace():
    expected = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    assert WHITESPACE == expected
    assert len(WHITESPACE) == 29


def test_strip_matches_python(spark):
    values = ["  a b  ", " 　x ", "‎y‎", "﻿z", "\t\n\x0b\x0c\rq\x1c\x1f", "", "   "]
    assert _eval(spark, values, strip) == [v.strip() for v in values]


def test_system_classification(spark):
    cases = {
        "I LEFT now": True,
        "left_": False,
        "éleft": False,
        "²left": False,
        "left́": True,
        "‍left": True,
        "you’re now an admin": False,
        "you're now an admin": True,
        "Ann joined using this group's invite link": True,
        "Messages and calls are end-to-end encrypted.": True,
        "I was added to it": True,
        "nothing here": False,
        "leftover": False,
    }
    got = _eval(spark, list(cases), is_system_text)
    assert got == list(cases.values())


def test_media_classification(spark):
    cases = {
        "‎image omitted": True,
        "This message was deleted.": True,
        "this message was deleted": True,
        "This message was deleted.x": True,
        "This message was deletedx": False,
        "GIF omitted": True,
        "gif  omitted": False,
        "sticker omitted!": True,
    }
    assert _eval(spark, list(cases), is_media_placeholder) == list(cases.values())


def test_edit_marker(spark):
    cases = {
        "foo <this MESSAGE was edited> bar": "foobar",
        "hello <This message was edited>": "hello",
        " 　": "",
        "a <This message was edited> <This message was edited> b": "ab",
        "keep ‎": "keep ‎",
        "x < y": "x < y",
    }
    assert _eval(spark, list(cases), strip_edit_marker) == list(cases.values())


def test_splitlines(spark):
    values = ["a\nb\r\nc\rd\x0be\x0cf\x1cg\x1dh\x1ei\x85j k l", "x\n", "\n", "", "a\r\n\r\nb"]
    got = _eval(spark, values, split_lines)
    assert got == [v.splitlines() for v in values]


def test_universal_newlines(spark):
    import io
    values = ["a\r\nb\rc\nd", "a\n", "a", "", "\n\n", "x y\x85z"]
    got = _eval(spark, values, split_newlines)
    expected = [[ln.rstrip("\n") for ln in io.StringIO(v, newline=None)] for v in values]
    assert got == expected


def test_prefilter_anchors_are_exact_supersets():
    from turnframe.functions import constants as C
    from turnframe.functions.text import MEDIA_ANCHORS, SYSTEM_ANCHORS
    for phrase in C.SYSTEM_PHRASES:
        assert any(a in phrase.lower() for a in SYSTEM_ANCHORS), phrase
    for phrase in C.MEDIA_PHRASES:
        assert any(a in phrase.lower() for a in MEDIA_ANCHORS), phrase
    # No letter with extra case-insensitive equivalents.
    assert not any(set(a) & set("isk") for a in SYSTEM_ANCHORS + MEDIA_ANCHORS)


def test_case_variants(spark):
    cases = ["I LEFT", "ıMAGE omitted", "meſſages and calls are end-to-end encrypted", "you're now an admİn",
             "only admıns can", "ADDED", "Removed!", "this messaGe was deleted"]
    got = _eval(spark, cases, is_system_text)
    import re
    word = re.compile(r"\b(created group|added|removed|left|joined using this group's invite link|changed "
                      r"(this group's icon|the group name|group settings|group description)|messages and calls "
                      r"are end-to-end encrypted|you're now an admin|only admins can)\b", re.IGNORECASE)
    assert got == [word.search(c) is not None for c in cases]
