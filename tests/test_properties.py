"""Property tests: Spark expressions against plain Python on random inputs
(SURVEY 5.3).  Expectations come from what the inputs were made of or from
Python's own str methods; nothing is parsed a second time."""

import io
import random
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnframe.functions import constants as C
from turnframe.functions.text import (is_media_placeholder, is_system_text, split_lines, split_newlines, strip,
                                      strip_edit_marker)
from turnframe.operators.assemble import assemble_messages, parse_export_text
from turnframe.operators.clean import clean_turns
from turnframe.sources.exports import explode_lines

# Characters that stress the Python/Java differences: whitespace of all
# kinds, line breaks, marks, joiners, digits of other scripts, letters.
ALPHABET = list("ab Z_:.<>[]/,0123456789") + [
    "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", " ",
    " ", " ", " ", "　", "​", "‍", "‎", "﻿", "́", "é", "²", "٣", "ſ",
]
ALPHABET += ["\u0131", "\u0130", "\u212a"]  # dotless i, dotted I, Kelvin sign: extra case equivalents
texts = st.lists(st.text(alphabet=ALPHABET, max_size=24), min_size=1, max_size=40)

def _eval(spark, values, *fns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    rows = df.select("i", *[fn(F.col("s")).alias(f"c{k}") for k, fn in enumerate(fns)]).orderBy("i").collect()
    return [tuple(r)[1:] for r in rows]


@settings(max_examples=15, deadline=None)
@given(texts)
def test_strip_and_lines(spark, values):
    got = _eval(spark, values, strip, split_lines, split_newlines)
    for v, (s, sl, nl) in zip(values, got):
        assert s == v.strip()
        assert sl == v.splitlines()
        assert nl == [ln.rstrip("\n") for ln in io.StringIO(v, newline=None)]


# phrase -> (system text, media placeholder); letters beside a phrase take it away
PHRASES = {"left": (True, False), "ADDED": (True, False), "you're now an admin": (True, False), "removed": (True, False),
           "image omitted": (False, True), "GIF Omitted": (False, True), "this message was deleted.": (False, True),
           "see you": (False, False)}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", " ", "- ", "x", "é", "9", "_"]), st.sampled_from(sorted(PHRASES)),
                          st.sampled_from(["", " ", "!", "y", "_", " <This message was edited> "])), min_size=1, max_size=30))
def test_classification(spark, parts):
    values = [a + p + b for a, p, b in parts]
    got = _eval(spark, values, is_system_text, is_media_placeholder, strip_edit_marker)
    for (a, p, b), value, (system, media, clean) in zip(parts, values, got):
        whole_before = not a or not (a[-1].isalnum() or a[-1] == "_")
        # a full stop ends the phrase on its own, whatever letter follows
        whole_after = p.endswith(".") or not b or not (b[0].isalnum() or b[0] == "_")
        found = whole_before and whole_after
        assert (system, media) == tuple(found and kind for kind in PHRASES[p]), value
        assert clean == (a + p + ("" if "edited" in b else b)).strip(), value


SPEAKERS = ["Ann", " Bob ", "Meta AI", "C d", "é"]
# body -> what cleaning makes of it (None: dropped)
BODIES = {"hi": "hi", "image omitted": None, "I left": None, "x <This message was edited>": "x", "  ": "", "a: b": "a: b", "": "",
          "\t[no header] ": "[no header]"}
MORE = ["", "more", " [1/2/23, 10:00] x: y", "[x]", "\u2028", "tail "]


def _made_export(rnd, path):
    """(file text, the turns that have to come out of it)."""
    lines = [rnd.choice(["", "not a header", "[1/1/23] a: b"]) for _ in range(rnd.randint(0, 3))]
    turns = []
    for _ in range(rnd.randint(0, 12)):
        when = datetime(rnd.randint(1969, 2068), rnd.randint(1, 12), rnd.randint(1, 28), rnd.randint(0, 23), rnd.randint(0, 59), rnd.randint(0, 59))
        speaker, body = rnd.choice(SPEAKERS), rnd.choice(sorted(BODIES))
        more = [rnd.choice(MORE) for _ in range(rnd.choice([0, 0, 1, 3]))]
        mark = rnd.choice(["", "", *C.LEADING_MARKERS])
        hour = rnd.choice([str(when.hour), f"{when.hour:02d}"])
        lines.append(f"{mark}[{when.month}/{when.day}/{when.year % 100:02d}, {hour}:{when:%M:%S}] {speaker}: {body}")
        start = len(lines)
        lines += more
        text = "\n".join([body, *more]).strip()
        if "edited" in text:  # the marker goes with the white space around it
            left, right = text.split("<This message was edited>")
            text = (left.rstrip() + right.lstrip()).strip()
        if speaker != "Meta AI" and BODIES[body] is not None:
            turns.append((when.isoformat(), speaker.strip(), text, path.split("/")[-1], start))
    sep = rnd.choice(["\n", "\r\n", "\r"])
    return sep.join(lines) + rnd.choice(["", sep]), turns


def test_made_exports(spark):
    rnd = random.Random(7)
    files, expected = [], []
    for i in range(60):
        path = f"/d{i % 3}/f{i}.txt"
        content, turns = _made_export(rnd, path)
        files.append((path, content))
        expected += turns
    df = spark.createDataFrame(files, "source_path string, content string")
    flags = dict(drop_system=True, drop_media=True, strip_edits=True)
    whole = clean_turns(parse_export_text(df), **flags)
    lines = clean_turns(assemble_messages(explode_lines(df), block_lines=3), **flags)
    assert len(expected) > 100
    assert sorted(tuple(r) for r in whole.collect()) == sorted(expected)
    assert sorted(tuple(r) for r in lines.collect()) == sorted(expected)
