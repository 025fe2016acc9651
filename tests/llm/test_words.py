import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from turnframe.llm.text import ALNUM, LOWER, PLAIN, Words, cover, pieces, window_starts, windows

TEXT = st.text(alphabet=st.sampled_from("aBz09_-,.é漢 \t\n\x0b\r \x00"), max_size=30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_of_a_batch(rows):
    w = Words(pa.array(rows, pa.string()), PLAIN)
    expect = [re.findall(r"[^\x20\x09-\x0D]+", r or "") for r in rows]
    assert [x.decode() for x in w.strings()] == [x for e in expect for x in e]
    assert w.counts.tolist() == [len(e) for e in expect]
    low = "".join
    w = Words(pa.array(rows, pa.string()), ALNUM, lower=True)
    lower = [low(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r or "") for r in rows]
    assert [x.decode() for x in w.strings()] == [x for r in lower for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r)]


def test_hash_depends_on_bytes_alone():
    a = Words(pa.array(["ab abcdefgh abcdefghi " + "q" * 100, "x"]))
    b = Words(pa.array([None, "zz " + "q" * 100 + " abcdefghi", "abcdefgh ab"]))
    x, y = dict(zip(a.strings(), a.hashes().tolist())), dict(zip(b.strings(), b.hashes().tolist()))
    assert all(x[k] == y[k] for k in x.keys() & y.keys()) and len(x.keys() & y.keys()) == 4
    assert len({*x.values(), *y.values()}) == len({*x, *y})


def test_windows_stay_in_documents():
    w = Words(pa.array(["a b c", "d e", "", "f g h i"]))
    ok = window_starts(w.first, 3, len(w))
    assert np.flatnonzero(ok).tolist() == [0, 5, 6]
    assert len(windows(w.hashes(), 3)) == len(w) - 2
    assert cover(np.array([1, 2]), 2, 6).tolist() == [False, True, True, True, False, False]


def test_pieces_cut_between_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "c", ""])], ["t"])
    got = list(pieces([b], 0, 20))
    assert [p.column(0).to_pylist() for p in got] == [["a" * 10, None], ["b" * 100], ["c", ""]]
    assert LOWER[ord("Z")] == ord("z")
