"""Phrase mining, vector codes and packaged archives against brute force."""

import base64
import hashlib
import io
import random
import re
import struct
import zipfile
from collections import Counter

import numpy as np
import pytest

from corpus_texts import WORDS, words
from turnframe.llm import phrase_mining as PM
from turnframe.llm import staging as S
from turnframe.llm import vector_codes as V
from turnframe.llm import warc_zip as Z
from turnframe.session import materialize

# ---------------------------------------------------------------- phrases


def brute_phrases(rows, threshold, top, longest=5):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < threshold:
            continue
        held = any(a2 >= a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for (lang2, q), a2 in f.items() if lang2 == lang and a2 >= max(a, threshold))
        if held:
            continue
        cuts = []
        for k in range(1, len(p)):
            x, y = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((1000 * a * n[lang] // (x * y), k, x, y))
        s, _, x, y = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), x, y))
    return {(lang, i + 1, p.decode(), -a, x, y, n[lang], -s)
            for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])}


def phrase_rows(seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            kind = rng.random()
            parts.append("New York City" if kind < 0.2 else "as soon as possible please" if kind < 0.35 else "été  à\tla plage" if kind < 0.45
                         else "a a a a" if kind < 0.5 else " ".join(rng.choice(WORDS[:6]) for _ in range(rng.randrange(1, 7))))
        sep = rng.choice([" ", ". ", ", ", "\n", " \x0b", "  "])
        rows.append((rng.choice(["en", "en", "fr", None, "und", "x\ny"]), sep.join(parts)))
    return rows + [("en", None), (None, ""), ("en", " .,;"), ("zz", "lonely words"), ("fr", "\t \n")]


@pytest.mark.parametrize("shards, active_rows, top", [(1, 10_000, 2000), (3, 10_000, 5), (3, 0, 2000)])
def test_phrases(spark, shards, active_rows, top):
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, t, lang, 7, "clash") for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, n int, phrase string")
    out = PM.mine_phrases(docs, threshold=20, top=top, shards=shards, active_rows=active_rows).collect()
    got = {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in out}
    expect = brute_phrases(rows, 20, top)
    assert len(out) == len(got) and got == expect and len(got) > 12
    assert any(len(r["phrase"].split()) == 5 for r in out)


def test_a_task_adds_up_its_words():
    import pyarrow as pa

    class Shared:
        value = PM.Reached([], np.zeros(0, np.int32))

    batches = [pa.RecordBatch.from_pydict({"lang": ["en", "de", "en"], "text": ["A b. ü a", "a ü", None]}) for _ in range(3)]
    rows = [r for b in PM._count_shard(Shared, 0, 3, 5)(batches) for r in b.to_pylist()]
    assert {(r["word"], r["n"]) for r in rows if r["p"]} == {("en\na", 6), ("en\nb", 3), ("en\nü", 3), ("de\na", 3), ("de\nü", 3)}
    assert sum(len(r["p"]) == PM.BYTES for r in rows) == 5  # each word once, not once a batch


def test_phrases_interleave():
    """A step counts a phrase only from the step after both subphrases
    reached the threshold, for one cycle."""
    import pyarrow as pa

    _, h, goes_on = PM.word_stream(["en", "en"], pa.array(["a b c. d", "a b"]))
    assert goes_on.tolist() == [True, True, False, False, True, False]
    name = [PM.names_of([h[i:i + 1]]).to_pylist()[0] for i in range(3)] + PM.names_of([h[:2], h[1:3]]).to_pylist()
    r = PM.Reached(name, np.array([0, 1, 1, 2, 4]))
    at = {t: {(k, p): s for k, where, first in PM.active_phrases(h, goes_on, r, t, 3, 5) for p, s in zip(where.tolist(), first.tolist())}
          for t in range(9)}
    assert at[1] == {} and at[2] == at[4] == {(2, 0): 2, (2, 1): 2, (2, 4): 2} and at[5] == at[7] == {(3, 0): 5} and at[8] == {}


def test_phrase_odd_rows(spark, odd_docs, no_docs):
    assert PM.mine_phrases(no_docs).collect() == []
    out = PM.mine_phrases(odd_docs, threshold=3).collect()
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    assert {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in out} == brute_phrases(rows, 3, 2000)


def test_scores_pass_64_bits(spark):
    name = lambda *x: b"".join(struct.pack("<Q", i) for i in x)
    big = 3_000_000_000_000
    counts = spark.createDataFrame([(bytearray(name(1)), "en\na", big), (bytearray(name(2)), "en\nb", big + 1),
                                    (bytearray(name(1, 2)), None, big - 7)], "p binary, word string, n long")
    langs = spark.createDataFrame([("en", 9_000_000_000_000_001)], "lang string, n long")
    r = PM.best_cuts(counts, langs).collect()
    assert [(x["l"], x["r"], x["score"]) for x in r] == [(big, big + 1, 1000 * (big - 7) * 9_000_000_000_000_001 // (big * (big + 1)))]


# ---------------------------------------------------------------- vector codes


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(256 * np.array([v for _, v, _ in kept], np.float64)).astype(np.int64).reshape(len(kept), parts, -1)
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [x[order[:entries], j].copy() for j in range(parts)]

    def near(j):
        d = ((x[:, j][:, None, :] - books[j][None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)
    for _ in range(rounds):
        for j in range(parts):
            a, _ = near(j)
            for e in range(len(books[j])):
                if (a == e).any():
                    books[j][e] = [int(s) // int((a == e).sum()) for s in x[a == e, j].sum(0)]
    codes = np.stack([near(j)[0] for j in range(parts)], 1)
    error = sum(near(j)[1] for j in range(parts))
    return [(i, "".join(f"{c:02x}" for c in codes[k]), int(error[k])) for k, (i, _, _) in enumerate(kept)], books


def vector_rows(n, dims, seed=1, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, dims))
    rows = [(int(i), (centres[rng.integers(12)] + rng.normal(0, spread, dims)).astype(np.float32).tolist(), int(rng.integers(5)) or None)
            for i in rng.permutation(n)]
    rows += [rows[0], (rows[1][0], rows[2][1], 3), (None, rows[3][1], None), (n, rows[4][1], 1)]
    return rows + [(-1, None, 1), (-2, [float("nan")] * dims, 1), (-3, [float("inf")] + [0.0] * (dims - 1), 2), (-4, [None] + [0.0] * (dims - 1), 2)]


@pytest.mark.parametrize("n, dims, entries, chunk, spread", [(900, 8, 20, 200, 0.02), (30, 4, 64, 4096, 0.5), (600, 12, 16, 599, 2.0)])
def test_codes(spark, n, dims, entries, chunk, spread):
    rows = vector_rows(n, dims, spread=spread)
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int")
    out, books = V.encode_vectors(df.repartition(3), parts=4, entries=entries, rounds=2, chunk=chunk)
    expect, final = brute_codes(rows, 4, entries, 2)
    got = [(r["vec_id"], r["code"], r["error"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(expect, key=str) and len({r[1] for r in got}) > 5
    assert all((a == b).all() for a, b in zip(books, final))
    assert dict(out.dtypes)["label"] == "int"


def test_trees_own_whole_balls():
    rng = np.random.default_rng(2)
    centres = rng.integers(-400, 400, (10, 4))
    x = (centres[rng.integers(0, 10, 5000)] + rng.integers(-3, 4, (5000, 4)))
    points, weight = np.unique(x, axis=0, return_counts=True)
    tree = V.MetricTree(points, weight)
    nodes, middle, sums, order = packed = tree.packed()
    assert sorted(order.tolist()) == list(range(len(points))) and nodes["count"][0] == 5000
    for k in range(len(nodes)):
        at = order[nodes["lo"][k]:nodes["hi"][k]]
        assert weight[at].sum() == nodes["count"][k] and (weight[at] @ points[at] == sums[k]).all()
        assert (V._distances(points[at].astype(float), middle[k]) <= nodes["radius"][k] + 1e-6).all()
        if nodes["left"][k] >= 0:
            assert nodes["lo"][nodes["left"][k]] == nodes["lo"][k] and nodes["hi"][nodes["left"][k]] == nodes["lo"][nodes["right"][k]]
    book = np.concatenate([centres, centres[:2], x[:4]]).astype(np.int64)
    s, n, compared = V.walk(packed, points, weight, book)
    near = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert compared < len(points) and n.sum() == 5000
    for e in range(len(book)):
        assert n[e] == weight[near == e].sum() and (s[e] == weight[near == e] @ points[near == e]).all()
    give = np.full(len(points), -1)
    V.walk(packed, points, weight, book, give)
    assert (give == near).all()


def test_odd_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    assert V.encode_vectors(make([]))[0].collect() == [] and V.encode_vectors(make([(1, None, "a")]))[0].collect() == []
    out = V.encode_vectors(make([(1, [0.5, 0.25], "a"), (2, [1.0], "b"), (3, [], "c"), (1, [0.5, 0.25], None)]), parts=4)[0].collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in out if r["code"]) == [(1, "00000000", 0), (1, "00000000", 0)]
    assert sorted(r["vec_id"] for r in out if r["code"] is None and r["error"] is None) == [2, 3]
    assert [r["code"] for r in V.encode_vectors(make([(3, [], "c")]), parts=2)[0].collect()] == ["0000"]
    with pytest.raises(Exception, match="below 2\\*\\*23"):
        V.encode_vectors(make([(1, [1e9] * 4, "a")]), parts=4)


@pytest.mark.parametrize("few, share", [(100, 10_000), (1, 4)])
def test_groups_are_joined_whole(spark, monkeypatch, few, share):
    monkeypatch.setattr(S, "BROADCAST_GROUPS", few)
    monkeypatch.setattr(S, "HOT_SHARE", share)
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f"k{i % 40}") for i in range(300)], "i long, k string")
    groups = materialize(rows.groupBy("k").count(), "groups")
    out = S.join_groups(rows, groups.withColumn("twice", groups["count"] * 2), "k", "count").collect()
    size = Counter(None if i % 3 == 0 else f"k{i % 40}" for i in range(300))
    assert sorted(r["i"] for r in out) == list(range(300)) and all(r["twice"] == 2 * size[r["k"]] for r in out)


# ---------------------------------------------------------------- archives


def b32(x: bytes) -> str:
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def page_rows():
    rng = random.Random(4)
    same = "<p>" + words(rng, 400) + "</p>"
    rows = [(i, f"http://x/{i}", "<p>" + words(rng, rng.randrange(3, 300)) + "é\r\n\r\nWARC/1.1</p>") for i in range(60)]
    rows += [(100 + i, f"http://y/ {i}\r\nX-Page-ID: 9", same) for i in range(30)] + [(7, None, same), (7, "u", same), (None, "n", same), (None, None, None)]
    return rows + [(200, "e", None), (201, "e", ""), (202, "", "long " * 50_000), (3, "x", "<p>other</p>")]


def test_archives_round_trip(spark, tmp_path):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "clash", True) for r in rows], "page_id long, url string, html string, payload string, revisit boolean")
    files = Z.write_packages(pages.repartition(4), str(tmp_path / "w"), package_bytes=8_000)
    made = files.collect()
    assert sum(r["n_records"] for r in made) == len(rows) and len(made) > 4
    out = Z.read_packages(spark, files, with_payload=True, run_bytes=5_000).collect()
    assert len(out) == len(rows)
    payload = lambda h: (h or "").encode()
    key = lambda x: (x is not None, x or 0)
    groups = {}
    for i, _, h in rows:
        groups.setdefault(payload(h), []).append(i)
    expect = Counter()
    for h, ids in groups.items():
        ids = sorted(ids, key=key)
        for k, i in enumerate(ids):
            expect[i, len(h), b32(h), "response" if k == len(ids) - 1 else "revisit", None if k == len(ids) - 1 else ids[-1]] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out) == expect
    assert sorted(bytes(r["payload"]) for r in out if r["record_type"] == "response") == sorted(groups)
    assert {r["url"] for r in out if r["page_id"] == 100} == {"http://y/%200%0D%0AX-Page-ID:%209"}
    # other readers of the format agree
    with zipfile.ZipFile(made[0]["file"]) as z:
        assert z.testzip() is None and z.namelist() == [Z.ARCHIVE, Z.INDEX] and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}


def test_smaller_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "yyyy"), (4, "d", "yyyy"), (5, "e", "é2"), (6, "f", "é2")],
                                  "page_id long, url string, html string")
    out = Z.read_packages(spark, Z.write_packages(pages, str(tmp_path / "w"), least=3)).collect()
    assert {r["page_id"]: r["refers_to"] for r in out if r["record_type"] == "revisit"} == {3: 4, 5: 6}
    none = Z.write_packages(pages.where("page_id > 9"), str(tmp_path / "v"))
    assert none.collect() == [] and Z.read_packages(spark, none).collect() == []


def opened(raw: bytes) -> Z.ZipPackage:
    return Z.ZipPackage(lambda at, n: raw[at:at + n], len(raw))


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("comment, before", [(b"", b""), (b"PK\x05\x06 a note", b""), (b"", b"#!bytes before the archive\n")])
def test_zip_directories(zip64, comment, before):
    out = io.BytesIO()
    members = [("a.bin", b"one" * 1000), ("dir/ü.txt", b""), ("c", b"PK\x05\x06" * 9)]
    Z.write_zip(out, members, zip64, comment)
    raw = before + out.getvalue()
    p = opened(raw)
    for name, data in members:
        at, size = p.place(name)
        assert raw[at:at + size] == data
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert [(i.filename, z.read(i)) for i in z.infolist()] == members


def test_zip_files_of_other_writers():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open("streamed", "w", force_zip64=True) as f:
            f.write(b"x" * 5000)
        for i in range(70_000):  # over 65,535 entries: only the ZIP64 record counts them
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"%d" % i)
        z.writestr("packed", b"y" * 500, zipfile.ZIP_DEFLATED)
    raw = out.getvalue()
    p = opened(raw)
    assert len(p.members) == 70_002
    for name, data in (("streamed", b"x" * 5000), ("m0", b"0"), ("m69999", b"69999")):
        at, size = p.place(name)
        assert raw[at:at + size] == data
    with pytest.raises(ValueError, match="not stored"):
        p.place("packed")
    with pytest.raises(ValueError, match="no end"):
        opened(raw[:-30])


def test_a_changed_record_is_found():
    raw, digest = Z.warc_record(5, "u", b"some text", False, None)
    assert Z.parse_record(raw) | {"payload": b""} == {"page_id": 5, "url": "u", "record_type": "response", "refers_to": None, "payload": b"",
                                                      "payload_digest": digest, "payload_bytes": 9}
    import zlib

    spoiled = zlib.decompress(raw, 31).replace(b"some text", b"some tent")
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    with pytest.raises(ValueError, match="wrong digest"):
        Z.parse_record(c.compress(spoiled) + c.flush())
