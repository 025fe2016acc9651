"""Similarity join, repeated passages and contamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from corpus_texts import words
from turnframe.llm import jaccard_join as J
from turnframe.llm import substring_dedup as D
from turnframe.llm.components import connected_components
from turnframe.llm.decontaminate import find_contamination, item_words
from turnframe.llm.substring_dedup import remove_repeats


def _edited(rng, text, share):
    w = text.split()
    return " ".join(words(rng, 1) if rng.random() < share else x for x in w)


def family_texts():
    """Near copies around the threshold, a frequent passage, short texts."""
    rng = random.Random(1)
    out, passage = [], words(rng, 60)
    for n in (5, 6, 8, 9, 13, 20, 45, 90, 200, 400):
        base = words(rng, n)
        out += [base, base] + [_edited(rng, base, s) for s in (0.005, 0.01, 0.02, 0.03, 0.04, 0.06)]
        out += [base + " " + words(rng, k) for k in (1, 1, 2, 4, n // 4)]
    out += [passage + " " + words(rng, k) for k in (1, 2, 3, 5, 8, 12, 12, 13, 14, 15, 16, 17, 30, 100)]
    hot = words(rng, 80)
    out += [_edited(rng, hot, 0.02) for _ in range(40)]
    loud = words(rng, 70)
    out += [loud, loud.upper(), _edited(rng, loud.title(), 0.01), "ÀB c d É f " + loud, "àb C D é F " + loud]
    return out + ["", " ", "a b", "a b", "a b c d", None]


def brute_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts, similar=80):
    sets = [brute_set(t) for t in texts]
    low = list(range(len(texts)))
    links = [(i, j) for i, x in enumerate(sets) for j in range(i)
             if (both := len(x & sets[j])) and 100 * both >= similar * (len(x) + len(sets[j]) - both)]
    while True:
        before = list(low)
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
        if low == before:
            return low, [len(s) for s in sets]


@pytest.mark.parametrize("group", [2, 24])
def test_similar_sets(make_docs, group):
    texts = family_texts()
    low, sizes = brute_components(texts)
    assert sum(a != b for a, b in zip(low, range(len(texts)))) > 50
    out = {r["doc_id"]: r for r in J.near_duplicates(make_docs(texts), group=group).collect()}
    assert [out[i]["component_id"] for i in range(len(texts))] == low
    assert [out[i]["n_shingles"] for i in range(len(texts))] == sizes


def test_similar_sets_of_repeated_ids(spark):
    rng = random.Random(13)
    rows = []
    for i in range(12):
        a, b = words(rng, 40), words(rng, 60)
        rows += [(i, a), (i, b), (100 + i, a + " " + words(rng, 2)), (200 + i, b + " " + words(rng, 2)), (100 + i, words(rng, 30))]
    alone = words(rng, 50)
    rows += [(None, alone), (None, alone), (300, alone + " more"), (None, words(rng, 20)), (None, None), (None, "new " + alone)]
    low = [(x is None, x or 0) for x, _ in rows]
    grams = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in ((t or "").split() for _, t in rows)]
    links = [(i, j) for i, x in enumerate(grams) for j in range(i) if x and 100 * len(x & grams[j]) >= 80 * len(x | grams[j])]
    for _ in rows:
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    out = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((key(r["doc_id"]), r["n_shingles"], key(r["component_id"])) for r in out) == \
        sorted((key(x), len(g), c) for (x, _), g, c in zip(rows, grams, low))


def test_texts_with_a_common_passage_are_no_pairs(make_docs, monkeypatch):
    rng = random.Random(21)
    passage = words(rng, 30)
    texts = [f"{words(rng, 6)} {passage} {words(rng, 6)}" for _ in range(120)]  # similar to none
    base = words(rng, 50)
    texts += [base + " " + words(rng, 2) for _ in range(4)]
    pairs = []
    verified = J._Join.verified
    monkeypatch.setattr(J._Join, "verified", lambda self, p: pairs.append(p.count()) or verified(self, p))
    out = {r["doc_id"]: r["component_id"] for r in J.near_duplicates(make_docs(texts)).collect()}
    assert [out[i] for i in range(len(texts))] == brute_components(texts)[0]
    assert sum(pairs) <= len(texts) + 20, pairs  # one pair a class at first, then those that the sketches leave


def test_folded_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(8)
    for n in (1, 30, 300, 2000):
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        for differ in (0, 1, n // 10, n):
            b = np.concatenate([a[differ:], rng.integers(0, 1 << 62, differ).astype(np.uint64)])
            x, y = J.parity_sketches(np.repeat([0, 1], n), np.concatenate([a, b]), np.array([n, n]))
            assert len(J.folded(x)) == J.FOLD
            bits = int(np.bitwise_count(J.folded(x) ^ J.folded(y)).sum())
            assert bits <= J.least_difference(x, y) <= 2 * differ
            assert n != 30 or differ < n or bits > 40


def test_signatures_meet_unless_out_of_slack():
    rng = np.random.default_rng(4)
    for n in (5, 7, 12, 30, 100, 600):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            differ = J.max_difference(2 * len(a), 80) // 2
            b = np.unique(np.concatenate([a[differ:], rng.integers(0, 1 << 62, differ).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            doc = np.repeat([0, 1], [len(a), len(b)])
            sig, of, left = (np.concatenate(x) for x in zip(*J.signatures(doc, np.concatenate([a, b]), np.array([len(a), len(b)]))))
            met = np.intersect1d(sig[of == 0], sig[of == 1])
            assert len(met) or (left < 0).any() or both == len(a) == len(b)
            s = J.parity_sketches(doc, np.concatenate([a, b]), np.array([len(a), len(b)]))
            assert J.least_difference(*s) <= len(a) + len(b) - 2 * both


def test_groups_over_batch_edges():
    import pyarrow as pa

    rows = sorted([(1, 5, 0), (2, 1, 0), (2, 3, 0), (2, 3, 0), (2, 9, 0), (3, 4, 0), (4, 6, 0), (4, 7, 0), (8, 8, -1)])
    for cut in range(1, len(rows)):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], pa.int64() if k < 2 else pa.int32()) for k in range(3)],
                                              names=["sig", "class", "left"]) for part in (rows[:cut], rows[cut:])]
        got = sorted((r["sig"], r["class"], r["leader"]) for b in J._shared_groups(batches) for r in b.to_pylist())
        assert got == [(2, 1, 1), (2, 3, 1), (2, 9, 1), (4, 6, 6), (4, 7, 6), (8, 8, 8)], cut


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)]
    low = {x: x for e in links for x in e}
    for _ in links:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {k: v for k, v in low.items() if any(k in e and e[0] != e[1] for e in links)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_repeats(make_docs):
    rng = random.Random(3)
    passage, hot = words(rng, 55), words(rng, 20)
    texts = [words(rng, 30) + " " + passage + " " + words(rng, 10), words(rng, 12), passage, None, "", passage + " tail"]
    texts += [words(rng, rng.randrange(0, 40)) + " " + hot + "\n" + words(rng, rng.randrange(0, 40)) for _ in range(30)]
    texts += [" ".join(passage.split()[3:17]), " ".join(passage.split()[5:17]), "a " * 40, "a " * 20, texts[0]]
    first, expect = {}, []
    for i, t in enumerate(texts):
        w = (t or "").split()
        gone = set()
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k:k + 13]), i) < i:
                gone |= set(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expect.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if gone else None))
    out = {r["doc_id"]: r for r in remove_repeats(make_docs(texts), with_text=True).collect()}
    got = [(r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"] if r["n_removed"] else None)
           for r in (out[i] for i in range(len(texts)))]
    assert got == expect
    assert out[2]["spans"] == [0, 55] and sum(e[1] for e in expect) > 500


def test_tree_nodes():
    """Nodes of every depth: all suffixes with one beginning, found among
    sorted neighbours."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        words = rng.integers(0, 3, (rng.integers(0, 60), 5)).astype(">u2")
        words = words[np.lexsort(words.T[::-1])] if len(words) else words
        common = D.common_prefixes(words)
        rows = [tuple(w) for w in words.tolist()]
        for depth in range(1, 6):
            first, end = D.tree_nodes(common, depth)
            groups = {}
            for i, w in enumerate(rows):
                groups.setdefault(w[:depth], []).append(i)
            assert list(zip(first.tolist(), end.tolist())) == sorted((g[0], g[-1] + 1) for g in groups.values() if len(g) > 1)
    h = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    numbers = D.word_numbers(h)
    got = D.suffix_words(numbers, np.array([0, 7]), 13).to_pylist()
    assert got == [numbers[k:k + 13].tobytes() for k in (0, 7)] and D.suffix_words(numbers, np.zeros(0, int), 13).to_pylist() == []


def test_repeats_of_repeated_ids(spark):
    rng = random.Random(11)
    a, b, c = words(rng, 30), words(rng, 20), words(rng, 25)
    rows = [(1, a), (2, words(rng, 40) + " " + a + " " + words(rng, 9)), (3, b), (4, c), (7, a), (7, words(rng, 18)),
            (5, words(rng, 60) + " " + b), (5, b + " " + words(rng, 3)), (5, words(rng, 14)), (5, c + " " + c), (None, a), (None, b),
            (2, words(rng, 40) + " " + a + " " + words(rng, 9)), (6, words(rng, 5) + " " + c), (9, words(rng, 50) + " " + words(rng, 15))]
    rows += [rows[1], rows[6], (8, rows[14][1].split(" ", 20)[20])]
    first = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 12 if i is not None else 0):
            first[tuple(w[k:k + 13])] = min(i, first.get(tuple(w[k:k + 13]), i))
    expect = []
    for i, t in rows:
        w = t.split()
        gone = {p for k in range(len(w) - 12 if i is not None else 0) if first[tuple(w[k:k + 13])] < i for p in range(k, k + 13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expect.append((i or 0, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    out = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == sorted(expect)


@pytest.mark.parametrize("window", [8, 12, 16])
def test_repeats_of_other_windows(make_docs, window):
    rng = random.Random(12)
    passages = [words(rng, n) for n in range(6, 22)]
    texts = passages + [words(rng, rng.randrange(20)) + " " + p + " " + words(rng, rng.randrange(20)) for p in passages for _ in range(2)]
    first, expect = {}, []
    for i, t in enumerate(texts):
        w, gone = t.split(), set()
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k:k + window]), i) < i:
                gone |= set(range(k, k + window))
        expect.append((len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    out = {r["doc_id"]: r for r in remove_repeats(make_docs(texts), window=window).collect()}
    assert [(out[i]["n_words"], out[i]["n_removed"], out[i]["kept_sha256"]) for i in range(len(texts))] == expect


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_contamination(spark, make_docs, block_words):
    rng = random.Random(6)
    items = [words(rng, n) for n in (40, 13, 14, 12, 5, 2, 1, 30)] + ["", None, "!!"]
    texts = [words(rng, 50) + " " + x + " " + words(rng, 60) for x in items if x] + [
        " ".join(items[0].split()[4:20]).upper() + "; " + items[1].replace(" ", "--"), items[4] + " " + items[5] * 3, None, "", "..", words(rng, 300)]
    found = find_contamination(make_docs(texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"),
                               block_words=block_words).collect()
    grams = {}
    for i, x in enumerate(items):
        w = item_words(x)
        for k in range(max(1, len(w) - 12) if w else 0):
            grams.setdefault(tuple(w[k:k + 13]), set()).add(str(i))
    for r in found:
        w, hit, ids = item_words(texts[r["doc_id"]]), set(), set()
        for k in range(len(w)):
            for n in range(1, 14):
                if k + n <= len(w) and tuple(w[k:k + n]) in grams:
                    hit |= set(range(k, k + n))
                    ids |= grams[tuple(w[k:k + n])]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(ids))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
