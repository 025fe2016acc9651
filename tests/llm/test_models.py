"""Trained models on held-out rows, the n-gram trie and the token files."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_texts import words
from turnframe.llm.eliasfano import EliasFano, NgramTrie
from turnframe.llm.html_text import FEATURES, attributes, main_text, named_words, trained_tree
from turnframe.llm.idcoder import decode_blocks, encode_blocks
from turnframe.llm.langid import ByteGru, identify, op6, train as train_langid, training_words
from turnframe.llm.mixing import mix_sources
from turnframe.llm.ngram_lm import MU, score_texts
from turnframe.llm.quality_model import grade_documents, train
from turnframe.llm.token_files import TextEncoder, join_crc32, read_token_files, token_files, write_token_files

SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 10), (1, 1), (5, 5), (1000, 1001), (500, 1 << 48), (300, 1 << 33)):
        v = np.sort(rng.choice(top, n, replace=False) if top < 10_000 else np.unique(rng.integers(0, top, n))).astype(np.uint64)
        e, _ = EliasFano.view(EliasFano.encode(v, top).to_bytes())
        assert (e.values() == v).all()
        ask = np.concatenate([v, rng.integers(0, top, 200).astype(np.uint64)])
        where = {int(x): i for i, x in enumerate(v)}
        assert e.find(ask).tolist() == [where.get(int(x), -1) for x in ask]


def test_trie_file(tmp_path):
    data = NgramTrie.build(np.array([3, 9, 70], np.uint64), 48, np.array([1, 2, 3]), np.array([0, 0, 2]), np.array([5, 8, 5], np.uint64),
                           np.array([10, 11, 12]))
    (tmp_path / "t").write_bytes(data)
    t = NgramTrie.open(str(tmp_path / "t"))
    w = t.find_words(np.array([9, 4, 70, 3], np.uint64))
    assert w.tolist() == [1, -1, 2, 0] and t.span(0) == (0, 2) and t.span(1) == (2, 2)
    assert t.find_pairs(w, np.array([5, 5, 5, 8], np.uint64)).tolist() == [-1, -1, 2, 1]
    assert t.pair_value.tolist() == [10, 11, 12]


def test_pairs_are_found_through_the_pointers():
    rng = np.random.default_rng(7)
    n = 400
    parent = np.sort(rng.integers(0, n, 3000))
    code = rng.integers(0, 1 << 32, 3000).astype(np.uint64)
    order = np.lexsort((code, parent))
    parent, code = parent[order], code[order]
    new = np.append(True, (parent[1:] != parent[:-1]) | (code[1:] != code[:-1]))
    parent, code = parent[new], code[new]
    words = np.unique(rng.integers(0, 1 << 48, 4 * n).astype(np.uint64))[:n]
    t = NgramTrie(NgramTrie.build(words, 48, np.zeros(n), parent, code, np.arange(len(code))))
    at = np.concatenate([np.arange(n), np.full(5, -1)])
    for c in (code, rng.integers(0, 1 << 32, 200).astype(np.uint64)):
        w = rng.choice(at, len(c))
        where = {(int(p), int(x)): i for i, (p, x) in enumerate(zip(parent, code))}
        assert t.find_pairs(w, c).tolist() == [where.get((int(a), int(b)), -1) for a, b in zip(w, c)]
    assert t.find_pairs(parent, code).tolist() == list(range(len(code)))
    # level 2 holds relative codes: without the right span a pair is not there
    moved = t.pointers
    t.pointers, _ = EliasFano.view(EliasFano.encode(np.minimum(moved.values() + np.uint64(1), np.uint64(len(code))), len(code) + 1).to_bytes())
    assert (t.find_pairs(parent, code) == np.arange(len(code))).mean() < 0.9
    # a level takes little more than its low bytes and two bits a value
    assert len(t.before.to_bytes()) < len(code) * 6


@pytest.mark.parametrize("shard_tokens", [250_000, 40])
def test_language_model(make_docs, shard_tokens):
    rng = random.Random(8)
    texts = [("The " + words(rng, rng.randrange(60)) + " the THE of the ") * rng.randrange(1, 3) for _ in range(40)] + [None, "", "new words"]
    train_ = [i % 5 != 1 for i in range(len(texts))]
    tokens = [[x.lower() for x in (t or "").split()] + [None] for t in texts]
    c1, c2 = Counter(), Counter()
    for t, use in zip(tokens, train_):
        if use:
            c1.update(t)
            c2.update(zip(["<s>", *t], t))
    n, z = sum(c1.values()), sum(c1.values()) + 0.5 * (len(c1) + 1)
    out = {r["doc_id"]: r for r in score_texts(make_docs(texts), F.col("doc_id") % 5 != 1, shard_tokens=shard_tokens).collect()}
    for i, t in enumerate(tokens):
        base = sum(math.log10((c1[x] + 0.5) / z) for x in t)
        full = sum(math.log10((c2[v, x] + MU * (c1[x] + 0.5) / z) / ((sum(train_) if v == "<s>" else c1[v]) + MU))
                   for v, x in zip(["<s>", *t], t))
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c1[x] > 0 for x in t), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert abs(r["score"] - full) < 2e-4 * len(t)


def test_equal_pieces_are_scored_each(spark):
    rng = random.Random(10)
    texts = ["the " + words(rng, 30) + " the end", "the end of the end", "other words here"]
    ids = [0, 0, 1, 0, 2]
    rows = [texts[i] for i in ids]
    one_row_parts = spark.sparkContext.parallelize(list(zip(ids, rows)), len(ids))
    out = score_texts(spark.createDataFrame(one_row_parts, "doc_id long, text string"), F.lit(True)).collect()
    tokens = [[*t.split(), None] for t in rows]
    c1, c2 = Counter(x for t in tokens for x in t), Counter(x for t in tokens for x in zip(["<s>", *t], t))
    n, z = sum(c1.values()), sum(c1.values()) + 0.5 * (len(c1) + 1)
    assert sorted(r["doc_id"] for r in out) == sorted(ids)
    for r in out:
        t = [*texts[r["doc_id"]].split(), None]
        base = sum(math.log10((c1[x] + 0.5) / z) for x in t)
        full = sum(math.log10((c2[v, x] + MU * (c1[x] + 0.5) / z) / ((len(rows) if v == "<s>" else c1[v]) + MU))
                   for v, x in zip(["<s>", *t], t))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), len(t), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert abs(r["score"] - full) < 2e-4 * len(t)


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    blocks = [np.zeros(0, int), np.array([65535]), rng.integers(0, 65536, 700), np.full(3000, 9), np.arange(2500) % 13,
              rng.zipf(1.4, 1500) % 50_000]
    data = encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, decode_blocks(data, [len(b) for b in blocks])))
    assert len(data[3]) < 200 and len(data[4]) < 400
    # a block does not depend on those coded beside it
    assert encode_blocks(blocks[3:4]) == data[3:4]
    assert (decode_blocks(data[5:], [1500])[0] == blocks[5]).all()


def test_words_seen_again_are_not_encoded_again():
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encode = TextEncoder(f.read(), keep=200)
    direct, learned, learn = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], encode._learn
    encode._learn = lambda new: learned.extend(new) or learn(new)
    often = [f" often{c}" for c in "abcdefghij"]
    for k in range(40):
        rare = [f" {chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i)}" for i in range(20)]
        text = "".join(w + sign for w in often + rare for sign in (",", ".", "!?", ""))
        (ids,) = encode([text])
        assert np.frombuffer(ids, "<u2").tolist() == direct.encode(text, add_special_tokens=False).ids
    assert all(learned.count(w) == 1 for w in often)  # neither forgotten nor known once for every sign after it
    assert len(learned) <= 40 * 20 + 20


def test_texts_encoded_by_pieces():
    t = Tokenizer.from_file(TOKENIZER)
    with open(TOKENIZER, encoding="utf-8") as f:
        encode = TextEncoder(f.read(), keep=500)
    rng = random.Random(6)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u3000", "\x1c", "\x85", "it's", "a", "Abc", "12", "3.5", "é漢", "!?", "<|endoftext|>",
             "<|", "_", "'ll", "\u200b", "x" * 40, "\x00", "\ufeff"]
    for _ in range(40):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(30)] + [None, ""]
        assert [np.frombuffer(x, "<u2").tolist() for x in encode(texts)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_joined_checksums():
    a, b = b"first part", b"second part, longer"
    assert join_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert join_crc32(zlib.crc32(a), 0, 0) == zlib.crc32(a)


def test_token_files(spark, odd_docs, tmp_path):
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in odd_docs.collect()))
    t = Tokenizer.from_file(TOKENIZER)
    expect, at = [], 0
    for known, i, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        expect.append((i if known else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    folder = str(tmp_path / "tokens")
    write_token_files(odd_docs, TOKENIZER, folder, block_ids=300, lanes=7)
    out = read_token_files(spark, folder, with_ids=True).collect()
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in out), key=lambda r: r[1])
    assert [g[1:] for g in got] == [e[1:] for e in expect]
    assert sorted((g[0] or 0) for g in got) == sorted((e[0] or 0) for e in expect)


def test_damaged_block_is_found(spark, make_docs, tmp_path):
    folder = str(tmp_path / "tokens")
    write_token_files(make_docs(["some text here", "and more"]), TOKENIZER, folder)
    bad = spark.read.parquet(folder).withColumn("crc32", F.col("crc32") + 1)
    bad.write.parquet(folder + "2")
    with pytest.raises(Exception, match="checksum"):
        read_token_files(spark, folder + "2").collect()


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randrange(1, 60)), None if i % 7 == 3 else "abcdef"[min(5, i % 11)]) for i in range(3000)]
    rows += [(9000, None, "z"), (9001, "w " * 400, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(docs).collect()
    again = mix_sources(docs.repartition(5)).collect()
    assert sorted(r["taken"] for r in out) == sorted(r["taken"] for r in again) and len(out) == len(rows)
    assert {r["doc_id"]: r["taken"] for r in out} == {r["doc_id"]: r["taken"] for r in again}
    by = {}
    for r in out:
        s = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["taken"]
        s[1] += r["size"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    total = sum(s[1] for s in by.values())
    weight = {x: i % 3 + 1 for i, x in enumerate(sorted(by, key=lambda x: (x is None, x or "")))}
    assert math.isclose(sum(s[2] for s in by.values()), total)
    for x, (taken, size, target, source_size) in by.items():
        assert size == source_size and abs(taken - target) <= 0.5 and target <= 3 * size + 1e-6
    free = {s[2] / weight[x] for x, s in by.items() if s[2] < 3 * s[1] - 1e-6}
    assert max(free) - min(free) < 1e-6 * max(free)
    whole = mix_sources(docs, boundary="nearest").collect()
    assert all(r["taken"] == r["copies"] * r["size"] for r in whole)


def test_quality_on_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = train(docs, labels.where("doc_id % 2 = 0"))
    assert model.thresholds[0] < model.thresholds[1]
    rated = labels.where("doc_id % 2 = 1").join(grade_documents(docs, model), "doc_id").collect()
    good = [r["kept"] for r in rated if r["quality"] == 1 and r["toxic"] == 0]
    toxic = [r["kept"] for r in rated if r["toxic"] == 1]
    poor = [r["kept"] for r in rated if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(toxic) < 0.05 and np.mean(poor) < 0.1


def test_language_on_held_out(spark):
    out = op6(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = out.where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_sample(spark):
    """Every language is sampled, long words are whole, and the rows' places
    do not matter."""
    rng = random.Random(4)
    rows = [(i, words(rng, 20), "en") for i in range(400)] + [(1000 + i, "漢字仮名交文" * 40, "zz") for i in range(3)]
    rows += [(5, "other text", "en"), rows[7], rows[8], (None, "no id", "fr"), (9000, None, "qq"), (9001, "text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = training_words(docs, train_docs=60, lang_docs=4)
    assert found == training_words(docs.repartition(7), train_docs=60, lang_docs=4)
    assert set(found[1]) == {"en", "zz", "fr"} and max(map(len, found[0])) == 48
    whole = len("漢字仮名交文".encode()) * 40
    assert sum(len(w) for w, x in zip(*found) if x == "zz") == 3 * whole
    a, b = train_langid(docs, 60), train_langid(docs.repartition(5), 60)
    assert a.langs == b.langs and all((a.p[k] == b.p[k]).all() for k in a.p)
    out = {r["doc_id"]: r["lang_pred"] for r in identify(docs, a).collect()}
    assert all(out[1000 + i] == "zz" for i in range(3)) and out[3] == "en"


def test_gru_gradient():
    m = ByteGru.new(["a", "b", "c"], 4)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    ids = np.frombuffer(b"abcdeabcxyzz", np.uint8).reshape(3, 4)
    args = ids, np.array([0, 1, 2]), np.array([1.0, 2.0, 0.5])
    _, g = m.gradient(*args)
    for k in m.p:
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old, e = m.p[k][i], 1e-3
        m.p[k][i] = old + e
        up = m.gradient(*args)[0]
        m.p[k][i] = old - e
        down = m.gradient(*args)[0]
        m.p[k][i] = old
        assert math.isclose(g[k][i], (up - down) / (2 * e), rel_tol=1e-3)


def test_html_blocks():
    page = """<html><head><title>t</title></head><body><div id=top><a href=1>Home</a> <a href=2>News</a></div>
      <div class="cookie-banner">We use cookies.</div><main><header><h1>Title &amp; more</h1></header><p>First   para&nbsp;graph with
      <b>bold</b>text &lt;x&gt;.</p><p>One.<p>Two<br>lines<ul><li>item one</li></ul><div class="ad">Buy now!</div>
      <section id="comments"><p>a reader says a long thing about all this text.</p></section></main>
      <aside><p>Popular text here is long enough to be prose, really.</p></aside><form><p>Sign up</p></form><footer>foot</footer>
      <script>x<p>no</p></script><!-- <p>not this</p> --></body>"""
    assert main_text(page).split("\n") == ["Title & more", "First para graph with boldtext <x>.", "One.", "Two lines", "item one"]
    used = {FEATURES[n[0]] for n in trained_tree().nodes if n[0] >= 0}
    assert {"words", "link_density"} <= used and used & {"words_before", "links_before"} and used & {"words_after", "links_after"}


def prose(rng, n=4):
    return [words(rng, rng.randrange(25, 70)) + "." for _ in range(n)]


MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2024 the site.</p></footer>"
#: Layouts that are not among the labelled pages; {} is the text.
LAYOUTS = [
    '<div class="layout has-sidebar">' + MENU + "<article>{}</article>" + FOOT + "</div>",
    '<div class="layout with-sidebar">' + MENU + '<div class="x">{}</div><div class="sidebar"><p>Popular now</p></div></div>',
    '<div class="site no-header">' + MENU + "<main>{}</main></div>",
    MENU + '<article class="post type-post tag-foo category-legal">{}</article>',
    MENU + '<article class="post side-effects-of-x">{}</article>',
    MENU + '<article data-id="sidebar" title="hidden gems of Rome">{}</article>' + FOOT,
    '<form id="aspnetForm" method="post"><input type="hidden" name="v">' + MENU + "<article>{}</article></form>" + FOOT,
    '<form id="aspnetForm" method="post">' + MENU + '<div id="ctl00_body">{}</div>' + FOOT + "</form>",
    '<div id="sidebar-layout">' + MENU + "<div>{}</div></div>" + FOOT,
    MENU + '<article>{}</article><section id="comments"><article class="comment"><p>A reader says quite a lot of things about all this.</p>'
    "</article></section>" + FOOT,
    '<div role="banner"><a href="/">Site</a></div><div class="wrap"><div class="ad-slot"><p>Buy this thing now and be glad about it.</p></div>'
    '<div class="col">{}</div></div><div class="related-posts"><h3>More</h3><ul><li><a href="/1">One more text</a></li></ul></div>',
    MENU + "<article>{}<footer><p>Filed under things and more things.</p></footer></article>",
    "<aside><div class=content><p>A long enough text on the side that is no article at all, is it.</p></div></aside><main>{}</main>",
]


@pytest.mark.parametrize("layout", range(len(LAYOUTS)))
def test_html_layouts(layout):
    rng = random.Random(layout)
    for n in (3, 6):
        text = prose(rng, n)
        html = LAYOUTS[layout].format("".join(f"<p>{x}</p>" for x in text))
        assert main_text(f"<html><head><title>t</title></head><body>{html}</body></html>").split("\n") == text


def test_html_inner_parts():
    rng = random.Random(8)
    a, b, c = prose(rng, 3)
    page = (f'{MENU}<article><div class="entry-header"><h1>The title</h1></div><p>{a}</p><p><a href="/x">One link and nothing else</a></p>'
            f"<p>{b}</p><select><option>one<option>two<p>{c}</p></article>{FOOT}")
    assert main_text(page).split("\n") == ["The title", a, "One link and nothing else", b, c]
    assert main_text(f"<article><p>{a}</p><select><option>x</select><p>{b}</p><select><option>y</select></article>").split("\n") == [a, b]
    assert main_text(f"<article><p>{a}</p><svg><text>x</text><p>{b}</p></article>") == f"{a}\n{b}"
    assert main_text(f"<article><p>{a}</p><script>var x = '<p>no</p>';") == a


def test_html_attributes():
    found = attributes(' class="a b" data-class="ad" title="x class=menu hidden" CLASS=menu id = \'k\' hidden aria-hidden=true/')
    assert found["class"] == "a b" and found["id"] == "k" and found["title"] == "x class=menu hidden" and found["hidden"] == ""
    assert named_words("has-sidebar tag-legal side-effects-of-x postBody side left-side") == {"post", "body", "side", "left"}


def test_html_neighbours_decide():
    """The same short block is text among prose, and other matter among links."""
    rng = random.Random(2)
    a, b, c = prose(rng, 3)
    links = "".join(f'<div><a href="/{i}">{words(rng, 4)}</a></div>' for i in range(3))
    short = "<div>alpha1 beta2 gamma3</div>"
    page = f'<div class="c1">{links}{short}{links}</div><div class="c1"><p>{a}</p>{short}<p>{b}</p><p>{c}</p></div><div class="c1">{links}</div>'
    assert main_text(page).split("\n") == [a, "alpha1 beta2 gamma3", b, c]
