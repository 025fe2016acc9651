"""Removal of word passages that an earlier document already has.

Prefix-partitioned suffix trees, without the suffixes that would hang alone:

1. Documents equal word for word to one with a smaller id are settled at once.
2. Sampling: among the ``PREFIX``-word prefixes that begin inside a window of
   ``WINDOW`` words, the one of smallest hash is sampled.  Equal windows sample
   equal prefixes, so a suffix whose sampled prefixes are in no second document
   would hang alone in the tree and is left out.
3. Suffixes that are left carry their first ``WINDOW`` words as numbers of 16
   bits.  They are cut at prefixes of as many words as it takes (the bounds of
   a range partition over these word sequences) into groups of about
   ``GROUP_ROWS`` suffixes, and each group is sorted by its words.
4. A group's sorted suffixes and the common prefixes of neighbours are its
   subtree: a node is a longest run of suffixes that have its depth in words in
   common.  Below the window no depth is looked at.  The nodes of the window's
   depth are the deep ones (told apart by a 64-bit fingerprint, too); of the
   suffixes below one, the smallest document keeps its words, all others lose
   theirs.  Neighbouring lost windows of a document, put together, are its
   maximal repeated spans, of any length.

Within a task, occurrences of a prefix or window in several documents are
settled there, and one row a task goes on, so a passage of very many documents
never gathers in one place.  Fingerprints are of 64 bits and more.

Null and empty texts have no words.  Rows with a null id are kept whole and
remove nothing; rows with one id do not remove each other's words.  Where ids
repeat, rows are named by a number of their own and the id only tells which
occurrence is earlier.
Documents of any length are taken whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import keyed, materialize, texts
from .text import U64, Words, cover, give_back, mix, pieces, window_starts, windows

WINDOW = 13
PREFIX = 7
GROUP_ROWS = 1_000_000
BROADCAST_IDS = 1_000_000
PIECE_BYTES = 8 << 20
ANNOUNCE = 1 << 30
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _summary(batches):
    for b in batches:
        n_words, sha = [], []
        for text in b.column(1):  # the words of one text at a time
            words = (text.as_py() or "").encode().split()
            n_words.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n_words, pa.int64()), pa.array(sha, pa.string())],
                                         names=["row", "doc_id", "n_words", "sha"])


def _sliding(x: np.ndarray, k: int, op) -> np.ndarray:
    """op over k consecutive values (length len(x) - k + 1)."""
    out, have = x, 1
    while have < k:
        step = min(have, k - have)
        out = op(out[:len(out) - step], out[step:])
        have += step
    return out


def sampled_prefixes(h: np.ndarray, first: np.ndarray, window: int = WINDOW, prefix: int = PREFIX):
    """(word positions whose prefix is the smallest of some window, hashes)."""
    n = len(h)
    grams = windows(h, prefix)
    w = window - prefix + 1
    if len(grams) < w:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    least = _sliding(grams, w, np.minimum)
    ok = window_starts(first, window, n)[:len(least)]
    least = np.where(ok, least, U64(0))
    padded = np.concatenate([np.zeros(w - 1, U64), least, np.zeros(w - 1, U64)])
    most = _sliding(padded, w, np.maximum)  # of the windows that hold a position
    at = np.flatnonzero((most == grams) & (most > 0))
    return at, grams[at]


def _prefix_rows(gone, window):
    def run(batches):
        copies = gone.value if gone is not None else None
        for b in pieces(batches, 1, PIECE_BYTES):
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if copies is not None:
                b = b.filter(pa.array(~np.isin(ids, copies)))
                ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not b.num_rows:
                continue
            w = Words(b.column(1))
            at, g = sampled_prefixes(w.hashes(), w.first, window)
            of = w.doc_of()[at]
            pos, doc = (at - w.first[of]).astype(np.int64), ids[of]
            order = np.lexsort((doc, g))
            g, doc, pos = g[order], doc[order], pos[order]
            edge, shared = _groups(g, doc)
            # settled here: dealt by place, not by prefix; one row a prefix tells the others
            key = np.where(shared, mix(doc.view(U64) * U64(0x9E3779B97F4A7C15) + pos.view(U64)), g)
            tell = edge & shared
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key, g[tell]]).view(np.int64)), pa.array(np.concatenate([doc, doc[tell]])),
                 pa.array(np.concatenate([np.where(shared, -1 - pos, pos), np.full(tell.sum(), ANNOUNCE)]).astype(np.int32))],
                names=["key", "doc", "pos"])
    return run


def _groups(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by (key, doc): first rows of groups, and the rows of
    groups with two documents or more."""
    n = len(key)
    edge = np.ones(n, bool)
    edge[1:] = key[1:] != key[:-1]
    if not n:
        return edge, edge
    first = np.flatnonzero(edge)
    last = np.append(first[1:], n) - 1
    many = doc[first] != doc[last]
    return edge, np.repeat(many, last - first + 1)


def _whole_groups(batches, n_keys: int):
    """Batches of sorted rows, regrouped so that no group is cut; a group has
    a row or a few for each input piece, so it is small."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for i in range(n_keys):
            k = b.column(i)
            new[1:] |= np.asarray(pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False), bool)
        if held:
            end = held[-1].slice(held[-1].num_rows - 1)
            new[0] = any(end.column(i)[0].as_py() != b.column(i)[0].as_py() for i in range(n_keys))
        at = np.flatnonzero(new)
        if len(at):
            cut = int(at[-1])
            ready = held + ([b.slice(0, cut)] if cut else [])
            if ready:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _shared_prefixes(batches):
    """Places whose sampled prefix is in two documents or more."""
    for b in _whole_groups(batches, 1):
        key, doc, pos = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        _, shared = _groups(key, doc)
        # a row that announces stands for two documents of its task
        told = np.isin(key, np.unique(key[pos == ANNOUNCE]))
        give = (pos < 0) | ((shared | told) & (pos != ANNOUNCE))
        pos = np.where(pos < 0, -1 - pos, pos)[give]
        yield pa.RecordBatch.from_arrays([pa.array(doc[give]), pa.array(pos.astype(np.int32))], names=["row", "pos"])


def word_numbers(h: np.ndarray) -> np.ndarray:
    """16 bits for every word; big-endian, so bytes sort as numbers."""
    return (mix(h ^ U64(0x71C9B8F0A53D2E17)) >> U64(48)).astype(">u2")


def suffix_words(numbers: np.ndarray, at: np.ndarray, window: int) -> pa.Array:
    """The first words of the suffixes from each place on, as bytes."""
    raw = np.stack([numbers[at + j] for j in range(window)], 1).astype(">u2")  # stack gives native numbers
    kind = pa.binary(2 * window)
    return pa.FixedSizeBinaryArray.from_buffers(kind, len(at), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def common_prefixes(words: np.ndarray) -> np.ndarray:
    """Words that each row of sorted suffixes has in common with the row
    before (0 for the first)."""
    out = np.zeros(len(words), np.int64)
    if len(words) > 1:
        differs = words[1:] != words[:-1]
        out[1:] = np.where(differs.any(1), differs.argmax(1), words.shape[1])
    return out


def tree_nodes(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) rows below each node of two suffixes or more that
    have ``depth`` words in common."""
    joined = common >= depth
    first = np.flatnonzero(~joined & np.append(joined[1:], False))
    last = np.flatnonzero(joined & ~np.append(joined[1:], False)) + 1
    return first, last


def _suffix_rows(window, row_is_id):
    def run(batches):
        for b in pieces(batches, 1, PIECE_BYTES):
            names = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = names if row_is_id else b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            w = Words(b.column(1))
            n = len(w)
            h = w.hashes()
            whole, numbers = windows(h, window), word_numbers(h)
            marks = np.zeros(n + 1, np.int64)
            lists = b.column(2)
            counts = np.diff(lists.offsets.to_numpy())
            of = np.repeat(np.arange(len(ids)), counts)
            marks[w.first[of] + lists.flatten().to_numpy()] = 1
            seen = np.zeros(n + 2, np.int64)
            np.cumsum(marks, out=seen[1:])
            i = np.flatnonzero(window_starts(w.first, window, n)[:len(whole)])
            i = i[seen[i + window - PREFIX + 1] > seen[i]]
            doc_at = w.doc_of()[i]
            doc, pos = ids[doc_at], (i - w.first[doc_at])
            order = np.lexsort((doc, whole[i]))
            i, doc, pos, doc_at = i[order], doc[order], pos[order], doc_at[order]
            row = names[doc_at]
            edge, _ = _groups(whole[i], doc)
            lowest = doc[np.flatnonzero(edge)][np.cumsum(edge) - 1] if len(doc) else doc
            lost = doc > lowest
            go = ~lost
            yield pa.RecordBatch.from_arrays(
                [suffix_words(numbers, i[go], window), pa.array(whole[i][go].view(np.int64)), pa.array(row[go]),
                 pa.array(pos[go].astype(np.int32)), pa.nulls(int(go.sum()), pa.list_(pa.int32())),
                 pa.nulls(int(go.sum()), pa.int64()) if row_is_id else pa.array(doc[go])], names=_SUFFIX)
            # windows settled in this task: one line for each row of the table
            at = np.flatnonzero(lost)
            if len(at):
                at = at[np.lexsort((pos[at], doc_at[at]))]
                rows, start = np.unique(doc_at[at], return_index=True)
                offsets = np.append(start, len(at)).astype(np.int32)
                m = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.array(names[rows]), pa.nulls(m, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(pos[at].astype(np.int32))), pa.nulls(m, pa.int64())],
                    names=_SUFFIX)
    return run


_SUFFIX = ["words", "path", "row", "pos", "lost", "doc_id"]  # no doc_id where it is the row


def _lost_leaves(window):
    """Suffixes below a deep node whose document is not the node's smallest."""
    def run(batches):
        for b in _whole_groups(batches, 2):
            raw = b.column(0).cast(pa.binary(2 * window))
            words = np.frombuffer(raw.buffers()[1], ">u2")[raw.offset * window:][:len(raw) * window].reshape(-1, window)
            path, row, pos = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            doc = b.column(4).to_numpy(zero_copy_only=False) if b.num_columns > 4 else row
            common = common_prefixes(words)
            common[1:][path[1:] != path[:-1]] = np.minimum(common[1:][path[1:] != path[:-1]], window - 1)
            first, end = tree_nodes(common, window)
            below = end - first
            at = np.repeat(first, below) + np.arange(below.sum()) - np.repeat(np.cumsum(below) - below, below)
            lost = at[doc[at] > np.repeat(doc[first], below)]  # sorted, so a node's smallest document comes first
            yield pa.RecordBatch.from_arrays([pa.array(row[lost]), pa.array(pos[lost])], names=["row", "pos"])
        give_back()
    return run


def _cut(window, with_text):
    def run(batches):
        for b in batches:
            out = []
            for text, one, more in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = text.encode().split() if text else []
                starts = np.array(sorted({*one, *(x for m in more for x in m)}), np.int64)
                gone = cover(starts, window, len(words))
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                ends = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None, ends.tolist()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()),
                 pa.array([r[2] for r in out], pa.string()), pa.array([r[3] for r in out], pa.list_(pa.int32()))],
                names=["row", "n_removed", "kept_sha256", "kept_text", "spans"])
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (removed word ranges as
    start, end, start, end, ...) and, if asked for, kept_text of the documents
    that lost words."""
    if window != WINDOW and window <= PREFIX:
        raise ValueError(f"window must be over {PREFIX} words")
    spark = docs.sparkSession
    d, row_is_id = keyed(texts(docs, "doc_id", "text"))
    d = d.select("row", "text", "doc_id")
    summary = materialize(d.mapInArrow(_summary, "row long, doc_id long, n_words long, sha string"), "summary")
    first = summary.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    copies = materialize(summary.where(F.col("n_words") >= window)
                         .join(first.where("n > 1"), "sha").where("doc_id > first_id").select("row"), "copies")
    known = d.where("doc_id is not null")
    shared = None
    if copies.count() <= BROADCAST_IDS:
        shared = spark.sparkContext.broadcast(np.sort(copies.toArrow().column(0).to_numpy().astype(np.int64)))
        firsts = known
    else:
        firsts = known.join(copies, "row", "left_anti")
    rows = firsts.select("row", "text").mapInArrow(_prefix_rows(shared, window), "key long, doc long, pos int")
    places = rows.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(_shared_prefixes, "row long, pos int")
    places = materialize(places.groupBy("row").agg(F.collect_list("pos").alias("places")), "places")
    own_id = [] if row_is_id else ["doc_id"]
    suffixes = _with(known, places).select("row", "text", "places", *own_id) \
        .mapInArrow(_suffix_rows(window, row_is_id), "words binary, path long, row long, pos int, lost array<int>, doc_id long")
    suffixes = materialize(suffixes, "suffixes")
    tree = suffixes.where("words is not null")
    parts = max(1, -(-tree.count() // GROUP_ROWS), spark.sparkContext.defaultParallelism)
    leaves = tree.select("words", "path", "row", "pos", *own_id).repartitionByRange(parts, "words", "path") \
        .sortWithinPartitions("words", "path", *(own_id or ["row"])).mapInArrow(_lost_leaves(window), "row long, pos int")
    one = leaves.groupBy("row").agg(F.collect_list("pos").alias("one"))
    more = suffixes.where("lost is not null").groupBy("row").agg(F.collect_list("lost").alias("more"))
    lost = materialize(one.join(more, "row", "full").select(
        "row", F.coalesce("one", F.array().cast("array<int>")).alias("one"),
        F.coalesce("more", F.array().cast("array<array<int>>")).alias("more")), "lost")
    cut = _with(known, lost).select("row", "text", "one", "more") \
        .mapInArrow(_cut(window, with_text), "row long, n_removed long, kept_sha256 string, kept_text string, spans array<int>")
    whole = copies.join(lost.select("row"), "row", "left_anti").select("row", F.lit(True).alias("copy"))
    out = summary.join(cut, "row", "left").join(whole, "row", "left")
    copy = F.coalesce("copy", F.lit(False))
    return out.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.array(F.lit(0), F.col("n_words").cast("int")))
        .otherwise(F.coalesce("spans", F.array().cast("array<int>"))).alias("spans"),
        *([F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []))


def _with(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents joined with what was found about them; the row numbers alone
    go to the scan first when they are known to be few, so only those texts
    move."""
    rows = found.select("row")
    if found.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(rows), "row", "left_semi")
    return docs.join(found, "row")


def op9(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")
