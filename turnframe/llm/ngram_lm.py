"""Language model scores from an Elias-Fano n-gram trie of order 2.

Tokens are words (A-Z lower-cased) and one end a text.  The model is the
Dirichlet-smoothed bigram model

    p(w | v) = (c(v w) + MU * p1(w)) / (c(v) + MU),  p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

with counts over the training documents; c(start) is their number.  Its
numerator depends on what is known at the word w, its denominator on what is
known at the word v, so a text's score is a sum of terms found word by word.

1. Vocabulary: distinct words of each piece of the corpus with their counts,
   added up by Spark.  N, V and the very frequent words (``HOT`` of them at
   most) go to the driver.
2. Every piece deals its distinct (word before, word) pairs, with training
   counts and the documents they occur in, to shards by a hash of the word;
   pairs of very frequent words are dealt by both words.  A row is one piece's
   part of one shard, with its codes as Elias-Fano sequences.  One more row a
   piece, its head, has the documents' ids and sizes and passes through.
3. A shard merges the counts into its part of the trie (see ``eliasfano``)
   with quantised logarithms, and looks all its pairs up in it.  Sums by
   document go back to the pieces, which add them up; equal pieces share them.

Words are known by 48 bits of a hash beside the shard's number, words before
by 32 bits relative to their word.  Null and empty texts have one token, the
end.  Rows with a null id are scored and are not trained on; repeated rows
count and are scored each; without training documents N is 0.
"""

from __future__ import annotations

import mmap

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eliasfano import EliasFano, NgramTrie
from .staging import held_out_hash, materialize
from .text import PLAIN, U64, Words, mix, pieces

MU = 500.0
SHARD_TOKENS = 250_000
HOT = 100_000
PIECE_BYTES = 4 << 20
CODE_BITS = 48
LEVELS = (1 << 16) - 1
END, START = U64(0x1234567F9ABCDEF1), U64(0x0FEDCBA987654321)


def _tokens(col: pa.Array):
    """(token hashes, hash of the token before, document index, first token
    of each document); every document ends with END."""
    w = Words(col, PLAIN, lower=True)
    n = len(w) + w.n_docs
    first = w.first + np.arange(w.n_docs + 1)
    token = np.full(n, END)
    is_word = np.ones(n, bool)
    is_word[first[1:] - 1] = False
    token[is_word] = w.hashes()
    before = np.concatenate([[START], token[:-1]]) if n else token
    before[first[:-1]] = START
    return token, before, np.repeat(np.arange(w.n_docs), np.diff(first)), first


def _vocabulary(batches):
    for b in pieces(batches, 1, PIECE_BYTES):
        train = np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool)
        token, _, doc, _ = _tokens(b.column(1))
        word, count = np.unique(token[train[doc]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], names=["word", "n"])


def _small(x: np.ndarray) -> bytes:
    """An array of counts in the fewest bytes a value; the first byte says."""
    top = int(x.max()) if len(x) else 0
    kind = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([kind]) + x.astype(f"<u{kind}").tobytes()


def _read_small(buf, n: int, at: int) -> tuple[np.ndarray, int]:
    kind = buf[at]
    return np.frombuffer(buf, f"<u{kind}", n, at + 1).astype(np.int64), at + 1 + n * kind


def _starts(*keys) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _deal(shared):
    def run(batches):
        hot, shards = shared.value["hot"], shared.value["shards"]
        for b in pieces(batches, 1, PIECE_BYTES):
            train = np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool)
            token, before, doc, first = _tokens(b.column(1))
            code = token >> U64(64 - CODE_BITS)
            code1 = mix(before ^ U64(0xA5A5A5A55A5A5A5A)) >> U64(32)
            h = mix(token ^ U64(0x3C3C3C3CC3C3C3C3))
            if len(hot):
                at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                frequent = hot[at] == token
                h[frequent] = mix(h[frequent] + before[frequent])
            shard = (h % U64(shards)).astype(np.int64)
            order = np.lexsort((code1, code, shard))
            shard, code, code1, doc_ = shard[order], code[order], code1[order], doc[order]
            entry = _starts(shard, code, code1, doc_)  # one document's occurrences of a pair
            times = np.diff(np.append(entry, len(order)))
            shard, code, code1, doc_ = shard[entry], code[entry], code1[entry], doc_[entry]
            pair = _starts(shard, code, code1)
            docs_of = np.diff(np.append(pair, len(entry)))
            trained = np.add.reduceat(times * train[doc_], pair) if len(pair) else np.zeros(0, np.int64)
            p_shard, p_code, p_code1 = shard[pair], code[pair], code1[pair]
            word = _starts(p_shard, p_code)
            w_shard = p_shard[word]
            name = int(mix(np.array([hash_of(b)], U64))[0] >> U64(1))
            out_shard, blobs = [], []
            edges = np.flatnonzero(np.append(True, w_shard[1:] != w_shard[:-1])) if len(w_shard) else np.zeros(0, np.int64)
            entry_at = np.append(pair, len(entry))
            pair_at = np.append(word, len(pair))
            for i, w0 in enumerate(edges.tolist()):
                w1 = int(edges[i + 1]) if i + 1 < len(edges) else len(word)
                p0, p1 = int(pair_at[w0]), int(pair_at[w1])
                e0, e1 = int(entry_at[p0]), int(entry_at[p1])
                of = np.repeat(np.arange(w1 - w0), np.diff(pair_at[w0:w1 + 1]))
                keys = (of.astype(U64) << U64(32)) | p_code1[p0:p1]
                blobs.append(b"".join([
                    np.array([w1 - w0, p1 - p0, e1 - e0, b.num_rows], "<i8").tobytes(),
                    EliasFano.encode(p_code[word[w0:w1]], 1 << CODE_BITS).to_bytes(),
                    EliasFano.encode(keys, (w1 - w0) << 32).to_bytes(), _small(trained[p0:p1]),
                    _small(docs_of[p0:p1]), _small(doc_[e0:e1]), _small(times[e0:e1])]))
                out_shard.append(int(w_shard[w0]))
            head = np.diff(first).astype("<i8").tobytes() + _ids(b.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1 - name % (1 << 30)] + out_shard, pa.int64()), pa.array([name] * (len(blobs) + 1), pa.int64()),
                 pa.array([head] + blobs, pa.binary())], names=["shard", "piece", "data"])
    return run


def hash_of(b: pa.RecordBatch) -> int:
    """A number for a piece: from its ids and all its texts, so a task that
    runs again gives it again, and equal pieces share it."""
    import xxhash

    x = xxhash.xxh3_64(_ids(b.column(0)))
    for text in b.column(1).cast(pa.large_string()).to_pylist():
        data = (text or "").encode()
        x.update((-1 if text is None else len(data)).to_bytes(8, "little", signed=True) + data)
    return x.intdigest()


def _ids(col: pa.Array) -> bytes:
    """Ids as 8 bytes and a byte that says null."""
    return col.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + \
        np.asarray(col.is_null().to_numpy(zero_copy_only=False), np.uint8).tobytes()


class Blob:
    """One piece's part of a shard."""

    def __init__(self, piece: int, buf: bytes):
        self.piece = piece
        w, p, e, self.n_docs = np.frombuffer(buf, "<i8", 4).tolist()
        words, at = EliasFano.view(buf, 32)
        keys, at = EliasFano.view(buf, at)
        self.words = words.values()
        k = keys.values()
        self.parent, self.code = (k >> U64(32)).astype(np.int64), k & U64(0xFFFFFFFF)
        self.trained, at = _read_small(buf, p, at)
        self.docs_of, at = _read_small(buf, p, at)
        self.doc, at = _read_small(buf, e, at)
        self.times, at = _read_small(buf, e, at)


class Quantiser:
    """Logarithms on an even grid of 16-bit steps."""

    def __init__(self, low: float, high: float):
        self.low, self.step = low, max(high - low, 1e-9) / LEVELS

    def code(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((x - self.low) / self.step), 0, LEVELS).astype(np.uint16)

    def value(self, code: np.ndarray) -> np.ndarray:
        return self.low + code * self.step


def build_shard(blobs: list[Blob], stats: dict) -> tuple[NgramTrie, np.ndarray, Quantiser]:
    """(the shard's trie in mapped memory, count of each of its words, grid)."""
    every = np.unique(np.concatenate([b.words for b in blobs]))
    keys, trained = [], []
    for b in blobs:
        at = np.searchsorted(every, b.words)
        seen = b.trained > 0
        keys.append((at[b.parent[seen]].astype(U64) << U64(32)) | b.code[seen])
        trained.append(b.trained[seen])
    key, which = np.unique(np.concatenate(keys), return_inverse=True)
    c12 = np.bincount(which, weights=np.concatenate(trained), minlength=len(key)).astype(np.int64)
    count = np.bincount((key >> U64(32)).astype(np.int64), weights=c12, minlength=len(every)).astype(np.int64)
    hot, hot_n = stats["hot_codes"], stats["hot_n"]
    if len(hot):
        at = np.minimum(np.searchsorted(hot, every), len(hot) - 1)
        match = hot[at] == every
        count[match] = hot_n[at[match]]
    known = count > 0
    number = np.cumsum(known) - 1
    grid = Quantiser(np.log10(stats["mu"] * 0.5 / stats["z"]), np.log10(stats["tokens"] + stats["mu"] + 1.0))
    parent = (key >> U64(32)).astype(np.int64)
    prior = stats["mu"] * (count + 0.5) / stats["z"]
    data = NgramTrie.build(every[known], CODE_BITS, grid.code(np.log10(prior[known])), number[parent],
                           key & U64(0xFFFFFFFF), grid.code(np.log10(c12 + prior[parent])))
    mapped = mmap.mmap(-1, max(1, len(data)))
    mapped.write(data)
    return NgramTrie(mapped), count[known], grid


def score_blob(b: Blob, trie: NgramTrie, count: np.ndarray, grid: Quantiser, stats: dict):
    """Per document of the piece: sum of log10(c + 0.5), known tokens, and
    sum of the model's terms."""
    word = trie.find_words(b.words)
    c = np.where(word >= 0, count[np.maximum(word, 0)] if len(count) else 0, 0)
    unseen = float(grid.value(grid.code(np.log10(np.array([stats["mu"] * 0.5 / stats["z"]]))))[0])
    prior = np.where(word >= 0, grid.value(trie.word_value[np.maximum(word, 0)]) if len(count) else unseen, unseen)
    pair = trie.find_pairs(word[b.parent], b.code)
    number = prior[b.parent]
    hit = pair >= 0
    number[hit] = grid.value(trie.pair_value[pair[hit]])
    end = b.words == U64(int(END) >> (64 - CODE_BITS))
    base = np.log10(c + 0.5)
    context = np.where(end, 0.0, np.log10(c + stats["mu"]))
    times = b.times.astype(float)
    per_pair = [base[b.parent], (c > 0)[b.parent].astype(float), number - context[b.parent]]
    return [np.bincount(b.doc, weights=np.repeat(x, b.docs_of) * times, minlength=b.n_docs) for x in per_pair]


def _score(shared):
    def run(batches):
        stats = shared.value
        sums: dict[int, np.ndarray] = {}
        held: list[Blob] = []
        size, shard = 0, None

        def close():
            nonlocal held, size
            if held:
                trie, count, grid = build_shard(held, stats)
                for b in {b.piece: b for b in held}.values():  # equal pieces have equal sums
                    got = np.stack(score_blob(b, trie, count, grid, stats))
                    if b.piece in sums:
                        sums[b.piece] += got
                    else:
                        sums[b.piece] = got
                        size += got.size
                held = []

        def rows(kind, found):
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([kind] * len(found), pa.int32()),
                                               pa.array([v for _, v in found], pa.binary())], names=["piece", "kind", "data"])

        def flush():
            nonlocal size
            out = list(sums.items())
            sums.clear()
            size = 0
            for i in range(0, len(out), 64):
                yield rows(1, [(k, _pack(v)) for k, v in out[i:i + 64]])

        for b in batches:
            for s, piece, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if s < 0:  # a piece's head goes on as it is
                    yield rows(0, [(piece, data)])
                    continue
                if s != shard:
                    close()
                    shard = s
                    if size > 6_000_000:
                        yield from flush()
                held.append(Blob(piece, data))
        close()
        yield from flush()
    return run


def _pack(v: np.ndarray) -> bytes:
    """Sums of the documents that have any: number, base, known, score."""
    at = np.flatnonzero(v.any(0))
    return np.array([len(at)], "<i8").tobytes() + at.astype("<u4").tobytes() + v[0, at].astype("<f8").tobytes() + \
        v[1, at].astype("<u4").tobytes() + v[2, at].astype("<f8").tobytes()


def _collect(shared):
    def run(batches):
        z, start = shared.value["z"], np.log10(shared.value["docs"] + shared.value["mu"])
        piece, data_of, head, sums, copies = None, None, None, None, 0

        def rows():
            counts, ids, nulls = head
            base = sums[0] - counts * np.log10(z)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=nulls), pa.array(counts), pa.array(np.rint(sums[1]).astype(np.int64)),
                 pa.array(base), pa.array(sums[2] - start)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

        for b in batches:
            for p, kind, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                if p == piece and kind == 0:  # equal pieces: heads come before sums
                    if data != data_of:
                        raise ValueError("different pieces of one name")
                    copies += 1
                    continue
                if p != piece:
                    for _ in range(copies):
                        yield rows()
                    n = len(data) // 17
                    data_of, copies = data, 1
                    head = (np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n, 8 * n),
                            np.frombuffer(data, np.uint8, n, 16 * n).astype(bool))
                    piece, sums = p, np.zeros((3, n))
                    if kind != 0:
                        raise ValueError("a piece's head is missing")
                    continue
                m = int(np.frombuffer(data, "<i8", 1)[0])
                at = np.frombuffer(data, "<u4", m, 8)
                sums[0, at] += np.frombuffer(data, "<f8", m, 8 + 4 * m)
                sums[1, at] += np.frombuffer(data, "<u4", m, 8 + 12 * m)
                sums[2, at] += np.frombuffer(data, "<f8", m, 8 + 16 * m)
        for _ in range(copies):
            yield rows()
    return run


def score_texts(docs: DataFrame, train, mu: float = MU, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every
    document; ``train`` is a Boolean column that marks training documents."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                    F.coalesce(train, F.lit(False)).alias("train"))
    words = materialize(d.mapInArrow(_vocabulary, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    tokens, vocabulary = words.agg(F.sum("n"), F.count("*")).first()
    tokens = tokens or 0
    n_docs = words.where(F.col("word") == int(END.astype(np.int64))).agg(F.sum("n")).first()[0] or 0
    hot = words.where(F.col("n") >= 4 * shard_tokens).orderBy(F.col("n").desc(), "word").limit(HOT).toArrow()
    hot_words = hot.column("word").to_numpy().astype(np.int64).view(U64)
    hot_n = hot.column("n").to_numpy().astype(np.int64)
    shards = max(16, -(-tokens // shard_tokens))
    by_code = np.argsort(hot_words >> U64(64 - CODE_BITS), kind="stable")
    stats = {"hot": np.sort(hot_words), "hot_codes": (hot_words >> U64(64 - CODE_BITS))[by_code], "hot_n": hot_n[by_code],
             "shards": shards, "tokens": tokens, "z": tokens + 0.5 * (vocabulary + 1), "mu": mu, "docs": n_docs}
    shared = spark.sparkContext.broadcast(stats)
    dealt = d.mapInArrow(_deal(shared), "shard long, piece long, data binary")
    parts = max(1, min(shards // 8, 100_000), spark.sparkContext.defaultParallelism)
    scored = dealt.repartition(parts, "shard").sortWithinPartitions("shard") \
        .mapInArrow(_score(shared), "piece long, kind int, data binary")
    back = scored.repartition("piece").sortWithinPartitions("piece", "kind")
    out = back.mapInArrow(_collect(shared), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = held_out_hash(F.col("doc_id"))
    out = score_texts(docs, fold != 1)
    held_out = F.coalesce(held_out_hash(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
