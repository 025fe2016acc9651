"""Language identification by a bidirectional gated recurrent network on bytes.

The network reads the bytes of a word in both directions and labels every
byte position with a distribution over the learned languages; a document's
probabilities are the means over all its positions in words with a letter.
The state starts anew at white space, so a word's labels depend on its bytes
alone and equal words of a batch are run once.  Words over ``SEGMENT`` bytes
run as several segments; no byte is left out.

Trained in numpy by backpropagation through time on the driver, on
``WORDS_PER_DOC`` whole words of each of at most ``TRAIN_DOCS`` labelled
documents, the same number of every language and at least ``LANG_DOCS`` of each
(those with the smallest hashes of id and text in the training fold), so rare
languages are learned and the model does not depend on how rows are dealt.
Predictions use the text only.

Null text or text without a letter: language ``und``, score 0.  Without any
labelled training document every language is ``und``.  Repeated rows are each
predicted; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import held_out_hash, texts
from .text import Words, mix, pieces

SEGMENT = 48
HIDDEN = 16
TRAIN_DOCS = 3000
LANG_DOCS = 50
WORDS_PER_DOC = 64
EPOCHS = 3
BATCH = 256
PIECE_BYTES = 8 << 20
STEP_ROWS = 4096

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class ByteGru:
    """Parameters: per direction an input table (256 x 3H), recurrent weights
    (H x 3H) and the candidate's bias; then the output layer."""

    langs: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 3) -> "ByteGru":
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden))
            p["u" + d] = rng.normal(0, hidden ** -0.5, (hidden, 3 * hidden))
            p["c" + d] = np.zeros(hidden)
        p["o"] = rng.normal(0, 0.1, (2 * hidden, len(langs)))
        p["k"] = np.zeros(len(langs))
        return cls(langs, {k: v.astype(np.float32) for k, v in p.items()})

    def _direction(self, ids: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (T, n, H) of a batch of equally long byte rows."""
        x, u, c = self.p["x" + d], self.p["u" + d], self.p["c" + d]
        n, steps = ids.shape
        hidden = len(c)
        h = np.zeros((n, hidden), np.float32)
        out = np.empty((steps, n, hidden), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = x[ids[:, t]]
            a = h @ u
            zr = _sigmoid(g[:, :2 * hidden] + a[:, :2 * hidden])
            z, r = zr[:, :hidden], zr[:, hidden:]
            inner = a[:, 2 * hidden:] + c
            cand = np.tanh(g[:, 2 * hidden:] + r * inner)
            new = cand + z * (h - cand)
            if keep is not None:
                keep.append((t, h, z, r, inner, cand))
            h = out[t] = new
        return out

    def positions(self, ids: np.ndarray) -> np.ndarray:
        """Probabilities (T, n, languages) of every byte position."""
        s = np.concatenate([self._direction(ids, "f"), self._direction(ids, "b")], 2)
        e = s @ self.p["o"] + self.p["k"]
        e -= e.max(2, keepdims=True)
        np.exp(e, out=e)
        e /= e.sum(2, keepdims=True)
        return e

    def gradient(self, ids: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Weighted mean cross-entropy over all positions and its gradient."""
        steps, hidden = ids.shape[1], len(self.p["cf"])
        kept = {"f": [], "b": []}
        s = np.concatenate([self._direction(ids, d, kept[d]) for d in "fb"], 2)
        e = s @ self.p["o"] + self.p["k"]
        e -= e.max(2, keepdims=True)
        q = np.exp(e)
        q /= q.sum(2, keepdims=True)
        rows = np.arange(len(label))
        loss = -(np.log(q[:, rows, label] + 1e-9) * weight).sum() / (steps * weight.sum())
        q[:, rows, label] -= 1
        q *= (weight / (steps * weight.sum()))[None, :, None].astype(np.float32)
        g = {"o": np.einsum("tnh,tnl->hl", s, q), "k": q.sum((0, 1))}
        ds = q @ self.p["o"].T
        for d, part in (("f", slice(0, hidden)), ("b", slice(hidden, None))):
            u = self.p["u" + d]
            gx, gu, gc = np.zeros_like(self.p["x" + d]), np.zeros_like(u), np.zeros_like(self.p["c" + d])
            dh = np.zeros((len(label), hidden), np.float32)
            for t, h, z, r, inner, cand in reversed(kept[d]):
                dh = dh + ds[t][:, part]
                dcand = dh * (1 - z) * (1 - cand * cand)
                dz = dh * (h - cand) * z * (1 - z)
                dr = dcand * inner * r * (1 - r)
                dinner = dcand * r
                da = np.concatenate([dz, dr, dinner], 1)
                gu += h.T @ da
                gc += dinner.sum(0)
                one = np.zeros((len(label), 256), np.float32)
                one[rows, ids[:, t]] = 1
                gx += one.T @ np.concatenate([dz, dr, dcand], 1)
                dh = dh * z + da @ u.T
            g["x" + d], g["u" + d], g["c" + d] = gx, gu, gc
        return float(loss), g


def fit(words: list[bytes], labels: list[str], epochs: int = EPOCHS, hidden: int = HIDDEN, rate: float = 0.01,
        seed: int = 3) -> ByteGru:
    """Trains on (word, language) pairs; languages weigh alike."""
    langs = sorted(set(labels))
    model = ByteGru.new(langs, hidden, seed)
    if len(langs) < 2:
        return model
    y = np.array([langs.index(x) for x in labels])
    weight = (1 / np.bincount(y))[y]
    length = np.array([len(w) for w in words])
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    groups = {n: np.flatnonzero(length == n) for n in np.unique(length)}
    per_epoch = sum(-(-len(i) // BATCH) for i in groups.values())
    total, t = epochs * per_epoch, 0
    for _ in range(epochs):
        batches = []
        for i in groups.values():
            i = rng.permutation(i)
            batches += [i[a:a + BATCH] for a in range(0, len(i), BATCH)]
        for k in rng.permutation(len(batches)):
            i = batches[k]
            ids = np.frombuffer(b"".join(words[j] for j in i), np.uint8).reshape(len(i), -1)
            _, g = model.gradient(ids, y[i], weight[i])
            t += 1
            size = min(1.0, 5 / np.sqrt(sum(float((x * x).sum()) for x in g.values()) + 1e-12))
            lr = rate * min(1.0, t / 20) * (1 - t / (total + 1)) ** 0.5
            for key, x in g.items():
                x = x * size
                m[key] = 0.9 * m[key] + 0.1 * x
                v[key] = 0.999 * v[key] + 0.001 * x * x
                step = lr * (m[key] / (1 - 0.9 ** t)) / (np.sqrt(v[key] / (1 - 0.999 ** t)) + 1e-8)
                model.p[key] = (model.p[key] - step).astype(np.float32)
    return model


def _segments(starts: np.ndarray, ends: np.ndarray):
    """(word number, start, end) of spans of at most SEGMENT bytes."""
    parts = -(-(ends - starts) // SEGMENT)
    word = np.repeat(np.arange(len(starts)), parts)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
    a = starts[word] + nth * SEGMENT
    return word, a, np.minimum(a + SEGMENT, ends[word])


def _letter_words(w: Words) -> np.ndarray:
    letters = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(LETTER[w.buf], out=letters[1:])
    return letters[w.ends] > letters[w.starts]


def pool(model: ByteGru, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per document: sums over positions of the language probabilities, and
    the number of positions."""
    use = np.flatnonzero(_letter_words(w))
    h = w.hashes()[use]
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    s, e = w.starts[use[first]], w.ends[use[first]]
    word, a, b = _segments(s, e)
    size = b - a
    sums = np.zeros((len(s), len(model.langs)))
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        for i in range(0, len(rows), STEP_ROWS):
            r = rows[i:i + STEP_ROWS]
            ids = w.buf[a[r][:, None] + np.arange(n)]
            np.add.at(sums, word[r], model.positions(ids).sum(0))
    doc = w.doc_of()[use]
    total = np.stack([np.bincount(doc, weights=sums[which, k], minlength=w.n_docs)
                      for k in range(len(model.langs))], 1)
    return total, np.bincount(doc, weights=(e - s)[which], minlength=w.n_docs)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _predict(shared):
    def run(batches):
        model: ByteGru = shared.value
        for b in pieces(batches, 1, PIECE_BYTES):
            col = b.column(1)
            if model.langs:
                sums, n = pool(model, Words(col))
                best = sums.argmax(1)
                score = np.clip(sums[np.arange(len(best)), best] / np.maximum(n, 1), 0, 1)
            lang, scores = [], []
            for i, text in enumerate(col.to_pylist()):
                known = bool(model.langs) and n[i] > 0 and has_letter(text)
                lang.append(model.langs[best[i]] if known else "und")
                scores.append(float(score[i]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])
    return run


def _sample_words(words_per_doc):
    def run(batches):
        for b in pieces(batches, 2):
            w = Words(b.column(2))
            strings, h, ok = w.strings(), w.hashes(), _letter_words(w)
            keys = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            rows = []
            for i in range(w.n_docs):
                at = np.arange(w.first[i], w.first[i + 1])
                at = at[ok[at]]
                order = np.argsort(mix(h[at] + keys[i]), kind="stable")[:words_per_doc]
                rows.append([strings[j] for j in at[np.sort(order)]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.binary()))], names=["lang", "key", "words"])
    return run


def training_words(docs: DataFrame, train_docs: int = TRAIN_DOCS, lang_docs: int = LANG_DOCS,
                   words_per_doc: int = WORDS_PER_DOC) -> tuple[list[bytes], list[str]]:
    """(spans of at most SEGMENT bytes, their languages) of the sampled words;
    the same however the rows are dealt."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                    F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    d = d.select("lang", F.xxhash64("doc_id", "text").alias("key"), "text")
    langs = d.select("lang").distinct().count()
    each = max(lang_docs, train_docs // max(1, langs))
    # only keys meet in one place, the first of each language; the texts are read where they are
    first = Window.partitionBy("lang").orderBy("key")
    keys = d.select("lang", "key").distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= each)
    sample = d.join(F.broadcast(keys.select("lang", "key")), ["lang", "key"], "left_semi").select("lang", "key", "text")
    found = sample.mapInArrow(_sample_words(words_per_doc), "lang string, key long, words array<binary>").dropDuplicates(["lang", "key"])
    words, labels = [], []
    for r in sorted(found.collect(), key=lambda r: (r["lang"], r["key"])):
        for x in map(bytes, r["words"]):
            spans = [x[i:i + SEGMENT] for i in range(0, len(x), SEGMENT)]
            words += spans
            labels += [r["lang"]] * len(spans)
    return words, labels


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> ByteGru:
    """Fits the network on documents (doc_id, text, lang) of the given rows."""
    return fit(*training_words(docs, train_docs))


def identify(docs: DataFrame, model: ByteGru) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return texts(docs, "doc_id", "text").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def op6(spark, sf_dir: str) -> DataFrame:
    """The contract's columns; learns from the documents not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.coalesce(held_out_hash(F.col("doc_id")), F.lit(0))
    model = train(docs.where(fold != 0))
    return identify(docs, model).select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")
