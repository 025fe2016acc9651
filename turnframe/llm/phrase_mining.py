"""Phrase collocations by dynamic itemset counting.

The documents are dealt once into ``SHARDS`` shards, which are scanned in a
cycle, one a step.  Words are counted from the first step on.  A phrase of two
or more words is activated in the step after both its subphrases (without its
last and without its first word) have reached the threshold, whatever their
lengths are doing, and is counted for one full cycle of shards from there, so
lengths interleave and every count is exact.  Counting ends when no phrase is
left in its cycle; phrases whose cycle ended below the threshold are forgotten.

A phrase is named by the 64-bit fingerprints of its words (mixed with the
language), eight bytes each, so its subphrases are byte ranges of its name.  The
phrases that reached the threshold go to the tasks while they are counted to be
at most ``ACTIVE_ROWS``; beyond that, tasks give all phrases and a join with
both subphrases finds the active ones.  A task adds up equal phrases before
they are shuffled, so a phrase of a third of all rows arrives as a few rows.

Words: A-Z lower-cased, pieces between ``.,;:!?`` and line breaks, split at
blanks and tabs.  Everything is counted per language (null: ``und``, together
with that name).  Null and empty texts have no words; a text of any length is
one row; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import _STAGED
from .staging import checkpoint_root, join_groups, materialize
from .text import U64, Words, mix, pieces

LONGEST = 5
THRESHOLD = 100
TOP = 2000
SHARDS = 3
ACTIVE_ROWS = 2_000_000
HELD_ROWS = 1_000_000
BYTES = 8  # of a word's fingerprint in a phrase's name
UNKNOWN = "und"

# Bytes that end a piece, and bytes of words.
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD_BYTES = ~BREAKS
WORD_BYTES[[0x20, 0x09]] = False

COUNTED = "p binary, start int, word string, n long"


# ---------------------------------------------------------------- names

def phrase_keys(words: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key of phrases, given the arrays of their first, second, ...
    words."""
    key = np.full(len(words[0]), len(words), U64)
    for w in words:
        key = mix(key * U64(0x9E3779B97F4A7C15) + w)
    return key


def names_of(words: list[np.ndarray]) -> pa.Array:
    """The phrases' names: the words' fingerprints one after the other."""
    raw = np.ascontiguousarray(np.stack(words, 1)).astype("<u8").tobytes()
    kind = pa.binary(BYTES * len(words))
    return pa.FixedSizeBinaryArray.from_buffers(kind, len(words[0]), [None, pa.py_buffer(raw)]).cast(pa.binary())


class Reached:
    """The phrases that reached the threshold, by length: sorted keys and the
    step in which each did."""

    def __init__(self, names: list[bytes], steps: np.ndarray):
        self.keys, self.steps = {}, {}
        size = np.array([len(x) for x in names], np.int64) // BYTES
        for k in np.unique(size).tolist():
            at = np.flatnonzero(size == k)
            words = np.frombuffer(b"".join(names[i] for i in at), "<u8").reshape(-1, k)
            keys = phrase_keys([words[:, j].astype(U64) for j in range(k)])
            order = np.argsort(keys)
            self.keys[k], self.steps[k] = keys[order], np.asarray(steps)[at][order].astype(np.int32)

    def step(self, length: int, keys: np.ndarray) -> np.ndarray:
        """The step of each phrase, -1 if it is not known."""
        have = self.keys.get(length)
        if have is None or not len(have):
            return np.full(len(keys), -1, np.int32)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return np.where(have[at] == keys, self.steps[length][at], -1).astype(np.int32)


# ---------------------------------------------------------------- counting

def word_stream(lang: list[str], text: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words of a batch, fingerprints, whether each word is followed by
    another one in its piece)."""
    w = Words(text, WORD_BYTES, lower=True)
    salt = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in lang], U64)
    h = mix(w.hashes() ^ np.repeat(salt, w.counts))
    n = len(w)
    goes_on = np.zeros(n, bool)
    if n > 1:
        cut = np.zeros(len(w.buf) + 1, np.int64)
        np.cumsum(BREAKS[w.buf], out=cut[1:])
        goes_on[:-1] = cut[w.starts[1:]] == cut[w.ends[:-1]]
        last = w.first[1:][w.counts > 0] - 1
        goes_on[last] = False
    return w, h, goes_on


def active_phrases(h: np.ndarray, goes_on: np.ndarray, reached: Reached, step: int, shards: int, longest: int):
    """Yields (length, positions, first steps) of the occurrences that are
    counted in this step."""
    at = np.flatnonzero(goes_on)  # places from which `length` words are in one piece
    before = np.full(len(h) + 1, -1, np.int32)  # step of the phrase of length - 1 at each place
    before[:len(h)] = reached.step(1, phrase_keys([h]))
    for length in range(2, longest + 1):
        at = at[(before[at] >= 0) & (before[at + 1] >= 0)]
        if not len(at):
            return
        start = np.maximum(before[at], before[at + 1]) + 1
        now = (start <= step) & (step < start + shards)
        if now.any():
            yield length, at[now], start[now]
        if length == longest:
            return
        own = reached.step(length, phrase_keys([h[at + j] for j in range(length)]))
        before = np.full(len(h) + 1, -1, np.int32)
        before[at] = own
        at = at[goes_on[at + length - 1]]


def all_phrases(goes_on: np.ndarray, longest: int):
    """Yields (length, positions, None) of all occurrences."""
    at = np.flatnonzero(goes_on)
    for length in range(2, longest + 1):
        if not len(at):
            return
        yield length, at, None
        at = at[goes_on[at + length - 1]]


class _Counts:
    """Adds up a task's phrases of one length."""

    def __init__(self, length: int):
        self.length, self.parts, self.rows = length, [], 0

    def add(self, words: list[np.ndarray], start: np.ndarray) -> None:
        keys = phrase_keys(words)
        self._keep(keys, words, start, np.ones(len(keys), np.int64))
        if self.rows > HELD_ROWS:
            self._fold()

    def _keep(self, keys, words, start, n) -> None:
        u, first, which = np.unique(keys, return_index=True, return_inverse=True)
        n = np.bincount(which, weights=n, minlength=len(u)).astype(np.int64)
        self.parts.append((u, [w[first] for w in words], start[first], n))
        self.rows += len(u)

    def _fold(self) -> None:
        parts, self.parts, self.rows = self.parts, [], 0
        self._keep(np.concatenate([p[0] for p in parts]), [np.concatenate([p[1][j] for p in parts]) for j in range(self.length)],
                   np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]))

    def full(self) -> bool:
        return self.rows > HELD_ROWS

    def rows_out(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        if len(self.parts) > 1:
            self._fold()
        _, words, start, n = self.parts[0]
        self.parts, self.rows = [], 0
        return pa.RecordBatch.from_arrays(
            [names_of(words), pa.array(start, pa.int32(), mask=start < 0), pa.nulls(len(n), pa.string()), pa.array(n)],
            names=["p", "start", "word", "n"])


class _WordCounts:
    """Adds up a task's words; they keep the text of their first occurrence."""

    def __init__(self):
        self.parts, self.rows = [], 0

    def add(self, w: Words, h: np.ndarray, lang: list[str]) -> None:
        u, first, n = np.unique(h, return_index=True, return_counts=True)
        size = w.ends[first] - w.starts[first]
        ends = np.cumsum(size)
        raw = w.buf[np.arange(ends[-1]) + np.repeat(w.starts[first] - ends + size, size)]
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        text = pa.LargeStringArray.from_buffers(len(u), pa.py_buffer(offsets), pa.py_buffer(raw))
        of = pa.array(lang, pa.large_string()).take(pa.array(w.doc_of()[first]))
        self.parts.append((u, n, pc.binary_join_element_wise(of, text, pa.scalar("\n", pa.large_string()))))
        self.rows += len(u)
        if self.rows > HELD_ROWS:
            self._fold()

    def _fold(self) -> None:
        parts, self.parts = self.parts, []
        u, first, which = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        n = np.bincount(which, weights=np.concatenate([p[1] for p in parts]), minlength=len(u)).astype(np.int64)
        self.parts.append((u, n, pa.concat_arrays([p[2] for p in parts]).take(pa.array(first))))
        self.rows = len(u)

    def full(self) -> bool:
        return self.rows > HELD_ROWS

    def rows_out(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        if len(self.parts) > 1:
            self._fold()
        u, n, word = self.parts[0]
        self.parts, self.rows = [], 0
        return pa.RecordBatch.from_arrays([names_of([u]), pa.array(np.zeros(len(u), np.int32)), word.cast(pa.string()), pa.array(n)],
                                          names=["p", "start", "word", "n"])


def _count_shard(shared, step: int, shards: int, longest: int):
    def run(batches):
        reached = shared.value if shared is not None else None
        counts = {k: _Counts(k) for k in range(2, longest + 1)}
        words = _WordCounts()
        sizes: Counter = Counter()  # word occurrences of the languages; their name is empty
        for b in pieces(batches, 1):
            lang = b.column(0).to_pylist()
            w, h, goes_on = word_stream(lang, b.column(1))
            if not len(h):
                continue
            if step < shards:  # the words' own cycle
                words.add(w, h, lang)
                if words.full():
                    yield words.rows_out()
                for x, k in zip(lang, w.counts.tolist()):
                    sizes[x] += k
            found = active_phrases(h, goes_on, reached, step, shards, longest) if reached is not None else all_phrases(goes_on, longest)
            for length, at, start in found:
                start = np.full(len(at), -1, np.int32) if start is None else start
                counts[length].add([h[at + j] for j in range(length)], start)
                if counts[length].full():
                    yield counts[length].rows_out()
        if sizes:
            yield pa.RecordBatch.from_arrays(
                [pa.array([b""] * len(sizes), pa.binary()), pa.array([0] * len(sizes), pa.int32()),
                 pa.array([x + "\n" for x in sizes]), pa.array(list(sizes.values()), pa.int64())], names=["p", "start", "word", "n"])
        for c in (words, *counts.values()):
            if (rows := c.rows_out()) is not None:
                yield rows
    return run


def _deal(docs: DataFrame, shards: int) -> DataFrame:
    """(lang, text, shard), written by shard."""
    d = docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
                    F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    d = d.select("lang", "text", F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int").alias("shard"))
    path = f"{checkpoint_root(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    d.write.partitionBy("shard").parquet(path)
    _STAGED.append(path)
    return docs.sparkSession.read.schema("lang string, text string, shard int").parquet(path)


def _words_in(name: str) -> Column:
    return (F.length(name) / BYTES).cast("int")


def _activated(counted: DataFrame, reached: DataFrame, step: int, shards: int) -> DataFrame:
    """Counted phrases of which both subphrases have reached the threshold,
    in their cycle (for sets of phrases too large for the tasks)."""
    words = counted.where("word is not null")
    size = F.length("p") - BYTES
    rows = counted.where("word is null").select("p", "n", F.expr(f"substring(p, 1, length(p) - {BYTES})").alias("head"),
                                                F.substring("p", F.lit(BYTES + 1), size).alias("rest"))
    for side in ("head", "rest"):
        rows = rows.join(reached.select(F.col("p").alias(side), F.col("reach").alias(side + "_step")), side)
    start = F.greatest("head_step", "rest_step") + 1
    rows = rows.withColumn("start", start).where((F.col("start") <= step) & (F.col("start") + shards > step))
    return words.unionByName(rows.select("p", "start", F.lit(None).cast("string").alias("word"), "n"))


def count_phrases(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS,
                  active_rows: int = ACTIVE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(p, word, n of all phrases of one to ``longest`` words that occur
    ``threshold`` times, word with its language for single words; lang and n of
    all word occurrences)."""
    spark = docs.sparkSession
    dealt = _deal(docs, shards)
    total, table, reached, step, last = None, None, Reached([], np.zeros(0, np.int32)), 0, shards - 1
    while step <= last:
        shared = spark.sparkContext.broadcast(reached) if reached is not None else None
        counted = dealt.where(F.col("shard") == step % shards).select("lang", "text") \
            .mapInArrow(_count_shard(shared, step, shards, longest), COUNTED)
        if reached is None:
            counted = _activated(counted.groupBy("p", "start", "word").agg(F.sum("n").alias("n")), table, step, shards)
        both = counted.withColumn("reach", F.lit(None).cast("int"))
        if total is not None:
            both = total.unionByName(both)
        # p has one start, as its subphrases reached the threshold in one step each
        both = both.groupBy("p", "start", "word").agg(F.sum("n").alias("n"), F.max("reach").alias("reach"))
        both = both.withColumn("reach", F.coalesce("reach", F.when((F.col("n") >= threshold) & (_words_in("p") > 0), F.lit(step))))
        done = F.col("start") + shards - 1 <= step
        both = both.where(~done | (F.col("n") >= threshold) | (_words_in("p") == 0))
        begins = F.col("reach").isNotNull() & (_words_in("p") < longest)
        seen = Observation()
        total = materialize(both.observe(seen, F.count(F.when(begins, 1)).alias("n"), F.max(F.when(begins, F.col("reach"))).alias("latest")),
                            "phrase-totals")
        table = total.where(begins).select("p", "reach")
        n, latest = seen.get["n"], seen.get["latest"]
        last = max(shards - 1, -1 if latest is None else latest + shards)
        reached = None
        if n <= active_rows:
            t = table.toArrow()
            reached = Reached(t.column("p").to_pylist(), t.column("reach").to_numpy())
        step += 1
    langs = total.where(_words_in("p") == 0).select(_lang_of("word").alias("lang"), "n")
    return total.where(_words_in("p") > 0).select("p", "word", "n"), langs


def _lang_of(word: str) -> Column:
    """The language before a word; words have no line feeds."""
    return F.expr(f"substring_index({word}, '\n', size(split({word}, '\n')) - 1)")


# ---------------------------------------------------------------- scores

def _parts(name: str, pairs) -> Column:
    """An array of the byte ranges (words before, words) of a name."""
    return F.array(*[F.substring(name, BYTES * a + 1, BYTES * k) for a, k in pairs])


def best_cuts(counts: DataFrame, langs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """p, a, lang, n, l, r and score of the phrases of two and more words at
    their lowest-scoring cut."""
    first = counts.where("word is not null").select(F.col("p").alias("w"), _lang_of("word").alias("lang"))
    first = join_groups(first, first.groupBy("lang").agg(F.count("*").alias("rows")).join(langs, "lang"), "lang", "rows")
    phrases = counts.where(_words_in("p") >= 2).select("p", F.col("n").alias("a"), F.substring("p", 1, BYTES).alias("w"))
    size = phrases.groupBy("w").agg(F.count("*").alias("rows"))
    phrases = join_groups(phrases, size.join(first, "w"), "w", "rows").drop("w")
    cut = F.explode(F.sequence(F.lit(1), _words_in("p") - 1)).alias("k")
    cuts = phrases.select("p", "a", "lang", "n", cut)
    head = F.substring("p", F.lit(1), F.col("k") * BYTES)
    rest = F.substring("p", F.col("k") * BYTES + 1, F.length("p"))
    cuts = cuts.withColumn("head", head).withColumn("rest", rest)
    for side, name in (("head", "l"), ("rest", "r")):
        # a frequent word begins or ends many phrases, so its rows are not sent to one task
        uses = cuts.groupBy(side).agg(F.count("*").alias("rows"))
        cuts = join_groups(cuts, uses.join(counts.select(F.col("p").alias(side), F.col("n").alias(name)), side), side, "rows")
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("top", F.lit(1000).cast("decimal(38,0)") * whole("a") * whole("n")).withColumn("down", whole("l") * whole("r"))
    cuts = cuts.withColumn("score", F.expr("top div down"))
    return cuts.groupBy("p", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")) \
        .select("p", "a", "lang", "n", "c.l", "c.r", "c.score")


def drop_parts(phrases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Phrases (p, a, ...) without those inside a longer one as frequent."""
    inner = None
    for size in range(3, longest + 1):
        ranges = [(a, k) for k in range(2, size) for a in range(size - k + 1)]
        part = phrases.where(_words_in("p") == size).select(F.explode(_parts("p", ranges)).alias("p"), F.col("a").alias("longer"))
        inner = part if inner is None else inner.unionByName(part)
    if inner is None:
        return phrases
    inner = inner.groupBy("p").agg(F.max("longer").alias("longer"))
    return phrases.join(inner, "p", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")


def spelled(phrases: DataFrame, counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Adds the phrase as text."""
    at = F.sequence(F.lit(0), _words_in("p") - 1)
    rows = phrases.select("p", F.posexplode(F.transform(at, lambda i: F.substring("p", i * BYTES + 1, F.lit(BYTES)))).alias("i", "w"))
    words = counts.where("word is not null").select(F.col("p").alias("w"), F.element_at(F.split("word", "\n"), -1).alias("spelling"))
    uses = rows.groupBy("w").agg(F.count("*").alias("rows"))
    rows = join_groups(rows, uses.join(words, "w"), "w", "rows")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "spelling"))), lambda x: x["spelling"]), " ")
    return phrases.join(rows.groupBy("p").agg(text.alias("phrase")), "p")


def mine_phrases(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS,
                 active_rows: int = ACTIVE_ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best
    phrases."""
    counts, langs = count_phrases(docs, threshold, longest, shards, active_rows)
    scored = materialize(best_cuts(counts, materialize(langs, "language-sizes"), longest), "phrase-scores")
    rows = spelled(materialize(drop_parts(scored, longest), "phrases"), counts, longest)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))
