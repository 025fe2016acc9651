"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts and test items become words (A-Z lower-cased, runs of letters, digits
and non-ASCII).  The patterns are all windows of ``window`` consecutive item
words; a shorter item is one pattern.  Patterns are put in classes by length
(1, 2-3, 4-7, 8 and more words); each class has its own tables over its
shortest length m: the shift of every block of two words that occurs in the
first m words of a pattern (any other block lets the search skip m - 1
positions), and buckets by the hash of the last block, whose pattern strings
are compared directly.

Test items are sent to the tasks in blocks of at most ``block_words`` words,
one pass over the documents for each block, so the tables have a proven bound;
a usual benchmark is one block.  Null or wordless texts have no words and are
clean.  Items with null id mark hits but are not listed.  Repeated document
rows are each returned; an empty benchmark or table gives clean or no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import materialize, texts
from .text import ALNUM, LOWER, pieces, worker_cache

WINDOW = 13
BLOCK_WORDS = 200_000  # their tables take about 130 MB a worker
CLASSES = (1, 2, 4, 8)
_TO_WORDS = bytes(LOWER[b] if ALNUM[LOWER[b]] else 0x20 for b in range(256))
SCHEMA = "doc_id long, n_words long, hits array<int>, items array<string>"


def item_words(text: str | None) -> list[bytes]:
    """The words of a text; ASCII that is no letter or digit separates."""
    return text.encode().translate(_TO_WORDS).split() if text else []


class WuManber:
    """The tables of one class of patterns."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.m = m = min(map(len, patterns))
        self.block = b = min(2, m)
        self.rest = m - b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets = defaultdict(list)
        for p, items in patterns.items():
            for i in range(m - b + 1):
                k = p[i:i + b]
                self.shift[k] = min(self.shift.get(k, self.rest), m - b - i)
            self.buckets[p[m - b:m]].append((p, items))

    def search(self, words: list[bytes], found) -> None:
        """Calls found(start, pattern, items) for every occurrence."""
        m, b, rest, shift, buckets = self.m, self.block, self.rest, self.shift.get, self.buckets
        i, n = m - 1, len(words)
        while i < n:
            k = (words[i - 1], words[i]) if b == 2 else (words[i],)
            skip = shift(k, rest)
            if skip:
                i += skip
                continue
            start = i - m + 1
            for p, items in buckets.get(k, ()):
                if tuple(words[start:start + len(p)]) == p:
                    found(start, p, items)
            i += 1


def build_tables(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[WuManber]:
    """Search tables of (item id, text) rows, one for each length class."""
    classes = defaultdict(lambda: defaultdict(list))
    for item_id, text in items:
        w = item_words(text)
        for p in {tuple(w[i:i + window]) for i in range(max(1, len(w) - window + 1))} if w else ():
            size = max(c for c in CLASSES if c <= len(p))
            if item_id not in (have := classes[size][p]):
                have.append(item_id)
    return [WuManber(c) for _, c in sorted(classes.items())]


def find_hits(tables: list[WuManber], words: list[bytes]) -> tuple[list[int], set[str]]:
    """(hit spans as start, end, start, end, ..., ids of items that occur)."""
    spans, items = [], set()

    def found(start, pattern, ids):
        spans.append((start, start + len(pattern)))
        items.update(x for x in ids if x is not None)

    for t in tables:
        t.search(words, found)
    return _merge(spans), items


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _tables(items: list, window: int) -> list[WuManber]:
    """The tables of one block of items, built once a worker process."""
    built, key = worker_cache("tables"), hashlib.sha256(repr((window, items)).encode()).digest()
    if key not in built:
        built.clear()
        built[key] = build_tables(items, window)
    return built[key]


def _scan(shared, window):
    def run(batches):
        tables = _tables(shared.value, window)
        for b in pieces(batches, 1):
            rows = []
            for text in b.column(1):
                words = item_words(text.as_py())
                hits, items = find_hits(tables, words)
                rows.append((len(words), hits, sorted(items)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                 pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["doc_id", "n_words", "hits", "items"])
    return run


def _scan_and_digest(shared, window):
    """The report of a single block of items, in one Python worker a task."""
    scan = _scan(shared, window)

    def run(batches):
        def alone():
            for b in scan(batches):
                one = pa.array(range(b.num_rows + 1), pa.int32())
                lists = [pa.ListArray.from_arrays(one, b.column(i)) for i in (2, 3)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["doc_id", "n_words", "hits", "items"])
        return _digest(alone())
    return run


def _digest(batches):
    for b in batches:
        hits, items = [], []
        for spans, ids in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            merged = _merge([(s[i], s[i + 1]) for s in spans for i in range(0, len(s), 2)])
            hits.append(sum(merged[1::2]) - sum(merged[::2]))
            items.append(sorted({x for s in ids for x in s}))
        n = b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
             pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
             pa.array([h > 0 and 20 * h >= k for h, k in zip(hits, n)], pa.bool_()),
             pa.array(items, pa.list_(pa.string()))],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])


REPORT = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "items array<string>")


def _item_blocks(benchmark: DataFrame, block_words: int):
    """Row filters that cut the benchmark into blocks of about block_words."""
    b = texts(benchmark, "item_id", "text")
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (4 * block_words)))
    if n == 1:
        return [b]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    staged = materialize(b.withColumn("part", part), "items")
    return [staged.where(F.col("part") == i).select("item_id", "text") for i in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated and the item ids found (``items``)."""
    spark = docs.sparkSession
    d = texts(docs, "doc_id", "text")
    blocks = _item_blocks(benchmark, block_words)
    if len(blocks) > 1:  # rows get a key, as several blocks' findings of a row are put together
        d = materialize(d.withColumn("row", F.monotonically_increasing_id()), "docs")
    parts = []
    for block in blocks:
        shared = spark.sparkContext.broadcast([(None if r[0] is None else str(r[0]), r[1]) for r in block.collect()])
        if len(blocks) == 1:
            return d.mapInArrow(_scan_and_digest(shared, window), REPORT)
        parts.append(d.select("row", "text").mapInArrow(_scan(shared, window), SCHEMA))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    grouped = union.withColumnRenamed("doc_id", "row").groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))
    keyed = grouped.join(d.select("row", "doc_id"), "row")
    return keyed.select("doc_id", "n_words", "hits", "items").mapInArrow(_digest, REPORT)


def op5(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents and test items."""
    out = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                             spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
