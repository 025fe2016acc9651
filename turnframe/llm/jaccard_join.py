"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document's set is its distinct 5-word shingles, the letters A-Z lower-cased.  Equal sets are one class
first, so copies are never compared.  For two sets of sizes a <= b with
similarity of at least s/100 the symmetric difference is at most
D = (a + b) (100 - s) / (100 + s).

* Size levels: a ladder of sizes; a pair belongs to the level of its larger
  set, so a set gives signatures for the levels that [n, n * 100 / s] meets
  (two at most).
* Segments: in a level with top size r at most D = 2 r (100 - s) / (100 + s)
  elements differ.  The universe is hashed into m1 + m2 segments, of which m1
  are indexed as they are (one difference spoils them) and m2 also with every
  single element left out (two spoil them).  With m1 + 2 m2 >= D + 1 some
  segment of a similar pair gives both sets the same signature.
* Cost-based allocation: m1 and m2 are chosen for each level to make the
  number of signatures and of weak ones (segments of one element or none,
  which many sets share) smallest.  ``slack`` units more than D + 1 are
  allotted, so a set may leave out that many empty or very frequent
  signatures and still lose no pair.

Signatures are dealt to tasks and sorted; every group is read as a stream.
First each member is compared with one of its groups' first ones (a pair a
member), and the links found give provisional components.  Then the members of
other components than their group's first one are compared with it, and the
pairs of different components in groups of up to ``GROUP``.  Sets that
had to leave out more than their slack in larger groups are joined exactly by
their rarest shingles (prefix filter).  A pair first has to pass on parity
sketches (two bits for about each element: bits that differ are at most the
elements that differ, so no similar pair is lost); what passes is verified on
its words.  The sketches' folds to ``FOLD`` numbers lie beside the rows of
groups, so the joins that find pairs give only those that pass on them: texts
with a common passage that are not similar are no pairs.

Null and empty texts have an empty set, size 0, and are linked with nothing.
Repeated rows and equal texts are one class.  A text of any length is one
set.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .staging import keyed, materialize, texts
from .text import U64, Words, mix, pieces, window_starts, windows

SHINGLE = 5
SIMILAR = 80
GROUP = 24
HEAD_ROW = 64
BROADCAST_IDS = 1_000_000
SET_BYTES = 1 << 20
FIRST_LEVEL = 4
STEP = 1.5
LOW_SIZE = 0.6
WEAK = 4.0
RARE = 3.0
FOLD = 8  # 64-bit numbers of a folded sketch


# ---------------------------------------------------------------- sets

def shingle_sets(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document index, shingle hash), each pair once, sorted by both."""
    n, h = len(w), w.hashes()
    grams = windows(h, k)
    at = np.flatnonzero(window_starts(w.first, k, n)[:len(grams)])
    doc = w.doc_of()
    d, g = doc[at], grams[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        whole = np.array([xxhash.xxh3_64_intdigest(h[w.first[i]:w.first[i + 1]].tobytes()) for i in short], U64)
        d, g = np.concatenate([d, short]), np.concatenate([g, whole])
    order = np.lexsort((g, d))
    d, g = d[order], g[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
    return d[new], g[new]


def _set_keys(doc: np.ndarray, gram: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size, 64-bit key of the whole set) of every document."""
    edges = np.searchsorted(doc, np.arange(n_docs + 1))
    raw = gram.tobytes()
    keys = [xxhash.xxh3_64_intdigest(raw[8 * a:8 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    return np.diff(edges), np.array(keys, U64).view(np.int64)


def parity_sketches(doc: np.ndarray, gram: np.ndarray, size: np.ndarray) -> list[bytes]:
    """For every set a bit vector, as long as the power of two that holds
    twice its size (``FOLD`` numbers at least): each bit tells whether the
    number of elements hashed to it is odd."""
    bits = np.maximum(64 * FOLD, 2 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(bits)])
    at = start[doc] + (mix(gram ^ U64(0x1D8E4E27C47D124F)).astype(np.int64) & (bits[doc] - 1))
    odd = (np.bincount(at, minlength=start[-1]) & 1).astype(np.uint8)
    raw = np.packbits(odd, bitorder="little").tobytes()
    return [raw[a:b] for a, b in zip((start[:-1] // 8).tolist(), (start[1:] // 8).tolist())]


def folded(sketch: bytes) -> np.ndarray:
    """A parity sketch folded to ``FOLD`` numbers."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, "<i8").reshape(-1, FOLD), axis=0)


def least_difference(a: bytes, b: bytes) -> int:
    """Bits in which two parity sketches differ, the longer one folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _class_rows(k):
    def run(batches):
        for b in pieces(batches, 1, SET_BYTES):
            doc, gram = shingle_sets(Words(b.column(1), lower=True), k)
            size, key = _set_keys(doc, gram, b.num_rows)
            sketches = parity_sketches(doc, gram, size)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(size.astype(np.int64)), pa.array(key), pa.array(sketches, pa.binary()),
                 pa.array([folded(x) for x in sketches], pa.list_(pa.int64()))],
                names=["row", "doc_id", "n_shingles", "class", "sketch", "fold"])
    return run


def _near_enough(similar):
    def run(batches):
        for b in batches:
            a, b_, na, nb, sa, sb = (b.column(i).to_pylist() for i in range(6))
            keep = [least_difference(x, y) <= max_difference(i + j, similar) for x, y, i, j in zip(sa, sb, na, nb)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


# ---------------------------------------------------------------- levels

def max_difference(total: int, similar: int) -> int:
    """Largest symmetric difference of two linked sets with ``total`` =
    a + b elements."""
    return total * (100 - similar) // (100 + similar)


@lru_cache(None)
def level_tops(upto: int, similar: int) -> tuple[int, ...]:
    tops = [FIRST_LEVEL]
    while tops[-1] < upto:
        tops.append(max(tops[-1] * 100 // similar + 1, int(tops[-1] * STEP)))
    return tuple(tops)


@lru_cache(None)
def allocation(top: int, similar: int) -> tuple[int, int, int]:
    """(m1, m2, slack) of the level whose largest size is ``top``.

    The cost of an allocation is its number of signatures, ``WEAK`` for each
    expected segment of a single element, and ``RARE`` times the size for
    the chance that a set's empty segments use up its slack.
    """
    d = max_difference(2 * top, similar)
    slack = 3 + (d + 1) // 6
    units = d + 1 + slack
    best = None
    for m2 in range(0, units // 2 + 1, max(1, units // 40)):
        m1 = units - 2 * m2
        s = LOW_SIZE * top / (m1 + m2)  # elements in a segment
        empty, one = math.exp(-s), s * math.exp(-s)
        mean = m1 * empty + 2 * m2 * (empty + one)
        spread = math.sqrt(2 * (m1 * empty + 4 * m2 * (empty + one)) + 1e-9)
        out = 0.5 * math.erfc((slack + 0.5 - mean) / spread)
        cost = m1 + m2 * (1 + s) + WEAK * one * m1 + RARE * out * top
        if best is None or cost < best[0]:
            best = (cost, m1, m2)
    return best[1], best[2], slack


def signatures(doc: np.ndarray, gram: np.ndarray, size: np.ndarray, similar: int = SIMILAR):
    """Arrays (signature, document index, slack left), level by level.  The
    two low bits of a signature are its level's parity and whether its segment
    counts twice.  Documents with less than no slack left have one row with
    signature 0."""
    if not len(size) or not size.max():
        return
    tops = level_tops(int(size.max()) * 100 // similar + 1, similar)
    for level, top in enumerate(tops):
        bottom = tops[level - 1] + 1 if level else 1
        use = (size >= 1) & (size <= top) & (size * 100 // similar >= bottom)
        if not use.any() or max_difference(2 * top, similar) < 1:
            continue  # without a difference only equal sets are similar
        m1, m2, slack = allocation(top, similar)
        m = m1 + m2
        docs = np.flatnonzero(use)
        local = np.full(len(size), -1)
        local[docs] = np.arange(len(docs))
        pick = use[doc]
        t = gram[pick]
        seg = (mix(t ^ U64(0x5851F42D4C957F2D * (level + 1) & (1 << 64) - 1)) % U64(m)).astype(np.int64)
        cell = local[doc[pick]] * m + seg
        element = mix(t + U64(0x2545F4914F6CDD1D))
        total = np.zeros(len(docs) * m, U64)
        np.add.at(total, cell, element)
        count = np.bincount(cell, minlength=len(total))
        twice = np.arange(m) < m2
        count2 = count.reshape(len(docs), m)
        weak = (count2[:, m2:] == 0).sum(1) + 2 * (count2[:, :m2] <= 1).sum(1)
        left = (slack - weak).astype(np.int32)
        salt = (np.arange(m).astype(U64) + U64(level << 40)) * U64(0x9E3779B97F4A7C15)
        low = U64((level & 1) * 2) + twice.astype(U64)

        def sig(sums, cells):
            s = cells % m
            return (mix(sums + salt[s]) & ~U64(3)) | low[s]

        full = np.flatnonzero(count)
        drop = np.flatnonzero(twice[seg] & (count[cell] > 1))
        for sums, cells in ((total[full], full), (total[cell[drop]] - element[drop], cell[drop])):
            of = cells // m
            yield sig(sums, cells), docs[of], left[of]
        gone = np.flatnonzero(left < 0)
        yield np.zeros(len(gone), U64), docs[gone], left[gone]


def _signature_rows(copies, k, similar):
    def run(batches):
        gone = copies.value if copies is not None else None
        for b in pieces(batches, 1, SET_BYTES):
            doc, gram = shingle_sets(Words(b.column(1), lower=True), k)
            size, key = _set_keys(doc, gram, b.num_rows)
            if gone is not None and len(gone):
                rows = b.column(0).to_numpy(zero_copy_only=False)
                copy = np.isin(_row_key(rows, key), gone)
                size = np.where(copy, 0, size)
                keep = ~copy[doc]
                doc, gram = doc[keep], gram[keep]
            for sig, of, left in signatures(doc, gram, size, similar):
                cls = key[of]
                # a document out of slack is marked by a row of its own, dealt by its class
                sig = np.where(sig == 0, cls, sig.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(cls), pa.array(left)],
                                                 names=["sig", "class", "left"])
    return run


def _row_key(rows: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(rows.astype(np.int64).view(U64) + U64(1)) ^ key.view(U64)


# ---------------------------------------------------------------- groups

def _shared_groups(batches):
    """From rows sorted by (sig, class): those of groups with two classes or
    more, each class once, with the group's first class as leader; and the
    rows that mark documents out of slack (sig = class).  The state is the last row, so a group may be of any length."""
    last = None  # (sig, leader, its left, whether the leader was given out, last class)
    for b in batches:
        sig, cls, left = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(sig):
            continue
        if last is not None:
            sig = np.concatenate([[last[0]], sig])
            cls = np.concatenate([[last[4]], cls])
            left = np.concatenate([[last[2]], left])
        n = len(sig)
        start = np.ones(n, bool)
        start[1:] = sig[1:] != sig[:-1]
        again = np.zeros(n, bool)
        again[1:] = ~start[1:] & (cls[1:] == cls[:-1])
        first = np.flatnonzero(start)[np.cumsum(start) - 1]
        leader = cls[first].copy()
        given = False
        if last is not None:
            leader[first == 0] = last[1]
            given = last[3]
        member = ~start & ~again
        led = np.unique(first[member])  # groups with a second class
        give = member.copy()
        for i in led:  # the leader's own row, once
            give[i] = True
        if last is not None and give[0]:
            give[0] = not given
        marks = sig == cls
        if last is not None:
            marks[0] = False
        give |= marks
        out_cls = cls.copy()
        if last is not None:
            out_cls[0] = last[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(sig[give]), pa.array(out_cls[give]), pa.array(left[give].astype(np.int32)), pa.array(leader[give])],
            names=["sig", "class", "left", "leader"])
        tail = first[-1]
        tail_given = bool(member[tail:].any()) or (tail == 0 and given)
        last = (sig[-1], leader[-1], left[tail] if tail else left[0], tail_given, cls[-1])


# ---------------------------------------------------------------- exact check

def word_set(text: str | None, k: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    w = (text or "").encode().lower().split()
    if len(w) < k:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(k))))


def _verify(k, similar):
    def run(batches):
        cache: tuple = (None, set())
        for b in batches:
            a_id, b_id, a_text, b_text = (b.column(i) for i in range(4))
            ok = np.zeros(b.num_rows, bool)
            ids = a_id.to_pylist()
            for i in range(b.num_rows):
                if cache[0] != ids[i]:
                    cache = (ids[i], word_set(a_text[i].as_py(), k))
                x, y = cache[1], word_set(b_text[i].as_py(), k)
                both = len(x & y)
                ok[i] = bool(both) and 100 * both >= similar * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([a_id.filter(pa.array(ok)), b_id.filter(pa.array(ok))], names=["a", "b"])
    return run


def _by_row(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Inner join on the row number; the rows go to the tasks when they are
    known to be few."""
    return table.join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows, "row")


class _Join:
    """One run of the join: classes, their texts and verification.  A class
    is represented by its first row, whose number no other row has."""

    def __init__(self, docs: DataFrame, k: int, similar: int):
        self.spark: SparkSession = docs.sparkSession
        self.k, self.similar = k, similar
        self.docs = keyed(texts(docs, "doc_id", "text"))[0].select("row", "text", "doc_id")
        self.rows = materialize(self.docs.mapInArrow(_class_rows(k), "row long, doc_id long, n_shingles long, class long, "
                                                     "sketch binary, fold array<long>"), "classes")
        full = self.rows.where("n_shingles > 0")
        self.classes = materialize(full.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.min("row").alias("first_row"),
                                                             F.count("*").alias("members"), F.min("n_shingles").alias("n"), F.first("sketch").alias("sketch"),
                                                             F.first("fold").alias("fold")), "class-ids")

    def representatives(self) -> DataFrame:
        """Signature rows of one document a class."""
        copies = self.rows.where("n_shingles > 0").join(self.classes.where("members > 1"), "class") \
            .where("row <> first_row").select("row", "class")
        n = copies.count()
        if n <= BROADCAST_IDS:
            t = copies.toArrow()
            keys = _row_key(t.column("row").to_numpy().astype(np.int64), t.column("class").to_numpy().astype(np.int64))
            shared = self.spark.sparkContext.broadcast(np.sort(keys))
            docs = self.docs
        else:
            shared = None
            docs = self.docs.join(self.classes.select(F.col("first_row").alias("row")), "row", "left_semi")
        return docs.select("row", "text").mapInArrow(_signature_rows(shared, self.k, self.similar), "sig long, class long, left int")

    def sketched(self, rows: DataFrame) -> DataFrame:
        """Adds each class's size and folded sketch."""
        return rows.join(self.classes.select("class", "n", "fold"), "class")

    def texts_of(self, pairs: DataFrame) -> DataFrame:
        need = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        firsts = self.classes.join(need, "class").select("class", F.col("first_row").alias("row"), "n")
        firsts = materialize(firsts, "firsts")
        return materialize(_by_row(self.docs, firsts).select("class", "text"), "pair-texts")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that are similar."""
        side = lambda x: self.classes.select(F.col("class").alias(x), F.col("n").alias("n" + x),
                                             F.col("sketch").alias("s" + x))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b")
        s = self.similar
        pairs = pairs.where((F.col("na") * 100 >= F.col("nb") * s) & (F.col("nb") * 100 >= F.col("na") * s))
        pairs = materialize(pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near_enough(s), "a long, b long"), "pairs")
        t = self.texts_of(pairs)
        both = pairs.join(t.select(F.col("class").alias("b"), F.col("text").alias("b_text")), "b") \
            .join(t.select(F.col("class").alias("a"), F.col("text").alias("a_text")), "a")
        return materialize(both.select("a", "b", "a_text", "b_text")
                           .mapInArrow(_verify(self.k, s), "a long, b long"), "links")

    def rare_heads(self, classes: DataFrame) -> DataFrame:
        """The rarest shingles of the given classes with their places: of two
        similar sets, the rarest n - ceil(n s / 100) + 1 of each meet."""
        firsts = materialize(self.classes.join(classes, "class").select("class", F.col("first_row").alias("row"), "n"), "rare")
        rows = _by_row(self.docs, firsts)
        k = self.k

        def explode(batches):
            for b in pieces(batches, 1, SET_BYTES):
                doc, gram = shingle_sets(Words(b.column(1), lower=True), k)
                cls = b.column(0).to_numpy(zero_copy_only=False)
                n = b.column(2).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(cls[doc]), pa.array(gram.view(np.int64)), pa.array(n[doc])],
                                                 names=["class", "gram", "n"])

        grams = materialize(rows.select("class", "text", "n").mapInArrow(explode, "class long, gram long, n long"), "grams")
        from pyspark.sql import Window
        often = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
        place = Window.partitionBy("class").orderBy(F.coalesce("df", F.lit(1)), "gram")
        prefix = F.col("n") - F.ceil(F.col("n") * self.similar / 100) + 1
        head = materialize(grams.join(often, "gram", "left").withColumn("place", F.row_number().over(place))
                           .where((F.col("place") <= prefix) & F.col("df").isNotNull())
                           .select("class", F.col("gram").alias("sig"), "n", "place"), "rare-heads")
        # short heads go with every row, so a pair is given once, at its first common shingle
        whole = head.groupBy("class").agg(F.count("*").alias("k"), F.array_sort(F.collect_list(F.struct("place", "sig"))).alias("head"))
        whole = whole.where(F.col("k") <= HEAD_ROW).select("class", F.col("head.sig").alias("head"))
        return head.join(whole, "class", "left")


def _labelled(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Adds each class's component so far (itself if it has no link)."""
    c = components.select(F.col("node").alias("class"), "component")
    return rows.join(c, "class", "left").withColumn("component", F.coalesce("component", "class"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """(class, leader) rows as pairs a < b."""
    return pairs.select(F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b")).distinct()


def _may_be_similar(similar: int) -> Column:
    """Whether the sizes and folded sketches of the classes a and b leave
    room for a similarity of ``similar`` (bits that differ are at most the
    elements that differ)."""
    na, nb = F.col("n_a"), F.col("n_b")
    differ = [F.bit_count(F.get("fold_a", F.lit(i)).bitwiseXOR(F.get("fold_b", F.lit(i)))) for i in range(FOLD)]
    fits = (na * 100 >= nb * similar) & (nb * 100 >= na * similar)
    return fits & (sum(differ[1:], differ[0]) * (100 + similar) <= (na + nb) * (100 - similar))


def _sides(rows: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
    """The rows twice, their columns but ``sig`` named after the classes a
    and b of a pair."""
    return tuple(rows.select("sig", *[F.col(c).alias(f"{c}_{side}") for c in cols]) for side in "ab")


def _leader_pairs(rows: DataFrame, similar: int) -> DataFrame:
    """Pairs (class, leader) of sketched rows of groups whose leader is of
    another component, if they may be similar."""
    of = ("class", "component", "n", "fold")
    x, y = _sides(rows.where("component <> lead"), *of)[0], _sides(rows.where(F.col("class") == F.col("leader")), *of)[1]
    found = x.join(y, "sig").where(_may_be_similar(similar) & (F.col("component_a") != F.col("component_b")))
    return found.select(F.col("class_a").alias("class"), F.col("class_b").alias("leader"))


def _pairs_between(rows: DataFrame, similar: int) -> DataFrame:
    """Pairs of classes of different components with a common signature that
    may be similar, from sketched rows."""
    x, y = _sides(rows, "class", "component", "n", "fold")
    found = x.join(y, "sig").where((F.col("class_a") < F.col("class_b")) & (F.col("component_a") != F.col("component_b")) &
                                   _may_be_similar(similar))
    return found.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def _rare_pairs_between(heads: DataFrame, similar: int) -> DataFrame:
    """Pairs of classes of different components that may be similar: with
    the common elements c that their sizes ask for, they meet among the
    rarest n - c + 1 of each."""
    x, y = _sides(heads, "class", "component", "n", "place", "head", "fold")
    total = F.col("n_a") + F.col("n_b")
    common = F.ceil(total * similar / (100 + similar))
    meet = (F.col("place_a") <= F.col("n_a") - common + 1) & (F.col("place_b") <= F.col("n_b") - common + 1)
    once = F.coalesce(F.get(F.array_intersect("head_a", "head_b"), F.lit(0)) == F.col("x.sig"), F.lit(True))
    on = (F.col("x.sig") == F.col("y.sig")) & (F.col("class_a") < F.col("class_b")) & \
        (F.col("component_a") != F.col("component_b")) & meet & _may_be_similar(similar) & once
    return x.alias("x").join(y.alias("y"), on).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def similar_classes(docs: DataFrame, k: int = SHINGLE, similar: int = SIMILAR, group: int = GROUP):
    """(rows, classes, links, components): every document's class (equal
    sets), each class's smallest doc_id, links between classes that settle
    the components, and the component of every linked class."""
    run = _Join(docs, k, similar)
    sigs = run.representatives()
    marked = sigs.repartition("sig").sortWithinPartitions("sig", "class")
    shared = materialize(marked.mapInArrow(_shared_groups, "sig long, class long, left int, leader long"), "shared")
    real = shared.where("sig <> class")
    # each class with the smallest of its groups' first ones: a pair a class settles most of a large family
    first = _ordered(real.where("class <> leader").groupBy("class").agg(F.min("leader").alias("leader")))
    links = run.verified(materialize(first, "first-pairs"))
    components = materialize(connected_components(links), "components")
    # groups that still hold more than one component
    rows = materialize(_labelled(real, components), "labelled")
    mixed = rows.groupBy("sig").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"),
                                    F.max(F.when(F.col("class") == F.col("leader"), F.col("component"))).alias("lead"))
    mixed = mixed.where("lo <> hi").select("sig", "size", "lead")
    rows = materialize(run.sketched(rows.join(mixed, "sig")), "open-groups")
    stars = _ordered(_leader_pairs(rows, similar))
    more = stars.unionByName(_pairs_between(rows.where(F.col("size") <= group), similar)).distinct().join(first, ["a", "b"], "left_anti")
    links = links.unionByName(run.verified(more))
    components = materialize(connected_components(links), "components")
    large = _labelled(rows.where(F.col("size") > group).drop("component"), components)
    still = large.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig")
    # classes that left out more in large groups than their slack allows
    weight = F.when(F.col("sig").bitwiseAND(1) == 1, 2).otherwise(1)
    out = large.join(still, "sig", "left_semi").groupBy("class", F.col("sig").bitwiseAND(2).alias("parity")) \
        .agg(F.sum(weight).alias("lost"), F.min("left").alias("left")).where("lost > left").select("class") \
        .unionByName(shared.where("sig = class").select("class")).distinct()
    heads = _labelled(run.sketched(run.rare_heads(materialize(out, "exceptions")).drop("n")), components)
    links = links.unionByName(run.verified(_rare_pairs_between(heads, similar)))
    components = materialize(connected_components(links), "components")
    return run.rows, run.classes, links, components


def near_duplicates(docs: DataFrame, k: int = SHINGLE, similar: int = SIMILAR, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id (the smallest doc_id of
    the class and of all documents reachable by links)."""
    rows, classes, _, components = similar_classes(docs, k, similar, group)
    named = _labelled(classes, components)
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = materialize(named.join(lowest, "component").select("class", F.col("first_id").alias("class_id"), "component_id"),
                        "class-components")
    out = rows.join(named, "class", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"),
                      F.coalesce("component_id", "doc_id").alias("component_id"))


def op2(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_shingles", "component_id")
