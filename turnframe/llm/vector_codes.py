"""Product codes of vectors, learned over anchors-hierarchy metric trees.

A vector is cut into ``parts`` equal consecutive parts of whole numbers
floor(256 x).  Each part position has a codebook; learning assigns every part
to its nearest entry and replaces entries by the floored means of their parts.

Vectors are packed once into rows of at most ``CHUNK`` vectors.  For every
part position such a row has a metric tree over its distinct parts:

* Anchors: the farthest point of the widest ball becomes a new anchor, which
  takes over the points that are nearer to it; points nearer to their anchor
  than half the distance between both anchors are not looked at.
* Middle-out: the anchors' balls are joined pairwise, the tightest joint ball
  first, up to the root, and balls of many points are cut again by anchors.
* Every ball keeps its centre, radius, and its points' sums and counts.

A round walks the trees from the roots.  A ball inherits its parent's list of
entries that may be nearest to some of its points; an entry leaves the list
when another one is nearer in the whole ball.  A ball whose list has one entry
left is owned: its cached sums and counts go to that entry, unread.  At the
leaves the remaining entries are compared exactly, in whole numbers, ties to
the lower index.  Trees do not change between rounds; only codebooks (a fixed
number of entries) go to the tasks and sums of entries come back.

Rows whose vector is null or holds null, NaN or infinite components are
dropped.  The first entries are the parts of the smallest vec_ids (null ids
last, equal ids by their vectors); with fewer vectors there are fewer entries.
Vectors whose length differs from the first one's keep a null code and error;
a length that ``parts`` does not divide is filled up with zeros.  Repeated rows
are each coded.  Components of 2**23 and more are refused, so whole numbers
stay exact.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import join_groups, materialize
from .text import give_back

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
CHUNK = 4096
LEAF = 40
LIMIT = 1 << 31  # of floor(256 x)
NODE = np.dtype([("lo", "<i4"), ("hi", "<i4"), ("left", "<i4"), ("right", "<i4"), ("radius", "<f8"), ("count", "<i8")])


# ---------------------------------------------------------------- trees

def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = x - p
    return np.sqrt(np.einsum("...i,...i->...", d, d))


def anchors(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner of every point, distance to it) of at most n anchors; stops
    early when every point is an anchor's place."""
    owner = np.zeros(len(x), np.int64)
    places = [x[0]]
    dist = _distances(x, x[0])
    while len(places) < n:
        far = int(dist.argmax())
        if dist[far] <= 0:
            break
        new = x[far]
        apart = _distances(np.array(places), new)
        ask = np.flatnonzero(dist > apart[owner] / 2)
        d = _distances(x[ask], new)
        win = d < dist[ask]
        owner[ask[win]] = len(places)
        dist[ask[win]] = d[win]
        places.append(new)
    return owner, dist


class MetricTree:
    """A tree over distinct points with multiplicities.  ``order`` lists the
    points so that each ball is a range; node 0 is the root."""

    def __init__(self, points: np.ndarray, weight: np.ndarray, leaf: int = LEAF):
        self.points, self.weight = points, weight
        self.x = points.astype(np.float64)
        self.leaf = leaf
        self.rows: list[list] = []  # [points, left, right, centre, radius, count, sums]
        self.root = self._build(np.arange(len(points))) if len(points) else -1

    def _ball(self, at: np.ndarray, left: int = -1, right: int = -1) -> int:
        w = self.weight[at]
        sums = w @ self.points[at]
        count = int(w.sum())
        centre = sums / count
        radius = float(_distances(self.x[at], centre).max())
        self.rows.append([at, left, right, centre, radius, count, sums])
        return len(self.rows) - 1

    def _build(self, at: np.ndarray) -> int:
        if len(at) <= self.leaf:
            return self._ball(at)
        owner, _ = anchors(self.x[at], max(2, int(len(at) ** 0.5)))
        order = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[order])) + 1
        groups = np.split(at[order], cuts)
        if len(groups) == 1:
            return self._ball(at)
        return self._join([self._build(g) for g in groups])

    def _join(self, balls: list[int]) -> int:
        """Joins balls pairwise, the smallest joint radius first."""
        k = len(balls)
        centre = np.array([self.rows[b][3] for b in balls])
        radius = np.array([self.rows[b][4] for b in balls])
        count = np.array([self.rows[b][5] for b in balls], np.float64)
        node = list(balls)

        def cost(i):  # radius of the joint ball of i and every other one
            total = count[i] + count
            middle = (centre[i] * count[i] + centre * count[:, None]) / total[:, None]
            return np.maximum(_distances(middle, centre[i]) + radius[i], _distances(middle, centre) + radius)

        costs = np.array([cost(i) for i in range(k)])
        np.fill_diagonal(costs, np.inf)
        for _ in range(k - 1):
            i, j = divmod(int(costs.argmin()), k)
            a, b = self.rows[node[i]], self.rows[node[j]]
            sums, n = a[6] + b[6], a[5] + b[5]
            middle = sums / n
            r = max(_distances(a[3], middle) + a[4], _distances(b[3], middle) + b[4])
            self.rows.append([None, node[i], node[j], middle, float(r), n, sums])
            node[i] = len(self.rows) - 1
            centre[i], radius[i], count[i] = middle, r, n
            costs[j], costs[:, j] = np.inf, np.inf
            gone = np.isinf(costs[i])
            c = np.where(gone, np.inf, cost(i))
            c[i] = np.inf
            costs[i], costs[:, i] = c, c
        return len(self.rows) - 1 if k > 1 else balls[0]

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, centres, sums, order of the points), parents before
        children."""
        dims = self.points.shape[1]
        n = len(self.rows)
        nodes, centres = np.zeros(n, NODE), np.zeros((n, dims))
        sums, order, at = np.zeros((n, dims), np.int64), [], 0
        number, stack, out = {}, [self.root] if n else [], []
        while stack:  # depth first, so each ball's points are consecutive
            me = stack.pop()
            number[me] = len(out)
            out.append(me)
            if self.rows[me][1] >= 0:
                stack += [self.rows[me][2], self.rows[me][1]]
        for me in out:
            pts, left, right, centre, radius, count, total = self.rows[me]
            k = number[me]
            lo = at
            if left < 0:
                order.append(pts)
                at += len(pts)
            nodes[k] = (lo, at, number.get(left, -1), number.get(right, -1), radius, count)
            centres[k], sums[k] = centre, total
        for k in range(len(out) - 1, -1, -1):  # a ball ends where its right child does
            if nodes["left"][k] >= 0:
                nodes["hi"][k] = nodes["hi"][nodes["right"][k]]
        return nodes, centres, sums, np.concatenate(order) if order else np.zeros(0, np.int64)


def walk(tree: tuple, points: np.ndarray, weight: np.ndarray, book: np.ndarray, give=None):
    """Finds every point's nearest entry (ties to the lower index).

    Returns (sums, counts) of the entries; owned balls give their cached
    values.  With ``give`` (an integer array) the points' entries are written
    there instead.  Also returns how many points were compared one by one."""
    nodes, centres, sums, order = tree
    k, dims = book.shape
    total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    compared = 0
    if not len(nodes):
        return total, n, compared
    b = book.astype(np.float64)
    apart = _distances(b[:, None, :], b[None, :, :])
    _, first = np.unique(book, axis=0, return_index=True)  # of equal entries the lowest wins
    start = np.zeros(k, bool)
    start[first] = True
    front, lists = np.zeros(1, np.int64), start[None, :]
    while len(front):
        d = centres[front][:, None, :] - b[None, :, :]
        d = np.where(lists, np.einsum("nki,nki->nk", d, d), np.inf)
        best = d.argmin(1)
        least = d[np.arange(len(front)), best]
        # x in the ball: |x-c|^2 - |x-best|^2 is at least this difference at the centre less 2 r |c-best|
        slack = 2 * nodes["radius"][front][:, None] * apart[best] * (1 + 1e-9) + 1e-6 * (1 + least[:, None])
        lists = lists & (d - least[:, None] <= slack)
        owned = lists.sum(1) == 1
        if give is None:
            np.add.at(total, best[owned], sums[front[owned]])
            np.add.at(n, best[owned], nodes["count"][front[owned]])
        else:
            for f, e in zip(front[owned].tolist(), best[owned].tolist()):
                give[order[nodes["lo"][f]:nodes["hi"][f]]] = e
        leaf = ~owned & (nodes["left"][front] < 0)
        for f, names in zip(front[leaf].tolist(), lists[leaf]):
            at = order[nodes["lo"][f]:nodes["hi"][f]]
            entries = np.flatnonzero(names)
            d = points[at][:, None, :] - book[entries][None, :, :]
            near = entries[np.einsum("nki,nki->nk", d, d).argmin(1)]
            compared += len(at)
            if give is None:
                np.add.at(total, near, points[at] * weight[at][:, None])
                np.add.at(n, near, weight[at])
            else:
                give[at] = near
        down = ~owned & ~leaf
        f = front[down]
        front = np.concatenate([nodes["left"][f], nodes["right"][f]]).astype(np.int64)
        lists = np.concatenate([lists[down], lists[down]])
    return total, n, compared


# ---------------------------------------------------------------- packed rows

PACKED = ("ids array<long>, labels array<string>, dims int, vectors binary, which binary, sizes array<int>, nodes binary, centres binary, "
          "sums binary, orders binary, points binary, weights binary")


def whole_numbers(vectors: np.ndarray, parts: int) -> np.ndarray:
    """floor(256 x) as (vectors, parts, part length), filled up with zeros."""
    x = np.floor(vectors.astype(np.float64) * SCALE)
    if len(x) and np.abs(x).max(initial=0) >= LIMIT:
        raise ValueError("vector components must be below 2**23")
    x = x.astype(np.int64)
    more = -x.shape[1] % parts
    if more:
        x = np.pad(x, ((0, 0), (0, more)))
    return x.reshape(len(x), parts, -1)


def _pack(ids, labels, vectors: np.ndarray, parts: int) -> dict:
    x = whole_numbers(vectors, parts)
    out = {"ids": ids, "labels": labels, "dims": x.shape[2], "vectors": x.astype("<i4").tobytes(), "sizes": []}
    cols: dict[str, list[bytes]] = {c: [] for c in ("which", "nodes", "centres", "sums", "orders", "points", "weights")}
    for j in range(parts):
        points, which, weight = np.unique(x[:, j], axis=0, return_inverse=True, return_counts=True)
        tree = MetricTree(points, weight)
        nodes, centres, sums, order = tree.packed()
        out["sizes"] += [len(points), len(nodes)]
        for c, v in (("which", which.reshape(-1).astype("<i4")), ("nodes", nodes), ("centres", centres), ("sums", sums),
                     ("orders", order.astype("<i4")), ("points", points.astype("<i4")), ("weights", weight.astype("<i4"))):
            cols[c].append(v.tobytes())
    return out | {c: b"".join(v) for c, v in cols.items()}


def _unpack(row: dict, parts: int):
    """Yields per part: (tree, points, weights, number of each vector's
    distinct part)."""
    dims, n = row["dims"], len(row["ids"])
    nodes = np.frombuffer(row["nodes"], NODE)
    arrays = {c: np.frombuffer(row[c], t).reshape(-1, dims) for c, t in (("centres", "<f8"), ("sums", "<i8"), ("points", "<i4"))}
    orders, weights = np.frombuffer(row["orders"], "<i4"), np.frombuffer(row["weights"], "<i4")
    which = np.frombuffer(row["which"], "<i4").reshape(parts, n)
    p = q = 0
    for j in range(parts):
        k, m = row["sizes"][2 * j:2 * j + 2]
        tree = nodes[q:q + m], arrays["centres"][q:q + m], arrays["sums"][q:q + m], orders[p:p + k]
        yield tree, arrays["points"][p:p + k].astype(np.int64), weights[p:p + k].astype(np.int64), which[j]
        p, q = p + k, q + m


def _pack_rows(length: int, parts: int, chunk: int):
    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            flat = np.asarray(t.column(1).combine_chunks().flatten()).reshape(t.num_rows, length)
            r = _pack(t.column(0).to_pylist(), t.column(2).to_pylist(), flat, parts)
            return pa.RecordBatch.from_pylist([r], schema=_ARROW)

        have = 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                take = min(chunk - have, b.num_rows - at)
                held.append(b.slice(at, take))
                have, at = have + take, at + take
                if have == chunk:
                    yield flush()
                    have = 0
        if have:
            yield flush()
        give_back()
    return run


_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("dims", pa.int32()), ("vectors", pa.binary()),
                    ("which", pa.binary()), ("sizes", pa.list_(pa.int32())), ("nodes", pa.binary()), ("centres", pa.binary()),
                    ("sums", pa.binary()), ("orders", pa.binary()), ("points", pa.binary()), ("weights", pa.binary())])


def _round(shared, parts: int):
    """Sums and counts of the entries over a task's rows."""
    def run(batches):
        books = shared.value
        sums = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                for j, (tree, points, weight, _) in enumerate(_unpack(row, parts)):
                    s, n, _ = walk(tree, points, weight, books[j])
                    sums[j] += s
                    counts[j] += n
        rows = [(j, e, int(counts[j][e]), sums[j][e].tolist()) for j in range(parts) for e in range(len(counts[j])) if counts[j][e]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"])
        give_back()
    return run


def _assign(shared, parts: int):
    def run(batches):
        books = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                n = len(row["ids"])
                code = np.zeros((n, parts), np.uint8)
                error = np.zeros(n, np.int64)
                x = np.frombuffer(row["vectors"], "<i4").reshape(n, parts, row["dims"])
                for j, (tree, points, weight, which) in enumerate(_unpack(row, parts)):
                    near = np.zeros(len(points), np.int64)
                    walk(tree, points, weight, books[j], near)
                    code[:, j] = near[which]
                    d = x[:, j].astype(np.int64) - books[j][near[which]]
                    error += np.einsum("ni,ni->n", d, d)
                raw = code.tobytes().hex()
                w = 2 * parts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()),
                     pa.array([raw[w * k:w * k + w] for k in range(n)]), pa.array(error)], names=["vec_id", "label", "code", "error"])
        give_back()
    return run


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def learn_codebooks(packed: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """Rounds of assignment and floored means; unused entries stay."""
    spark, parts = packed.sparkSession, len(books)
    dims = books[0].shape[1]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        sums = packed.drop("ids", "labels", "vectors", "which").withColumn("ids", F.array().cast("array<long>")) \
            .withColumn("which", F.lit(b"")).mapInArrow(_round(shared, parts), "part int, entry int, n long, sums array<long>")
        exact = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims)]
        new = [b.copy() for b in books]
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact).collect():
            new[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
        books = new
    return books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


OUT = "vec_id long, label {}, code string, error long"


def encode_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
                   chunk: int = CHUNK) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error of every kept vector; final codebooks)."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["label"]
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"),
                       F.col("label").cast("string").alias("label")).where(finite(F.col("v")))
    first = v.orderBy(F.col("vec_id").isNull(), "vec_id", "v").select("v").limit(entries).collect()
    if not first:
        return spark.createDataFrame([], OUT.format(kind)), []
    length = len(first[0]["v"])
    fit = F.size("v") == length
    start = [r["v"] for r in first if len(r["v"]) == length]
    if length == 0:
        return v.select("vec_id", F.col("label").cast(kind).alias("label"), F.when(fit, F.lit("00" * parts)).alias("code"),
                        F.when(fit, F.lit(0).cast("long")).alias("error")), [np.zeros((len(start), 0), np.int64)] * parts
    x = whole_numbers(np.array(start), parts)
    packed = v.where(fit).mapInArrow(_pack_rows(length, parts, chunk), PACKED)
    packed = materialize(packed, "vector-trees")
    books = learn_codebooks(packed, [np.ascontiguousarray(x[:, j]) for j in range(parts)], rounds)
    shared = spark.sparkContext.broadcast(books)
    out = packed.mapInArrow(_assign(shared, parts), OUT.format("string"))
    odd = v.where(~fit).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return out.unionByName(odd).withColumn("label", F.col("label").cast(kind)), books


def op12(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all embeddings."""
    coded, books = encode_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = materialize(coded, "vector-codes")
    total = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = join_groups(coded, total, "label", "n")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
