"""Adaptive context-mixing range coder for blocks of token ids (numpy).

Every block starts from empty tables and is coded on its own; many blocks are
coded side by side, one array lane each.  Within a block an id is known by its
rank, the place of its first appearance among the block's different ids.
Before a rank is coded, its two and its one predecessor each predict a rank
(the last that followed them) with a confidence.  Two adaptive confidence
probabilities are mixed in the logistic domain, by weights that are trained
along, into the probability that the order-2 prediction holds; next comes the
order-1 prediction's; a rank that neither tells is coded by its order-0
frequency among the ranks told that way so far, and an id that is new evenly.
All arithmetic is on integers, so a block decodes alike on every machine.

The order-0 sums are brought up to date at fixed places; ranks that are new
since the last one have a share of one each.  The decoder keeps a list with
each rank as often as it counts, so a sum's rank is one look-up.

The range coder has a 64-bit low end and range and gives out words of 32 bits;
a carry is added to the words before.  A coded block begins with one word, the
number of its different ids.
"""

from __future__ import annotations

import numpy as np

VOCABULARY = 1 << 16
SLOTS = 1 << 11
STATES = 16
ONE = 1 << 16
RATE = 5
ROOM = 128
LONGEST = (1 << 12) - 1  # ids of a block; a prediction and its state share 16 bits
_U = np.uint64
_LOW32 = _U(0xFFFFFFFF)
_SIXTEEN = _U(16)

# logistic tables: probabilities of 16 bits in steps of 16, logits in steps of 1/256
_X = (np.arange(ONE >> 4) + 0.5) / (ONE >> 4)
STRETCH = np.clip(np.rint(np.log(_X / (1 - _X)) * 256), -2047, 2047).astype(np.int32)
SQUASH = np.clip(np.rint(ONE / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 64, ONE - 64).astype(np.int32)


def _rebuild_points(longest: int) -> set[int]:
    """Places at which the order-0 frequencies are brought up to date."""
    points, at = set(), 16
    while at < longest:
        points.add(at)
        at += max(16, at // 6)
    return points


class _Lanes:
    """The models of blocks that are coded side by side; each lane's entries
    of a table lie together."""

    def __init__(self, lanes: int, distinct: int, inverse: bool):
        self.width = distinct + 1
        lane = np.arange(lanes, dtype=np.int32)
        self.base1, self.base2 = lane * np.int32(self.width), lane * np.int32(SLOTS)
        self.base_s = lane * np.int32(STATES)
        self.r1, self.r2 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        # a predicted rank and, in the low four bits, how sure it is (0: nothing seen, and a rank that none has)
        self.told1 = np.full(lanes * self.width, distinct << 4, np.uint16)
        self.told2 = np.full(lanes * SLOTS, distinct << 4, np.uint16)
        self.chance2, self.other = (np.full(lanes * STATES, ONE // 2, np.int32) for _ in range(2))
        self.chance1 = np.full(2 * lanes * STATES, ONE // 2, np.int32)
        self.weight2, self.weight1, self.bias = (np.full(lanes, ONE // 2, np.int32) for _ in range(3))
        self.count = np.zeros(lanes * self.width, np.uint16)
        self.sums = np.zeros(lanes * self.width, np.int32)  # of the counts before each rank
        self.total = np.zeros(lanes, np.int32)
        self.top = np.zeros(lanes, np.int32)  # ranks in the sums
        self.seen = np.zeros(lanes, np.int32)  # ranks so far
        self.inverse = np.zeros(1, np.uint16) if inverse else None
        self.inverse_at = np.zeros(lanes, np.int64)
        self.every_rank = np.tile(np.arange(self.width, dtype=np.uint16), lanes) if inverse else None

    def predict(self, n: int) -> None:
        """The first n lanes' predictions and their chances."""
        r1 = self.r1[:n]
        self.i2 = i2 = (((r1 * np.int32(8109) + self.r2[:n] * np.int32(5003)) >> 3) & np.int32(SLOTS - 1)) + self.base2[:n]
        self.i1 = i1 = self.base1[:n] + r1
        self.e2, self.e1 = e2, e1 = self.told2.take(i2).astype(np.int32), self.told1.take(i1).astype(np.int32)
        self.g2, self.g1 = g2, g1 = e2 >> 4, e1 >> 4
        self.s2, self.s1 = s2, s1 = e2 & 15, e1 & 15
        self.same = same = g2 == g1
        base = self.base_s[:n]
        self.j2, self.jo = s2 + base, s1 + base
        self.j1 = (self.jo << 1) + same
        self.v2, self.v1, self.vo = self.chance2.take(self.j2), self.chance1.take(self.j1), self.other.take(self.jo)
        self.a2, self.a1 = STRETCH.take(self.v2 >> 4), STRETCH.take(self.v1 >> 4)
        dot = (self.weight2[:n] * self.a2 + self.weight1[:n] * self.a1 + self.bias[:n] * np.int32(32)) >> 16
        self.p2 = SQUASH.take(np.minimum(np.maximum(dot, -2047), 2047) + 2047)
        # of the rest; without another prediction there is no such case
        rest = ((ONE - self.p2) * (np.minimum(np.maximum(self.vo, 64), ONE - 64) >> 1)) >> 15
        self.p1 = np.where(same, 0, np.maximum(rest, 1))

    def learn(self, n: int, rank: np.ndarray, hit2: np.ndarray) -> None:
        """Brings predictions, chances and weights up to the coded ranks."""
        right1 = rank == self.g1
        bit = hit2.astype(np.int32) << 16
        error = (bit - self.p2) * 3 >> 7
        self.weight2[:n] += self.a2 * error >> 6
        self.weight1[:n] += self.a1 * error >> 6
        self.bias[:n] += error >> 1
        self.chance2.put(self.j2, self.v2 + ((bit - self.v2) >> RATE))
        bit1 = right1.astype(np.int32) << 16
        self.chance1.put(self.j1, self.v1 + ((bit1 - self.v1) >> RATE))
        self.other.put(self.jo, self.vo + (((bit1 - self.vo) >> RATE) * ~(hit2 | self.same)))
        new = (rank << 4) + 1
        for told, at, e, s, right in ((self.told2, self.i2, self.e2, self.s2, hit2), (self.told1, self.i1, self.e1, self.s1, right1)):
            missed = np.where(s > 3, e - s + (s >> 1), new)
            told.put(at, np.where(right & (s > 0), e + (s < 15), missed))
        self.r2[:n] = self.r1[:n]
        self.r1[:n] = rank

    def refresh(self, n: int) -> None:
        """Brings the order-0 sums up to date."""
        w = self.width
        count = self.count[:n * w].reshape(n, w)
        sums = np.cumsum(count, axis=1, dtype=np.int32)
        self.total[:n] = sums[:, -1]
        np.subtract(sums, count, out=self.sums[:n * w].reshape(n, w))
        self.top[:n] = self.seen[:n]
        if self.inverse is not None:
            self.inverse = np.repeat(self.every_rank[:n * w], self.count[:n * w])
            self.inverse_at[:n] = np.cumsum(self.total[:n], dtype=np.int64) - self.total[:n]

    def note(self, rows: np.ndarray, rank: np.ndarray) -> None:
        """Counts ranks told by order 0."""
        at = self.base1[rows] + rank
        self.count.put(at, self.count.take(at) + np.uint16(1))


class _Encoder:
    def __init__(self, lanes: int, longest: int):
        self.low = np.zeros(lanes, _U)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
        self.words = np.zeros((lanes, longest // 3 + 2 * ROOM), np.uint32)
        self.n = np.zeros(lanes, np.int64)

    def make_room(self) -> None:
        """Called every ROOM // 2 ids: an id takes under 64 bits (a case of 16
        at most, a sum of 13 and an even code of 16)."""
        if len(self.n) and int(self.n.max()) + ROOM + 2 > self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros((len(self.n), self.words.shape[1] // 2 + ROOM), np.uint32)], 1)

    def put(self, rows, part, start, size) -> None:
        """Codes [start, start + size) of the lanes' ranges cut into
        ``part``s."""
        low = self.low[rows]
        new = low + part * start
        over = np.flatnonzero(new < low)
        if len(over):
            self._carry(over if isinstance(rows, slice) else rows[over])
        r = part * size
        small = np.flatnonzero(r <= _LOW32)
        if len(small):
            lanes = small if isinstance(rows, slice) else rows[small]
            out = new[small]
            at = self.n[lanes]
            self.words[lanes, at] = (out >> _U(32)).astype(np.uint32)
            self.n[lanes] = at + 1
            new[small] = out << _U(32)
            r[small] <<= _U(32)
        self.low[rows], self.range[rows] = new, r

    def _carry(self, lanes: np.ndarray) -> None:
        at = self.n[lanes] - 1
        self.words[lanes, at] += np.uint32(1)
        for lane, k in zip(lanes[wrapped := self.words[lanes, at] == 0], at[wrapped]):
            while k > 0 and not self.words[lane, k]:
                k -= 1
                self.words[lane, k] += np.uint32(1)

    def finish(self, lane: int, distinct: int) -> bytes:
        k = int(self.n[lane])
        ends = np.array([distinct, int(self.low[lane]) >> 32, int(self.low[lane]) & 0xFFFFFFFF], np.uint32)
        return np.concatenate([ends[:1], self.words[lane, :k], ends[1:]]).astype("<u4").tobytes()


class _Decoder:
    def __init__(self, data: list[bytes]):
        sizes = [len(x) // 4 for x in data]
        self.words = np.zeros((len(data), max(sizes, default=0) + 4), np.uint32)
        for i, x in enumerate(data):
            self.words[i, :sizes[i]] = np.frombuffer(x, "<u4")
        self.distinct = self.words[:, 0].astype(np.int64)
        self.value = self.words[:, 1].astype(_U) << _U(32) | self.words[:, 2].astype(_U)
        self.range = np.full(len(data), 0xFFFFFFFFFFFFFFFF, _U)
        self.n = np.full(len(data), 3, np.int64)

    def take(self, rows, value, size) -> None:
        """Goes on with a range of ``size`` and the value in it."""
        small = np.flatnonzero(size <= _LOW32)
        if len(small):
            lanes = small if isinstance(rows, slice) else rows[small]
            at = self.n[lanes]
            value[small] = value[small] << _U(32) | self.words[lanes, at]
            self.n[lanes] = at + 1
            size[small] <<= _U(32)
        self.value[rows], self.range[rows] = value, size


def _first_ranks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each id by first appearance, the ids in order of rank)."""
    known, first, which = np.unique(ids, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    rank = np.empty(len(first), np.int32)
    rank[order] = np.arange(len(first), dtype=np.int32)
    return rank[which], known[order]


def _by_size(sizes) -> tuple[list[int], np.ndarray]:
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    size = np.array([sizes[i] for i in order], np.int64)
    if len(size) and size[0] > LONGEST:
        raise ValueError(f"a block has at most {LONGEST} ids")
    return order, size


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Codes each block of ids (0 to 65535) on its own."""
    lanes = len(blocks)
    order, size = _by_size([len(b) for b in blocks])
    longest = int(size[0]) if lanes else 0
    rank, known = np.zeros((longest, lanes), np.uint16), []  # known: each lane's ids in order of rank
    for lane, i in enumerate(order):
        if len(blocks[i]):
            rank[:size[lane], lane], ids = _first_ranks(blocks[i])
            known.append(ids.astype(np.uint16))
        else:
            known.append(np.zeros(0, np.uint16))
    distinct = np.array([len(k) for k in known], np.int64)
    by_rank = np.zeros((lanes, int(distinct.max(initial=0))), np.uint16)
    for lane, k in enumerate(known):
        by_rank[lane, :len(k)] = k
    del known
    m, coder = _Lanes(lanes, int(distinct.max(initial=0)), False), _Encoder(lanes, longest)
    points = _rebuild_points(longest)
    live = lanes - np.searchsorted(size[::-1], np.arange(longest), "right")
    for t, n in enumerate(live.tolist()):
        if t in points:
            m.refresh(n)
        if t % (ROOM // 2) == 0:
            coder.make_room()
        m.predict(n)
        x = rank[t, :n].astype(np.int32)
        every = slice(0, n)
        hit2 = x == m.g2
        # with one prediction of both orders, the second case has no share
        hit1 = (x == m.g1) & ~hit2
        p2, p12 = m.p2.astype(_U), (m.p2 + m.p1).astype(_U)
        start = np.where(hit2, _U(0), np.where(hit1, p2, p12))
        end = np.where(hit2, p2, np.where(hit1, p12, _U(ONE)))
        coder.put(every, coder.range[every] >> _SIXTEEN, start, end - start)
        rows = np.flatnonzero(~(hit2 | hit1))
        if len(rows):
            _code_order0(m, rows, x[rows], by_rank, coder)
        m.learn(n, x, hit2)
    out: list[bytes] = [b""] * lanes
    for lane, i in enumerate(order):
        out[i] = coder.finish(lane, int(distinct[lane]))
    return out


def _code_order0(m: _Lanes, rows, rank, by_rank, coder: _Encoder) -> None:
    top, seen, tot = m.top.take(rows), m.seen.take(rows), m.total.take(rows)
    at = m.base1.take(rows) + rank
    start = m.sums.take(at)
    settled, fresh = rank < top, rank >= seen
    width = np.where(settled, m.sums.take(at + 1) - start, np.where(fresh, seen + 1, 1))
    start = np.where(settled, start, tot + rank - top)
    part = coder.range[rows] // (tot + (seen - top) + (seen + 1)).astype(_U)
    coder.put(rows, part, start.astype(_U), width.astype(_U))
    new = rows[fresh]
    if len(new):
        coder.put(new, coder.range[new] >> _SIXTEEN, by_rank[new, seen[fresh]].astype(_U), _U(1))
        m.seen[new] += 1
    m.note(rows, rank)


def decode_blocks(data: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of blocks, given each one's number of ids."""
    lanes = len(data)
    order, size = _by_size(sizes)
    longest = int(size[0]) if lanes else 0
    coder = _Decoder([data[i] for i in order])
    distinct = int(coder.distinct.max(initial=0))
    if distinct > min(longest, VOCABULARY):
        raise ValueError("a block has more different ids than ids")
    rank = np.zeros((longest, lanes), np.int16)
    m = _Lanes(lanes, distinct, True)
    by_rank = np.zeros((lanes, distinct + 1), np.uint16)
    points = _rebuild_points(longest)
    live = lanes - np.searchsorted(size[::-1], np.arange(longest), "right")
    for t, n in enumerate(live.tolist()):
        if t in points:
            m.refresh(n)
        m.predict(n)
        every = slice(0, n)
        value, part = coder.value[every], coder.range[every] >> _SIXTEEN
        cut2, cut1 = part * m.p2.astype(_U), part * (m.p2 + m.p1).astype(_U)
        hit2, under = value < cut2, value < cut1
        start = np.where(hit2, _U(0), np.where(under, cut2, cut1))
        end = np.where(hit2, cut2, np.where(under, cut1, part << _SIXTEEN))
        coder.take(every, value - start, end - start)
        x = np.where(hit2, m.g2, m.g1)
        rows = np.flatnonzero(~(hit2 | under))
        if len(rows):
            x[rows] = _read_order0(m, rows, coder, by_rank)
        rank[t, :n] = x
        m.learn(n, x, hit2)
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * lanes
    for lane, i in enumerate(order):
        out[i] = by_rank[lane].take(rank[:size[lane], lane])
    return out


def _read_order0(m: _Lanes, rows, coder: _Decoder, by_rank) -> np.ndarray:
    top, seen, tot = m.top.take(rows), m.seen.take(rows), m.total.take(rows)
    total = tot + (seen - top) + (seen + 1)
    value = coder.value[rows]
    part = coder.range[rows] // total.astype(_U)
    at = np.minimum((value // part).astype(np.int64), total - 1)
    settled, last = at < tot, tot + seen - top
    fresh = at >= last
    listed = m.inverse.take(np.minimum(m.inverse_at.take(rows) + at, len(m.inverse) - 1)).astype(np.int64) if len(m.inverse) else at
    rank = np.where(settled, listed, np.minimum(top + at - tot, seen)).astype(np.int32)
    k = m.base1.take(rows) + np.where(settled, rank, 0)
    begin = m.sums.take(k)
    width = np.where(settled, m.sums.take(k + 1) - begin, np.where(fresh, seen + 1, 1))
    start = np.where(settled, begin, np.where(fresh, last, at))
    coder.take(rows, value - part * start.astype(_U), part * width.astype(_U))
    new = rows[fresh]
    if len(new):
        if (m.seen[new] >= by_rank.shape[1] - 1).any():
            raise ValueError("a block has more different ids than it says")
        value, part = coder.value[new], coder.range[new] >> _SIXTEEN
        v = np.minimum(value // part, _U(ONE - 1))
        coder.take(new, value - part * v, part)
        by_rank[new, m.seen[new]] = v.astype(np.uint16)
        m.seen[new] += 1
    m.note(rows, rank)
    return rank
