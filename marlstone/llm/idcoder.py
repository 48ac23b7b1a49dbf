"""Adaptive context-mixing range coder for token ids.

A block is coded by itself. Its ids are laid out in lanes that advance side by side
and share one model. The model holds the distributions of the next id after the two
ids before it (order 2), after the one before (order 1), and of ids alone (order 0),
learned from the ids of the block coded so far: it is even at the block's first step
and is renewed whenever the number of steps has grown fourfold. Each order's distribution is
mixed with that of the order below, with weights that follow from how often a context
was seen and with how many different ids (absolute discounting; the discount comes
from the ids seen once and twice). What a context never saw is left to the order below
by an escape. The interval of each entry or escape drives a range coder with 64-bit
bounds, whose carries are settled at the end.

Sums are of integers and all else is element by element, so that reader and writer
agree on any machine.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import zstandard

#: Ids of a block at most, its lanes at most, and the growth in steps after which the model is renewed.
BLOCK_IDS, LANES, GROWTH = 1 << 21, 4096, 4
#: Ids of a block whose intervals are looked up at a time.
CHUNK = 1 << 18
#: Bits of an interval's begin and size; an id's bits.
_FIELD, _ID = 24, 20
_U = np.uint64
_LEAST, _WORD = _U(1 << 48), _U(16)
_MASK = _U((1 << _FIELD) - 1)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


class _Places:
    """The place of each key in a list of distinct keys, by tables of hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables = np.append(keys, -1), []
        left = np.arange(len(keys), dtype=np.int32)
        while not self.tables or len(left):
            hasher = _U(64 - max(4, len(left).bit_length() + 1)), _U(_ODD[len(self.tables) % 4] + 2 * (len(self.tables) // 4))
            table = np.full(1 << (64 - int(hasher[0])), len(keys), np.int32)
            at = self._hash(keys.take(left) if self.tables else keys, hasher)
            table[at] = left
            self.tables.append((hasher, table))
            left = left[table.take(at) != left]

    @staticmethod
    def _hash(keys: np.ndarray, hasher) -> np.ndarray:
        return ((keys.view(_U) * hasher[1]) >> hasher[0]).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places, or the number of keys where there is none.

        A key goes on to the next table only where another one holds its slot: an empty slot ends the search.
        """
        none = len(self.keys) - 1
        hasher, table = self.tables[0]
        out = table.take(self._hash(keys, hasher)).astype(np.int64)
        lost = ((self.keys.take(out) != keys) & (out < none)).nonzero()[0]
        for hasher, table in self.tables[1:]:
            own = keys.take(lost)
            got = table.take(self._hash(own, hasher)).astype(np.int64)
            out[lost] = got
            lost = lost.take(((self.keys.take(got) != own) & (got < none)).nonzero()[0])
        out[lost] = none
        return out


class _Order:
    """Distributions after each context, an escape last. Entries are sorted by context."""

    def __init__(self, key: np.ndarray, count: np.ndarray, width: int, below: np.ndarray):
        """``key``: context * width + id of each entry; ``below``: the id's probability in the order below."""
        context = key // width
        self.id = key - context * width
        fresh, first = _fresh(context)
        self.end = np.append(first[1:], len(key)) if len(key) else first
        self.context, kinds = context.take(first), self.end - first
        self.of = of = np.cumsum(fresh)
        of -= 1
        total = np.add.reduceat(count, first) if len(key) else first
        once, twice = np.count_nonzero(count == 1), np.count_nonzero(count == 2)
        discount = (once + 1) / (once + 2 * twice + 2)
        self.bits = np.clip(np.frexp(total.astype(np.float64))[1] + 1, np.frexp(kinds.astype(np.float64))[1] + 1, 20).astype(np.int64)
        share = (discount * kinds).take(of)
        share *= below
        share += count - discount
        share /= total.astype(np.float64).take(of)
        share *= ((1 << self.bits) - kinds - 1).astype(np.float64).take(of)
        self.freq = freq = share.astype(np.int64)
        freq += 1
        ends = np.cumsum(freq)
        known = ends.take(self.end - 1)
        base = np.append(0, known[:-1]) if len(key) else known
        known = known - base
        size = self.bits << 2 * _FIELD
        #: interval of each entry, then of each escape
        self.interval = np.empty(len(key) + len(first), np.int64)
        self.interval[len(key) :] = size | (1 << self.bits) - known << _FIELD | known
        ends -= freq
        ends += (size - base).take(of)
        np.bitwise_or(ends, freq << _FIELD, out=self.interval[: len(key)])

    def chance(self) -> np.ndarray:
        """The probability of each entry."""
        return self.freq / (1 << self.bits).take(self.of)

    def by_context(self) -> np.ndarray:
        """Entries and escapes in the order of contexts."""
        n, k = len(self.id), np.arange(len(self.context))
        out = np.empty(n + len(k), np.int64)
        out[np.arange(n) + self.of] = np.arange(n)
        out[self.end + k] = n + k
        return out


class _Model:
    """What the first ``steps`` of a grid tell of the next ids. Two rows of begin marks stand before them.

    Contexts are numbered through the orders, 2 first; so are entries, each order's
    before its escapes. ``interval`` is begin, size and bits of each entry.
    """

    def __init__(self, grid: np.ndarray, steps: int, kinds: int):
        self.width = width = kinds + 1
        key = grid[:steps].ravel().astype(np.int64)
        for k in (1, 2):
            key *= width
            key += grid[k : k + steps].ravel()
        key.sort()
        _, first = _fresh(key)
        triple, count = key.take(first), np.diff(np.append(first, len(key)))
        # the pair in each triple, sorted with the triple's place
        shift = len(triple).bit_length()
        key = triple % (width * width)
        key <<= shift
        key |= np.arange(len(triple))
        key.sort()
        of = key & ((1 << shift) - 1)
        key >>= shift
        fresh, first = _fresh(key)
        pair, pair_of = key.take(first), np.empty(len(key), np.int64)
        pair_of[of] = np.cumsum(fresh) - 1
        twos = np.add.reduceat(count.take(of), first) if len(key) else first
        del key, of, fresh, first
        ones = np.bincount(pair % width, weights=twos, minlength=kinds).astype(np.int64)
        bits0 = max(12, kinds.bit_length() + 4)
        freq = 1 + ones * ((1 << bits0) - kinds) // max(1, grid[:steps].size)
        freq[-1] += (1 << bits0) - freq.sum()
        ends = np.cumsum(freq)
        self.one = one = _Order(pair, twos, width, (freq / (1 << bits0)).take(pair % width))
        self.two = two = _Order(triple, count, width, one.chance().take(pair_of))
        self.places = _Places(two.context)
        self.first1, self.first0 = len(two.interval), len(two.interval) + len(one.interval)
        self.context0 = len(two.context) + len(one.context)
        self.context1 = np.full(width, self.context0, np.int64)
        self.context1[one.context] = len(two.context) + np.arange(len(one.context))
        self.bits = np.concatenate([two.bits, one.bits, [bits0]])
        self.interval = np.concatenate([two.interval, one.interval, ends - freq | freq << _FIELD | bits0 << 2 * _FIELD])
        self.triple, self.pair, self.pair_of, self.kinds = triple, pair, pair_of, kinds

    @functools.cached_property
    def triples(self) -> _Places:
        return _Places(self.triple)

    @functools.cached_property
    def pairs(self) -> _Places:
        return _Places(self.pair)

    def context(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The context after ids ``a`` and ``b``, of the highest order that was seen."""
        at = self.places.find(a * self.width + b)
        new = np.flatnonzero(at == len(self.two.context))
        at[new] = self.context1.take(b.take(new))
        return at

    def automaton(self):
        """For the reader. Of each context: bits and the place of its units; of each unit: its entry; of each entry: its interval, and beside it the id and the context that follows."""
        one, two, kinds = self.one, self.two, self.kinds
        place = np.append(0, np.cumsum(1 << self.bits)[:-1])
        order = np.concatenate([two.by_context(), self.first1 + one.by_context(), self.first0 + np.arange(kinds)])
        unit = np.repeat(order.astype(np.int32), (self.interval >> _FIELD & int(_MASK))[order])
        after = self.context(self.pair // self.width, one.id)
        none = np.full(1, (1 << _ID) - 1)
        ids = np.concatenate([two.id, none.repeat(len(two.context)), one.id, none.repeat(len(one.context)), np.arange(kinds)])
        follow = np.concatenate([after[self.pair_of], self.context1[two.context % self.width], after, np.full(len(one.context), self.context0), self.context1[:kinds]])
        return self.bits | place << 8, unit, np.stack([self.interval, ids | follow << _ID], axis=1).view(np.complex128).ravel()  # one look-up for both


def _fresh(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values of a sorted array differ from the one before, and where those are."""
    fresh = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    return fresh, np.flatnonzero(fresh)


def _shape(n: int) -> tuple[int, int]:
    steps = -(-n // min(LANES, 3 * math.isqrt(n)))
    return -(-n // steps), steps


def _spans(steps: int):
    """Steps from one renewal of the model to the next."""
    a = 0
    while a < steps:
        b = min(steps, max(1, GROWTH * a))
        yield a, b
        a = b


def _events(model: _Model, a, b, c) -> tuple[np.ndarray, list]:
    """Of each id: how many entries code it, and places and entries of the first, second and third."""
    w, n2 = model.width, len(model.two.id)
    pair = b * w + c
    entry = model.triples.find(a * (w * w) + pair)
    count = np.ones(len(a), np.int8)
    lost = np.flatnonzero(entry == n2)
    under = b.take(lost)
    after = model.context(a.take(lost), under)
    at2 = after < len(model.two.context)
    found = model.pairs.find(pair.take(lost))
    has1 = model.context1.take(under)
    hit1, esc1 = found < len(model.one.id), has1 < model.context0
    zero = model.first0 + c.take(lost)
    # entries of order 1 and below
    low1 = np.where(hit1, model.first1 + found, np.where(esc1, model.first1 + len(model.one.id) + has1 - len(model.two.context), zero))
    low2 = np.where(hit1 | ~esc1, -1, zero)
    now = np.where(at2, n2 + after, low1)
    second, third = np.where(at2, low1, low2), np.where(at2, low2, -1)
    entry[lost] = now
    count[lost] += (second >= 0).astype(np.int8) + (third >= 0)
    s, t = np.flatnonzero(second >= 0), np.flatnonzero(third >= 0)
    return count, [(slice(None), entry), (lost.take(s), second.take(s)), (lost.take(t), third.take(t))]


def compress(ids: np.ndarray, kinds: int) -> tuple[bytes, np.ndarray]:
    """The coded ids of one block, all below ``kinds``, and the 16-bit words of each lane."""
    n = len(ids)
    lanes, steps = _shape(n)
    grid = np.full((steps + 2, lanes), kinds, np.uint32)
    full = np.zeros(lanes * steps, np.uint32)
    full[:n] = ids
    grid[2:] = full.reshape(lanes, steps).T
    last = n - (lanes - 1) * steps  # ids of the last lane
    low, span = np.zeros(lanes, _U), np.full(lanes, ~_U(0))
    out, used = np.zeros((lanes, steps // 2 + 16), np.uint32), np.zeros(lanes, np.int64)
    for a, b in _spans(steps):
        model, c = _Model(grid, a, kinds), max(1, CHUNK // lanes)
        for s in range(a, b, c):
            e = min(b, s + c)
            count, stages = _events(model, *(grid[k + s : k + e].ravel().astype(np.int64) for k in (0, 1, 2)))
            count = count.reshape(e - s, lanes)
            count[max(0, last - s) :, -1] = 0
            ends = np.cumsum(count, axis=0, dtype=np.int32)
            total = ends[-1]
            by = np.argsort(-total, kind="stable")
            rank = np.empty(lanes, np.int32)
            rank[by] = np.arange(lanes, dtype=np.int32)
            place = ((ends - count) * np.int32(lanes) + rank).ravel()
            table = np.zeros((int(total.max()) + 3, lanes), np.int64)
            for k, (of, entry) in enumerate(stages):
                table.ravel()[place[of] + k * lanes] = model.interval.take(entry)
            active = lanes - np.searchsorted(np.sort(total), np.arange(int(total.max())), "right")
            if used.max() + 2 * len(active) > out.shape[1]:  # an entry moves two words out at most
                out = np.pad(out, ((0, 0), (0, int(used.max()) + 2 * len(active) + steps // 8)))
            begin = by * out.shape[1]
            own = low[by], span[by], begin + used[by]
            _push(table.view(_U), active.tolist(), out.ravel(), *own)
            low[by], span[by], used[by] = *own[:2], own[2] - begin
    # one more word names a number within each lane's bounds
    whole, lane = low + (_LEAST - _U(1)), np.arange(lanes)
    if out.shape[1] == used.max():
        out = np.pad(out, ((0, 0), (0, 1)))
    over = np.flatnonzero(whole < low)
    out[over, used[over] - 1] += 1
    out[lane, used] = whole >> _U(48)
    used += 1
    words = out[np.arange(out.shape[1]) < used[:, None]]
    over = np.flatnonzero(words >> 16)
    while len(over):  # a lane's first word takes no carry beyond itself
        words[over] &= 0xFFFF
        over -= 1
        words[over] += 1
        over = over[words[over] > 0xFFFF]
    return words.astype("<u2").tobytes(), used


def _push(table, active, out, low, span, to) -> None:
    """Narrow each lane to its intervals, one row of the table after another."""
    bits, size, start = table >> _U(2 * _FIELD), table >> _U(_FIELD) & _MASK, table & _MASK
    for j, m in enumerate(active):
        lo, sp = low[:m], span[:m]
        sp >>= bits[j, :m]
        add = sp * start[j, :m]
        lo += add
        sp *= size[j, :m]
        over = (lo < add).nonzero()[0]
        if len(over):
            out[to.take(over) - 1] += 1
        more = (sp < _LEAST).nonzero()[0]
        while len(more):
            l, s, p = lo.take(more), sp.take(more), to.take(more)
            out[p] = l >> _U(48)
            to[more] = p + 1
            l <<= _WORD
            s <<= _WORD
            lo[more], sp[more] = l, s
            more = more[s < _LEAST]


def expand(data: bytes, size: np.ndarray, n: int, kinds: int) -> np.ndarray:
    """The ``n`` ids below ``kinds`` that ``compress`` coded."""
    lanes, steps = _shape(n)
    grid = np.full((steps + 2, lanes), kinds, np.uint32)
    grid[2:] = 0
    flat = grid.ravel()
    words = np.append(np.frombuffer(data, "<u2"), np.zeros(8, np.uint16)).astype(_U)
    final = len(words) - 1
    end = np.cumsum(size)
    at = end - size
    code, span = np.zeros(lanes, _U), np.full(lanes, ~_U(0))
    for _ in range(4):
        code = code << _WORD | np.where(at < end, words.take(np.minimum(at, final)), _U(0))
        at += 1
    until = np.full(lanes, steps)
    until[-1] = n - (lanes - 1) * steps
    for a, b in _spans(steps):
        model = _Model(grid, a, kinds)
        context, unit, entries = model.automaton()
        lane, left = np.arange(lanes), np.minimum(until, b) - a
        now, to = model.context(grid[a].astype(np.int64), grid[a + 1].astype(np.int64)), (a + 2) * lanes + lane
        co, sp, place, stop = code, span, at, end
        keep = np.flatnonzero(left > 0)
        while len(keep):
            if len(keep) < len(left):
                code[lane], span[lane], at[lane] = co, sp, place
                lane, left, now, to, co, sp, place, stop = (x[keep] for x in (lane, left, now, to, co, sp, place, stop))
            fewest, was = int(left.min()), to.copy()
            for _ in range(fewest):
                c = context.take(now)
                sp >>= (c & 255).view(_U)
                u = co // sp
                c >>= 8
                c += u.view(np.int64)
                entry = entries.take(unit.take(c)).view(_U)
                x, f = entry[::2], entry[1::2].view(np.int64)
                co -= sp * (x & _MASK)
                sp *= x >> _U(_FIELD) & _MASK
                more = (sp < _LEAST).nonzero()[0]
                while len(more):
                    w, s, p = co.take(more), sp.take(more), place.take(more)
                    w <<= _WORD
                    w |= np.where(p < stop.take(more), words.take(p), _U(0))
                    s <<= _WORD
                    co[more], sp[more], place[more] = w, s, p + 1
                    more = more[s < _LEAST]
                i = (f & ((1 << _ID) - 1)).astype(np.uint32)
                flat[to] = i
                to += (i < kinds) * lanes
                now = f >> _ID
            left -= (to - was) // lanes
            keep = np.flatnonzero(left > 0)
        code[lane], span[lane], at[lane] = co, sp, place
    return grid[2:].T.ravel()[:n]


def to_block(ids: np.ndarray) -> bytes:
    """A block by itself: sizes, checksum of the ids, which ids occur, words of each lane, coded places of the ids among those."""
    if not len(ids):
        return np.zeros(4, "<u4").tobytes()
    there = np.zeros(int(ids.max()) + 1, bool)
    there[ids] = True
    place = np.cumsum(there, dtype=np.uint32) - np.uint32(1)
    coded, size = compress(place[ids], int(place[-1]) + 1)
    head = zstandard.ZstdCompressor(level=3).compress(np.packbits(there).tobytes() + size.astype("<u4").tobytes())
    sizes = np.array([len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(there), len(head)], "<u4")
    return sizes.tobytes() + head + coded


def from_block(data: bytes) -> np.ndarray:
    """The ids of a block; ValueError where it is damaged."""
    n, checksum, top, size = np.frombuffer(data, "<u4", 4).tolist()
    if not n:
        return np.zeros(0, np.uint32)
    try:
        raw, flags = zstandard.ZstdDecompressor().decompress(data[16 : 16 + size]), -(-top // 8)
        ids = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, flags), count=top)).astype(np.uint32)
        places = expand(data[16 + size :], np.frombuffer(raw, "<u4", offset=flags).astype(np.int64), n, len(ids))
        out = ids[places]
    except (zstandard.ZstdError, IndexError, ZeroDivisionError) as e:
        raise ValueError("damaged block") from e
    if zlib.crc32(out.astype("<u4").tobytes()) != checksum:
        raise ValueError("checksum of a block")
    return out
