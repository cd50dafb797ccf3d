"""Adaptive context-mixing range coder for token ids, run over many blocks in lockstep.

A block starts from an empty model. An id is predicted in three orders: by the id that last followed
the two ids before it, by the one that followed the id before it, and by the frequencies of the
block's ids so far. The three are mixed by weights that each order earns in its block, and the mixture's
interval drives an arithmetic coder (carry-less, 48 bits, 16 at a time). Blocks do not depend on
each other: here every numpy operation does one step of all blocks at once.
"""

import struct
import zlib

import numpy as np

MAGIC = b"OFT1"
#: magic, ids, crc32 of the ids as little-endian unsigned 32-bit integers, bytes that follow
_HEAD = "<4sIII"
_CONTEXTS, _SLOTS, _LEVELS, _SCALE = 1024, 512, 8, 12
_MASK = (1 << 48) - 1
_FULL, _FLOOR = 1 << 16, 1 << _SCALE
#: Ids after which the order-0 intervals follow the counts again.
_EARLY, _REFRESH = (16, 64, 128, 256), 512


class _Model:
    """The predictions of a number of blocks, and what they learn from each id.

    A context's entry is 8 * (id + 1) + confidence, 0 before it is met. Entries, slots and counts of all
    blocks lie in one array each, so that one lookup serves all of them.
    """

    def __init__(self, lanes: int, decodes: bool):
        self.decodes = decodes
        self.context_base = np.arange(lanes) * _CONTEXTS
        self.slot_base = np.arange(lanes) * (_SLOTS + 1)
        self.cum_base = np.arange(lanes) * (_SLOTS + 2)
        self.level_base = np.arange(lanes) * _LEVELS
        self.pair_base = np.arange(lanes) * _LEVELS * _LEVELS
        self.quantile_base = np.arange(lanes) << _SCALE
        self.order2, self.order1 = (np.zeros(lanes * _CONTEXTS, np.int32) for _ in range(2))
        self.trust2 = np.full(lanes * _LEVELS, 1 << 14, np.int32)
        self.trust1 = np.full(lanes * _LEVELS * _LEVELS, 1 << 13, np.int32)
        self.held = np.full(lanes * (_SLOTS + 1), -1, np.int32)
        self.counts = np.zeros((lanes, _SLOTS + 1), np.int32)
        self.counts[:, _SLOTS] = 24
        self.cum = np.zeros((lanes, _SLOTS + 2), np.int32)
        self.symbol = np.zeros(lanes << _SCALE if decodes else 0, np.int16)
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)
        self.refresh(lanes)

    def refresh(self, n: int) -> None:
        """Interval bounds of the order-0 frequencies; what is left over goes to the escape symbol."""
        counts = self.counts[:n]
        seen = counts > 0
        room = _FLOOR - np.count_nonzero(seen, axis=1)
        factor = room / counts.sum(1)
        share = (counts * factor[:, None]).astype(np.int32) + seen
        share[:, _SLOTS] += _FLOOR - share.sum(1)
        np.cumsum(share, axis=1, out=self.cum[:n, 1:])
        if self.decodes:
            symbols = np.broadcast_to(np.arange(_SLOTS + 1, dtype=np.int16), share.shape)
            self.symbol[: n << _SCALE] = np.repeat(symbols.ravel(), share.ravel())

    def predict(self, n: int) -> None:
        """The mixture for the next id of the first n blocks: [0, m2) order 2, [m2, m2 + m1) order 1, the rest order 0."""
        spread = self.last[:n] * 40503
        before = self.before[:n]
        self.at2 = (((spread + before * 30011 + (before >> 5)) >> 3) & (_CONTEXTS - 1)) + self.context_base[:n]
        self.at1 = ((spread >> 4) & (_CONTEXTS - 1)) + self.context_base[:n]
        e2, e1 = self.order2.take(self.at2), self.order1.take(self.at1)
        self.g2, self.g1 = (e2 >> 3) - 1, (e1 >> 3) - 1
        self.s2, self.s1 = e2 & 7, e1 & 7
        self.t2 = self.level_base[:n] + self.s2
        self.t1 = self.pair_base[:n] + ((self.s2 << 3) + self.s1)
        self.has2 = e2 > 0
        self.has1 = (e1 > 0) & (self.g1 != self.g2)
        self.w2, self.w1 = self.trust2.take(self.t2), self.trust1.take(self.t1)
        self.m2 = ((self.w2 * ((_FULL - 2 * _FLOOR) >> 4) >> 12) + 16) * self.has2
        self.m1 = (((_FULL - _FLOOR - 16 - self.m2 >> 2) * (self.w1 >> 2) >> 12) + 16) * self.has1
        self.low0 = self.m2 + self.m1
        self.room = _FULL - self.low0

    def bounds(self, n: int, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.cum_base[:n] + symbol
        cum = self.cum.reshape(-1)
        start = self.room * cum.take(at) >> _SCALE
        return self.low0 + start, (self.room * cum.take(at + 1) >> _SCALE) - start

    def slots(self, n: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An id's slot, and whether the slot can stand for it."""
        slot = (ids * 40503 >> 5) & (_SLOTS - 1)
        at = self.cum_base[:n] + slot
        cum = self.cum.reshape(-1)
        return slot, (self.held.take(self.slot_base[:n] + slot) == ids) & (cum.take(at + 1) > cum.take(at))

    def learn(self, n: int, ids: np.ndarray, slot: np.ndarray, escaped: np.ndarray) -> None:
        hit2, hit1 = ids == self.g2, ids == self.g1
        self.trust2[self.t2] = self.w2 + ((hit2 * np.int32(65535) - self.w2) >> 5) * self.has2
        self.trust1[self.t1] = self.w1 + ((hit1 * np.int32(65535) - self.w1) >> 5) * (self.has1 & ~hit2)
        fresh = ((ids + 1) << 3 | 1).astype(np.int32)
        for table, at, hit, guess, sure in ((self.order2, self.at2, hit2, self.g2, self.s2), (self.order1, self.at1, hit1, self.g1, self.s1)):
            kept = (guess + 1 << 3) + np.where(hit, np.minimum(sure + 1, _LEVELS - 1), sure >> 1)
            table[at] = np.where(hit | (sure > 1), kept, fresh)
        at = self.slot_base[:n] + slot
        self.held[at] = ids
        counts = self.counts.reshape(-1)
        counts[at] += 24
        self.counts[:n, _SLOTS] += 24 * escaped
        self.before[:n] = self.last[:n]
        self.last[:n] = ids


def _sorted_lanes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks from the longest, and how many of them go on at each step."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    return order, np.searchsorted(-lengths[order], -np.arange(longest), side="left")


def _due(step: int) -> bool:
    return step % _REFRESH == 0 or step in _EARLY


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """A self-contained byte string for each block of ids (each below 65536)."""
    if not blocks:
        return []
    lengths = np.array([len(b) for b in blocks])
    order, active = _sorted_lanes(lengths)
    lanes, longest = len(blocks), len(active)
    ids = np.zeros((longest, lanes), np.int64)
    for lane, b in enumerate(order):
        ids[: lengths[b], lane] = blocks[b]
    words = np.zeros((lanes, 2 * longest + 4), np.uint16)
    flat, row, width = words.reshape(-1), np.arange(lanes), words.shape[1]
    filled = np.zeros(lanes, np.int64)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    model = _Model(lanes, decodes=False)

    def narrow(at, start, size):
        """One symbol of the blocks `at`, a slice or positions."""
        r = span[at] >> 16
        a, s = low[at] + r * start, r * size
        small = np.flatnonzero(s < (1 << 32))
        if len(small):
            x, y = a[small], s[small]
            y = np.where((x ^ (x + y - 1)) >> 32, (1 << 32) - (x & 0xFFFFFFFF), y)
            lane = row[at][small]
            flat[lane * width + filled[lane]] = x >> 32
            filled[lane] += 1
            a[small], s[small] = (x << 16) & _MASK, y << 16
        low[at], span[at] = a, s

    for step in range(longest):
        n = int(active[step])
        if step and _due(step):
            model.refresh(n)
        model.predict(n)
        now = ids[step, :n]
        hit2 = now == model.g2
        hit1 = ~hit2 & (now == model.g1)
        slot, known = model.slots(n, now)
        start, size = model.bounds(n, np.where(known, slot, _SLOTS))
        start = np.where(hit2, 0, np.where(hit1, model.m2, start))
        size = np.where(hit2, model.m2, np.where(hit1, model.m1, size))
        narrow(slice(0, n), start, size)
        escaped = ~(hit2 | hit1 | known)
        where = np.flatnonzero(escaped)
        if len(where):
            narrow(where, now[where], 1)
        model.learn(n, now, slot, escaped)
    for shift in (32, 16, 0):
        flat[row * width + filled] = (low >> shift) & 0xFFFF
        filled += 1
    out: list[bytes] = [b""] * lanes
    for lane, b in enumerate(order):
        body = words[lane, : filled[lane]].astype("<u2").tobytes()
        out[b] = struct.pack(_HEAD, MAGIC, len(blocks[b]), zlib.crc32(np.asarray(blocks[b]).astype("<u4").tobytes()), len(body)) + body
    return out


def decode(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a block that is cut, foreign or does not match its checksum raises ValueError."""
    if not coded:
        return []
    heads = []
    for block in coded:
        if len(block) < struct.calcsize(_HEAD):
            raise ValueError("a block is cut")
        magic, n, crc, size = struct.unpack_from(_HEAD, block)
        if magic != MAGIC or len(block) != struct.calcsize(_HEAD) + size:
            raise ValueError("a block is cut or of another format")
        heads.append((n, crc, size))
    lengths = np.array([h[0] for h in heads])
    order, active = _sorted_lanes(lengths)
    lanes, longest = len(coded), len(active)
    width = max(h[2] for h in heads) // 2 + 4
    words = np.zeros((lanes, width), np.int64)
    for lane, b in enumerate(order):
        words[lane, : heads[b][2] // 2] = np.frombuffer(coded[b], "<u2", offset=struct.calcsize(_HEAD))
    flat, row = words.reshape(-1), np.arange(lanes)
    code = (words[:, 0] << 32) | (words[:, 1] << 16) | words[:, 2]
    read = np.full(lanes, 3, np.int64)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    ids = np.zeros((longest, lanes), np.uint16)
    model = _Model(lanes, decodes=True)

    def narrow(at, r, start, size):
        a, s = low[at] + r * start, r * size
        small = np.flatnonzero(s < (1 << 32))
        if len(small):
            x, y = a[small], s[small]
            y = np.where((x ^ (x + y - 1)) >> 32, (1 << 32) - (x & 0xFFFFFFFF), y)
            lane = row[at][small]
            code[lane] = ((code[lane] << 16) & _MASK) | flat[lane * width + np.minimum(read[lane], width - 1)]
            read[lane] += 1
            a[small], s[small] = (x << 16) & _MASK, y << 16
        low[at], span[at] = a, s

    for step in range(longest):
        n = int(active[step])
        if step and _due(step):
            model.refresh(n)
        model.predict(n)
        r = span[:n] >> 16
        value = np.minimum((code[:n] - low[:n]) // r, _FULL - 1)
        hit2 = value < model.m2
        hit1 = ~hit2 & (value < model.low0)
        rest = np.maximum(value - model.low0, 0)
        symbol = model.symbol[model.quantile_base[:n] + ((rest + 1 << _SCALE) - 1) // model.room]
        start, size = model.bounds(n, symbol)
        start = np.where(hit2, 0, np.where(hit1, model.m2, start))
        size = np.where(hit2, model.m2, np.where(hit1, model.m1, size))
        narrow(slice(0, n), r, start, size)
        now = np.where(hit2, model.g2, np.where(hit1, model.g1, model.held[model.slot_base[:n] + symbol])).astype(np.int64)
        escaped = ~(hit2 | hit1) & (symbol == _SLOTS)
        where = np.flatnonzero(escaped)
        if len(where):
            r = span[where] >> 16
            raw = np.clip((code[where] - low[where]) // r, 0, _FULL - 1)
            narrow(where, r, raw, 1)
            now[where] = raw
        ids[step, :n] = now
        slot = (now * 40503 >> 5) & (_SLOTS - 1)
        model.learn(n, now, slot, escaped)
    out: list[np.ndarray] = [ids[:0, 0]] * lanes
    for lane, b in enumerate(order):
        found = ids[: lengths[b], lane].copy()
        if zlib.crc32(found.astype("<u4").tobytes()) != heads[b][1]:
            raise ValueError("a block does not match its checksum")
        out[b] = found
    return out
