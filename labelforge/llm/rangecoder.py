"""Adaptive context-mixing range coder for token ids, many blocks side by side in numpy.

In every block an order-2 and an order-1 context each predict one id, with a confidence from 0 to 3; order 0 spreads what
is left over the ids of the segment by their counts. The mix gives the order-2 guess the share that guesses of its
confidence have earned so far in this block, the order-1 guess its share of the rest, and order 0 what remains. The
interval of the id that follows narrows a carryless range coder of 64 bits. Blocks start with empty tables and have a
checksum of their own, so that each can be read without the others.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 4096
MIX_BITS, ORDER0_BITS = 26, 20
CONTEXTS = (1 << 9, 1 << 10)
_U = np.uint64
_TOTAL = 1 << MIX_BITS
_LOW_RANGE = _U(1 << 32)
_NONE = np.uint32(0xFFFFFFFC)
_TWO, _THREE = np.uint32(2), np.uint32(3)
_SHIFTS = [np.uint32(33 - c.bit_length()) for c in CONTEXTS]


def order0(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2^ORDER0_BITS."""
    total, n = 1 << ORDER0_BITS, len(counts)
    freq = 1 + counts.astype(np.int64) * (total - n) // max(1, int(counts.sum()))
    freq[np.argmax(counts)] += total - freq.sum()
    return freq


class _Mixer:
    """Predictions of all lanes and their tables; row 0 is order 1, row 1 order 2. Ids, guesses and shares are unsigned 32-bit numbers."""

    def __init__(self, lanes: int):
        self.base = np.array([np.arange(lanes) * c for c in CONTEXTS], np.int64)
        self.base[1] += lanes * CONTEXTS[0]
        self.guess = np.full(lanes * sum(CONTEXTS), _NONE, np.uint32)
        self.earned = np.empty((2, lanes, 4), np.uint32)
        self.earned[0], self.earned[1] = (2000, 6000, 12_000, 24_000), (2000, 20_000, 30_000, 45_000)
        self.earned = self.earned.ravel()
        self.state = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes) * 4
        self.last = np.zeros(lanes, np.uint32)
        self.mixed = np.zeros(lanes, np.uint32)
        self.context = np.empty((2, lanes), np.uint32)

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The guesses, and the shares of the interval of order 1 and of order 2."""
        hashed = self.last * np.uint32(0x9E3779B1)
        np.right_shift(hashed, _SHIFTS[0], out=self.context[0])
        np.right_shift(hashed + self.mixed, _SHIFTS[1], out=self.context[1])
        self.mixed = hashed * np.uint32(0x85EBCA6B)
        self.at = self.base + self.context
        self.e = self.guess.take(self.at)
        self.sure = self.e & _THREE
        self.c = self.state + self.sure
        g = self.e >> _TWO
        self.w = self.earned.take(self.c)
        a2 = self.w[1] * np.uint32(_TOTAL // 65536 * 7 // 8)
        a1 = (((np.uint32(_TOTAL) - a2) >> np.uint32(10)) * self.w[0] >> np.uint32(6)) * np.uint32(7) >> np.uint32(3)
        a1 *= g[0] != g[1]
        return g, a1, a2

    def learn(self, x: np.ndarray, hit: np.ndarray) -> None:
        """Reward or weaken the guesses by the id that came."""
        # a guess that failed loses confidence, and at none gives way; _NONE has none
        failed = np.where(self.sure > 0, self.e - np.uint32(1), x << _TWO)
        self.guess[self.at] = np.where(hit, self.e + (self.sure < _THREE), failed)
        self.earned[self.c] = self.w - (self.w >> np.uint32(5)) + (hit * np.uint32(2028) + _THREE)
        self.last = x


def _settle(low: np.ndarray, span: np.ndarray):
    """The lanes that must shift 16 bits, again and again until none must; narrows the spans that straddle."""
    some = None
    while True:
        a, b = (low, span) if some is None else (low[some], span[some])
        alike = (low_high(a, b)) == 0
        must = alike | (b < _LOW_RANGE)
        pick = np.flatnonzero(must)
        if not len(pick):
            return
        lone = pick[~alike[pick]]
        some = pick if some is None else some[pick]
        if len(lone):
            lone = lone if a is low else some[np.searchsorted(pick, lone)]
            span[lone] = (~low[lone] + _U(1)) & (_LOW_RANGE - _U(1))
        yield some
        low[some] <<= _U(16)
        span[some] <<= _U(16)


def low_high(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The upper 16 bits in which the ends of the interval differ."""
    return (low ^ (low + span)) >> _U(48)


def _lanes_of(n: int, block: int) -> np.ndarray:
    """Lengths of the blocks of ``n`` ids."""
    sizes = np.full(-(-n // block), block, np.int64)
    if n % block:
        sizes[-1] = n % block
    return sizes


def encode(ids: np.ndarray, freq: np.ndarray, block: int = BLOCK) -> tuple[list[bytes], np.ndarray]:
    """The blocks' bytes and checksums. ids: places in an alphabet whose frequencies are ``freq``."""
    sizes = _lanes_of(len(ids), block)
    lanes = len(sizes)
    if not lanes:
        return [], np.zeros(0, np.uint32)
    padded, full = np.zeros((block, lanes), np.uint32), len(ids) // block
    padded[:, :full] = ids[: full * block].reshape(full, block).T
    padded[: len(ids) - full * block, full:] = ids[full * block :, None]
    upto = np.concatenate([[0], np.cumsum(freq)]).astype(_U)
    mixer = _Mixer(lanes)
    low, span = np.zeros(lanes, _U), np.full(lanes, _U(0xFFFFFFFFFFFFFFFF))
    width = 3 * block + 8
    out = np.zeros(lanes * width, np.uint16)
    first = np.arange(lanes, dtype=np.int64) * width
    place = first.copy()
    ended = None
    for t in range(int(sizes.max())):
        x = padded[t]
        g, a1, a2 = mixer.predict()
        hit = g == x
        start, size = _interval(x, hit[0], hit[1], a1, a2, upto)
        part = span >> _U(MIX_BITS)
        if t == sizes[-1]:
            ended = place[-1], low[-1]
        low += part * start
        span = part * size
        for need in _settle(low, span):
            at = place[need]
            out[at] = low[need] >> _U(48)
            place[need] = at + 1
        mixer.learn(x, hit)
    if ended is not None:  # the last block is shorter: it ended there
        place[-1], low[-1] = ended
    for k in range(4):
        out[place + k] = (low >> _U(48 - 16 * k)).astype(np.uint16)
    place += 4 - first
    out = out.reshape(lanes, width)
    sums = checksums(ids, block)
    return [out[i, :n].astype(">u2").tobytes() for i, n in enumerate(place.tolist())], sums


def _interval(x, hit1, hit2, a1, a2, upto):
    """Begin and size of the ids' intervals in the mix: order 2 first, then order 1, then order 0."""
    both = (a1 + a2).astype(_U)
    rest = _U(_TOTAL) - both
    x = x.astype(np.int64)
    start = upto.take(x) * rest >> _U(ORDER0_BITS)
    size = (upto.take(x + 1) * rest >> _U(ORDER0_BITS)) - start
    start += both
    some = np.flatnonzero(hit1)
    if len(some):
        start[some], size[some] = a2[some], a1[some]
    some = np.flatnonzero(hit2)
    if len(some):
        start[some], size[some] = _U(0), a2[some]
    return start, size


def checksums(ids: np.ndarray, block: int) -> np.ndarray:
    """crc32 of each block's ids as little-endian 32-bit integers."""
    return np.array([zlib.crc32(ids[i : i + block].astype("<u4").tobytes()) for i in range(0, len(ids), block)], np.uint32)


def decode(blocks: list[bytes], sizes: np.ndarray, freq: np.ndarray) -> list[np.ndarray]:
    """The ids of each block; any choice of blocks can be read."""
    lanes = len(blocks)
    if not lanes:
        return []
    upto = np.concatenate([[0], np.cumsum(freq)]).astype(_U)
    slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    length = max(map(len, blocks)) // 2 + 8
    data = np.zeros((lanes, length), np.uint16)
    for i, b in enumerate(blocks):
        data[i, : len(b) // 2] = np.frombuffer(b, ">u2")
    mixer = _Mixer(lanes)
    low, span = np.zeros(lanes, _U), np.full(lanes, _U(0xFFFFFFFFFFFFFFFF))
    code = np.zeros(lanes, _U)
    for k in range(4):
        code = code << _U(16) | data[:, k].astype(_U)
    data = data.ravel()
    place = np.arange(lanes, dtype=np.int64) * length + 4
    final = place + length - 5
    most = int(np.max(sizes))
    out = np.zeros((most, lanes), np.uint32)
    last = np.uint32(len(freq) - 1)
    for t in range(most):
        g, a1, a2 = mixer.predict()
        part = span >> _U(MIX_BITS)
        v = np.minimum((code - low) // part, _U(_TOTAL - 1))
        both = (a1 + a2).astype(_U)
        in2, in1 = v < a2, v < both
        u = v - np.minimum(v, both)
        x = slot.take(np.minimum(((u + _U(1) << _U(ORDER0_BITS)) - _U(1)) // (_U(_TOTAL) - both), _U((1 << ORDER0_BITS) - 1)).view(np.int64))
        x = np.where(in2, g[1], np.where(in1, g[0], x))
        x = np.minimum(x, last)  # lanes whose block has ended read anything
        start, size = _interval(x, in1 & ~in2, in2, a1, a2, upto)
        low += part * start
        span = part * size
        for need in _settle(low, span):
            at = place[need]
            code[need] = code[need] << _U(16) | data[np.minimum(at, final[need])]
            place[need] = at + 1
        mixer.learn(x, g == x)
        out[t] = x
    return [out[:n, i] for i, n in enumerate(np.asarray(sizes).tolist())]
