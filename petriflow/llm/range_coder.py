"""An adaptive context-mixing range coder for ids below 65,536.

The distribution of the next id is a mixture: order 0 (adaptive counts of all ids so far), order 1 (the id that follows the id
before, with its confidence) and order 2 (the same for the two ids before). The shares of the three are learnt while coding, in 32
contexts made of the two confidences and of whether both predict one id. An id's probability is the sum of what all three give it,
and arithmetic coding narrows the range to exactly that part.

A block is coded in ``lanes`` equal stretches side by side, so that numpy advances all of them by one id at a time; they share one
model, which learns from all of them every ``CHUNK`` ids. Every block starts from nothing and never looks at another, so it
can be read alone. Shares, counts and ranges are integers; the only floating-point steps are multiplications, divisions and
roundings that IEEE 754 fixes, so every machine makes the same bytes.

Block: ``CMR2``, number of ids, CRC-32 of the ids as little-endian 32-bit numbers, lanes, one more than the largest id (4 bytes
each), the number of words of each lane (16 bits), and the lanes' 16-bit words in a row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC, HEADER = b"CMR2", struct.Struct("<4sIIII")
#: Most lanes and most ids of one, and the ids of a lane between updates of the model (fewer at first).
LANES, LANE_IDS, CHUNK = 4_096, 256, 32
#: Most ids of a block.
BLOCK_IDS = LANES * LANE_IDS
#: Bits of a mixture's total and of order 0's; of the range when it is widest, and below which it is widened by 16. Numbers of 48 bits
#: are exact in double precision, and their quotients by what is left of the range are too far from whole numbers to be rounded up.
_MIX, _ZERO, _WIDE, _NARROW = 24, 21, 48, 32
_PAIR_BITS = 18
_CONTEXTS = 32
_REST = np.int64((1 << _NARROW) - 1)


class ChecksumError(ValueError):
    """A block's ids are not those that were written."""


def _chunks(steps: int) -> Iterator[tuple[int, int]]:
    at, size = 0, 1
    while at < steps:
        yield at, min(at + size, steps)
        at, size = at + size, min(2 * size, CHUNK)


class _Model:
    """What a block has taught so far. A prediction and its confidence (0 to 3) share one number."""

    def __init__(self, n_ids: int, searched: bool = False):
        self.n_ids, self.searched = n_ids, searched
        self.counts = np.zeros(n_ids, np.int64)
        self.after_one = np.zeros(n_ids, np.int64)
        self.after_two = np.zeros(1 << _PAIR_BITS, np.int64)
        self.met = np.full((3, _CONTEXTS), 2, np.int64)  # coded ids, those order 1 had right, those only order 2 had right
        self.met[0] = 8
        self.refresh()

    def refresh(self) -> None:
        up = np.cumsum(self.counts * 64 + 1)
        self.below = np.zeros(self.n_ids + 1, np.int64)
        # Each id keeps at least one part of 2^_ZERO.
        self.below[1:] = (up * (float((1 << _ZERO) - self.n_ids) / float(up[-1]))).astype(np.int64) + np.arange(1, self.n_ids + 1)
        self.below[-1] = 1 << _ZERO
        if self.searched:
            # The first id of every 32 parts of order 0; at most 32 ids follow before the next one.
            self.fine = np.concatenate([self.below[:-1], np.full(32, 1 << 40)])
            self.coarse = np.cumsum(np.bincount(self.below[:-1] + 31 >> 5, minlength=1 << (_ZERO - 5))) - 1
        n, one, two = self.met
        most = 7 << (_MIX - 3)  # order 0 keeps an eighth, so that no id is without a part
        self.share_one, self.share_two = one * most // n, two * most // n
        self.share_two[1::2] = 0  # both orders predict one id
        self.share_zero = (1 << _MIX) - self.share_one - self.share_two

    @staticmethod
    def slot(last: np.ndarray, before: np.ndarray) -> np.ndarray:
        return (last * 0x9E3779B1 + before * 0x85EBCA6B) >> 9 & (1 << _PAIR_BITS) - 1

    def look(self, last: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, ...]:
        """What orders 1 and 2 know and predict, the context, and the shares of orders 0, 1 and 2."""
        one, two = self.after_one.take(last), self.after_two.take(slot)
        a, b = one >> 2, two >> 2
        context = ((two & 3) << 3) + ((one & 3) << 1) + (a == b)
        return one, two, a, b, context, self.share_zero.take(context), self.share_one.take(context), self.share_two.take(context)

    def part(self, x, a, b, w0, w1, w2) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of ids ``x`` in their mixtures: what order 0 gives to the ids in a row, widened where another order predicts one."""
        low, high = self.below.take(x) * w0 >> _ZERO, self.below.take(x + 1) * w0 >> _ZERO
        return low + w1 * (a < x) + w2 * (b < x), high - low + w1 * (a == x) + w2 * (b == x)

    def at(self, value, a, b, w0, w1, w2) -> np.ndarray:
        """The ids whose part holds ``value``: the widenings are taken out, and order 0 is searched for the rest."""
        low_a = (self.below.take(a) * w0 >> _ZERO) + w2 * (b < a)
        low_b = (self.below.take(b) * w0 >> _ZERO) + w1 * (a < b)
        zero = value - np.minimum(np.maximum(value - low_a, 0), w1) - np.minimum(np.maximum(value - low_b, 0), w2)
        y = np.clip(((zero + 1 << _ZERO) - 1) / w0, 0, (1 << _ZERO) - 1).astype(np.int64)
        x = self.coarse.take(y >> 5)
        for step in (16, 8, 4, 2, 1):
            x += (self.fine.take(x + step) <= y) * step
        return x

    def learn(self, x, last, slot, one, two, a, b, context) -> None:
        """Of equal contexts in one chunk the last one is kept."""
        self.counts += np.bincount(x, minlength=self.n_ids)
        right_one, right_two = a == x, b == x
        met = np.bincount((context << 2) + (right_two << 1) + right_one, minlength=4 * _CONTEXTS).reshape(_CONTEXTS, 4)
        self.met += [met.sum(1), met[:, 1] + met[:, 3], met[:, 2]]
        for table, at, known, right in ((self.after_one, last, one, right_one), (self.after_two, slot, two, right_two)):
            sure = known & 3
            table[at] = np.where(right, known + (sure < 3), np.where(sure > 0, known - 1, x << 2))
        self.refresh()


def encode_block(ids: np.ndarray) -> bytes:
    """A block of at most ``BLOCK_IDS`` ids below 65,536 as bytes."""
    n = len(ids)
    if n > BLOCK_IDS:
        raise ValueError(f"a block holds {BLOCK_IDS} ids at most")
    crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
    if not n:
        return HEADER.pack(MAGIC, 0, crc, 0, 0)
    if int(ids.min()) < 0 or int(ids.max()) > 0xFFFF:
        raise ValueError("ids must be from 0 to 65,535")
    steps = -(-n // min(LANES, -(-n // 128)))
    lanes, n_ids = -(-n // steps), int(ids.max()) + 1
    table = np.zeros((lanes, steps), np.int64)
    table.ravel()[:n] = ids
    # By step: what was coded two ids before, one before, and now.
    line = np.zeros((steps + 2, lanes), np.int64)
    line[2:] = table.T
    low, width = np.zeros(lanes, np.int64), np.full(lanes, 1 << _WIDE, np.int64)
    room = 2 * steps + 2
    at = np.arange(lanes, dtype=np.int64) * room
    words, first = np.zeros(lanes * room, np.int32), at.copy()

    def widen() -> None:
        small = width < 1 << _NARROW
        if small.any():
            words[at] = low >> _NARROW  # a lane that is wide enough writes here again
            np.copyto(low, (low & _REST) << 16, where=small)
            np.copyto(width, width << 16, where=small)
            np.add(at, small, out=at)

    model = _Model(n_ids)
    for a_step, b_step in _chunks(steps):
        x, last, before = (line[a_step + k : b_step + k].ravel() for k in (2, 1, 0))
        slot = model.slot(last, before)
        one, two, a, b, context, w0, w1, w2 = model.look(last, slot)
        start, size = (y.reshape(-1, lanes) for y in model.part(x, a, b, w0, w1, w2))
        for k in range(b_step - a_step):
            r = width >> _MIX
            low += r * start[k]
            np.multiply(r, size[k], out=width)
            widen()
            if int(width.min()) < 1 << _NARROW:
                widen()
        model.learn(x, last, slot, one, two, a, b, context)
    words[at] = (low + _REST) >> _NARROW  # one word more names a number inside the range
    n_words = at + 1 - first
    grid = words.reshape(lanes, room)
    carry = np.zeros(lanes, np.int32)
    for w in range(int(n_words.max()) - 1, -1, -1):
        value = np.where(w < n_words, grid[:, w] + carry, 0)
        carry = value >> 16
        grid[:, w] = value & 0xFFFF
    held = np.arange(room) < n_words[:, None]
    return HEADER.pack(MAGIC, n, crc, lanes, n_ids) + n_words.astype("<u2").tobytes() + grid[held].astype("<u2").tobytes()


def decode_block(payload: bytes) -> np.ndarray:
    """The ids of a block (uint32); a block whose checksum differs is an error."""
    if len(payload) < HEADER.size:
        raise ChecksumError("not a whole block of ids")
    magic, n, crc, lanes, n_ids = HEADER.unpack_from(payload)
    if magic != MAGIC or n > BLOCK_IDS or lanes > LANES or n_ids > 1 << 16 or (n > 0) != (lanes > 0) or (n > 0) != (n_ids > 0) or len(payload) < HEADER.size + 2 * lanes:
        raise ChecksumError("not a whole block of ids")
    n_words = np.frombuffer(payload, "<u2", lanes, HEADER.size).astype(np.int64)
    if len(payload) < HEADER.size + 2 * lanes + 2 * int(n_words.sum()):
        raise ChecksumError("not a whole block of ids")
    steps = -(-n // lanes) if n else 0
    ids = np.zeros((steps, lanes), np.int64)
    if n:
        _decode_steps(ids, np.frombuffer(payload, "<u2", int(n_words.sum()), HEADER.size + 2 * lanes), n_words, n_ids)
    out = np.ascontiguousarray(ids.T).ravel()[:n].astype("<u4")
    if zlib.crc32(out.tobytes()) != crc:
        raise ChecksumError("a block's ids don't match its checksum")
    return out


def _decode_steps(ids: np.ndarray, stream: np.ndarray, n_words: np.ndarray, n_ids: int) -> None:
    steps, lanes = ids.shape
    room = int(n_words.max()) + 4
    grid = np.zeros((lanes, room), np.int64)
    grid[np.arange(room) < n_words[:, None]] = stream
    words, at = grid.ravel(), np.arange(lanes, dtype=np.int64) * room
    rest = np.zeros(lanes, np.int64)
    for _ in range(3):
        rest = rest << 16 | words[at]
        at += 1
    width = np.full(lanes, 1 << _WIDE, np.int64)
    end = np.arange(1, lanes + 1, dtype=np.int64) * room - 1  # damaged blocks read zeros at the end of their lane

    def widen() -> None:
        small = width < 1 << _NARROW
        if small.any():
            np.copyto(rest, rest << 16 | words.take(at), where=small)
            np.copyto(width, width << 16, where=small)
            np.minimum(at + small, end, out=at)

    model = _Model(n_ids, searched=True)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for a_step, b_step in _chunks(steps):
        seen = []
        for t in range(a_step, b_step):
            slot = model.slot(last, before)
            found = one, two, a, b, context, w0, w1, w2 = model.look(last, slot)
            r = np.maximum(width >> _MIX, 1)
            value = np.clip((rest / r).astype(np.int64), 0, (1 << _MIX) - 1)
            x = np.clip(model.at(value, a, b, w0, w1, w2), 0, n_ids - 1)
            start, size = model.part(x, a, b, w0, w1, w2)
            rest -= r * start
            np.multiply(r, size, out=width)
            widen()
            if int(width.min()) < 1 << _NARROW:
                widen()
            ids[t] = x
            seen.append((x, last, slot, *found[:5]))
            last, before = x, last
        model.learn(*(np.concatenate(y) for y in zip(*seen, strict=True)))


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids as bytes."""
    return [encode_block(b) for b in blocks]


def decode(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of each block (uint32); a block whose checksum differs is an error."""
    return [decode_block(p) for p in payloads]
