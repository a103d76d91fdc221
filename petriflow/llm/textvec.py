"""Words of many texts at once: byte masks, rolling hashes and windows over Arrow string columns with numpy.

All functions work on one *block* of texts, laid end to end as UTF-8 bytes. Blocks are cut at about ``BLOCK`` bytes, so
that the arrays of a task stay small however long its partition is (one text is never split).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 19
_U = np.uint64

#: Words between ASCII white space, and words of ASCII letters, digits and anything beyond ASCII.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_lo:_hi] = True
#: ASCII upper case to lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def quoted(name: str) -> str:
    """A column's name as Spark's parser reads it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def beside(docs: DataFrame, kept: list[str], inputs: list[Column], run, made: dict[str, str]) -> DataFrame:
    """Columns ``kept`` of ``docs`` and those that ``run(names of the kept ones)`` makes (name to type), batch by batch from the kept columns and
    ``inputs`` behind them. Inside, kept columns go by number, so that no name can clash or be misread."""
    inner = [f"c{i}" for i in range(len(kept))]
    ready = docs.select(*(F.col(quoted(c)).alias(i) for c, i in zip(kept, inner, strict=True)), *(x.alias(f"x{j}") for j, x in enumerate(inputs)))
    schema = ", ".join([*(f"{i} {docs.schema[c].dataType.simpleString()}" for c, i in zip(kept, inner, strict=True)), *(f"{quoted(n)} {t}" for n, t in made.items())])
    return ready.mapInArrow(run(inner), schema).select(*(F.col(i).alias(c) for c, i in zip(kept, inner, strict=True)), *(F.col(quoted(n)) for n in made))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as long as any block needed so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up, self.down
        size = max(n, BLOCK + 1)
        up, down = (np.cumprod(np.concatenate([[_U(1)], np.full(size, b, np.uint64)])) for b in (self.base, self.inverse))
        if size <= 2 * BLOCK:  # those of a very long text are not kept
            self.up, self.down = up, down
        return up, down


_BYTES, _WORDS, _AGAIN = _Powers(0x5851F42D4C957F2D), _Powers(0xD1342543DE82EF95), _Powers(0x9FB21C651E98DF25)


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        last = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        last = min(max(last, row + 1), len(column))
        yield row, raw[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def words(data: np.ndarray, offsets: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of every maximal run of allowed bytes inside a text, in order."""
    inside = allowed[data]
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, again: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``again`` gives another one, independent of the first."""
    up, down = (_AGAIN if again else _BYTES)(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, Rabin-Karp hash) of every ``k`` consecutive words of one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = _WORDS(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    starts = np.flatnonzero(text[:n] == text[k - 1 :])
    return starts, mix((total[starts + k] - total[starts]) * down[starts])


def per_text(text: np.ndarray, n: int) -> np.ndarray:
    """How many words each of ``n`` texts has."""
    return np.bincount(text, minlength=n).astype(np.int64)


class Table:
    """Non-negative numbers to numbers, by open addressing; -1 for what is not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.n = 0
        self._empty(len(keys))
        self.add(keys, values)

    def _empty(self, n: int) -> None:
        self.mask = (1 << max(8, (2 * n).bit_length())) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Takes in keys that differ from one another and from those here."""
        self.n += len(keys)
        if 2 * self.n > self.mask:
            held = self.keys >= 0
            keys, values = np.concatenate([self.keys[held], keys]), np.concatenate([self.values[held], values])
            self._empty(self.n)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of keys that meet in a slot one stays
            there = self.keys[slot] == keys
            self.values[slot[there]] = values[there]
            keys, values, slot = keys[~there], values[~there], slot[~there] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.int64(0x2545F4914F6CDD1D) >> np.int64(20)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        known = self.keys[slot]
        out = np.where(known == keys, self.values[slot], -1)
        left = np.flatnonzero((known != keys) & (known >= 0))
        keys, slot = keys[left], slot[left]
        while len(left):
            slot = slot + 1 & self.mask
            known = self.keys[slot]
            hit = known == keys
            out[left[hit]] = self.values[slot[hit]]
            more = ~hit & (known >= 0)
            left, keys, slot = left[more], keys[more], slot[more]
        return out


class WordTable:
    """Words to stretches of numbers, in arrays of about 70 bytes a word: 128 bits of hashes tell words apart. Past ``most`` words it starts anew."""

    def __init__(self, dtype: str, most: int):
        self.dtype, self.most = dtype, most
        self.clear()

    def clear(self) -> None:
        self.table = Table(np.empty(0, np.int64), np.empty(0, np.int64))
        self.check, self.first, self.size, self.pool = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, self.dtype)
        self.n = self.held = 0

    @staticmethod
    def hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each of an array of large strings."""
        made = [(word_hashes(raw, cuts[:-1], cuts[1:]), word_hashes(raw, cuts[:-1], cuts[1:], True)) for _, raw, cuts in blocks(words)]
        key, check = (np.concatenate([x[i] for x in made]) if made else np.empty(0, np.uint64) for i in (0, 1))
        return (key >> _U(1)).view(np.int64), check

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The entry of each word, or -1."""
        at = self.table.find(key).astype(np.int64)
        if self.n:
            at[(at >= 0) & (self.check[at] != check)] = -1
        return at

    def add(self, key: np.ndarray, check: np.ndarray, values: list[bytes]) -> np.ndarray:
        """The entries of words that are not here; a word given twice has two, either of which serves."""
        numbers = np.frombuffer(b"".join(values), self.dtype)
        size = np.fromiter(map(len, values), np.int64, len(values)) // numbers.itemsize
        at = np.arange(self.n, self.n + len(values))
        first = self.held + np.cumsum(size) - size
        self.check, self.first, self.size = (self._grown(x, self.n, y) for x, y in ((self.check, check), (self.first, first), (self.size, size)))
        self.pool = self._grown(self.pool, self.held, numbers)
        self.n, self.held = self.n + len(values), self.held + len(numbers)
        keys, once = np.unique(key, return_index=True)
        fresh = self.table.find(keys) < 0
        self.table.add(keys[fresh], at[once[fresh]])
        return at

    @staticmethod
    def _grown(x: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
        if n + len(more) > len(x):
            x = np.concatenate([x[:n], np.empty(max(n // 2, 1 << 16, 2 * len(more)), x.dtype)])
        x[n : n + len(more)] = more
        return x

    def laid_out(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the stretches of ``entries`` in a row, where each ends)."""
        n = self.size[entries]
        upto = np.cumsum(n, dtype=np.int64)
        at = np.repeat(self.first[entries] - upto + n, n)
        at += np.arange(len(at))
        return self.pool[at], upto


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different words, which of them stands at each place, words of each text) of large strings cut at single spaces."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def strings(words: pa.Array) -> list[str]:
    """Words without spaces as Python strings, by way of one string for all of them."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
