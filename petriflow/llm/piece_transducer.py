"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into one transducer: the normaliser's rewrite rules, white space to U+2581 and the prefix; an automaton
whose arcs are the pieces; and byte arcs for characters that are no piece. It is composed with a batch of inputs lazily, as a lattice
of arcs over all places at once, and one routine takes the shortest path in the tropical semiring. In a unigram model an arc weighs
the piece's negative log probability. In a BPE model arcs weigh nothing, and two arcs in a row weigh zero if the merge order
leaves their pieces apart and infinity otherwise: the one finite path is the result of the merges. Runs of white
space pieces, which all have one rank, are merged from the left.

Paths are independent between characters that stand side by side in no piece, so the lattice is cut there. A batch's words are made
distinct first, and a worker keeps the ids of ``CACHE`` words and then starts anew.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petriflow.llm import textvec as tv

SPACE = "▁"
#: Words whose ids a worker keeps, bytes of text and characters of new words taken at a time.
CACHE, TEXT_BYTES, LATTICE = 800_000, 2 << 20, 1 << 17
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_INF = float("inf")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
            yield tag >> 3, value
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            yield tag >> 3, raw[at : at + size]
            at += size


def rewrite_rules(blob: bytes) -> dict[str, str]:
    """The rules of a normaliser's character map: a double-array trie of sources, then the targets, each ended by a zero byte."""
    size = struct.unpack_from("<I", blob)[0]
    units, targets = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    jump = lambda u: (u >> 10) << ((u & 1 << 9) >> 6)
    rules: dict[str, str] = {}
    at, sources = jump(units[:1]), [b""]
    labels = np.arange(1, 256)
    while len(at):
        places = at[:, None] ^ labels
        inside = places < len(units)
        found = units[np.where(inside, places, 0)]
        row, byte = np.nonzero(inside & ((found & (1 << 31 | 0xFF)) == labels))
        unit = found[row, byte]
        sources = [sources[r] + bytes([b + 1]) for r, b in zip(row.tolist(), byte.tolist(), strict=True)]
        at = places[row, byte] ^ jump(unit)
        for i in np.flatnonzero(unit >> 8 & 1).tolist():
            start = int(units[at[i]] & (1 << 31) - 1)
            rules[sources[i].decode()] = targets[start : targets.index(b"\0", start)].decode()
    return rules


class Transducer:
    """The compiled model; `encode` gives ids, `decode` the text."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.kind, self.unknown = UNIGRAM, 0
        self.prefix = self.escape = True
        self.squeeze = True
        self.rules: dict[str, str] = {}
        self.bytes: list[int] = [0] * 256
        table: list[bytes] = []
        for number, value in _fields(model):
            if number == 1:
                part = dict(_fields(value))
                piece, kind = part[1].decode(), part.get(3, _NORMAL)
                i = len(self.pieces)
                self.pieces.append(piece)
                table.append(b"" if kind == _CONTROL else piece.replace(SPACE, " ").encode())
                if kind == _BYTE:
                    self.bytes[int(piece[3:5], 16)] = i
                    table[-1] = bytes([int(piece[3:5], 16)])
                elif kind == _UNKNOWN:
                    self.unknown, table[-1] = i, " ⁇ ".encode()
                elif kind in (_NORMAL, _USER):
                    self.rank[piece], self.id[piece] = -struct.unpack("<f", part.get(2, b"\0" * 4))[0], i
            elif number == 2:
                spec = dict(_fields(value))
                self.kind = spec.get(3, UNIGRAM)
                if spec.get(24):
                    raise ValueError("models with white space as a suffix are not supported")
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    self.rules = rewrite_rules(spec[2])
                self.prefix, self.squeeze, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        self.fallback = len({*self.bytes}) == 256
        self.longest = max(map(len, self.rank), default=1)
        self.worst = 10 + max(self.rank.values(), default=0.0)
        self.runs = {p for p in self.rank if p and not p.strip(SPACE)}
        self.left: dict[str, list[tuple[str, float]]] = {}
        self.right: dict[str, list[tuple[str, float]]] = {}
        if self.kind == BPE:
            self._compile_merges()
        #: Whether no piece holds white space after another character, so that each word stands alone.
        self.by_word = self.escape and not any(SPACE in p.lstrip(SPACE) for p in self.rank)
        if self.kind == BPE and not self.by_word:
            raise ValueError("BPE models with pieces over white space are not supported")
        self.rewritten = re.compile("[" + "".join(map(re.escape, sorted({s[0] for s in self.rules}))) + "]") if self.rules else None
        self.widest_rule = max(map(len, self.rules), default=0)
        self._compile_automaton()
        sizes = np.array([len(t) for t in table], np.int64)
        self.out = np.frombuffer(b"".join(table), np.uint8)
        self.out_size, self.out_first = sizes, np.cumsum(sizes) - sizes
        self.known = tv.WordTable("<u4", CACHE)

    def _compile_automaton(self) -> None:
        usable = [p for p in (self.right if self.kind == BPE else self.rank) if p]
        chars = sorted({c for p in usable for c in p})
        number = {c: i + 1 for i, c in enumerate(chars)}
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.n_codes = k = len(chars) + 1
        arcs: dict[int, int] = {}
        final, near = [-1], set()
        for p in usable:
            state = 0
            codes = [number[c] for c in p]
            near.update(zip(codes, codes[1:], strict=False))
            for c in codes:
                key = state * k + c
                if (to := arcs.get(key)) is None:
                    to = arcs[key] = len(final)
                    final.append(-1)
                state = to
            final[state] = self.id[p]
        numbers = lambda x: np.fromiter(x, np.int64)
        self.arcs = tv.Table(numbers(arcs), numbers(arcs.values()))
        self.final = np.array(final, np.int64)
        self.near = tv.Table(numbers(a * k + b for a, b in near), np.zeros(len(near), np.int64))
        self.weight = np.zeros(len(self.pieces) + 1)
        if self.kind != BPE:
            self.weight[-1] = self.worst
            for p in usable:
                self.weight[self.id[p]] = self.rank[p]
        self.apart = tv.Table(np.empty(0, np.int64), np.empty(0, np.int64))

    def _merge(self, text: str) -> list[tuple[str, str]]:
        """The merges of ``text`` in order, white space runs aside; the last makes the whole if it is reachable."""
        parts, made = list(text), []
        while len(parts) > 1:
            pairs = [(self.rank.get(a + b, _INF) if a + b not in self.runs else _INF, i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(pairs)
            if rank == _INF:
                break
            made.append((parts[i], parts[i + 1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return made if len(parts) == 1 else []

    def _compile_merges(self) -> None:
        """For each reachable piece its outermost parts on either side, each with the rank of the merge that ends it."""
        split: dict[str, tuple[str, str]] = {}
        for piece in self.rank:
            if len(piece) > 1 and piece not in self.runs and (made := self._merge(piece)):
                split[piece] = made[-1]
        for piece in self.rank:
            if piece in self.runs and len(piece) > 1 or len(piece) > 1 and piece not in split:
                continue
            for side, known in ((0, self.left), (1, self.right)):
                spine, part, ends = [(piece, _INF)], piece, 0.0
                while part in split:
                    ends, part = self.rank[part], split[part][side]
                    spine.append((part, ends))
                known[piece] = spine

    def _stay_apart(self, a: str, b: str) -> bool:
        """Whether the merges of ``a + b`` end in these two: no part on the right edge of a ever joins one on the left edge of b."""
        ra, lb = self.right[a], self.left[b]
        i, j, ok = len(ra) - 1, len(lb) - 1, True
        while ok:
            (x, x_ends), (y, y_ends) = ra[i], lb[j]
            joint = _INF if x + y in self.runs else self.rank.get(x + y, _INF)
            if joint < _INF and joint < x_ends and joint <= y_ends:
                ok = False
            elif i == 0 and j == 0:
                break
            elif j == 0 or i > 0 and x_ends <= y_ends:
                i -= 1
            else:
                j -= 1
        return ok

    def _leaves_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two pieces in a row stay two in a BPE model, by ids; byte arcs always do."""
        inner = np.flatnonzero((a >= 0) & (b >= 0))
        out = np.ones(len(a), bool)
        keys = a[inner] * len(self.pieces) + b[inner]
        found = self.apart.find(keys)
        if (found < 0).any():
            new = np.unique(keys[found < 0])
            pieces = self.pieces
            made = [self._stay_apart(pieces[x], pieces[y]) for x, y in zip((new // len(pieces)).tolist(), (new % len(pieces)).tolist(), strict=True)]
            fresh = tv.Table(new, np.array(made, np.int64))
            found = np.where(found < 0, fresh.find(keys), found)
            if self.apart.n < CACHE:
                self.apart.add(new, np.array(made, np.int64))
        out[inner] = found > 0
        return out

    def _lattice(self, code: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every arc over the characters ``code``, none past ``stop``; piece -1 is a byte arc. Longer arcs come first."""
        starts, ends, pieces = [], [], []
        bare = np.ones(len(code), bool)
        at = np.flatnonzero(code)
        state = self.arcs.find(code[at].astype(np.int64))
        size = 1
        while len(at):
            some = np.flatnonzero(self.final[state] >= 0)
            starts.append(at[some])
            ends.append(at[some] + size)
            pieces.append(self.final[state[some]])
            if size == 1:
                bare[at[some]] = False
            go = np.flatnonzero(at + size < stop[at])
            at, state = at[go], state[go].astype(np.int64)
            state = self.arcs.find(state * self.n_codes + code[at + size])
            go = np.flatnonzero(state >= 0)
            at, state = at[go], state[go]
            size += 1
        at = np.flatnonzero(bare)
        starts.insert(1, at)
        ends.insert(1, at + 1)
        pieces.insert(1, np.full(len(at), -1))
        return tuple(np.concatenate(x[::-1]) for x in (starts, ends, pieces))

    def shortest_paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, ids of each): the lightest path through each word's lattice; of equal ones that of the longest arcs."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        point = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        total, code = len(point), self.code[point]
        word = np.repeat(np.arange(len(words)), size)
        if not total:
            return np.empty(0, np.uint32), size
        begins = np.ones(total, bool)
        begins[1:] = (word[1:] != word[:-1]) | (self.near.find(code[:-1].astype(np.int64) * self.n_codes + code[1:]) < 0)
        first = np.flatnonzero(begins)
        unit = np.cumsum(begins) - 1
        stop = np.append(first[1:], total)[unit]
        start, end, piece = self._lattice(code, stop)
        offset = start - first[unit[start]]
        order = np.argsort(offset, kind="stable")
        start, end, piece, offset = start[order], end[order], piece[order], offset[order]
        weight = self.weight[piece]
        by_end = np.argsort(end * np.int64(1 << 20) + np.minimum(start - end + (1 << 20) - 1, (1 << 20) - 1), kind="stable")
        ending = np.searchsorted(end[by_end], np.arange(total + 2))
        steps = np.searchsorted(offset, np.arange(int(offset[-1]) + 2))
        cost, back = np.full(len(start), _INF), np.full(len(start), -1)
        cost[: steps[1]] = weight[: steps[1]]
        for low, high in zip(steps[1:-1].tolist(), steps[2:].tolist(), strict=True):
            a = ending[start[low:high]]
            times = ending[start[low:high] + 1] - a
            upto = np.cumsum(times)
            arc = np.repeat(np.arange(low, high), times)
            before = by_end[np.repeat(a - upto + times, times) + np.arange(len(arc))]
            live = np.flatnonzero(cost[before] < _INF)
            arc, before = arc[live], before[live]
            if self.kind == BPE:
                live = np.flatnonzero(self._leaves_apart(piece[before], piece[arc]))
                arc, before = arc[live], before[live]
            if not len(arc):
                continue
            come = cost[before]
            cuts = np.flatnonzero(np.concatenate([[True], arc[1:] != arc[:-1]]))
            least = np.minimum.reduceat(come, cuts)
            best = np.flatnonzero(come == np.repeat(least, np.diff(np.append(cuts, len(arc)))))
            best = best[np.concatenate([[True], arc[best[1:]] != arc[best[:-1]]])]
            cost[arc[best]] = least + weight[arc[best]]
            back[arc[best]] = before[best]
        last = np.flatnonzero((end == stop[start]) & (cost < _INF))
        last = last[np.lexsort((start[last], cost[last], end[last]))]
        now = last[np.concatenate([[True], end[last[1:]] != end[last[:-1]]])] if len(last) else last
        on = np.zeros(len(start), bool)
        while len(now):
            on[now] = True
            now = back[now]
            now = now[now >= 0]
        path = np.flatnonzero(on)
        path = path[np.argsort(start[path])]
        return self._path_ids(piece[path], point[start[path]], word[start[path]], len(words))

    def _path_ids(self, piece: np.ndarray, point: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        odd = piece < 0
        if not odd.any():
            return piece.astype(np.uint32), np.bincount(word, minlength=n_words)
        if not self.fallback:  # neighbours that are unknown are one
            again = odd & np.concatenate([[False], odd[:-1] & (word[1:] == word[:-1])])
            piece, word = np.where(odd, self.unknown, piece)[~again], word[~again]
            return piece.astype(np.uint32), np.bincount(word, minlength=n_words)
        p = point[odd]
        times = np.ones(len(piece), np.int64)
        times[odd] = 1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF)
        out = np.repeat(piece, times)
        raw = np.frombuffer(p.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        out[np.repeat(odd, times)] = np.array(self.bytes)[raw]
        return out.astype(np.uint32), np.bincount(word, weights=times, minlength=n_words).astype(np.int64)

    def _run(self, n: int) -> list[int]:
        """Lengths of the pieces that a run of ``n`` white space characters merges into, from the left among equals."""
        parts = [1] * n
        while len(parts) > 1:
            rank, i = min((self.rank.get(SPACE * (a + b), _INF), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == _INF:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _rewrite(self, text: str) -> str:
        """The normaliser's rules, the longest source at each place."""
        out, at = [], 0
        for found in self.rewritten.finditer(text):
            start = found.start()
            if start < at:
                continue
            for size in range(min(self.widest_rule, len(text) - start), 0, -1):
                if (to := self.rules.get(text[start : start + size])) is not None:
                    out += [text[at:start], to]
                    at = start + size
                    break
        return "".join(out) + text[at:] if out else text

    def normalise(self, text: str) -> str:
        if self.rewritten:
            text = self._rewrite(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def _words(self, text: str) -> list[str]:
        """A normalised text's words, each with the white space before it; the whole text if pieces cross white space."""
        normal = self.normalise(text)
        if not self.by_word:
            return [normal] if normal else []
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", normal)

    def _find(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words as little-endian 32-bit numbers."""
        heads: dict[str, tuple[int, str]] = {}
        plain = []
        for w in words:
            bare = w.lstrip(SPACE)
            if self.kind == BPE and len(w) - len(bare) > (1 if bare else 0):
                heads[w] = len(w) - len(bare), bare
                if bare:
                    plain.append(SPACE + bare)
            else:
                plain.append(w)
        plain, made, low = list(dict.fromkeys(plain)), {}, 0
        while low < len(plain):
            high, held = low, 0
            while high < len(plain) and (high == low or held + len(plain[high]) <= LATTICE):
                held, high = held + len(plain[high]), high + 1
            ids, n = self.shortest_paths(plain[low:high])
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
            made.update((w, raw[a:b]) for w, a, b in zip(plain[low:high], [0, *ends], ends, strict=False))
            low = high
        for w, (n_spaces, bare) in heads.items():
            rest = made[SPACE + bare] if bare else b""
            if bare and struct.unpack_from("<I", rest)[0] != self.id.get(SPACE):
                n_spaces -= 1
            elif bare:
                rest = rest[4:]
            head: list[int] = []
            while n_spaces:
                blocks = self._run(min(n_spaces, 4 * self.longest))
                for size in blocks if n_spaces <= 4 * self.longest else blocks[:1]:
                    head.append(self.id[SPACE * size])
                    n_spaces -= size
            made[w] = struct.pack(f"<{len(head)}I", *head) + rest
        return made

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids of each). Null counts as the empty text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        # Single spaces between words, none at the ends, and nothing to rewrite: words are what stands between spaces.
        simple = pc.invert(pc.match_substring_regex(texts, "^ | $|  |" + SPACE)) if self.by_word and self.prefix and not self.rewritten else pa.array([False] * len(texts))
        simple = pc.and_(simple, pc.not_equal(texts, ""))
        words, index, n_words = tv.distinct_words(pc.if_else(simple, texts, ""))
        words = pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), words, pa.scalar("", pa.large_string()))
        index = index.astype(np.int64)
        others = np.flatnonzero(~simple.to_numpy(zero_copy_only=False))
        if len(others):
            number: dict[str, int] = {}
            split = [[number.setdefault(w, len(number)) for w in self._words(t)] for t in texts.take(pa.array(others)).to_pylist()]
            kept = np.ones(len(index), bool)
            spots = np.cumsum(n_words)[others] - 1
            kept[spots] = False  # such a text was cut as the empty one, to one word
            times = np.fromiter(map(len, split), np.int64, len(split))
            index = np.insert(index[kept], np.repeat(spots - np.arange(len(spots)), times), len(words) + np.array([i for x in split for i in x], np.int64))
            n_words[others] = times
            words = pa.concat_arrays([words, pa.array(number, pa.large_string())])
        known = self.known
        if known.n > known.most:
            known.clear()
        key, check = known.hashes(words)
        entry = known.find(key, check)
        new = np.flatnonzero(entry < 0)
        if len(new):
            fresh = words.take(pa.array(new)).to_pylist()
            made = self._find(fresh)
            entry[new] = known.add(key[new], check[new], [made[w] for w in fresh])
        ids, upto = known.laid_out(entry[index])
        ends, whole = np.cumsum(n_words), np.concatenate([[0], upto])
        return ids, whole[ends] - whole[ends - n_words]

    def decode_flat(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts in a row, bytes of each): the inverse transducer, white space restored and the prefix taken off."""
        size, first = self.out_size[ids], self.out_first[ids]
        if self.prefix:
            heads = (np.cumsum(n) - n)[n > 0]
            heads = heads[(size[heads] > 0)]
            heads = heads[self.out[first[heads]] == 0x20]
            size[heads] -= 1
            first[heads] += 1
        upto = np.cumsum(size)
        at = np.arange(upto[-1] if len(upto) else 0)
        at += np.repeat(first - upto + size, size)
        whole = np.concatenate([[0], upto])
        ends = np.cumsum(n)
        return self.out[at], whole[ends] - whole[ends - n]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_flat(pa.array([text], pa.large_string()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_flat(np.array(ids, np.int64), np.array([len(ids)]))[0].tobytes().decode(errors="replace")


@lru_cache(maxsize=2)
def _compiled(model: bytes) -> Transducer:
    return Transducer(model)


def _encoding(model: bytes, kept: list[str], decoded: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _compiled(model)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for row, data, offsets in tv.blocks(column, TEXT_BYTES):
                part = batch.slice(row, len(offsets) - 1)
                ids, n = fst.encode_flat(part.column(part.num_columns - 1))
                text, size = fst.decode_flat(ids, n)
                cuts, ends = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(size)])
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
                old, new = memoryview(np.ascontiguousarray(data)), memoryview(text)
                same = [old[a:b] == new[c:d] for a, b, c, d in zip(offsets.tolist(), offsets[1:].tolist(), ends.tolist(), ends[1:].tolist(), strict=False)]
                made = [pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.view(np.int32)))]
                names = ["n_tokens", "ids_crc32", "round_trip", "ids"]
                if decoded:
                    made.append(_strings(text, ends))
                    names.append(decoded)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(kept))], *made], [*kept, *names])

    return run


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte stretches as strings; U+FFFD for bytes that are not UTF-8."""
    made = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    try:
        return made.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.decode(errors="replace") for b in made.to_pylist()], pa.string())


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _read(model: str | bytes | None) -> bytes:
    if isinstance(model, bytes):
        return model
    with open(model or default_model(), "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str | bytes | None = None, text: str = "text", decoded: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids_crc32 (unsigned, of the ids as little-endian 32-bit numbers), round_trip (decoding gives the text's
    bytes) and ids (array<int>); with ``decoded``, the text that they decode to too, under that name. Null and empty texts have no ids
    and decode to the empty text. Columns named like the results are replaced; any other column is kept, whatever its name.

    The model file is read once by the driver and shipped with the task (its size does not grow with the data). A batch is taken in
    parts of ``TEXT_BYTES``; a longer text is one part, for about 40 bytes of memory a byte of text.
    """
    model = _read(model)
    made = {"n_tokens", "ids_crc32", "round_trip", "ids", *([decoded.lower()] if decoded else [])}
    kept = [c for c in docs.columns if c == text or c.lower() not in made]
    types = {"n_tokens": "long", "ids_crc32": "long", "round_trip": "boolean", "ids": "array<int>"} | ({decoded: "string"} if decoded else {})
    return tv.beside(docs, kept, [F.col(tv.quoted(text))], lambda names: _encoding(model, names, decoded), types)


def decode(encoded: DataFrame, model: str | bytes | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null for null ids, and U+FFFD for bytes that are not UTF-8."""
    model = _read(model)
    encoded = encoded.drop(*({into} & {*encoded.columns}))
    kept = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _compiled(model)
        for batch in batches:
            lists = batch.column(ids)
            n = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            text, size = fst.decode_flat(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n)
            texts = pc.if_else(lists.is_valid(), _strings(text, np.concatenate([[0], np.cumsum(size)])), None)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], texts], [*kept, into])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), f"`{into}` string"])
    return encoded.mapInArrow(run, schema)


def encoding_digest(docs: DataFrame) -> DataFrame:
    """The registered query: every document's ids, with their number and checksum, and the text they decode to."""
    return encode(docs.select("doc_id", "text"), decoded="decoded")
