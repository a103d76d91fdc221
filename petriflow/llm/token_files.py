"""Token-id files: documents encoded with a public tokenizer, written as checksummed range-coded blocks in id order, and read back.

A file set is a folder of Parquet files whose rows are blocks: partition, number in it, how many ids stand before it in the
partition, the documents in it (id, ordinal, ids of the document before this block, ids in this block) and the coded payload of
`range_coder`. Spark's writers commit it, so a task that is run again leaves no second copy. Partitions are ranges of
document ids; no partition, document or block is ever held whole by the driver.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from petriflow.functions.lineage import checkpointed, partitions, remove, shared_dir
from petriflow.llm import range_coder
from petriflow.llm import textvec as tv

#: Ids of a block, bytes of text that are tokenized at a time, about, words whose ids a worker remembers, and the id that ends a document.
BLOCK_IDS, TEXT_BYTES, CACHE, END = range_coder.BLOCK_IDS, 4 << 20, 1_500_000, 2
_BLOCKS = "part int, seq long, before long, n_ids long, docs array<struct<id:bigint,ordinal:bigint,begin:bigint,n:bigint>>, payload binary"
_DOCS = pa.list_(pa.struct([("id", pa.int64()), ("ordinal", pa.int64()), ("begin", pa.int64()), ("n", pa.int64())]))
#: Texts whose ids must be those of their words in a row.
_PROBES = ("a b", " a  b ", "the cat sat, on 12 mats.\nIt\'s", "x \u0301y \u00e9 ,", "\n\n a. B", "\U0001f642 \u65e5\u672c z")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts by a tokenizer that never joins words across spaces and newlines: a batch's words are made distinct, and each is
    encoded once. A tokenizer for which that does not hold is refused."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_str(spec)
        parts = json.loads(spec)
        if max(t.get_vocab(with_added_tokens=True).values(), default=0) > 0xFFFF:
            raise ValueError("the coder takes ids below 65,536")
        added = parts.get("added_tokens") or []
        whole = lambda x: t.encode(x, add_special_tokens=False).ids
        if any(a["lstrip"] or a["rstrip"] or any(c.isspace() for c in a["content"]) for a in added) or any(whole(p) != [i for w in p.replace("\n", " ").split(" ") for i in whole(w)] for p in _PROBES):
            raise ValueError("the tokenizer joins words across white space")
        kinds = parts.get("normalizer") or {}
        kinds = [n.get("type") for n in kinds.get("normalizers", [kinds])]
        pre = t.pre_tokenizer
        cut = (lambda x: [p for p, _ in pre.pre_tokenize_str(x)]) if pre else (lambda x: [x])
        plain = not any(a["content"].isalpha() for a in added)
        #: Whether the first letter's case counts for nothing, a full stop or comma after a letter is apart, and the model's
        #: symbols of single Latin letters, if words of them are one piece whose symbols stand in a row.
        self.lower = "Lowercase" in kinds and plain
        self.stops = {x: self._packed(whole(x)) for x in ".,"} if plain and cut("ab,")[0] == "ab" and cut("ab.")[0] == "ab" else {}
        self.letters: dict[int, str] = {}
        if plain and all(k in (None, "NFC", "Lowercase", "Replace") for k in kinds):
            pieces = {i: cut(chr(i)) for i in range(0x250) if chr(i).isalpha() and chr(i).islower()}
            letters = {i: p[0] for i, p in pieces.items() if len(p) == 1}
            if cut("abz\u00e9\u00df\u0159q") == ["abz\u00e9\u00df\u0159q".translate(letters)]:
                self.letters = letters
        self.known = tv.WordTable("<u2", CACHE)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}H", *ids)

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of words that are not known yet. Words that differ by a first capital or a last full stop or comma share the work."""
        letters, lower, stops = self.letters, self.lower, self.stops
        tokenize, packed = self.tokenizer.model.tokenize, self._packed
        parts, others = [], {}
        for w in words:
            base, tail = w, b""
            if w[-1:] in stops and len(w) > 1 and w[-2] < "\u0250" and w[-2].lower().isalpha():
                base, tail = w[:-1], stops[w[-1]]
            if lower and "A" <= base[:1] <= "Z" and base[1:2] < "\u0300":  # no mark that joins either case alone
                base = base[0].lower() + base[1:]
            if base is not w:
                others[base] = None
            parts.append((base, tail))
        made: dict[str, bytes] = {"": b""}
        key, check = tv.WordTable.hashes(pa.array(others, pa.large_string()))
        there = self.known.find(key, check)
        for base, e in zip(others, there.tolist(), strict=True):
            if e >= 0:
                made[base] = self.known.pool[self.known.first[e] : self.known.first[e] + self.known.size[e]].tobytes()
        rest = {}
        for base, _ in parts:
            if base not in made and base not in rest:
                if letters and base.isalpha() and base.islower() and (base.isascii() or max(base) < "\u0250"):
                    made[base] = packed([x.id for x in tokenize(base if base.isascii() else base.translate(letters))])
                else:
                    rest[base] = None
        made.update(zip(rest, (packed(e.ids) for e in self.tokenizer.encode_batch_fast(list(rest), add_special_tokens=False)), strict=True))
        new = np.flatnonzero(there < 0)
        self.known.add(key[new], check[new], [made[b] for b, e in zip(others, there.tolist(), strict=True) if e < 0])
        return [made[base] + tail for base, tail in parts]

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each followed by ``END``; ids of each text with it)."""
        known = self.known
        if not 0 < known.n <= known.most:
            known.clear()
            known.add(*known.hashes(pa.array(["\n"], pa.large_string())), [self._packed([END])])  # entry 0; no word is a newline
        words, index, n_words = tv.distinct_words(pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " "))
        key, check = known.hashes(words)
        entry = known.find(key, check)
        new = np.flatnonzero(entry < 0)
        if len(new):
            entry[new] = known.add(key[new], check[new], self._new(tv.strings(words.take(pa.array(new)))))
        ends = np.cumsum(n_words)
        ids, upto = known.laid_out(np.insert(entry[index], ends, 0))
        return ids, np.diff(upto[ends + np.arange(len(ends))], prepend=0)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, n = self.flat(pa.array(texts, pa.large_string()))
        return np.split(ids.astype("<u4"), np.cumsum(n)[:-1]) if texts else []


@lru_cache(maxsize=2)
def _encoder(spec: str) -> Encoder:
    return Encoder(spec)


def _write_blocks(spec: str, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(spec), TaskContext.get().partitionId()
        docs: list[dict] = []
        pieces: list[np.ndarray] = []
        held = seq = before = ordinal = 0

        def hand_on() -> pa.RecordBatch:
            nonlocal docs, pieces, held, seq, before
            payload = range_coder.encode_block(np.concatenate(pieces))
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([docs], _DOCS), pa.array([payload], pa.binary())]
            seq, before, docs, pieces, held = seq + 1, before + held, [], [], 0
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "before", "n_ids", "docs", "payload"])

        for batch in batches:
            names, texts = batch.column("id").to_pylist(), batch.column("text")
            for row, _, offsets in tv.blocks(texts, TEXT_BYTES):
                ids, lengths = encoder.flat(texts[row : row + len(offsets) - 1])
                at = 0
                for doc, n in zip(names[row : row + len(lengths)], lengths.tolist(), strict=True):
                    begin = 0
                    while begin < n:
                        size = min(n - begin, block_ids - held)
                        docs.append({"id": doc, "ordinal": ordinal, "begin": begin, "n": size})
                        pieces.append(ids[at + begin : at + begin + size])
                        held, begin = held + size, begin + size
                        if held == block_ids:
                            yield hand_on()
                    at, ordinal = at + n, ordinal + 1
        if held:
            yield hand_on()

    return run


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, block_ids: int = BLOCK_IDS) -> None:
    """The ids of all documents, each followed by ``END``, as blocks of ``block_ids`` under ``path`` in ascending id order (null ids first).

    Rows with equal ids stay together in one partition, ordered by a hash of their text. Null texts count as empty, so they are
    one id long. An empty table writes no block. Texts of any length are cut over blocks; the longest one is tokenized in one piece, for
    about 30 bytes of memory a byte of text. A tokenizer that joins words across white space, or with ids over 65,535, is refused.
    """
    with open(tokenizer or default_tokenizer()) as f:
        spec = f.read()
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id", F.xxhash64("text"))
    dealt.mapInArrow(_write_blocks(spec, block_ids), _BLOCKS).write.mode("errorifexists").parquet(path)


def _read_blocks(with_ids: bool):
    kinds = [("part", pa.int32()), ("ordinal", pa.int64()), ("id", pa.int64()), ("at", pa.int64()), ("begin", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p, before, docs, payload = (batch.column(c)[i].as_py() for c in ("part", "before", "docs", "payload"))
                ids, at, rows = range_coder.decode_block(payload), 0, []
                for d in docs:
                    x = ids[at : at + d["n"]]
                    rows.append((p, d["ordinal"], d["id"], before + at - d["begin"], d["begin"], d["n"], zlib.crc32(x), *([x.astype(np.int32)] if with_ids else [])))
                    at += d["n"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    return run


def _times(matrix: list[int], vector: int) -> int:
    out = i = 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector, i = vector >> 1, i + 1
    return out


@lru_cache(maxsize=64)
def _zeros(power: int) -> list[int]:
    """The linear map on a CRC-32 of 2^power more zero bytes."""
    if power < 0:  # one bit is 2^-3 bytes
        one = [0xEDB88320] + [1 << i for i in range(31)]
        return one if power == -3 else [_times(_zeros(power - 1), x) for x in _zeros(power - 1)]
    return [_times(_zeros(power - 1), x) for x in _zeros(power - 1)]


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """The CRC-32 of two byte strings in a row, from theirs."""
    power = 0
    while second_bytes:
        if second_bytes & 1:
            first = _times(_zeros(power), first)
        second_bytes, power = second_bytes >> 1, power + 1
    return first ^ second


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each document put together."""
    for batch in batches:
        n, crc = [], []
        for pieces in batch.column("pieces").to_pylist():
            total, value = 0, 0
            for p in sorted(pieces, key=lambda p: p["begin"]):
                value = joined_crc(value, p["crc"], 4 * p["n"]) if total else p["crc"]
                total += p["n"]
            n.append(total)
            crc.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("id"), batch.column("at"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["part", "id", "at", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; a damaged block is an error.

    Blocks are decoded where they lie; a document that spans blocks is put together from its pieces' checksums.
    """
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row for each partition of the files.
    offsets = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    pieces = blocks.mapInArrow(_read_blocks(False), "part int, ordinal long, id long, at long, begin long, n long, crc long")
    docs = pieces.groupBy("part", "ordinal").agg(F.first("id").alias("id"), F.min("at").alias("at"), F.collect_list(F.struct("begin", "n", "crc")).alias("pieces"))
    whole = docs.select("part", "id", "at", "pieces").mapInArrow(_whole, "part int, id long, at long, n_tokens long, ids_crc32 long")
    return whole.join(F.broadcast(offsets), "part").select(F.col("id").alias("doc_id"), (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, ordinal, begin, ids): every piece of every document with its ids."""
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    out = blocks.mapInArrow(_read_blocks(True), "part int, ordinal long, id long, at long, begin long, n long, crc long, ids array<int>")
    return out.select(F.col("id").alias("doc_id"), "part", "ordinal", "begin", "ids")


def token_digest(docs: DataFrame) -> DataFrame:
    """The registered query: writes the files of all documents into the shared folder, reads them back, and deletes them."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(docs, path)
    out = checkpointed(read(spark, path))
    remove(spark, path)
    return out
