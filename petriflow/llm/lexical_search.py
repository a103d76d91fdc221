"""Ranked lexical search with bag deduplication.

Of a document the ranking sees its length class m and how often it has each word of the items' vocabulary. So a document is reduced to that *bag* once;
documents of equal bag and m form a class (brought together by a hash, told apart by the bag itself), a class is scored once for
all items, and only the best classes are expanded into their members, in order of id.

Shuffles: the bags, as one row a class and task at most; the best ``k`` classes of each item and task; and the bags once more,
to find the members of those classes. Texts never move. Neither a large class nor a common word has a group of its own anywhere: members are
limited to ``k`` in every task before they meet, and word counts are summed in tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petriflow.functions.lineage import checkpointed
from petriflow.llm import textvec as tv
from petriflow.llm.textvec import quoted

#: Words of items (once an item) that one pass over the documents looks for, about; more items take more passes. They go to every task, at 40 bytes each.
MOST_TERMS = 1 << 19
#: Cells of scores, and of words met with items, that a task holds at a time.
CELLS = 1 << 21
#: Parts into which the members of a class are dealt, by the task that has them, before they meet.
SALTS = 16
#: The class id of rows without an id; they rank behind those with one.
NO_ID = np.iinfo(np.int64).max


def _hashed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, number of texts, lower-cased bytes, starts, ends, text of each word) of the blocks of a column."""
    for row, data, offsets in tv.blocks(column):
        data = tv.LOWER[data]
        starts, ends, text = tv.words(data, offsets, tv.ALNUM)
        yield row, len(offsets) - 1, data, starts, ends, text


@dataclass
class Vocabulary:
    """Words by two hashes, and the items (0, 1, ...) that have each: those of word i are ``items[first[i]:first[i + 1]]``."""

    keys: np.ndarray
    checks: np.ndarray
    first: np.ndarray
    items: np.ndarray
    n_items: int

    @classmethod
    def of(cls, numbers: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> Vocabulary:
        order = np.argsort(keys, kind="stable")
        known, at, n = np.unique(keys[order], return_index=True, return_counts=True)
        return cls(known, checks[order][at], np.concatenate([[0], np.cumsum(n)]), numbers[order], int(numbers.max()) + 1)

    @property
    def index(self) -> str:
        return "<u2" if len(self.keys) <= 1 << 16 else "<u4"

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which words are known, their numbers)."""
        key = tv.word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == key)
        same = tv.word_hashes(data, starts[hit], ends[hit], again=True) == self.checks[at[hit]]
        return hit[same], at[hit[same]]


def _item_terms(names: list[str]):
    """Rows (no, key, chk) for each different word of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for row, _, data, starts, ends, text in _hashed(batch.column(1)):
                key, check = tv.word_hashes(data, starts, ends), tv.word_hashes(data, starts, ends, again=True)
                order = np.lexsort((key, text))
                new = np.ones(len(order), bool)
                new[1:] = (key[order[1:]] != key[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
                one = order[new]
                yield pa.RecordBatch.from_arrays([pa.array(numbers[row + text[one]]), pa.array(key[one].view(np.int64)), pa.array(check[one].view(np.int64))], names)

    return run


def _pack(index: str, words: np.ndarray, times: np.ndarray) -> bytes:
    """Word numbers in order, and how often each occurs, in as few bytes as the largest takes; equal contents have equal bytes."""
    most = int(times.max())
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 8
    return bytes([width]) + words.astype(index).tobytes() + times.astype(f"<u{width}").tobytes()


def _unpack(index: str, bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, size = bag[0], int(index[-1])
    n = (len(bag) - 1) // (size + width)
    return np.frombuffer(bag, index, n, 1), np.frombuffer(bag, f"<u{width}", n, 1 + n * size)


def _bagging(vocabulary: Vocabulary, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary.keys)
        for batch in batches:
            lengths = np.zeros(batch.num_rows, np.int64)
            bags: list[bytes | None] = [None] * batch.num_rows
            for row, n, data, starts, ends, text in _hashed(batch.column(1)):
                lengths[row : row + n] = tv.per_text(text, n)
                hit, word = vocabulary.find(data, starts, ends)
                cells, times = np.unique(text[hit] * size + word, return_counts=True)
                owner, word = cells // size, cells % size
                cuts = np.searchsorted(owner, np.arange(n + 1))
                for i in np.flatnonzero(np.diff(cuts)):
                    bags[row + i] = _pack(vocabulary.index, word[cuts[i] : cuts[i + 1]], times[cuts[i] : cuts[i + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), pa.array(bags, pa.binary())], names)

    return run


def _counting(index: str, size: int):
    """Rows (word, n): how many bags have a word; -1: all words of all documents; -2: documents with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, documents = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            n = batch.column(0).to_numpy()
            words, documents = words + int(n.sum()), documents + int((n > 0).sum())
            some = [_unpack(index, b)[0] for b in batch.column(1).to_pylist() if b]
            if some:
                held += np.bincount(np.concatenate(some), minlength=size)
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], there])), pa.array(np.concatenate([[words, documents], held[there]]))], ["word", "n"])

    return run


def _best(k: int, rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Of rows (item, score, first, h, m) the ``k`` of each item with the highest scores; of equals those of least first."""
    item, score, first = rows[:3]
    order = np.lexsort((first, -score, item))
    item = item[order]
    start = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.empty(0, np.int64)
    place = np.arange(len(item)) - np.repeat(start, np.diff(np.append(start, len(item))))
    return tuple(x[order[place < k]] for x in rows)


def _scoring(vocabulary: Vocabulary, weights: np.ndarray, k: int):
    """The ``k`` best classes of each item among a task's rows (first, h, m, bag)."""
    per_word = np.diff(vocabulary.first)

    def scores(bags: list[bytes], m: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, scores by row and item) of bags, as many at a time as their cells allow."""
        parts = [_unpack(vocabulary.index, b) for b in bags]
        words = np.concatenate([p[0] for p in parts]).astype(np.int64)
        times = np.concatenate([p[1].astype(np.int64) for p in parts])
        cuts = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        owner = np.repeat(np.arange(len(bags)), np.diff(cuts))
        worth = weights[words] * ((1_000_000_000 * times) // (1000 * times + 20 * m[owner]))
        met = np.concatenate([[0], np.cumsum(per_word[words])])
        row = 0
        while row < len(bags):
            until = int(np.searchsorted(met[cuts], met[cuts[row]] + CELLS, "right")) - 1
            until = min(max(until, row + 1), row + max(1, CELLS // vocabulary.n_items), len(bags))
            a, b = cuts[row], cuts[until]
            n = per_word[words[a:b]]
            at = np.repeat(vocabulary.first[words[a:b]] - (met[a:b] - met[a]), n) + np.arange(met[b] - met[a])
            table = np.zeros((until - row) * vocabulary.n_items, np.int64)
            np.add.at(table, np.repeat(owner[a:b] - row, n) * vocabulary.n_items + vocabulary.items[at], np.repeat(worth[a:b], n))
            yield row, table.reshape(until - row, vocabulary.n_items)
            row = until

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = tuple(np.empty(0, np.int64) for _ in range(5))
        least = np.zeros(vocabulary.n_items, np.int64)  # a score below an item's least can't enter its best
        for batch in batches:
            if not batch.num_rows:
                continue
            first, h, m = (batch.column(i).to_numpy() for i in range(3))
            for row, table in scores(batch.column(3).to_pylist(), m):
                r, item = np.nonzero((table > 0) & (table >= least))
                some = (item, table[r, item], first[row + r], h[row + r], m[row + r])
                top = _best(k, tuple(np.concatenate(x) for x in zip(top, some, strict=True)))
                n = np.bincount(top[0], minlength=vocabulary.n_items)
                full = np.flatnonzero(n == k)
                least[full] = top[1][np.cumsum(n)[full] - 1]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in top], ["item", "score", "first", "h", "m"])

    return run


def _search(docs: DataFrame, vocabulary: Vocabulary, k: int) -> DataFrame:
    """(item, rank, doc_id, score) for rows (doc_id, text) and items by number."""
    size = len(vocabulary.keys)
    bags = checkpointed(docs.mapInArrow(_bagging(vocabulary, ["doc_id", "n", "bag"]), "doc_id long, n long, bag binary"))
    counts = dict(bags.select("n", "bag").mapInArrow(_counting(vocabulary.index, size), "word long, n long").groupBy("word").agg(F.sum("n")).collect())  # a row a word of the items
    all_words, n_docs = counts.get(-1, 0), counts.get(-2, 0)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(i, 0) + 1))) for i in range(size)], np.int64)
    m = F.expr(f"50L + (50L * n * {n_docs}L) div {max(1, all_words)}L")
    keyed = bags.where("bag IS NOT NULL").withColumn("m", m).select("doc_id", F.xxhash64("m", "bag").alias("h"), "m", "bag")
    classes = checkpointed(keyed.groupBy("h", "m", "bag").agg(F.coalesce(F.min("doc_id"), F.lit(int(NO_ID))).alias("first")))
    found = classes.select("first", "h", "m", "bag").mapInArrow(_scoring(vocabulary, weights, k), "item long, score long, first long, h long, m long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "first")
    top = checkpointed(found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n"))
    # Members of the classes that are in some item's best; a class keeps its first k at most, in each task before they meet.
    chosen = classes.join(top.select("h", "m", "first").distinct(), ["h", "m", "first"])
    # Tasks hand their part of a class to one of SALTS tasks, and these to one.
    by_id, salts = F.asc_nulls_last("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    some = Window.partitionBy("h", "m", "bag", "salt").orderBy(by_id)
    members = keyed.withColumn("salt", F.spark_partition_id() % SALTS).withColumn("_n", F.row_number().over(some)).where(F.col("_n") <= k)
    members = members.join(chosen.withColumn("salt", salts), ["h", "m", "bag", "salt"]).select("h", "m", "first", "doc_id")
    members = members.withColumn("_n", F.row_number().over(Window.partitionBy("h", "m", "first").orderBy(by_id))).where(F.col("_n") <= k).drop("_n")
    last = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = top.join(members, ["h", "m", "first"]).withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return ranked.select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", most_terms: int = MOST_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score above 0 for each row of ``items``; of equal scores those of least id.

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. N documents have a word, L words are in all documents, n in
    one; a word that df documents have weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))). With m = 50 + (50 n N) div L a document's score sums
    w ((10^9 tf) div (1000 tf + 20 m)) over the item's different words, in whole numbers.

    Null and empty texts have no words: such a document is never found, such an item finds nothing. Each row of ``items`` is an item of its own, and each
    row of ``docs`` a document of its own, whatever their ids; documents without an id rank behind their equals. Other columns play no part. Items
    with more than ``most_terms`` words together are dealt into several passes over the documents. Words are compared by 128 bits of hashes. A
    text of n bytes costs about 60 n bytes of memory.
    """
    spark = docs.sparkSession
    named = items.select(F.col(quoted(item_id)).alias("item_id"), F.col(quoted(item_text)).alias("text"))
    named = checkpointed(named.withColumn("no", F.monotonically_increasing_id()))
    terms = checkpointed(named.select("no", "text").mapInArrow(_item_terms(["no", "key", "chk"]), "no long, key long, chk long"))
    passes = terms.count() // most_terms + 1
    ready = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))
    out = []
    for p in range(passes):
        block = terms.where(F.pmod(F.xxhash64("no"), F.lit(passes)) == p).toPandas()  # about most_terms rows
        if not len(block):
            continue
        numbers, item = np.unique(block["no"].to_numpy(), return_inverse=True)
        vocabulary = Vocabulary.of(item, block["key"].to_numpy().view(np.uint64), block["chk"].to_numpy().view(np.uint64))
        back = spark.createDataFrame([*enumerate(numbers.tolist())], "item long, no long")
        out.append(_search(ready, vocabulary, k).join(back, "item").drop("item"))
    if not out:
        return named.join(ready.select("doc_id").where("false")).select("item_id", F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score")).where("false")
    return reduce(DataFrame.union, out).join(named.select("no", "item_id"), "no").select("item_id", "rank", "doc_id", "score")
