"""Benchmark decontamination by winnowing.

Documents and items are fingerprinted alike: of every ``SPAN - GRAM + 1`` consecutive hashes of ``GRAM`` words the least one
is kept, so two texts that share ``SPAN`` words share a fingerprint inside them. Fingerprints of both sides are joined in Spark; a
document and an item that share one are then compared at every window of ``SPAN`` words, which extends each hit as far as the texts
agree. Items shorter than a window are one window each and are met by the hash of all their words.

Before the join a bitmap of fixed size, made of the items' fingerprints by a Spark aggregation, drops documents' fingerprints that
no item has. Nothing else of the benchmark is shipped to tasks or passes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petriflow.functions.lineage import checkpointed
from petriflow.llm import textvec as tv
from petriflow.llm.textvec import quoted

SPAN, GRAM = 10, 5
#: Bits of a bitmap as a power of two; parts of a hash's documents in a join; most bytes of a table that is broadcast (its size is counted first).
BITMAP, SALTS, BROADCAST = 24, 16, 32 << 20
_LAST = (1 << 63) - 1


def winnow(h: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Indexes of the least hash (the last of equals) of every ``width`` consecutive hashes of one text."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = np.arange(n)
    for shift in range(1, width):
        other = np.arange(shift, n + shift)
        best = np.where(h[other] <= h[best], other, best)
    return np.unique(best[text[:n] == text[width - 1 :]])


def _split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words with their text and, by text, the first word."""
    starts, ends, text = tv.words(data, offsets, tv.ALNUM)
    first = np.concatenate([[0], np.cumsum(tv.per_text(text, len(offsets) - 1))])
    return tv.word_hashes(tv.LOWER[data], starts, ends), text, first


def _windows(h: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every window; windows of different sizes have different hashes."""
    at, grams = tv.windows(h, text, size)
    return at, tv.mix(grams + np.uint64(size))


def fingerprints(h: np.ndarray, text: np.ndarray, span: int, gram: int, short: tuple[int, ...], whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, fingerprint) of the winnowed grams and of windows of the ``short`` sizes; with ``whole`` (words of each text), of texts
    of exactly that size only."""
    at, grams = _windows(h, text, gram)
    keep = winnow(grams, text[at], span - gram + 1)
    owners, found = [text[at[keep]]], [grams[keep]]
    for size in short:
        at, grams = _windows(h, text, size)
        # A gram of the same size as a short item is told apart from the winnowed ones.
        grams = tv.mix(grams ^ np.uint64(0x5A5A5A5A5A5A5A5A))
        if whole is not None:
            at, grams = at[whole[text[at]] == size], grams[whole[text[at]] == size]
        owners.append(text[at])
        found.append(grams)
    return np.concatenate(owners), np.concatenate(found)


def _place(f: np.ndarray) -> np.ndarray:
    return (f >> np.uint64(64 - BITMAP)).astype(np.int64)


def _prints_of_items(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in tv.blocks(batch.column("text")):
                h, text, first = _split(data, offsets)
                n = np.diff(first)
                owner, f = fingerprints(h, text, span, gram, tuple(range(1, span)), n)
                items = batch.column("item").to_numpy()[row + owner]
                yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(f.view(np.int64)), pa.array(_place(f)), pa.array(n[owner])], ["item", "f", "place", "n"])

    return run


def _prints_of_docs(span: int, gram: int, short: tuple[int, ...], bitmap: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            for row, data, offsets in tv.blocks(batch.column("text")):
                h, text, _ = _split(data, offsets)
                owner, f = fingerprints(h, text, span, gram, short)
                place = _place(f)
                hit = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                owner, f = owner[hit], f[hit]
                order = np.lexsort((f, owner))
                owner, f = owner[order], f[order]
                new = np.ones(len(f), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (f[1:] != f[:-1])
                rows = pa.array(row + owner[new])
                yield pa.RecordBatch.from_arrays([batch.column("rid").take(rows), batch.column("key").take(rows), pa.array(f[new].view(np.int64))], ["rid", "key", "f"])

    return run


def _bitmap(prints: DataFrame) -> bytes:
    """2^BITMAP bits, folded to 64-bit words by Spark: 2^(BITMAP-6) rows come to the driver at most."""
    words = prints.groupBy((F.col("place") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (BITMAP - 6), np.int64)
    out[words.w] = words.bits
    return out.astype("<i8").tobytes()


def _windows_of_items(span: int):
    """Rows (id, w, place) for every window of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in tv.blocks(batch.column("text")):
                h, text, first = _split(data, offsets)
                n = np.diff(first)
                for size in np.unique(np.minimum(n[n > 0], span)).tolist():
                    at, w = _windows(h, text, size)
                    whole = np.minimum(n[text[at]], span) == size
                    rows = pa.array(row + text[at][whole])
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), pa.array(w[whole].view(np.int64)), pa.array(_place(w[whole]))], ["id", "w", "place"])

    return run


def _windows_of_docs(sizes: tuple[int, ...], bitmap: bytes):
    """Rows (rid, key, start, size, w) for the windows of documents that an item may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            for row, data, offsets in tv.blocks(batch.column("text")):
                h, text, first = _split(data, offsets)
                for size in sizes:
                    at, w = _windows(h, text, size)
                    place = _place(w)
                    hit = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                    at, w = at[hit], w[hit]
                    rows = pa.array(row + text[at])
                    yield pa.RecordBatch.from_arrays([batch.column("rid").take(rows), batch.column("key").take(rows), pa.array(at - first[text[at]]), pa.array(np.full(len(at), size)), pa.array(w.view(np.int64))], ["rid", "key", "start", "size", "w"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rid, key, at, sids), at being starts and sizes of windows, to (rid, key, spans, sids)."""
    for batch in batches:
        spans = []
        for at in batch.column("at").to_pylist():
            out: list[list[int]] = []
            for start, size in sorted((w["start"], w["size"]) for w in at):
                if out and start <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], start + size)
                else:
                    out.append([start, start + size])
            spans.append(out)
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("key"), pa.array(spans, pa.list_(pa.list_(pa.int64()))), batch.column("sids")], ["rid", "key", "spans", "sids"])


def _small(df: DataFrame, n_bytes: int) -> DataFrame:
    """``df`` for a broadcast if its counted bytes allow it; otherwise the join is left to the planner."""
    return F.broadcast(df) if n_bytes <= BROADCAST else df


def _met(rows: DataFrame, known: DataFrame, on: str, n_bytes: int) -> DataFrame:
    """``rows`` (rid, key, ...) joined with ``known`` on a hash that very many documents may have: broadcast by counted bytes, else dealt to `SALTS` tasks."""
    if n_bytes <= BROADCAST:
        return rows.join(F.broadcast(known), on)
    salted = rows.withColumn("s", F.pmod(F.xxhash64("rid", "key"), F.lit(SALTS)).cast("int"))
    return salted.join(known.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [on, "s"]).drop("s")


def _found(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, span: int, gram: int) -> tuple[DataFrame, int]:
    """(rid, key, spans, items) of the documents with hits, and how many bytes they take, about."""
    items = benchmark.select(F.col(quoted(item_id)).cast("long").alias("id"), F.col(quoted(item_text)).alias("text")).where("text is not null")
    items = checkpointed(items.withColumn("item", F.monotonically_increasing_id()))
    prints = checkpointed(items.select("item", "text").mapInArrow(_prints_of_items(span, gram), "item long, f long, place long, n long"))
    short = tuple(sorted(r.n for r in prints.where(F.col("n") < span).select("n").distinct().collect()))  # span - 1 numbers at most
    windows = checkpointed(items.select("id", "text").mapInArrow(_windows_of_items(span), "id long, w long, place long"))
    # Windows that the same items have share the set of these.
    sets = checkpointed(windows.groupBy("w").agg(F.sort_array(F.collect_set("id")).alias("items")).withColumn("sid", F.xxhash64("items")))
    size = sets.agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("m")).first()
    n_prints = prints.select("f").distinct().count()
    ours = docs.select(F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(_LAST)).alias("rid"), F.xxhash64(F.col(quoted(text))).alias("key"), F.col(quoted(text)).alias("text"))
    seeds = ours.mapInArrow(_prints_of_docs(span, gram, short, _bitmap(prints)), "rid long, key long, f long")
    candidates = checkpointed(_met(seeds, prints.select("f").distinct(), "f", 24 * n_prints).select("rid", "key").distinct())
    n_candidates = candidates.count()
    near = ours.join(_small(candidates, 32 * n_candidates), ["rid", "key"], "left_semi")
    hits = near.mapInArrow(_windows_of_docs((*short, span), _bitmap(windows)), "rid long, key long, start long, size long, w long")
    hits = _met(hits, sets.select("w", "sid"), "w", 32 * size.n)
    by = hits.groupBy("rid", "key").agg(F.collect_set(F.struct("start", "size")).alias("at"), F.collect_set("sid").alias("sids"))  # of one text
    spans = checkpointed(by.mapInArrow(_merged, "rid long, key long, spans array<array<long>>, sids array<long>"))
    named = _met(spans.select("rid", "key", F.explode("sids").alias("sid")), sets.groupBy("sid").agg(F.first("items").alias("items")), "sid", 32 * size.n + 8 * (size.m or 0))
    named = named.select("rid", "key", F.explode("items").alias("item")).groupBy("rid", "key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = checkpointed(spans.drop("sids").join(named, ["rid", "key"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<long>"))))
    n_bytes = found.agg(F.sum(64 + 40 * F.size("spans") + 8 * F.size("items"))).first()[0] or 0
    return found, n_bytes


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with n_words, spans (array of [first word, end word)) and items (array of item ids, distinct).

    A window is ``span`` consecutive words of an item; an item of fewer words, but not none, is one window. spans cover the
    document's words that stand in any occurrence of a window. Words are runs of ASCII letters (lower-cased), digits and
    characters beyond ASCII; null has none. Items of equal text each count; an item without id counts for spans only. Rows with the
    same id and text have the same result, rows of one id with other texts their own. Columns named like the results are replaced, all
    others kept, whatever their names. A text of n bytes costs about 60 n bytes of memory.

    Documents move only if they share a fingerprint with an item (or, where results are too large to broadcast, in the last join).
    """
    found, size = _found(docs, benchmark, doc_id, text, item_id, item_text, span, gram)
    kept = [c for c in docs.columns if c in (text, doc_id) or c.lower() not in ("n_words", "spans", "items")]
    n_words = F.regexp_count(F.coalesce(F.col(quoted(text)), F.lit("")), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("long")
    named = docs.select(F.struct(*(F.col(quoted(c)) for c in kept)).alias("doc"), n_words.alias("n_words"), F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(_LAST)).alias("rid"), F.xxhash64(F.col(quoted(text))).alias("key"))
    out = named.join(_small(found, size), ["rid", "key"], "left")
    return out.select("doc.*", "n_words", F.coalesce("spans", F.array().cast("array<array<long>>")).alias("spans"), F.coalesce("items", F.array().cast("array<long>")).alias("items"))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The registered query: hit words and the digest of the items found, per document."""
    out = contamination(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a window of a benchmark item."""
    found, size = _found(docs, benchmark, doc_id, text, "item_id", "text", SPAN, GRAM)
    named = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("doc"), F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(_LAST)).alias("rid"), F.xxhash64(F.col(quoted(text))).alias("key"))
    return named.join(_small(found.select("rid", "key"), size), ["rid", "key"], "left_anti").select("doc.*")


def sha_of(ids: list[int]) -> str:
    """The digest of item ids as `contamination_digest` writes it."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
