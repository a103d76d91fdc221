"""Substring dedup: Rabin-Karp hashes of every window of ``k`` words are brought together by hash, and the windows that
an earlier document has too are merged into maximal intervals of words to remove.

Shuffles: (1) the texts, by groups of documents of about ``GROUP_BYTES``, used by steps 2 and 4; (2) each group's distinct
hashes with the least id that has them there, packed per hash bucket (about ten bytes a hash); (3) to each group, which of its
hashes an earlier document of another group has. A bucket holds a hash once a group, so a window's copies meet as one entry
for each ``GROUP_BYTES`` of text at most, never one by one, and stay packed but for ``MERGE_HASHES`` at a time; a group finds its own
occurrences again from its texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petriflow.functions.lineage import partitions
from petriflow.llm import textvec as tv
from petriflow.llm.textvec import quoted

WINDOW = 13
#: Hashes in one hash bucket, on average, at most.
PER_BUCKET = 2_000_000
#: Bytes of text that one task cuts at a time, about.
GROUP_BYTES = 4 << 20
#: Hashes that a bucket takes in at a time.
MERGE_HASHES = 1_000_000
_LAST = np.iinfo(np.int64).max


def _planes(x: np.ndarray, width: int = 4) -> bytes:
    """Numbers byte plane by byte plane: the upper planes are nearly all alike and shrink in the shuffle."""
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _unplanes(b: bytes, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def _hashes(docs: pa.Table, text_column: str, k: int, n_buckets: int) -> tuple[np.ndarray, ...]:
    """Of a group's documents, (row, start) of each window and the number of its hash; and (hash, least id, bucket) of the distinct
    hashes, ordered by these from the last to the first, so that their order is the same whatever order the rows come in."""
    ids = docs.column("_id").to_numpy()
    parts = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32))]
    for row, data, offsets in tv.blocks(docs.column(text_column)):
        starts, ends, text = tv.words(data, offsets, tv.SPACED)
        first = np.concatenate([[0], np.cumsum(tv.per_text(text, len(offsets) - 1))])
        at, h = tv.windows(tv.word_hashes(data, starts, ends), text, k)
        parts.append((h, row + text[at], (at - first[text[at]]).astype(np.int32)))
    h, row, start = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    cuts = np.flatnonzero(new)
    least = np.minimum.reduceat(ids[row[order]], cuts) if len(h) else np.empty(0, np.int64)
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    h = h[order[cuts]]
    bucket = (tv.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.lexsort((least, bucket))  # stable, and by hash before
    place = np.empty(len(h), np.int64)
    place[order] = np.arange(len(h))
    return row, start, place[which], h[order], least[order], bucket[order]


def _runs(k: int, n_buckets: int, text_column: str):
    """A group's documents to rows (bucket, g, hashes, ids, counts), one a bucket; each hash of the group is there once."""

    def run(docs: pa.Table) -> pa.Table:
        _, _, _, h, least, bucket = _hashes(docs, text_column, k, n_buckets)
        g = docs.column("_g")[0].as_py()
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows: list[tuple] = []
        for a, b in zip(cuts, np.append(cuts, len(h))[1:], strict=True):
            new = np.flatnonzero(np.concatenate([[True], least[a + 1 : b] != least[a : b - 1]]))
            rows.append((int(bucket[a]), g, h[a:b].tobytes(), _planes(least[a:b][new], 8), _planes(np.diff(np.append(new, b - a)))))
        columns = zip(*rows, strict=True) if rows else [()] * 5
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3]
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["bucket", "g", "hashes", "ids", "counts"])

    return run


def _unpacked(hashes: bytes, ids: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A row's hashes and the least id of each in the row's group."""
    return np.frombuffer(hashes, np.uint64), np.repeat(_unplanes(ids, 8).view(np.int64), _unplanes(counts).astype(np.int64))


def _repeated():
    """Of one hash bucket, rows (g, bucket, places): the places in a group's run of the hashes that an earlier document has elsewhere."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        runs = list(zip(bucket.hashes, bucket.ids, bucket.counts, strict=True))
        # A bucket is held as its packed rows and one entry for each distinct hash, however many rows have it.
        h, least, part, held = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0
        for i, run in enumerate(runs):
            part.append(_unpacked(*run))
            held += len(part[-1][0])
            if held >= MERGE_HASHES or i == len(runs) - 1:
                h, least = (np.concatenate(x) for x in zip((h, least), *part, strict=True))
                order = np.argsort(h, kind="stable")
                h, least = h[order], least[order]
                cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                h, least, part, held = h[cuts], np.minimum.reduceat(least, cuts), [], 0
        rows = []
        for g, b, run in zip(bucket.g, bucket.bucket, runs, strict=True):
            theirs, doc = _unpacked(*run)
            order = np.argsort(theirs)
            hit = np.sort(order[doc[order] > least[np.searchsorted(h, theirs[order])]])
            if len(hit):
                rows.append((int(g), int(b), _planes(np.diff(hit, prepend=0))))
        return pd.DataFrame({"g": np.array([r[0] for r in rows], np.int64), "bucket": np.array([r[1] for r in rows], np.int64), "places": [r[2] for r in rows]})

    return run


def _cut(k: int, n_buckets: int, passthrough: list[str], text_column: str):
    """A group's documents (…, _id, _g) and the places of its repeated hashes to (…, n_words, n_removed, kept_text)."""

    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        row, start, which, h, least, bucket = _hashes(docs, text_column, k, n_buckets)
        elsewhere = np.zeros(len(h), bool)
        for b, at in zip(places.column("bucket").to_pylist(), places.column("places").to_pylist(), strict=True):
            elsewhere[np.searchsorted(bucket, b) + np.cumsum(_unplanes(at).astype(np.int64))] = True
        hit = np.flatnonzero(elsewhere[which] | (docs.column("_id").to_numpy()[row] > least[which]))
        row, start = row[hit], start[hit]
        bounds = np.searchsorted(row, np.arange(docs.num_rows + 1))
        n_words, n_removed, kept = [], [], []
        for i, text in enumerate(docs.column(text_column).cast(pa.large_binary()).to_pylist()):
            words = (text or b"").split()  # bytes: white space is ASCII white space
            n_words.append(len(words))
            if bounds[i] < bounds[i + 1]:
                gone = np.zeros(len(words) + k, np.int64)
                gone[start[bounds[i] : bounds[i + 1]]] = 1
                gone = np.cumsum(gone)
                gone[k:] -= gone[:-k].copy()
                words = [w for w, g in zip(words, (gone > 0).tolist(), strict=False) if not g]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        columns = [docs.column(c) for c in passthrough] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table(columns, names=[*passthrough, "n_words", "n_removed", "kept_text"])

    return run


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_removed (long) and kept_text: the words that are left, joined by one space.

    A word goes if a window of ``window`` words that covers it starts, word for word, in a document with a smaller id too.
    Windows are judged on the input, so what one document loses never hides a repeat in another. Null and empty texts have
    no words; a null id counts as larger than any other; rows with the same id and text are treated alike, and windows
    repeated within one id stay. Columns of ``docs`` named like the results are replaced, all others kept, whatever their names. A text of
    n bytes costs about 60 n bytes of memory.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c in (doc_id, text) or c.lower() not in ("n_words", "n_removed", "kept_text")]
    size = docs.agg(F.sum(F.octet_length(F.col(quoted(text)))).alias("n")).first().n or 0
    n_buckets = max(partitions(spark), size // 6 // PER_BUCKET + 1)
    n_groups = max(partitions(spark), size // GROUP_BYTES + 1)
    number = F.col(quoted(doc_id)).cast("long")
    # Columns go by number inside, so that no name can clash. Both uses of the groups read one exchange; a group is the same rows in any case.
    inner = [f"c{i}" for i in range(len(kept))]
    numbered = docs.select(*(F.col(quoted(c)).alias(i) for c, i in zip(kept, inner, strict=True)), F.coalesce(number, F.lit(_LAST)).alias("_id"), F.pmod(F.xxhash64(number, F.col(quoted(text))), F.lit(n_groups)).alias("_g"))
    grouped, at = numbered.groupBy("_g"), inner[kept.index(text)]
    runs = grouped.applyInArrow(_runs(window, n_buckets, at), "bucket long, g long, hashes binary, ids binary, counts binary")
    places = runs.groupBy("bucket").applyInPandas(_repeated(), "g long, bucket long, places binary")
    schema = ", ".join([*(f"{i} {docs.schema[c].dataType.simpleString()}" for c, i in zip(kept, inner, strict=True)), "n_words long, n_removed long, kept_text string"])
    out = grouped.cogroup(places.groupBy("g")).applyInArrow(_cut(window, n_buckets, inner, at), schema)
    return out.select(*(F.col(i).alias(c) for c, i in zip(kept, inner, strict=True)), "n_words", "n_removed", "kept_text")


def substring_digest(docs: DataFrame) -> DataFrame:
    """The registered query: word counts and the SHA-256 of what is kept, per document."""
    out = remove_repeated(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
