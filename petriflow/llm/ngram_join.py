"""N-gram Jaccard self-join: MinHash bands find candidates, full n-gram sets decide.

Texts with the same n-gram set are first folded into one representative, so a group of copies costs one row however large it
is. Representatives meet in band buckets as stars (member, least member), never as pairs; the connected candidates are cut
into blocks of bounded size, and each pair of blocks of one component is compared in one task as a product of incidence
matrices. Such a task hands on counts and a spanning forest of the links, so no row is made for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petriflow.functions.graph import components
from petriflow.functions.lineage import checkpointed
from petriflow.llm import textvec as tv
from petriflow.llm.textvec import quoted

NGRAM, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
#: Documents and n-grams of one block, about; columns of the incidence matrix at a time.
BLOCK_DOCS, BLOCK_GRAMS, COLUMNS = 256, 1_000_000, 4_096
_LAST = (1 << 63) - 1


def bands_for(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest bands that still find a pair of similarity ``threshold`` with probability ``recall``."""
    for rows in range(most, 0, -1):
        bands = most // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            need = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
            return min(max(need, 1), bands), rows
    raise ValueError(f"{most} hashes can't reach recall {recall} at similarity {threshold}")


def gram_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct ``k``-grams of each text, sorted; a text of fewer words, but not none, is one gram."""
    starts, ends, text = tv.words(data, offsets, tv.SPACED)
    h = tv.word_hashes(data, starts, ends)
    at, grams = tv.windows(h, text, k)
    owner = text[at]
    for size in range(1, k):
        at, short = tv.windows(h, text, size)
        whole = np.flatnonzero(tv.per_text(text, len(offsets) - 1)[text[at]] == size)
        owner, grams = np.concatenate([owner, text[at][whole]]), np.concatenate([grams, short[whole]])
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    return owner[new], grams[new]


def _signatures(k: int, bands: int, rows: int, seed: int = 1):
    seeds = tv.mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(2 * seed + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("id"), batch.column("key")
            for row, data, offsets in tv.blocks(batch.column("text")):
                n = len(offsets) - 1
                owner, grams = gram_sets(data, offsets, k)
                size = tv.per_text(owner, n)
                some = np.flatnonzero(size)
                cuts = (np.cumsum(size) - size)[some]
                set_a, set_b, out = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, bands), np.uint64)
                if len(some):
                    set_a[some] = np.add.reduceat(tv.mix(grams), cuts).view(np.int64)
                    set_b[some] = np.add.reduceat(tv.mix(grams ^ np.uint64(0x2545F4914F6CDD1D)), cuts).view(np.int64)
                    for b in range(bands):
                        band = np.full(len(some), b + 1, np.uint64)
                        for s in seeds[b * rows : (b + 1) * rows]:
                            x = (grams ^ s) * np.uint64(0x9E3779B97F4A7C15)
                            band = tv.mix(band ^ np.minimum.reduceat(x ^ (x >> np.uint64(32)), cuts)) + np.uint64(b)
                        out[some, b] = band
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), pa.array(out.view(np.int64).ravel()))
                part = slice(row, row + n)
                yield pa.RecordBatch.from_arrays([ids[part], keys[part], pa.array(set_a), pa.array(set_b), pa.array(size), lists], ["id", "key", "set_a", "set_b", "n_grams", "bands"])

    return run


def _links(k: int, threshold: float):
    """One group of (node, comp, side, copies, lo, hi, text): links within block lo where it is hi too, else between the two blocks (none if one has no node)."""

    def compare(part: pd.DataFrame) -> list[tuple]:
        part = part.drop_duplicates("node").reset_index(drop=True)
        n, across = len(part), bool(0 <= part.lo[0] != part.hi[0])  # lo is -1 for a component of one block
        side = part.side.to_numpy()
        if across and (side == side[0]).all():
            return []  # block (b, b) compares these
        owners, sets, base = [], [], 0
        for row, data, offsets in tv.blocks(pa.array(part.text, pa.large_string())):
            owner, grams = gram_sets(data, offsets, k)
            owners.append(owner + row)
            sets.append(grams)
            base += len(offsets) - 1
        owner, grams = np.concatenate(owners), np.concatenate(sets)
        size = np.bincount(owner, minlength=n).astype(np.float64)
        _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        both = np.zeros((n, n), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, [low, low + COLUMNS])
            x = np.zeros((n, min(COLUMNS, int(column[b - 1]) - low + 1)), np.float32)
            x[owner[a:b], column[a:b] - low] = 1
            both += x @ x.T
        hit = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
        np.fill_diagonal(hit, False)
        if across:
            hit &= side[:, None] != side[None, :]
        copies, node = part.copies.to_numpy(), part.node.to_numpy()
        docs, texts = hit @ copies, hit.sum(1)
        rows = [(int(node[i]), None, int(docs[i]), int(texts[i])) for i in np.flatnonzero(texts)]
        parent = list(range(n))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, j in np.argwhere(np.triu(hit)):
            if (p := root(int(i))) != (q := root(int(j))):
                parent[max(p, q)] = min(p, q)
                rows.append((int(node[i]), int(node[j]), 0, 0))
        return rows

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = [r for _, part in group.groupby("comp", sort=False) if len(part) > 1 for r in compare(part)]
        return pd.DataFrame({"u": pd.array([r[0] for r in rows], "Int64"), "v": pd.array([r[1] for r in rows], "Int64"), "docs": np.array([r[2] for r in rows], np.int64), "texts": np.array([r[3] for r in rows], np.int64)})

    return run


def _labelled(docs: DataFrame, doc_id: str, text: str, ngram: int, threshold: float, recall: float) -> DataFrame:
    """(id, rid, key, row, n_grams, c, class_id, copy_of, copies, docs, texts) of every row. row: a number of its own; rid: the id, or the
    largest number for null; key: hash of the text; c: a number of the class (null without words)."""
    bands, rows = bands_for(threshold, recall)
    number = F.col(quoted(doc_id)).cast("long")
    base = docs.select(number.alias("id"), F.xxhash64(F.col(quoted(text))).alias("key"), F.col(quoted(text)).alias("text"))
    signed = base.mapInArrow(_signatures(ngram, bands, rows), "id long, key long, set_a long, set_b long, n_grams long, bands array<long>")
    signed = checkpointed(signed.withColumns({"rid": F.coalesce("id", F.lit(_LAST)), "row": F.monotonically_increasing_id()}))
    # A node is the row that stands for an n-gram set, so rows with equal ids and other texts stay apart.
    sets = signed.where("n_grams > 0").groupBy("set_a", "set_b").agg(F.min("row").alias("node"), F.min("id").alias("least"), F.count("*").alias("copies"))
    sets = checkpointed(sets)
    reps = signed.join(sets.select(F.col("node").alias("row"), "copies"), "row").select(F.col("row").alias("node"), "rid", "key", "copies", "n_grams", "bands")
    banded = reps.select("node", F.explode("bands").alias("band"))
    lead = banded.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last")
    stars = checkpointed(banded.join(lead, "band").where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v")).distinct())
    member = components(stars).select(F.col("id").alias("node"), "component").join(reps.drop("bands"), "node")
    member = checkpointed(member.select("node", "component", "rid", "key", "copies", "n_grams"))
    share = member.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("k"), F.sum("n_grams").alias("size"))
    packs = int((share.where("k = 1").agg(F.sum("size").alias("n")).first().n or 0) // (BLOCK_GRAMS // 4) + 1)
    blocked = member.join(share.select("component", "k"), "component").withColumn("b", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    placed = blocked.select("node", "rid", "key", "copies", "component", "b", F.explode(F.expr("if(k = 1, array(-1), sequence(0, k - 1))")).alias("other"))
    placed = placed.select("node", "rid", "key", "copies", F.col("component").alias("comp"), F.when(F.col("other") >= 0, F.col("b")).otherwise(0).alias("side"), F.when(F.col("other") < 0, F.pmod(F.xxhash64("component"), F.lit(packs))).otherwise(F.col("component")).alias("g"), F.least("b", "other").alias("lo"), F.greatest("b", "other").alias("hi"))
    texts = base.select(F.coalesce("id", F.lit(_LAST)).alias("rid"), "key", "text")
    # Rows alike in id and text have one node's text more than once.
    full = placed.join(texts, ["rid", "key"]).dropDuplicates(["rid", "key", "node", "g", "lo", "hi"]).drop("rid", "key")
    found = checkpointed(full.groupBy("g", "lo", "hi").applyInPandas(_links(ngram, threshold), "u long, v long, docs long, texts long"))
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    classes = components(found.where("v is not null").select("u", "v")).select(F.col("id").alias("node"), F.col("component").alias("c"))
    leasts = classes.join(sets.select("node", "least"), "node").groupBy("c").agg(F.min("least").alias("class_id"))
    known = sets.join(counts, "node", "left").join(classes, "node", "left").join(leasts, "c", "left")
    known = known.select("set_a", "set_b", F.coalesce("c", "node").alias("c"), F.when(F.col("c").isNull(), F.col("least")).otherwise(F.col("class_id")).alias("class_id"), "least", "copies", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("texts", F.lit(0)).alias("texts"))
    out = signed.select("id", "rid", "key", "row", "n_grams", F.when(F.col("n_grams") > 0, F.col("set_a")).alias("set_a"), "set_b").join(known, ["set_a", "set_b"], "left")
    own = lambda c: F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col(c))
    return out.select("id", "rid", "key", "row", "n_grams", "c", own("class_id").alias("class_id"), own("least").alias("copy_of"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.coalesce("docs", F.lit(0)).cast("long").alias("docs"), F.coalesce("texts", F.lit(0)).cast("long").alias("texts"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ngram: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, copy_of, n_copies, n_links, n_linked_texts), one row per row of ``docs``.

    Similarity is Jaccard over the sets of ``ngram`` consecutive words (runs of anything but ASCII white space; a text of fewer words
    is one gram). copy_of: the least id with the same set; class_id: the least id that links reach from here; n_copies: rows
    with the same set, this one included; n_links: other rows of similarity ``threshold`` or more, copies included;
    n_linked_texts: representatives among them other than one's own. Null texts and texts without words link to nothing. Every row
    is judged by its own text, whatever its id: repeated rows are copies of one another, and rows of one id with other texts are not
    brought together by it. Rows without an id link like any other; a class in which no row has one has a null class_id. Other columns
    of ``docs`` are not read. A text of n bytes costs about 60 n bytes of memory.
    """
    out = _labelled(docs, doc_id, text, ngram, threshold, recall)
    return out.select(F.col("id").alias(doc_id), "class_id", "copy_of", F.col("copies").alias("n_copies"), (F.col("copies") - 1 + F.col("docs")).alias("n_links"), F.col("texts").alias("n_linked_texts"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate class: one of the least id (null ids last). Rows without words all stay.

    Any other columns are kept, whatever their names; of rows alike in id and text any one may stand for the class.
    """
    rows = checkpointed(_labelled(docs, doc_id, text, NGRAM, THRESHOLD, RECALL).where("c is not null").select("rid", "key", "row", "c"))
    chosen = rows.groupBy("c").agg(F.min(F.struct("rid", "row")).alias("least")).select(F.col("least.row").alias("row"))
    chosen = checkpointed(rows.join(chosen, "row").select("rid", "key"))
    other = rows.select("rid", "key").distinct().join(chosen, ["rid", "key"], "left_anti")
    twice = rows.join(chosen, ["rid", "key"], "left_semi").groupBy("rid", "key").count().where("count > 1").drop("count")
    number = F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(_LAST))
    named = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("doc"), number.alias("rid"), F.xxhash64(F.col(quoted(text))).alias("key"))
    kept = named.join(other, ["rid", "key"], "left_anti")
    if not twice.isEmpty():
        kept = kept.join(twice, ["rid", "key"], "left_anti").unionByName(kept.join(twice, ["rid", "key"], "left_semi").dropDuplicates(["rid", "key"]))
    return kept.select("doc.*")
