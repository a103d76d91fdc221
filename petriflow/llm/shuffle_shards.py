"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt to buckets by their key. How many rows each bucket sends to each shard is drawn exactly (a multivariate
hypergeometric row per bucket, given what the buckets before it used up), so the counts are those of a uniformly random
permutation. Each bucket is then permuted by itself and cut at those counts, and each shard is permuted again. Every
random choice is a seeded hash or a seeded draw on the driver: a task that runs again makes the same rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petriflow.llm import textvec as tv

#: Rows of a bucket, about, and the most buckets (the matrix has buckets x shards numbers and is broadcast).
BUCKET_ROWS, MOST_BUCKETS = 20_000, 16_384


def communication_matrix(rows: np.ndarray, shards: np.ndarray, seed: int) -> np.ndarray:
    """Counts from each source to each shard: row sums ``rows``, column sums ``shards``, distributed as under a uniform permutation."""
    if rows.sum() != shards.sum():
        raise ValueError("sources and shards must hold the same number of rows")
    draw, left = np.random.default_rng(seed), shards.astype(np.int64).copy()
    out = np.zeros((len(rows), len(shards)), np.int64)
    for i, n in enumerate(rows.tolist()):
        # The marginals method needs no memory of the population's size.
        out[i] = draw.multivariate_hypergeometric(left, n, method="marginals") if n else 0
        left -= out[i]
    return out


def _bucket(key: list[str], n: int, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(n)).cast("int")


def shuffle_shards(df: DataFrame, n_shards: int, key: list[str], seed: int = 7, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with shard (int, 0 to n_shards-1) and slot (long, gapless from 0 in each shard), in uniformly random order.

    Shard sizes differ by one at most; the first shards hold the larger ones. ``key`` names columns that tell rows apart; every choice is by
    the key and a hash of the whole row, so rows of one key are spread like any others, and only rows alike in every column share a bucket
    and may swap places between runs. An empty table gives no rows; null keys are keys like any other. Columns named shard or slot are
    replaced, all others kept, whatever their names.
    """
    own = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    inner = {c: f"c{i}" for i, c in enumerate(own)}
    df = df.select(*(F.col(tv.quoted(c)).alias(i) for c, i in inner.items()))
    key = [inner[k] for k in key] + ["_row"]
    df = df.withColumn("_row", F.xxhash64(*inner.values()))
    spark = df.sparkSession
    total = df.count()
    n_buckets = int(min(MOST_BUCKETS, max(1, total // bucket_rows + 1)))
    per = {r["_bucket"]: r["count"] for r in df.select(_bucket(key, n_buckets, seed).alias("_bucket")).groupBy("_bucket").count().collect()}
    rows = np.array([per.get(b, 0) for b in range(n_buckets)], np.int64)
    sizes = np.full(n_shards, rows.sum() // n_shards, np.int64)
    sizes[: rows.sum() % n_shards] += 1
    cuts = np.cumsum(communication_matrix(rows, sizes, seed), axis=1)
    matrix = spark.createDataFrame([(b, [int(x) for x in row[:-1]]) for b, row in enumerate(cuts)], "_bucket int, _cuts array<long>")

    named = df.withColumn("_bucket", _bucket(key, n_buckets, seed))
    local = Window.partitionBy("_bucket").orderBy(F.xxhash64(F.lit(seed + 1), *key), "_row")
    ranked = named.withColumn("_first", F.row_number().over(local) - 1)
    dealt = ranked.join(F.broadcast(matrix), "_bucket")  # MOST_BUCKETS x n_shards numbers at most
    dealt = dealt.withColumn("shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_first"))).cast("int"))

    # The second permutation: a shard's rows fall by hash into sub-buckets, whose sizes give the offsets of their slots.
    n_subs = int(max(1, total // n_shards // bucket_rows + 1))
    dealt = dealt.withColumn("_sub", F.pmod(F.xxhash64(F.lit(seed + 2), *key), F.lit(n_subs)).cast("int"))
    counts = dealt.groupBy("shard", "_sub").agg(F.count("*").alias("n"))
    before = counts.withColumn("_before", F.sum("n").over(Window.partitionBy("shard").orderBy("_sub")) - F.col("n")).drop("n")
    again = Window.partitionBy("shard", "_sub").orderBy(F.xxhash64(F.lit(seed + 3), *key), "_row")
    placed = dealt.withColumn("_second", F.row_number().over(again) - 1).join(before, ["shard", "_sub"])
    return placed.select(*(F.col(i).alias(c) for c, i in inner.items()), "shard", (F.col("_before") + F.col("_second")).cast("long").alias("slot"))


def shard_digest(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """The registered query: whole documents are put into shards, and the digest is made of what arrives there. Law ``rows``, so
    counts are one apart at most and no row says where it goes with a shard more."""
    out = shuffle_shards(docs.select("doc_id", "text"), n_shards, ["doc_id"])
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    return out.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
