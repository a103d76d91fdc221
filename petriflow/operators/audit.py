"""Hash-chained audit logs. Blocks: (chain_id, index, ts, operation, details, prev_hash, hash, nonce); a chain is one node's log."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "chain_id string, index long, ts string, operation string, details string, prev_hash string, hash string, nonce long"


_BLOCK = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (c.split() for c in SCHEMA.split(", "))])


def block_hash() -> Column:
    """SHA-256 of index:timestamp:operation:prev_hash:nonce."""
    return F.sha2(F.concat_ws(":", F.col("index").cast("string"), "ts", "operation", "prev_hash", F.col("nonce").cast("string")), 256)


@F.pandas_udf(T.StringType())
def json_block_hash(index: pd.Series, ts: pd.Series, operation: pd.Series, details: pd.Series, prev: pd.Series) -> pd.Series:
    """SHA-256 of the block's five fields as JSON with sorted keys."""
    return pd.Series([hashlib.sha256(json.dumps({"index": int(i), "timestamp": t, "operation": o, "details": d, "prev_hash": p}, sort_keys=True).encode()).hexdigest() for i, t, o, d, p in zip(index, ts, operation, details, prev, strict=True)])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events by chain and index to blocks; from batch to batch only the chain's last hash is carried."""
    chain, prev = object(), "0"
    for batch in batches:
        rows = []
        for c, i, t, o, d in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if c != chain:
                chain, h = c, hashlib.sha256(f"0:{t}:Genesis:0:0".encode()).hexdigest()
                rows.append((c, 0, t, "Genesis", None, "0", h, 0))
                prev = h
            h = hashlib.sha256(f"{i}:{t}:{o}:{prev}:0".encode()).hexdigest()
            rows.append((c, i, t, o, d, prev, h, 0))
            prev = h
        columns = zip(*rows, strict=True) if rows else ([] for _ in _BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(columns, _BLOCK, strict=True)], schema=_BLOCK)


def build_chain(events: DataFrame) -> DataFrame:
    """Blocks of each chain's events (chain_id, index from 1, ts, operation, details): a genesis block of index 0 and previous hash 0, then one a block,
    linked to the one before. A chain is sequential by definition; a task walks its chains in order, a batch of rows at a time, so a chain of any length
    takes one batch of memory.
    """
    ordered = events.select("chain_id", "index", "ts", "operation", "details").repartition("chain_id").sortWithinPartitions("chain_id", "index")
    return ordered.mapInArrow(_linked, SCHEMA)


def verify_blocks(blocks: DataFrame, check_first: bool = True) -> DataFrame:
    """Blocks with hash_ok, link_ok and ok. The first kept block of a chain has nothing to link to; its own hash is checked on demand."""
    w = Window.partitionBy("chain_id").orderBy("index")
    first = F.row_number().over(w) == 1
    hash_ok = (F.col("hash") == block_hash()) | (first & F.lit(not check_first))
    link_ok = first | (F.col("prev_hash") == F.lag("hash").over(w))
    return blocks.withColumn("hash_ok", hash_ok).withColumn("link_ok", link_ok).withColumn("ok", F.col("hash_ok") & F.col("link_ok"))


def verify_chain(blocks: DataFrame, check_first: bool = True) -> DataFrame:
    """(chain_id, n_blocks, valid, first_bad_index)."""
    v = verify_blocks(blocks, check_first)
    return v.groupBy("chain_id").agg(F.count("*").alias("n_blocks"), F.min("ok").alias("valid"), F.min(F.when(~F.col("ok"), F.col("index"))).alias("first_bad_index"))


def recent(blocks: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest blocks of each chain with place 1 for the newest."""
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy("chain_id").orderBy(F.desc("index")))).where(F.col("place") <= n)


def trail(blocks: DataFrame, limit: int, operation: str | None = None) -> DataFrame:
    """The last ``limit`` blocks of each chain, of one operation on demand, numbered from the oldest."""
    b = blocks if operation is None else blocks.where(F.col("operation") == operation)
    tail = recent(b, limit).drop("place")
    return tail.withColumn("place", F.row_number().over(Window.partitionBy("chain_id").orderBy("index")))


def retain(blocks: DataFrame, max_blocks: int) -> DataFrame:
    """The last ``max_blocks`` of each chain; what is left still verifies from its first block."""
    return recent(blocks, max_blocks).drop("place")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of JSON lines: lines that are none are skipped, and of several genesis blocks of a chain the first is kept."""
    b = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path).where("chain_id is not null and index is not null")
    n = F.row_number().over(Window.partitionBy("chain_id", "index").orderBy("ts", "hash"))
    return b.withColumn("_n", n).where("index > 0 or _n = 1").drop("_n")


def append_json_lines(blocks: DataFrame, path: str) -> None:
    blocks.select(*(c.split()[0] for c in SCHEMA.split(", "))).write.mode("append").json(path)


def audit_stats(blocks: DataFrame) -> DataFrame:
    """(chain_id, length, valid, latest_hash, operations): the latest hash cut to 16 characters, counts by operation as a map."""
    counts = blocks.groupBy("chain_id", "operation").agg(F.count("*").alias("n")).groupBy("chain_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("operation", "n")))).alias("operations"))
    last = blocks.groupBy("chain_id").agg(F.concat(F.substring(F.max_by("hash", "index"), 1, 16), F.lit("...")).alias("latest_hash"))
    return verify_chain(blocks).select("chain_id", F.col("n_blocks").alias("length"), "valid").join(last, "chain_id").join(counts, "chain_id")


def display(blocks: DataFrame) -> DataFrame:
    """Blocks for reading: details cut to 80 characters, hashes to 16."""
    return blocks.withColumns({"details": F.substring("details", 1, 80), "hash": F.substring("hash", 1, 16), "prev_hash": F.substring("prev_hash", 1, 16)})
