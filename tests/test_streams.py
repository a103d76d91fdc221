"""Streams over files: blocks in any order, rounds of clients, and the versioned table of vectors."""

import os
import random

import pytest
from pyspark.sql import functions as F

from petriflow.operators import audit as A
from petriflow.streaming import streams as T

UPDATE = "exp string, round int, client string, n_samples long, value array<double>"
WRITE = "id long, values array<double>, deleted boolean, seq long"


def run(spark, made, path, name, seconds=None):
    """What a query over files writes; one with timers, which never ends by itself, is stopped after so many seconds."""
    with T.state_store(spark):
        q = made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/k-{name}").option("path", f"{path}/o-{name}").trigger(availableNow=True).start()
    ended = q.awaitTermination(seconds or 120)
    q.stop()
    assert q.exception() is None and ended == (seconds is None)
    return spark.read.parquet(f"{path}/o-{name}").collect() if any(f.endswith(".parquet") for f in os.listdir(f"{path}/o-{name}")) else []


def files(rows, path, schema, spark):
    """A file for each part, one after the other."""
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def chain(spark):
    events = [(c, i, f"2024-01-01T00:00:{i:02d}", "Op", "x") for c in ("a", "b") for i in range(1, 12)]
    return [tuple(r) for r in A.build_chain(spark.createDataFrame(events, "chain_id string, index long, ts string, operation string, details string")).collect()]


def test_blocks_in_any_order_verify(spark, chain, tmp_path):
    random.Random(2).shuffle(chain)
    broken = [(*b[:3], "Changed", *b[4:]) if (b[0], b[1]) == ("b", 4) else b for b in chain]
    parts = [broken[i::4] for i in range(4)] + [[chain[0]]]
    out = run(spark, T.verify_stream(files(parts, str(tmp_path / "b"), A.SCHEMA, spark), wait=None), tmp_path, "v")
    good = [r for r in out if not r.late]
    assert sorted((r.chain_id, r["index"]) for r in good) == sorted((b[0], b[1]) for b in chain) and len(out) == len(good) + 1
    assert all(r.link_ok for r in good) and [(r.chain_id, r["index"]) for r in good if not r.hash_ok] == [("b", 4)]


def test_a_missing_block_is_waited_for(spark, chain, tmp_path):
    some = [b for b in chain if b[0] == "a" and b[1] not in (3, 7)]
    out = run(spark, T.verify_stream(files([some], str(tmp_path / "b"), A.SCHEMA, spark), wait=None), tmp_path, "v")
    assert sorted(r["index"] for r in out) == [0, 1, 2]
    # After a wait of no time the timer of a later batch lets the others go, in order, and tells the two gaps.
    stream = files([some, [b for b in chain if b[:2] == ("b", 0)]], str(tmp_path / "c"), A.SCHEMA, spark)
    out = sorted((r["index"], r.link_ok, r.late) for r in run(spark, T.verify_stream(stream, wait="0 seconds"), tmp_path, "w", 25) if r.chain_id == "a")
    assert out == [(i, i not in (4, 8), False) for i in (0, 1, 2, 4, 5, 6, 8, 9, 10, 11)]


def test_rounds_average_once_enough_clients_sent_theirs(spark, tmp_path):
    parts = [[("e", 1, "a", 1, [1.0, 0.0]), ("e", 2, "a", 1, [9.0, 9.0])], [("e", 1, "a", 3, [2.0, 2.0])], [("e", 1, "b", 1, [6.0, 0.0]), ("f", 1, "a", 2, [0.0, 0.0])], [("e", 1, "c", 9, [100.0, 0.0]), ("f", 1, "b", 2, [1.0, 3.0])]]
    out = run(spark, T.average_rounds(files(parts, str(tmp_path / "u"), UPDATE, spark), 2, None), tmp_path, "r")
    assert sorted((r.exp, r["round"], r.n_clients, r.n_samples, r.value) for r in out) == [("e", 1, 2, 4, [3.0, 1.5]), ("f", 1, 2, 4, [0.5, 1.5])]


@pytest.mark.parametrize("every", [0, 1, 2])
def test_versioned_table_of_vectors(spark, tmp_path, every):
    table = str(tmp_path / "t")
    parts = [
        [(1, [1.0, 1.0], False, 0), (2, [2.0, 2.0], False, 0), (3, [3.0], False, 0)],
        [(2, None, True, 5), (4, [4.0, 4.0], None, 1), (1, [1.5, 1.5], False, 1)],
        [(2, [2.5, 2.5], False, 3), (1, [0.0, 0.0], False, 0)],  # both come late
        [(4, None, True, 2), (5, [5.0, 5.0], False, 2)],
    ]
    for n, part in enumerate(parts):  # each run of the stream takes in one more file
        stream = files([part], str(tmp_path / "in"), WRITE, spark)
        q = T.ingest_vectors(stream, 2, table, str(tmp_path / "a"), str(tmp_path / "c"), compact_every=every)
        assert q.awaitTermination(120) and q.exception() is None
        assert T.total_inserted(spark, table) == [2, 4, 6, 7][n]
    want = {1: [1.5, 1.5], 5: [5.0, 5.0]}
    assert {r.id: r["values"] for r in T.read_vectors(spark, table).collect()} == want
    epochs = [d for d in os.listdir(table) if d.startswith("epoch=")]
    assert len(epochs) == {0: 4, 1: 1, 2: 2}[every]
    T.compact_vectors(spark, table, keep=0)
    assert not [d for d in os.listdir(table) if d.startswith("epoch=")] and len(os.listdir(f"{table}/_snapshots")) == 1
    assert {r.id: r["values"] for r in T.read_vectors(spark, table).collect()} == want and T.total_inserted(spark, table) == 7
    assert T.compact_vectors(spark, table) == 3
    chain = T.read_audit(spark, str(tmp_path / "a"))
    assert [r.details for r in chain.orderBy("index").collect()][1] == "accepted=2 rejected=0 deleted=1"
    assert A.verify_chain(chain).first().valid


def test_no_vectors_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no vectors"):
        T.read_vectors(spark, str(tmp_path))
