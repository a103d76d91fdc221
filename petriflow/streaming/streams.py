"""Streams: vectors in and out of a versioned table, chains verified as they arrive in any order, rounds averaged once enough clients sent theirs.

State lies in the RocksDB store in small entries (one a client, one for early blocks of 128 indices), so neither a long chain nor a round of many clients
is ever read whole; `state_store` sets the store for the queries started inside it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from petriflow.functions.lineage import remove
from petriflow.operators.audit import SCHEMA, block_hash
from petriflow.operators.vectors import split_batch

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB, as `verify_stream` and `average_rounds` need; the session's own choice comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


# --- vectors: a log of writes by epoch, and snapshots that take in the log up to a version


def ingest_vectors(stream: DataFrame, dim: int, table: str, audit: str, checkpoint: str, available_now: bool = True, chain: str = "vectors", compact_every: int = 0):
    """Each micro-batch: writes of rows of the right length and deletes go to the log of ``table``, and one block with the batch's counts goes to the hash
    chain under ``audit``, linked to the block before, so that `verify_chain` accepts it.

    Rows carry id and values; one with ``deleted`` true is a tombstone and needs no values; ``seq``, if given, is the writer's order of writes, else the
    batch's number is. A batch that is run again overwrites its own folders, so it counts once and makes the same block but for its time, which is
    the stream's batch number. Every ``compact_every`` batches the log goes into a snapshot (0: never; see `compact_vectors`).
    """
    stream = stream if "deleted" in stream.columns else stream.withColumn("deleted", F.lit(False))

    def store(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("deleted", F.coalesce("deleted", F.lit(False))).persist()
        gone = batch.where("deleted").withColumn("values", F.lit(None).cast(batch.schema["values"].dataType))
        good, bad = split_batch(batch.where("NOT deleted"), dim)
        rows = good.unionByName(gone)
        if "seq" not in rows.columns:
            rows = rows.withColumn("seq", F.lit(epoch).cast("long"))
        rows.write.mode("overwrite").parquet(f"{table}/epoch={epoch}")
        accepted, rejected, deleted = good.count(), bad.count(), gone.count()
        batch.unpersist()
        before = None if epoch == 0 else spark.read.schema(SCHEMA).json(f"{audit}/epoch={epoch - 1}").orderBy(F.desc("index")).first()
        said = f"accepted={accepted} rejected={rejected}" + f" deleted={deleted}" * (deleted > 0)
        row = (chain, epoch, str(epoch), "Insert", said, "0" if before is None else before["hash"], 0)
        block = spark.createDataFrame([row], "chain_id string, index long, ts string, operation string, details string, prev_hash string, nonce int")
        block.withColumn("hash", block_hash()).select(*(c.split()[0] for c in SCHEMA.split(", "))).write.mode("overwrite").json(f"{audit}/epoch={epoch}")
        if compact_every and (epoch + 1) % compact_every == 0:
            compact_vectors(spark, table)

    w = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def _names(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the folders ``prefix=number`` in a folder of any file system that Spark reaches."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listStatus(hadoop) if fs.exists(hadoop) else []
    return sorted(int(f.getPath().getName()[len(prefix) + 1 :]) for f in found if f.getPath().getName().startswith(f"{prefix}="))


def _version(spark: SparkSession, table: str) -> tuple[int, int]:
    """(last snapshot, writes that it and those before it took in); a snapshot counts once its own note of these is written."""
    for v in reversed(_names(spark, f"{table}/_notes", "version")):
        note = spark.read.schema("inserted long").json(f"{table}/_notes/version={v}").first()
        if note is not None:
            return v, note.inserted
    return -1, 0


def _log(spark: SparkSession, table: str, after: int) -> DataFrame | None:
    epochs = [e for e in _names(spark, table, "epoch") if e > after]
    return spark.read.option("basePath", table).parquet(*(f"{table}/epoch={e}" for e in epochs)) if epochs else None


def _last_writes(rows: DataFrame, key: str) -> DataFrame:
    """The last write of each key, tombstones among them; of equal ``seq`` the later epoch."""
    order = Window.partitionBy(key).orderBy(F.desc("seq"), F.desc("epoch"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _current(spark: SparkSession, table: str, key: str) -> DataFrame:
    version, _ = _version(spark, table)
    log = _log(spark, table, version)
    if version < 0:
        if log is None:
            raise ValueError(f"no vectors in {table}")
        return _last_writes(log, key)
    held = spark.read.parquet(f"{table}/_snapshots/version={version}")
    return held if log is None else _last_writes(held.unionByName(log, allowMissingColumns=True), key)


def read_vectors(spark: SparkSession, table: str, key: str = "id") -> DataFrame:
    """The table that `ingest_vectors` wrote: the last write of each id that is not a delete, from the last snapshot and the log after it."""
    return _current(spark, table, key).where("NOT deleted").drop("deleted", "epoch")


def total_inserted(spark: SparkSession, table: str) -> int:
    """How many writes the table has ever accepted, those of rows that were deleted or written again included."""
    version, before = _version(spark, table)
    log = _log(spark, table, version)
    return before + (0 if log is None else log.where("NOT deleted").count())


def compact_vectors(spark: SparkSession, table: str, key: str = "id", keep: int = 1) -> int:
    """Takes the log into a new snapshot and returns its version, the log's last epoch. A snapshot's rows keep their seq and tombstones (a late write must not
    bring a row back). The log up to the last ``keep`` earlier versions and the snapshots before them are then removed, so readers of those go on.
    """
    version, inserted = _version(spark, table)
    epochs = [e for e in _names(spark, table, "epoch") if e > version]
    if epochs:
        version, log = epochs[-1], _log(spark, table, version)
        rows = _current(spark, table, key)
        rows.write.mode("overwrite").parquet(f"{table}/_snapshots/version={version}")
        note = spark.createDataFrame([(inserted + log.where("NOT deleted").count(),)], "inserted long")
        note.coalesce(1).write.mode("overwrite").json(f"{table}/_notes/version={version}")
    if version < 0:
        return version
    kept = _names(spark, f"{table}/_snapshots", "version")[-1 - keep :]
    for v in _names(spark, f"{table}/_snapshots", "version"):
        if v < kept[0]:
            remove(spark, f"{table}/_snapshots/version={v}")
            remove(spark, f"{table}/_notes/version={v}")
    for e in _names(spark, table, "epoch"):
        if e <= kept[0]:
            remove(spark, f"{table}/epoch={e}")
    return version


def read_audit(spark: SparkSession, audit: str) -> DataFrame:
    """The chain of blocks that `ingest_vectors` wrote."""
    return spark.read.schema(SCHEMA).json(f"{audit}/epoch=*")


# --- chains


_VERDICT = "chain_id string, index long, hash_ok boolean, link_ok boolean, late boolean"


#: Groups of chains, indices of a chain whose early blocks share an entry of the state, pages that are held at once, and verdicts that go out in one frame.
GROUPS, PAGE, PAGES_HELD, FRAME = 4_096, 128, 64, 10_000


class _Verifier(StatefulProcessor):
    """State of a group of chains: each chain's last judged block, its blocks that came before their turn by page of `PAGE` indices, and when it stops waiting.

    A call on the state is a trip from Python to the JVM and back, so a chain makes a few a batch and a page, and none a block; chains of a group share frames.
    """

    def __init__(self, first: int, wait_ms: int):
        self.first, self.wait_ms = first, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.out = handle, []
        self.heads = handle.getMapState("heads", "chain_id string", "index long, hash string")
        self.early = handle.getMapState("early", "chain_id string, page long", "blocks string")  # JSON of [index, [prev_hash, hash, own]]
        self.due = handle.getMapState("due", "time long, chain_id string", "waits boolean")

    def _begin(self, chain: str) -> None:
        held = self.heads.getValue((chain,))
        self.chain, self.last = chain, None if held is None else (int(held[0]), held[1])
        self.pages: dict[int, dict] = {}
        self.stored, self.changed, self.moved = set(), set(), False

    def _end(self) -> None:
        self._store()
        if self.moved:
            self.heads.updateValue((self.chain,), self.last)

    def _page(self, page: int) -> dict:
        """The early blocks of a page by index."""
        if page not in self.pages:
            if len(self.pages) >= PAGES_HELD:
                self._store()
            text = self.early.getValue((self.chain, page))
            self.pages[page] = {} if text is None else dict(json.loads(text[0]))
            if text is not None:
                self.stored.add(page)
        return self.pages[page]

    def _store(self) -> None:
        """Writes the changed pages, and holds none any more."""
        for page in self.changed:
            if self.pages[page]:
                self.early.updateValue((self.chain, page), (json.dumps(list(self.pages[page].items())),))
            elif page in self.stored:
                self.early.removeKey((self.chain, page))
        self.pages, self.stored, self.changed = {}, set(), set()

    def _turn(self) -> int:
        return self.first if self.last is None else self.last[0] + 1

    def _judge(self, index: int, prev: str, digest: str, own: bool) -> None:
        """A verdict for a block; ``last`` is the one before it, None at the chain's start."""
        last = self.last
        linked = last is None if index == self.first else last is not None and index == last[0] + 1 and prev == last[1]
        self.out.append((self.chain, index, own, linked, False))
        self.last, self.moved = (index, digest), True

    def _told(self, least: int) -> Iterator[pd.DataFrame]:
        """The verdicts so far in a frame, if there are as many."""
        if len(self.out) >= least:
            yield pd.DataFrame(self.out, columns=["chain_id", "index", "hash_ok", "link_ok", "late"])
            self.out = []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms if self.wait_ms >= 0 else None
        timer = False
        for frame in rows:
            blocks = zip(*(frame[c].tolist() for c in ("chain_id", "index", "prev_hash", "hash", "own")), strict=True)
            for chain, part in groupby(sorted(blocks, key=lambda b: (b[0] is None, b[0] or "", b[1])), key=lambda b: b[0]):
                self._begin(chain)
                early = 0
                for _, index, *block in part:
                    turn, page = self._turn(), index // PAGE
                    if index == turn:
                        self._judge(index, *block)
                        while held := self._page(self._turn() // PAGE).pop(self._turn(), None):
                            self.changed.add(self._turn() // PAGE)
                            self._judge(self._turn(), *held)
                            early -= 1
                            yield from self._told(FRAME)
                    elif index < turn or index in self._page(page):
                        self.out.append((chain, index, block[2], False, True))
                    else:
                        self._page(page)[index] = block
                        self.changed.add(page)
                        early += 1
                    yield from self._told(FRAME)
                self._end()
                if early > 0 and due is not None:
                    self.due.updateValue((due, chain), (True,))
                    timer = True
        if timer:
            self.handle.registerTimer(due)
        yield from self._told(1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Judges all early blocks of the chains whose wait is over, in order though something before them is missing; pages are read one by one."""
        over = [k for k in self.due.keys() if k[0] <= expiredTimerInfo.getExpiryTimeInMs()]
        chains = {k[1] for k in over}
        pages = sorted(((k[0], k[1]) for k in self.early.keys() if k[0] in chains), key=lambda k: (k[0] is None, k[0] or "", k[1]))
        for chain, part in groupby(pages, key=lambda k: k[0]):
            self._begin(chain)
            for _, page in part:
                blocks = self._page(page)
                for index in sorted(blocks):
                    self._judge(index, *blocks.pop(index))
                    yield from self._told(FRAME)
                self.changed.add(page)
                self._store()
            self._end()
        for k in over:
            self.due.removeKey(tuple(k))
        yield from self._told(1)

    def close(self) -> None:
        pass


def verify_stream(blocks: DataFrame, first_index: int = 0, wait: str | None = "1 hour") -> DataFrame:
    """A verdict for each arriving block, in any order of arrival: one that comes before its turn waits in the state until those before it are
    there, and is judged then. A block whose index was judged, or waits already, is late and changes nothing.

    If blocks are missing for ``wait`` (a processing time; None: for ever), those that wait are judged in order, the first of them and any after a further
    gap as not linked. ``first_index`` is the index of a chain's first block. Start it inside `state_store`. A query with a ``wait`` runs until it is
    stopped, as any with timers of processing time; one without ends when its files do (``availableNow``).
    """
    ready = blocks.withColumn("own", F.coalesce(F.col("hash") == block_hash(), F.lit(False))).select("chain_id", "index", "prev_hash", "hash", "own")
    wait_ms = -1 if wait is None else int(pd.Timedelta(wait).total_seconds() * 1000)
    grouped = ready.withColumn("group", F.pmod(F.xxhash64("chain_id"), F.lit(GROUPS)).cast("int")).groupBy("group")
    return grouped.transformWithStateInPandas(_Verifier(first_index, wait_ms), _VERDICT, "Append", "None" if wait is None else "ProcessingTime")


# --- rounds


_ROUND = "exp string, round int, n_clients int, n_samples long, value array<double>"


class _Averager(StatefulProcessor):
    """State of a round: whether it is closed, the number of its clients, and one entry a client."""

    def __init__(self, min_clients: int, wait_ms: int):
        self.min_clients, self.wait_ms = min_clients, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "n int")  # clients so far; -1 once closed
        self.clients = handle.getMapState("clients", "client string", "n long, value array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.wait_ms >= 0:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        held = self.done.get()[0] if self.done.exists() else 0
        for frame in rows:
            for u in frame.itertuples(index=False):
                if held >= 0:
                    held += not self.clients.containsKey((u.client,))
                    self.clients.updateValue((u.client,), (int(u.n_samples), [float(x) for x in u.value]))
        if held >= self.min_clients:
            total, samples = 0.0, 0
            for n, value in self.clients.values():  # one client at a time
                total, samples = total + n * np.array(value, float), samples + n
            yield pd.DataFrame({"exp": [key[0]], "round": [int(key[1])], "n_clients": [held], "n_samples": [samples], "value": [(total / samples).tolist()]})
            self.clients.clear()
            held = -1
        self.done.update((held,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.done.clear()
        self.clients.clear()
        return iter(())

    def close(self) -> None:
        pass


def average_rounds(updates: DataFrame, min_clients: int, forget_after: str | None = "1 hour") -> DataFrame:
    """Updates (exp, round, client, n_samples, value array<double>) to the sample-weighted mean of a round, once ``min_clients`` sent one.

    A client's later update replaces its earlier one while the round is open; updates of a closed round are not accepted. A closed round keeps
    no values, and any round that has heard nothing for ``forget_after`` leaves the state (None: never; then a query over files ends with them). Start it
    inside `state_store`.
    """
    wait = -1 if forget_after is None else int(pd.Timedelta(forget_after).total_seconds() * 1000)
    return updates.groupBy("exp", "round").transformWithStateInPandas(_Averager(min_clients, wait), _ROUND, "Append", "None" if forget_after is None else "ProcessingTime")
