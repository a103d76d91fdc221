"""Registered queries that write a given table's rows to files, stream these file by file, and return what the stream has made."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petriflow.functions.lineage import checkpointed, remove, shared_dir
from petriflow.operators import audit as A
from petriflow.operators import vectors as V
from petriflow.plans import standins as S
from petriflow.plans.box_queries import r9
from petriflow.streaming import streams as T

#: Triggers of a stream's input.
TRIGGERS = 3


def _streamed(s: SparkSession, rows: DataFrame, run) -> DataFrame:
    """What ``run(stream, folder)`` returns for rows dealt to the files of `TRIGGERS` triggers by a hash of the row; the folder goes again. A trigger takes as
    many files as keep the cluster's cores busy while they are written."""
    path, each = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}", -(-s.sparkContext.defaultParallelism // TRIGGERS)
    rows.repartition(TRIGGERS * each, F.xxhash64(*rows.columns)).write.parquet(f"{path}/in")
    out = checkpointed(run(s.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(f"{path}/in"), path))
    remove(s, path)
    return out


def _written(s: SparkSession, made: DataFrame, path: str) -> DataFrame:
    with T.state_store(s):
        q = made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(made.schema).parquet(f"{path}/out")


def _writes(s: SparkSession, d: str) -> DataFrame:
    """(id, values, deleted, seq): first writes, second ones of every third id (of every fifteenth too short), deletes of every seventh, and writes of every
    fourteenth that are older than its delete."""
    v = S.vectors(s, d).select("id", "values")
    plus = lambda n: F.transform("values", lambda x: x + n)
    part = lambda rows, values, deleted, seq: rows.select("id", values.alias("values"), F.lit(deleted).alias("deleted"), F.lit(seq).cast("long").alias("seq"))
    second = F.when(F.col("id") % 5 == 0, F.slice("values", 1, 3)).otherwise(plus(1))
    return part(v, F.col("values"), False, 1).union(part(v.where("id % 3 = 0"), second, False, 2)).union(part(v.where("id % 7 = 0"), F.lit(None).cast("array<double>"), True, 3)).union(part(v.where("id % 14 = 0"), plus(2), False, 2))


def _stream_vectors(s: SparkSession, d: str) -> DataFrame:
    def run(stream: DataFrame, path: str) -> DataFrame:
        T.ingest_vectors(stream, 64, f"{path}/table", f"{path}/audit", f"{path}/checkpoint", compact_every=2).awaitTermination()
        chain = A.verify_chain(T.read_audit(s, f"{path}/audit")).select(F.col("valid").alias("audit_valid"))
        live = T.read_vectors(s, f"{path}/table").withColumn("inserted", F.lit(T.total_inserted(s, f"{path}/table")).cast("long"))
        return live.crossJoin(chain)  # one chain

    out = _streamed(s, _writes(s, d), run)
    return out.select("id", "seq", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), "inserted", "audit_valid")


def _stream_verdicts(s: SparkSession, d: str) -> DataFrame:
    """Blocks of all chains in no order, one in fifty changed after it was hashed."""
    blocks = A.build_chain(S.events(s, d)).withColumn("operation", F.when(F.col("index") % 50 == 7, "Changed").otherwise(F.col("operation")))
    return _streamed(s, blocks, lambda stream, path: _written(s, T.verify_stream(stream, wait=None), path))


def _stream_rounds(s: SparkSession, d: str) -> DataFrame:
    p = S.params(s, d).groupBy("exp", "round", "client").agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("m"))  # 40 numbers
    value = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    updates = p.join(S.client_stats(s, d), ["exp", "round", "client"]).select("exp", "round", "client", "n_samples", value.alias("value"))
    out = _streamed(s, updates, lambda stream, path: _written(s, T.average_rounds(stream, 6, None), path))
    return r9(out.select("exp", "round", "n_clients", "n_samples", F.posexplode("value").alias("pos", "mean")), "mean")


def _vector_stats(s: SparkSession, d: str) -> DataFrame:
    """Of the rows that all writes leave, with the writes counted."""
    writes = _writes(s, d)
    upserts = writes.where("NOT deleted")
    kept = V.upsert_vectors(upserts.where("false"), upserts, 64)
    cls = S.vectors(s, d).select("id", "cls")
    left, _ = V.delete_vectors(kept.join(cls, "id"), writes.where("deleted"))
    return V.vector_stats(left, upserts, 64).withColumn("classes", F.to_json("classes"))


_INSERTED = "(SELECT count(*) + count(*) FILTER (WHERE id % 3 = 0 AND id % 5 <> 0) + count(*) FILTER (WHERE id % 14 = 0) FROM vectors)::BIGINT"

QUERIES = {
    "stream_vectors": (
        _stream_vectors,
        f"""WITH {S.VECTORS} SELECT id, CASE WHEN id % 3 = 0 AND id % 5 <> 0 THEN 2 ELSE 1 END::BIGINT AS seq, round(list_sum(values) + CASE WHEN id % 3 = 0 AND id % 5 <> 0 THEN 64 ELSE 0 END, 6) AS total,
{_INSERTED} AS inserted, true AS audit_valid FROM vectors WHERE id % 7 <> 0""",
    ),
    "stream_verdicts": (
        _stream_verdicts,
        f"WITH {S.EVENTS} SELECT chain_id, index::BIGINT AS index, index % 50 <> 7 AS hash_ok, true AS link_ok, false AS late FROM (SELECT chain_id, index FROM ev UNION ALL SELECT DISTINCT chain_id, 0 FROM ev)",
    ),
    "stream_rounds": (
        _stream_rounds,
        f"""WITH {S.PARAMS}, {S.CLIENT_STATS}, c AS (SELECT exp, round, client, n_samples, pos FROM client_stats CROSS JOIN range(40) t(pos))
SELECT exp, round, count(DISTINCT client)::INT AS n_clients, sum(n_samples)::BIGINT AS n_samples, pos::INT AS pos, round(sum(n_samples * coalesce(value, 0)) / sum(n_samples), 9) AS mean FROM c LEFT JOIN params USING (exp, round, client, pos) GROUP BY exp, round, pos""",
    ),
    "vector_stats": (
        _vector_stats,
        f"""WITH {S.VECTORS}, l AS (SELECT * FROM vectors WHERE id % 7 <> 0), c AS (SELECT cls, count(*) AS n FROM l GROUP BY cls)
SELECT (SELECT count(*) FROM l) AS live, (SELECT max(len(values)) FROM l)::INT AS dimension, '[' || string_agg('{{"cls":' || cls || ',"n":' || n || '}}', ',' ORDER BY cls) || ']' AS classes, {_INSERTED} AS total_inserted FROM c""",
    ),
}
