"""Averaging model parameters over clients. Parameters are a long table (exp, round, client, param, pos, value, is_int)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["exp", "round"]


def fedavg(params: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(exp, round, param, pos, value): the weighted mean over clients (equal weights without a table); integer parameters come from the first client.

    Weights (exp, round, client, weight) are one row a client and round; values are summed on the map side first.
    """
    if weights is None:
        p = params.withColumn("weight", F.lit(1.0))
    else:
        p = params.join(weights.select(*KEYS, "client", "weight"), [*KEYS, "client"])
    g = p.groupBy(*KEYS, "param", "pos").agg(F.max("is_int").alias("is_int"), F.sum(F.col("weight") * F.col("value")).alias("_s"), F.sum("weight").alias("_w"), F.avg("value").alias("_m"), F.min_by("value", "client").alias("_f"))
    return g.select(*KEYS, "param", "pos", F.when(F.col("is_int"), F.col("_f")).when(F.col("_w") > 0, F.col("_s") / F.col("_w")).otherwise(F.col("_m")).alias("value"))


def quality_weights(stats: DataFrame, metric: str = "map50", warmup: int = 0, warm: str = "equal", floor: float = 0.0) -> DataFrame:
    """(exp, round, client, weight): each client's share of the metric; equal if all are 0. The first ``warmup`` rounds take equal weights or shares of samples."""
    w = Window.partitionBy(*KEYS)
    m = F.greatest(F.col(metric), F.lit(floor))
    share = F.when(F.sum(m).over(w) > 0, m / F.sum(m).over(w)).otherwise(1 / F.count("*").over(w))
    early = 1 / F.count("*").over(w) if warm == "equal" else F.col("n_samples") / F.sum("n_samples").over(w)
    return stats.select(*KEYS, "client", F.when(F.col("round") < warmup, early).otherwise(share).alias("weight"))


def fedprox_pull(params: DataFrame, global_params: DataFrame, mu: float) -> DataFrame:
    """``params`` drawn towards the global values: (1 - mu) * local + mu * global; integer and unmatched parameters stay."""
    g = global_params.select("exp", "param", "pos", F.col("value").alias("_g"))
    j = params.join(g, ["exp", "param", "pos"], "left")
    return j.withColumn("value", F.when(F.col("is_int") | F.col("_g").isNull(), F.col("value")).otherwise((1 - mu) * F.col("value") + mu * F.col("_g"))).select(*params.columns)


#: Strategies by name: (weights by quality, pull towards the global model).
STRATEGIES = {"FedAvg": (False, False), "FedProx": (False, True), "EWA-v2": (True, False), "EWA-FedProx": (True, True)}


def aggregate_round(params: DataFrame, stats: DataFrame, strategy: str, global_params: DataFrame | None = None, mu: float = 0.01, warmup: int = 0) -> DataFrame:
    """One averaging step under a named strategy."""
    by_quality, pull = STRATEGIES[strategy]
    weights = quality_weights(stats, warmup=warmup) if by_quality else stats.select(*KEYS, "client", F.col("n_samples").cast("double").alias("weight"))
    if pull and global_params is not None:
        params = fedprox_pull(params, global_params, mu)
    return fedavg(params, weights)


def node_order(stats: DataFrame, kind: str = "fixed", seed: int = 0, metric: str = "map50") -> DataFrame:
    """(exp, round, client, place): fixed, reversed, random (seeded by round) or quality (last round's metric, best first; the first round fixed)."""
    w = Window.partitionBy(*KEYS)
    s = stats.withColumn("_last", F.lag(metric).over(Window.partitionBy("exp", "client").orderBy("round")))
    order = {"fixed": ["client"], "reversed": [F.desc("client")], "random": [F.md5(F.concat_ws("|", F.lit(seed), "round", "client"))], "quality": [F.desc(F.coalesce("_last", F.lit(0.0))), "client"]}[kind]
    return s.select(*KEYS, "client", F.row_number().over(w.orderBy(*order)).alias("place"))


def sequential_gate(stats: DataFrame, order: DataFrame, kind: str = "none", margin: float = 0.0, warmup: int = 2, metric: str = "map50", measured: DataFrame | None = None, n_nodes: int = 3) -> DataFrame:
    """(exp, round, source_round, client, weight): what each update weighs in the global model after a round, nodes being folded in one by one.

    none: the running mean weighted by samples. hard: an update replaces the model if its signal exceeds the cached one by ``margin``, and is cached.
    soft: as none in the first ``warmup`` rounds, then weighted by signal against the cache, which becomes the weighted mean. local: every node keeps its
    best update (by ``margin``), and the model is their mean once ``n_nodes`` have one. ``measured`` (exp, round, signal) resets the cache after a round.
    The fold is over one number an update; the parameters themselves are averaged with these weights by `gated_average`.
    """

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        rows, model, count, cache = [], {}, 0.0, 0.0
        best: dict[str, tuple[float, int]] = {}
        for place, (r, g) in enumerate(p.sort_values(["round", "place"]).groupby("round", sort=True)):
            for c, s, n in zip(g.client, g.signal, g.n_samples, strict=True):
                if kind == "local":
                    if c not in best or s > best[c][0] + margin:
                        best[c] = (s, int(r))
                    if len(best) == n_nodes:
                        model = {(at, k): 1 / n_nodes for k, (_, at) in best.items()}
                    continue
                if not model:
                    share, count = 1.0, n
                    cache = s if kind == "hard" else cache
                elif kind == "hard":
                    share = float(s > cache + margin)
                    cache = s if share else cache
                elif kind == "none" or place < warmup:
                    share = n / (n + count)
                    count += n
                else:
                    share = max(s, 1e-8) / (max(s, 1e-8) + max(cache, 1e-8))
                    cache = share * s + (1 - share) * cache
                model = {k: w * (1 - share) for k, w in model.items() if w * (1 - share) > 0}
                if share:
                    model[int(r), c] = model.get((int(r), c), 0.0) + share
            known = g.measured.dropna()
            cache = float(known.iloc[0]) if len(known) else cache
            rows += [(p.exp.iloc[0], int(r), at, c, w) for (at, c), w in sorted(model.items())]
        return pd.DataFrame(rows, columns=["exp", "round", "source_round", "client", "weight"])

    s = stats.select(*KEYS, "client", F.col(metric).cast("double").alias("signal"), F.col("n_samples").cast("double").alias("n_samples")).join(order, [*KEYS, "client"])
    s = s.withColumn("measured", F.lit(None).cast("double")) if measured is None else s.join(measured.select(*KEYS, F.col("signal").alias("measured")), KEYS, "left")  # a row a round
    return s.groupBy("exp").applyInPandas(fold, "exp string, round int, source_round int, client string, weight double")


def gated_average(params: DataFrame, weights: DataFrame) -> DataFrame:
    """(exp, round, param, pos, value): the global model after each round from the weights of `sequential_gate`; integer parameters come from the heaviest update."""
    w = weights.select("exp", F.col("round").alias("_target"), F.col("source_round").alias("round"), "client", "weight")  # a row an update and round
    g = params.join(w, ["exp", "round", "client"]).groupBy("exp", "_target", "param", "pos").agg(F.max("is_int").alias("is_int"), F.sum(F.col("weight") * F.col("value")).alias("_s"), F.max_by("value", F.struct("weight", "client")).alias("_f"))
    return g.select("exp", F.col("_target").alias("round"), "param", "pos", F.when(F.col("is_int"), F.col("_f")).otherwise(F.col("_s")).alias("value"))


def federated_rounds(rows: DataFrame, features: list[str], label: str, client: str, n_classes: int, rounds: int = 3, steps: int = 20, rate: float = 0.5) -> DataFrame:
    """(round, accuracy, loss, n_clients): softmax regression fitted at every client from the global model, averaged by samples, round after round.

    Every step sums each client's gradient over the partitions that hold its rows, so no client is ever gathered; parameters (features x
    classes a client) come to the driver, and history rows go out.
    """
    shape = (len(features) + 1, n_classes)
    model, history = np.zeros(shape), []
    data = rows.select(F.col(client).cast("string").alias("client"), F.col(label).cast("int").alias("y"), F.array(*(F.col(f).cast("double") for f in features)).alias("x")).persist()
    sizes = {r["client"]: r["n"] for r in data.groupBy("client").agg(F.count("*").alias("n")).collect()}  # a row a client
    total = sum(sizes.values())

    def predict(m: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = np.c_[x, np.ones(len(x))] @ m
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradients(models: dict[str, np.ndarray]) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = {c: np.zeros(shape) for c in models}
            for p in frames:
                for c, g in p.groupby("client"):
                    x = np.array(g.x.tolist())
                    sums[c] += np.c_[x, np.ones(len(x))].T @ (predict(models[c], x) - np.eye(n_classes)[g.y.to_numpy()])
            for c, g in sums.items():
                yield pd.DataFrame({"client": c, "at": np.arange(g.size), "g": g.ravel()})

        return data.mapInPandas(run, "client string, at int, g double").groupBy("client", "at").agg(F.sum("g").alias("g"))

    def scored(now: np.ndarray) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in frames:
                if len(p):
                    q, y = predict(now, np.array(p.x.tolist())), p.y.to_numpy()
                    yield pd.DataFrame({"right": [int((q.argmax(1) == y).sum())], "loss": [float(-np.log(np.maximum(q[np.arange(len(y)), y], 1e-12)).sum())]})

        return data.mapInPandas(run, "right long, loss double").agg(F.sum("right").alias("right"), F.sum("loss").alias("loss"))

    for r in range(1, rounds + 1):
        models = {c: model.copy() for c in sizes}
        for _ in range(steps):
            got = gradients(models).toPandas()
            for c, g in got.groupby("client"):
                step = np.zeros(model.size)
                step[g["at"].to_numpy()] = g.g.to_numpy()
                models[c] -= rate * step.reshape(shape) / sizes[c]
        model = sum(models[c] * (n / total) for c, n in sorted(sizes.items())) if sizes else model
        s = scored(model).first()
        history.append((r, (s.right or 0) / max(total, 1), (s.loss or 0.0) / max(total, 1), len(sizes)))
    data.unpersist()
    return rows.sparkSession.createDataFrame(history, "round int, accuracy double, loss double, n_clients int")
