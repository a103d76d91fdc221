"""Keyed vectors: upsert, delete, exact and approximate neighbours, neighbour votes, clusters. Rows carry (id, values array<double>)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petriflow.functions.joins import with_few
from petriflow.functions.lineage import checkpointed
from petriflow.operators.models import dirichlet_mixture
from petriflow.operators.neighbours import CELLS, SAMPLE_BYTES, approx_knn, centres, knn, recall_at_k, sample  # noqa: F401
from petriflow.operators.ranking import areas, mann_whitney, pr_auc, roc_auc, score_steps

#: Rows of one block of a block product, about.
BLOCK_ROWS = 20_000


def split_batch(batch: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a batch: bad ones have another length, or none."""
    ok = F.coalesce(F.size("values") == dim, F.lit(False))
    return batch.where(ok), batch.where(~ok)


def upsert_vectors(table: DataFrame, batch: DataFrame, dim: int, seq: str = "seq") -> DataFrame:
    """The table after a batch: rows of the right length, the last write of each id."""
    good, _ = split_batch(batch, dim)
    return table.unionByName(good).withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(seq)))).where("_n = 1").drop("_n")


def delete_vectors(table: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what is left, the ids that existed)."""
    return table.join(ids.select("id").distinct(), "id", "left_anti"), ids.select("id").distinct().join(table.select("id"), "id", "left_semi")


def metadata_filter(table: DataFrame, wanted: dict[str, str], column: str = "metadata") -> DataFrame:
    for k, v in wanted.items():
        table = table.where(F.try_element_at(F.col(column), F.lit(k)) == v)
    return table


def vector_stats(table: DataFrame, writes: DataFrame | None = None, dim: int | None = None, cls: str = "cls") -> DataFrame:
    """One row: live vectors, their dimension, how many were ever inserted, and how many there are of each class (array of the class and n).

    Ever inserted are the rows of ``writes`` (all upserts since the table began; null without them) of length ``dim``, those that are gone or written over
    included.
    """
    counts = table.groupBy(F.col(cls).alias("cls")).agg(F.count("*").alias("n"), F.max(F.size("values")).alias("d"))  # a row a class
    classes = F.sort_array(F.collect_list(F.struct("cls", "n")))
    out = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("live"), F.max("d").alias("dimension"), classes.alias("classes"))
    if writes is None:
        return out.withColumn("total_inserted", F.lit(None).cast("long"))
    accepted = writes if dim is None else split_batch(writes, dim)[0]
    return out.crossJoin(accepted.agg(F.count("*").alias("total_inserted")))  # one row


def _blocks(df: DataFrame, n: int, name: str) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))


def knn_euclidean(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    return knn(queries, base, k)


def knn_cosine(queries: DataFrame, base: DataFrame, k: int, min_similarity: float | None = None) -> DataFrame:
    """The threshold is applied after the top k."""
    out = knn(queries, base, k, "cosine")
    return out if min_similarity is None else out.where(F.col("similarity") >= min_similarity)


def class_match_rate(neighbours: DataFrame, rows: DataFrame, cls: str = "cls") -> DataFrame:
    """(query_id, match_rate): share of neighbours with the query's class."""
    j = neighbours.join(rows.select(F.col("id").alias("query_id"), F.col(cls).alias("_q")), "query_id").join(rows.select("id", F.col(cls).alias("_n")), "id")
    return j.groupBy("query_id").agg(F.avg((F.col("_q") == F.col("_n")).cast("double")).alias("match_rate"))


def _vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    return neighbours.join(labels.select("id", "label"), "id").groupBy("query_id").agg(F.avg(F.col("label").cast("double")).alias("vote"))


def knn_vote(train: DataFrame, test: DataFrame, k: int = 7) -> DataFrame:
    """(id, vote): the positive share of each test row's ``k`` nearest training rows by cosine; 0.5 without any."""
    v = _vote(knn(test, train, k, "cosine"), train)
    return test.select("id").join(v.withColumnRenamed("query_id", "id"), "id", "left").fillna(0.5, ["vote"])


def knn_vote_loo(rows: DataFrame, k: int = 7, scope: str = "global", client: str = "client") -> DataFrame:
    """(id, vote) of each row against all others (by key, so a duplicate vector still counts).

    local: within its client, and only where that has more than k + 1 rows and both classes; 0.5 elsewhere.
    """
    if scope == "global":
        v = _vote(knn(rows, rows, k, "cosine", exclude_self=True), rows)
    else:
        size = rows.groupBy(client).agg(F.count("*").alias("_n"), F.countDistinct("label").alias("_c")).where((F.col("_n") > k + 1) & (F.col("_c") > 1))
        fit = with_few(rows, size.select(client), client, "left_semi")  # a row a client
        v = _vote(knn(fit, fit, k, "cosine", group=client, same_group=True, exclude_self=True), rows)
    return rows.select("id").join(v.withColumnRenamed("query_id", "id"), "id", "left").fillna(0.5, ["vote"])


def local_vs_global_report(rows: DataFrame, k: int = 7, conf: str | None = None, client: str = "client") -> DataFrame:
    """(client, n, n_pos, local_auc, global_auc, local_pr, global_pr, delta_auc[, conf_auc])."""
    kinds = ["local", "global", *([conf] if conf else [])]
    votes = rows.join(knn_vote_loo(rows, k, "local", client).withColumnRenamed("vote", "local"), "id").join(knn_vote_loo(rows, k, "global").withColumnRenamed("vote", "global"), "id")
    # All areas come from these few rows, so that no neighbour is looked for again.
    each = F.inline(F.array(*(F.struct(F.lit(i).alias("_kind"), F.col(c).cast("double").alias("score")) for i, c in enumerate(kinds))))
    steps = checkpointed(score_steps(votes.where(F.col(client).isNotNull()).select(client, "label", each), "label", "score", [client, "_kind"]))
    of = lambda i, c: F.max(F.when(F.col("_kind") == i, F.col(c)))
    more = [of(2, "auc").alias("conf_auc")] if conf else []
    out = areas(steps, [client, "_kind"]).groupBy(client).agg(F.max("n").alias("n"), F.max("n_pos").alias("n_pos"), *(of(i, c).alias(f"{kinds[i]}_{name}") for c, name in (("auc", "auc"), ("pr_auc", "pr")) for i in (0, 1)), *more)
    return out.select(client, "n", "n_pos", "local_auc", "global_auc", "local_pr", "global_pr", (F.col("global_auc") - F.col("local_auc")).alias("delta_auc"), *(["conf_auc"] if conf else []))


def knn_outlier(rows: DataFrame, k: int = 5, client: str = "client") -> DataFrame:
    """(id, client, label, distance): mean distance of each row to its ``k`` nearest positives of other clients (values standardised by the caller).

    Clients with fewer than 3 negatives are left out; rows with fewer than k foreign positives too.
    """
    neg = rows.groupBy(client).agg(F.sum((F.col("label") != 1).cast("long")).alias("_n")).where("_n >= 3")
    q = with_few(rows, neg.select(client), client, "left_semi")  # a row a client
    near = knn(q, rows.where("label = 1"), k, group=client, same_group=False)
    d = near.groupBy("query_id").agg(F.avg("distance").alias("distance"), F.count("*").alias("_k")).where(F.col("_k") == k)
    return q.select("id", client, "label").join(d.select(F.col("query_id").alias("id"), "distance"), "id")


def knn_outlier_report(scored: DataFrame, client: str = "client") -> DataFrame:
    """(client, auc, median1, median0, u, z): AUC of minus the distance, and whether positives lie nearer."""
    s = scored.withColumn("score", -F.col("distance"))
    return roc_auc(s, "label", "score", [client]).select(client, "auc").join(mann_whitney(scored, "distance", "label", [client], "less").select(client, "median1", "median0", "u", "z"), client)


def combined_outlier_score(scored: DataFrame, conf: str = "conf", client: str = "client") -> DataFrame:
    most = F.max("distance").over(Window.partitionBy(client))
    return scored.withColumn("combined", 0.5 * F.col(conf) + 0.5 * (-F.col("distance") / (most + 1e-10)))


def standardised(rows: DataFrame, values: str = "values") -> DataFrame:
    """``rows`` with their value arrays standardised by position (population deviation; 0 counts as 1)."""
    pos = rows.select("id", F.posexplode(values).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    moments = pos.agg(F.sort_array(F.collect_list(F.struct("p", "m", "s"))).alias("_m"))
    j = rows.crossJoin(F.broadcast(moments))  # one row
    z = F.zip_with(values, "_m", lambda x, m: (x - m.m) / F.when(m.s > 0, m.s).otherwise(1.0))
    return j.withColumn(values, z).drop("_m")


def _scaled(rows: DataFrame) -> DataFrame:
    v = rows.withColumn("_v", array_to_vector("values"))
    return StandardScaler(inputCol="_v", outputCol="_x", withMean=True, withStd=True).fit(v).transform(v)


def kmeans_clusters(rows: DataFrame, k: int = 8, nearest: int = 8, seed: int = 42) -> DataFrame:
    """(id, cluster, distance, n, pct, rank): K-means on standardised values; rank 1 to ``nearest`` are the rows nearest each centre."""
    x = _scaled(rows)
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(x)
    centres = F.array(*(F.array(*(F.lit(float(a)) for a in c)) for c in model.clusterCenters()))
    p = model.transform(x).select("id", "cluster", vector_to_array("_x").alias("v"))
    d = F.sqrt(F.aggregate(F.zip_with("v", F.get(centres, F.col("cluster")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, a: s + a))
    w = Window.partitionBy("cluster")
    p = p.select("id", "cluster", d.alias("distance"))
    size = p.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
    return p.withColumn("rank", F.row_number().over(w.orderBy("distance", "id"))).join(size, "cluster")  # k rows


def pca_project(rows: DataFrame, k: int = 50) -> tuple[DataFrame, list[float]]:
    """(rows with ``pc``, explained variance ratios) of at most min(k, dimension, n - 1) components of the standardised values."""
    x = _scaled(rows)
    some = x.select(F.size("values").alias("d")).first()
    k = max(1, min(k, some.d if some else 1, rows.count() - 1))
    model = PCA(k=k, inputCol="_x", outputCol="_p").fit(x)
    return model.transform(x).select(*rows.columns, vector_to_array("_p").alias("pc")), list(model.explainedVariance)


def mixture_score(rows: DataFrame, components: int | None = None, pcs: int = 8, seed: int = 42, prior: float = 1e-2) -> DataFrame:
    """``rows`` with log_likelihood under a truncated Dirichlet-process mixture (diagonal Gaussians, weight prior ``prior``) of the label-1 rows in principal
    component space, and active, how many of its components have more than a hundredth of the weight. None: one component for every 100 of these rows,
    2 at least and 15 at most."""
    p, _ = pca_project(rows, pcs)
    p = checkpointed(p)
    fit = p.where("label = 1").select("id", F.col("pc").alias("values"))
    k = components or min(15, max(2, fit.count() // 100))
    some = sample(fit, 4096, seed)
    if not len(some):
        return p.withColumns({"log_likelihood": F.lit(None).cast("double"), "active": F.lit(0)}).drop("pc")
    model = dirichlet_mixture(fit.select(F.col("values").alias("x")), centres(some, k, seed), prior)

    @F.pandas_udf("double")
    def loglik(s: pd.Series) -> pd.Series:
        return pd.Series(model.log_likelihood(np.array(s.tolist())) if len(s) else [])

    return p.withColumns({"log_likelihood": loglik("pc"), "active": F.lit(int((model.weights > 0.01).sum()))}).drop("pc")


def centroid_spread(rows: DataFrame, cls: str = "cls") -> DataFrame:
    """(cls, n, mean_distance, sd_distance) of rows to their class's centroid."""
    c = rows.select(cls, F.posexplode("values").alias("p", "x")).groupBy(cls, "p").agg(F.avg("x").alias("m")).groupBy(cls).agg(F.sort_array(F.collect_list(F.struct("p", "m"))).alias("_c"))
    j = with_few(rows, c, cls)  # a row a class
    d = F.sqrt(F.aggregate(F.zip_with("values", "_c", lambda x, m: (x - m.m) * (x - m.m)), F.lit(0.0), lambda s, a: s + a))
    return j.groupBy(cls).agg(F.count("*").alias("n"), F.avg(d).alias("mean_distance"), F.stddev_pop(d).alias("sd_distance"))


def calinski_harabasz(rows: DataFrame, cls: str = "cls") -> DataFrame:
    """(score): spread between classes over spread within, each by its degrees of freedom."""
    long = rows.select(cls, F.posexplode("values").alias("p", "x"))
    by = long.groupBy(cls, "p").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.sum(F.col("x") * F.col("x")).alias("q"))
    w = Window.partitionBy("p")
    by = by.withColumn("g", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    s = by.agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)).alias("b"), F.sum(F.col("q") - F.col("n") * F.col("m") * F.col("m")).alias("w"), F.countDistinct(cls).alias("k"), F.max("p").alias("d"), F.sum("n").alias("nd"))
    n, k = F.col("nd") / (F.col("d") + 1), F.col("k")
    return s.select(F.when((F.col("w") > 0) & (k > 1), F.col("b") / (k - 1) / (F.col("w") / (n - k))).otherwise(0.0).alias("score"))


def silhouette(rows: DataFrame, cls: str = "cls") -> DataFrame:
    """(cls, silhouette): mean over rows by exact mean Euclidean distances; pairs of blocks hand on one sum a row and class."""
    n_b = max(1, rows.count() // BLOCK_ROWS + 1)
    base = rows.select("id", F.col(cls).cast("long").alias("c"), "values")
    again = base.select(*(F.col(c).alias(c) for c in base.columns))
    a = _blocks(base, n_b, "_q").withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_b - 1))))
    b = _blocks(again, n_b, "_b").withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n_b - 1))))

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "c": pd.Series([], dtype="int64"), "o": pd.Series([], dtype="int64"), "d": pd.Series([], dtype="float64")})
        y, kinds, out = np.array(right["values"].tolist(), np.float64), np.unique(right.c), []
        own = (right.c.to_numpy()[:, None] == kinds[None, :]).astype(np.float64)
        step = max(1, CELLS // (8 * len(right)))
        for low in range(0, len(left), step):
            some = left.iloc[low : low + step]
            x = np.array(some["values"].tolist(), np.float64)
            dist = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))
            dist[some.id.to_numpy()[:, None] == right.id.to_numpy()[None, :]] = 0
            out.append(pd.DataFrame({"id": np.repeat(some.id.to_numpy(), len(kinds)), "c": np.repeat(some.c.to_numpy(), len(kinds)), "o": np.tile(kinds, len(some)), "d": (dist @ own).ravel()}))
        return pd.concat(out)

    part = a.groupBy("_q", "_b").cogroup(b.groupBy("_q", "_b")).applyInPandas(sums, "id long, c long, o long, d double")
    size = base.groupBy(F.col("c").alias("o")).agg(F.count("*").alias("n"))
    m = part.groupBy("id", "c", "o").agg(F.sum("d").alias("d")).join(size, "o")  # a row a class
    own = F.col("o") == F.col("c")
    mean = F.when(own, F.col("d") / F.nullif(F.col("n") - 1, F.lit(0))).otherwise(F.col("d") / F.col("n"))
    s = m.groupBy("id", "c").agg(F.max(F.when(own, mean)).alias("a"), F.min(F.when(~own, mean)).alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return s.groupBy(F.col("c").alias(cls)).agg(F.avg(value).alias("silhouette"))


def silhouette_estimate(rows: DataFrame, cls: str = "cls", per_cluster: int = 1024, seed: int = 1) -> DataFrame:
    """(cls, silhouette, margin): as `silhouette`, with mean distances to ``per_cluster`` rows of each cluster (those of least hashes) for those to all of them.

    One pass compares every row with these rows, so the work grows with the rows and not with their square. margin bounds the error of a cluster's mean at three
    standard errors of its rows' mean distances, all taken to err the same way; clusters of ``per_cluster`` rows or fewer add nothing to it, and
    if all are, the result is exact. The rows that are shipped take `SAMPLE_BYTES` at most; with many clusters each gets fewer.
    """
    base = rows.select("id", F.col(cls).cast("long").alias("c"), "values")
    sizes = {r.c: r.n for r in base.groupBy("c").agg(F.count("*").alias("n")).collect()}  # a row a cluster
    first = base.select(F.size("values").alias("n")).first()
    if first is None:
        return base.select(F.col("c").alias(cls), F.lit(0.0).alias("silhouette"), F.lit(0.0).alias("margin"))
    most = max(2, min(per_cluster, SAMPLE_BYTES // (8 * max(1, first.n) * len(sizes))))
    order = Window.partitionBy("c").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    some = base.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).toPandas().sort_values(["c", "id"])
    y, ids, kinds = np.array(some["values"].tolist(), np.float64), some.id.to_numpy(), np.array(sorted(sizes))
    owner = np.searchsorted(kinds, some.c.to_numpy())
    member = (owner[:, None] == np.arange(len(kinds))[None]).astype(float)
    n = np.array([sizes[k] for k in kinds], float)

    def score(frames):
        for f in frames:
            step = max(1, CELLS // (8 * max(1, len(y))))
            for low in range(0, len(f), step):
                part = f.iloc[low : low + step]
                x = np.array(part["values"].tolist(), np.float64)
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))
                self_ = part.id.to_numpy()[:, None] == ids[None, :]
                d[self_] = 0
                own = np.searchsorted(kinds, part.c.to_numpy())
                mine = own[:, None] == np.arange(len(kinds))[None]
                m = member.sum(0)[None] - self_ @ member  # the row itself is no neighbour
                with np.errstate(divide="ignore", invalid="ignore"):
                    mean = d @ member / m
                    error = 3 * np.sqrt(np.maximum((d * d) @ member / m - mean**2, 0) / np.maximum(m - 1, 1) * np.maximum(1 - m / (n[None] - mine), 0))
                a, b = np.where(mine, mean, np.inf).min(1), np.where(mine, np.inf, mean).min(1)
                alone = ~np.isfinite(a) | ~np.isfinite(b) | (np.maximum(a, b) <= 0) | (n[own] < 2)
                top = np.where(alone, 1, np.maximum(a, b))
                with np.errstate(invalid="ignore"):
                    yield pd.DataFrame({"c": part.c.to_numpy(), "s": np.where(alone, 0.0, (b - a) / top), "e": np.where(alone, 0.0, 2 * np.nan_to_num(error).max(1) / top)})

    out = base.mapInPandas(score, "c long, s double, e double")
    return out.groupBy(F.col("c").alias(cls)).agg(F.avg("s").alias("silhouette"), F.avg("e").alias("margin"))


def channel_stats(df: DataFrame, channels: list[str], low: float = 0.0, high: float = 1.0, bins: int = 8) -> DataFrame:
    """``df`` with, for each channel's array, *_mean, *_sd (population) and *_hist (shares of ``bins`` equal bins of [low, high], last one closed)."""
    step = (high - low) / bins

    def inside(i: int):
        lo, hi = low + i * step, low + (i + 1) * step
        return (lambda x: (x >= lo) & (x <= high)) if i == bins - 1 else (lambda x: (x >= lo) & (x < hi))

    def spread(mean: str):
        return lambda x: F.pow(x - F.col(mean), 2)

    for c in channels:
        n = F.size(c)
        total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
        df = df.withColumn(f"{c}_mean", total(F.col(c)) / n)
        df = df.withColumn(f"{c}_sd", F.sqrt(total(F.transform(c, spread(f"{c}_mean"))) / n))
        df = df.withColumn(f"{c}_hist", F.array(*(F.size(F.filter(c, inside(i))) / n for i in range(bins))))
    return df
