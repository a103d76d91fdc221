"""Fusing a classifier's score with a detector's confidence, and reading a language model's verdicts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petriflow.functions.grid import with_each
from petriflow.functions.joins import with_few
from petriflow.functions.lineage import checkpointed
from petriflow.operators.models import HeldOut, held_out_logistic, held_out_scores, summed
from petriflow.operators.ranking import areas, average_precision, roc_auc, score_steps

WEIGHTS = [round(0.05 * i, 2) for i in range(21)]


def weighted_scan(df: DataFrame, score: str = "score", conf: str = "conf", label: str = "label") -> DataFrame:
    """(w, auc, pr_auc, delta_auc, best): w * score + (1 - w) * conf for each weight; delta to conf alone; best is the first of the highest AUC."""
    # Rows alike in both scores are one row before they are multiplied by the weights; one running total gives both areas.
    alike = score_steps(df.select(F.col(label).alias("label"), F.col(score).alias("score"), F.col(conf).alias("b")), "label", "score", ["b"])
    many = with_each(alike, ["w"], [(w,) for w in WEIGHTS])
    mixed = F.round(F.col("w") * F.col("score") + (1 - F.col("w")) * F.col("b"), 12).alias("score")
    g = areas(many.groupBy("w", mixed).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), ["w"])
    every = Window.partitionBy(F.lit(0))  # a row a weight
    base = F.max(F.when(F.col("w") == 0.0, F.col("auc"))).over(every)
    top = F.first("w").over(every.orderBy(F.desc("auc"), "w").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return g.select("w", "auc", "pr_auc", (F.col("auc") - base).alias("delta_auc"), (F.col("w") == top).alias("best"))


def _alike(df: DataFrame, label: str, score: str, conf: str) -> DataFrame:
    """(c, s, pos, neg): rows alike in both scores are one row before they are multiplied by the settings of a scan."""
    rows = df.select(F.col(label).alias("label"), F.col(score).alias("score"), F.col(conf).alias("c"))
    return score_steps(rows, "label", "score", ["c"]).withColumnRenamed("score", "s")


def _scan(df: DataFrame, name: str, grid: list[float], fused: Column, label: str, score: str, conf: str) -> DataFrame:
    many = with_each(_alike(df, label, score, conf), ["param"], [(float(p),) for p in grid])
    steps = many.groupBy("param", F.round(fused, 12).alias("score")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return areas(checkpointed(steps), ["param"]).select(F.lit(name).alias("rule"), "param", "ap")


def hard_filter(df: DataFrame, label: str = "label", score: str = "score", conf: str = "conf", least: int = 10) -> DataFrame:
    """Confidence where score reaches the threshold (.05 to .90), else 0; thresholds that fewer than ``least`` rows reach are skipped."""
    grid = [round(0.05 * i, 2) for i in range(1, 19)]
    out = _scan(df, "hard_filter", grid, F.when(F.col("s") >= F.col("param"), F.col("c")).otherwise(0.0), label, score, conf)
    many = with_each(df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("k")), ["param"], [(p,) for p in grid]).where("s >= param").groupBy("param").agg(F.sum("k").alias("n"))
    return out.join(many.where(F.col("n") >= least).select("param"), "param", "left_semi").select("rule", "param", "ap")


def soft_penalize(df: DataFrame, label: str = "label", score: str = "score", conf: str = "conf") -> DataFrame:
    """conf * (1 - alpha * (1 - score)) for alpha .1 to .9."""
    return _scan(df, "soft_penalize", [round(0.1 * i, 1) for i in range(1, 10)], F.col("c") * (1 - F.col("param") * (1 - F.col("s"))), label, score, conf)


def geometric_mean(df: DataFrame, label: str = "label", score: str = "score", conf: str = "conf") -> DataFrame:
    """(conf + 1e-8)^w * (score + 1e-8)^(1 - w) for w .1 to .9."""
    return _scan(df, "geometric_mean", [round(0.1 + 0.05 * i, 2) for i in range(17)], F.pow(F.col("c") + 1e-8, F.col("param")) * F.pow(F.col("s") + 1e-8, 1 - F.col("param")), label, score, conf)


def best_rules(df: DataFrame, label: str = "label", score: str = "score", conf: str = "conf") -> DataFrame:
    """(rule, param, ap, baseline): the best setting of each scan by strict gain; the baseline (null) where none gains."""
    base = average_precision(df.select(F.col(label).alias("label"), F.col(conf).alias("score"))).withColumnRenamed("ap", "baseline")
    scans = hard_filter(df, label, score, conf).unionByName(soft_penalize(df, label, score, conf)).unionByName(geometric_mean(df, label, score, conf))
    best = scans.groupBy("rule").agg(F.max(F.struct("ap", (-F.col("param")).alias("p"))).alias("b")).crossJoin(F.broadcast(base))  # one row
    gain = F.col("b.ap") > F.col("baseline")
    return best.select("rule", F.when(gain, -F.col("b.p")).alias("param"), F.greatest("b.ap", "baseline").alias("ap"), "baseline")


def fold_of(label: str, key: str, k: int, seed: int = 0) -> Column:
    """A stratified fold: rows of a class in seeded hash order, dealt round. Numbered within hash buckets, so no class is one window."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return ((F.row_number().over(Window.partitionBy(label, F.substring(h, 1, 2)).orderBy(h, key)) + F.conv(F.substring(h, 1, 2), 16, 10).cast("int")) % k).cast("int")


def _finite(df: DataFrame, kept: list[str], features: list[str], label: str) -> DataFrame:
    """(kept, label, x): rows without a null or NaN among the features."""
    x = F.array(*(F.col(c).cast("double") for c in features))
    return df.select(*kept, F.col(label).cast("double").alias("label"), x.alias("x")).where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))


def lr_meta(df: DataFrame, features: list[str], label: str = "label", key: str = "id", k: int = 5, c: float = 1.0) -> DataFrame:
    """(key, label, fold, prob): out-of-fold probabilities of a logistic regression on the features, for AUC and AP. All folds are fitted at once."""
    rows = checkpointed(_finite(df, [key], features, label).withColumn("fold", fold_of("label", key, k)))
    fit = rows.select("x", F.col("label").alias("y"), F.col("fold").alias("g"))
    model = held_out_logistic(fit, k, len(features), lambda n: 1 / (c * n))
    return held_out_scores(rows.withColumn("g", F.col("fold")), model, [key, "label", "fold"]).withColumnRenamed("score", "prob")


def correlations(df: DataFrame, a: str = "score", b: str = "conf") -> DataFrame:
    """(pearson, spearman): Spearman is Pearson on mid-ranks, which are found from counts of distinct values."""
    from petriflow.operators.ranking import running_totals

    ranks = []
    for c in (a, b):
        steps = df.groupBy(F.col(c).alias(c)).agg(F.count("*").alias("n"))
        r = running_totals(steps, [], c, ["n"], descending=False)
        ranks.append(r.select(c, (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias("_r_" + c)))
    pairs = df.groupBy(a, b).agg(F.count("*").alias("_w")).join(ranks[0], a).join(ranks[1], b)
    x, y, w = F.col("_r_" + a), F.col("_r_" + b), F.col("_w")
    m = pairs.agg(F.sum(w).cast("double").alias("n"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"), F.sum(w * x * y).alias("xy"))
    n = F.col("n")
    rho = (n * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt((n * F.col("xx") - F.col("x") * F.col("x")) * (n * F.col("yy") - F.col("y") * F.col("y")))
    return df.agg(F.corr(a, b).alias("pearson")).crossJoin(m.select(rho.alias("spearman")))  # one row each


def adaptive_score(df: DataFrame, by: str, label: str = "label", score: str = "score", conf: str = "conf") -> DataFrame:
    """``df`` with rule and fused: by the group's AUC of conf, below .70 the classifier, below .85 the product, else conf."""
    base = roc_auc(df.select(by, F.col(label).alias("label"), F.col(conf).alias("score")), by=[by]).select(by, F.col("auc").alias("base_auc"))
    j = with_few(df, base, by)  # one row a group
    rule = F.when(F.col("base_auc") < 0.70, "classifier").when(F.col("base_auc") < 0.85, "product").otherwise("confidence")
    fused = F.when(F.col("base_auc") < 0.70, F.col(score)).when(F.col("base_auc") < 0.85, F.col(score) * F.col(conf)).otherwise(F.col(conf))
    return j.withColumn("rule", rule).withColumn("fused", fused)


def alpha_for_gap(gap: Column) -> Column:
    """The weight of conf by how much better the classifier's AUC is."""
    return F.when(gap > 0.10, 0.0).when(gap > 0, 0.2).when(gap > -0.05, 0.5).otherwise(1.0)


def _one_left_out(df: DataFrame, by: str, features: list[str], label: str) -> tuple[DataFrame, HeldOut]:
    """(rows (by, label, x, g), a model for each group g that all others fitted)."""
    rows = checkpointed(_finite(df, [by], features, label))
    names = checkpointed(rows.select(by).distinct().withColumn("g", F.row_number().over(Window.orderBy(by)).cast("int") - 1))  # a row a group
    rows = checkpointed(with_few(rows, names, by))
    return rows, held_out_logistic(rows.select("x", F.col("label").alias("y"), "g"), max(1, names.count()), len(features), lambda n: np.full(len(n), 1e-3))


def leave_one_group_out(df: DataFrame, by: str, features: list[str], label: str = "label") -> DataFrame:
    """(by, n, n_pos, auc) of each group scored by a logistic regression fitted to all others, and pooled (null). All groups are fitted at once, by passes
    whose number doesn't grow with the groups."""
    rows, model = _one_left_out(df, by, features, label)
    out = held_out_scores(rows, model, [by, "label"])
    return roc_auc(out, by=[by]).unionByName(roc_auc(out).withColumn(by, F.lit(None)), allowMissingColumns=True)


def calibration_left_out(df: DataFrame, by: str, features: list[str], label: str = "label") -> DataFrame:
    """(by, n, n_pos, mean_prob, mean_prob_out): of each group's held-out model, the rows that it was fitted to, its mean probability over them (the share of
    positives, if the fit has converged), and over the group itself."""
    rows, model = _one_left_out(df, by, features, label)
    k = len(model.weights)

    def sums(x: np.ndarray, g: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros((k, 5))
        for m in range(k):
            p, own = model.score(x, np.full(len(x), m)), g == m
            out[m] = [(~own).sum(), y[~own].sum(), p[~own].sum(), own.sum(), p[own].sum()]
        return out.ravel()

    total = summed(rows.select("x", "g", "label"), 5 * k, sums).reshape(k, 5)
    made = [(m, int(t[0]), int(t[1]), float(t[2] / max(t[0], 1)), float(t[4] / max(t[3], 1))) for m, t in enumerate(total)]
    told = df.sparkSession.createDataFrame(made, "g int, n long, n_pos long, mean_prob double, mean_prob_out double")
    return rows.select(by, "g").distinct().join(told, "g").drop("g")


def distilled_score(df: DataFrame, by: str, label: str = "label", conf: str = "conf", prob: str = "score") -> DataFrame:
    """(by, zero_shot_auc, distilled_auc, improvement) of conf and conf * prob."""
    a = roc_auc(df.select(by, F.col(label).alias("label"), F.col(conf).alias("score")), by=[by]).select(by, F.col("auc").alias("zero_shot_auc"))
    b = roc_auc(df.select(by, F.col(label).alias("label"), F.round(F.col(conf) * F.col(prob), 12).alias("score")), by=[by]).select(by, F.col("auc").alias("distilled_auc"))
    return a.join(b, by).withColumn("improvement", F.col("distilled_auc") - F.col("zero_shot_auc"))


def similarity_margin(df: DataFrame, prototypes: list[tuple[str, list[float], list[float]]], values: str = "values", label: str = "label", by: str = "client") -> DataFrame:
    """(by, pair, auc, best): AUC of cos(x, positive) - cos(x, negative) for each pair of prototypes, and each group's best pair."""

    def cosine(x: Column, y: Column) -> Column:
        dot = F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda a: a * a), F.lit(0.0), lambda s, a: s + a))
        return F.when((norm(x) > 0) & (norm(y) > 0), dot / (norm(x) * norm(y))).otherwise(0.0)

    lit = lambda v: F.array(*(F.lit(float(a)) for a in v))
    each = F.array(*(F.struct(F.lit(name).alias("pair"), F.round(cosine(F.col(values), lit(p)) - cosine(F.col(values), lit(n)), 12).alias("score")) for name, p, n in prototypes))
    long = df.select(by, F.col(label).alias("label"), F.inline(each))
    a = roc_auc(long, by=[by, "pair"]).select(by, "pair", "auc")
    return a.withColumn("best", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("auc"), "pair")) == 1)


_KEYS = ("is_organoid", "morphology_typical", "confidence")


def parse_score_text(df: DataFrame, text: str = "raw") -> DataFrame:
    """is_organoid, morphology_typical, confidence (doubles) and reason of a model's answer: the JSON between the first { and the last }, with 0.5 for what
    it lacks; if that is no JSON, a number after each key, with 0.5 without one, and the first 200 characters as the reason. A null text has no result."""
    inner = F.regexp_extract(F.col(text), r"(?s)(\{.*\})", 1)
    j = F.from_json(inner, "is_organoid double, morphology_typical double, confidence double, reason string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = df.withColumn("_j", F.when(inner != "", j))
    good = F.col("_j").isNotNull() & F.col("_j._bad").isNull()
    for k in _KEYS:
        found = F.expr(f"try_cast(regexp_extract({text}, '(?i){k}[\"\\']?\\\\s*[:=]\\\\s*([0-9.]+)', 1) as double)")
        out = out.withColumn(k, F.when(F.col(text).isNotNull(), F.when(good, F.coalesce(F.col("_j")[k], F.lit(0.5))).otherwise(F.coalesce(found, F.lit(0.5)))))
    return out.withColumn("reason", F.when(good, F.coalesce("_j.reason", F.lit(""))).otherwise(F.substring(text, 1, 200))).drop("_j")


def conflict_check(df: DataFrame, score: str = "score", conf: str = "conf") -> DataFrame:
    """conflict (hallucination, missed or none) and adjusted: the mean of both scores in a conflict, else the score."""
    s, c = F.col(score), F.col(conf)
    kind = F.when((s > 0.7) & (c < 0.4), "hallucination").when((s < 0.3) & (c > 0.7), "missed").otherwise("none")
    return df.withColumn("conflict", kind).withColumn("adjusted", F.when(F.col("conflict") != "none", (s + c) / 2).otherwise(s))


def upsert_results(table: DataFrame, batch: DataFrame, key: str = "cache_key", seq: str = "seq") -> DataFrame:
    """The latest row of each key over both."""
    both = table.unionByName(batch)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where("_n = 1").drop("_n")


def pending(items: DataFrame, table: DataFrame, key: str = "cache_key") -> DataFrame:
    """Items whose key has no result yet."""
    return items.join(table.select(key), key, "left_anti")
