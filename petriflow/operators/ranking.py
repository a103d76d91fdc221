"""Ranking metrics, tests and distributions over (label, score) rows, by group.

Everything cumulative starts from one row per distinct score. Without a group such a table can still be large, so running totals go by
`running_totals`: score ranges are totalled first, and each range adds what lies before it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from petriflow.functions.grid import all_pairs_of_keys, with_each
from petriflow.functions.joins import with_few
from petriflow.operators.order_stats import percentiles

#: Rows of one range of a group's distinct scores in a running total, about.
RANGE_ROWS = 100_000


def running_totals(steps: DataFrame, by: list[str], order: str, sums: list[str], descending: bool = True, most_so_far: bool = False) -> DataFrame:
    """``steps`` with cum_* of each of ``sums``, up to and including the row, in order of ``order`` within ``by``; ``most_so_far``: the largest value so
    far instead of the sum.

    Each group is cut into ranges of about ``RANGE_ROWS`` rows at approximate percentiles of its own values, so no window holds more than
    one range's rows, however the values lie; a range's total is carried into the ranges after it.
    """
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    total = F.max if most_so_far else F.sum
    n = steps.groupBy(*by).agg(F.count("*").alias("_n"))
    most = n.agg(F.max("_n").alias("n")).first().n or 0
    if most <= RANGE_ROWS:  # every group is one range
        whole = Window.partitionBy(*(by or [F.lit(0)])).orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
        return steps.withColumns({"cum_" + c: total(c).over(whole) for c in sums})
    k = int(most // RANGE_ROWS) + 1
    cuts = steps.groupBy(*by).agg(F.percentile_approx(order, [i / k for i in range(1, k)], 10 * k).alias("_cuts"))
    joined = with_few(steps, cuts, by) if by else steps.crossJoin(cuts)  # one row a group
    s = joined.withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    totals = s.groupBy(*by, "_part").agg(*(total(c).alias("_t_" + c) for c in sums))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(way("_part")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "_part", *(total("_t_" + c).over(w).alias("_b_" + c) for c in sums))
    inner = Window.partitionBy(*by, "_part").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = with_few(s, before, [*by, "_part"])  # a row a range
    for c in sums:
        own, carried = total(c).over(inner), F.col("_b_" + c)
        out = out.withColumn("cum_" + c, F.greatest(own, carried) if most_so_far else own + F.coalesce(carried, F.lit(0)))
    return out.drop("_part", *("_b_" + c for c in sums))


def score_steps(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """One row per group and distinct score: pos, neg."""
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) != 1).cast("long")).alias("neg"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """(by, n, n_pos, auc): ties count half; a single class gives 0.5."""
    by = by or []
    s = running_totals(score_steps(df, label, score, by), by, "score", ["pos", "neg"], descending=False)
    won = F.col("pos") * (F.col("cum_neg") - F.col("neg")) + F.col("pos") * F.col("neg") / 2
    a = s.groupBy(*by).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("_n"), F.sum(won).alias("_won"))
    pairs = F.col("n_pos") * F.col("_n")
    return a.select(*by, "n", "n_pos", F.when(pairs > 0, F.col("_won") / pairs).otherwise(0.5).alias("auc"))


def pr_table(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """(by, score, tp, fp, n_pos, precision, recall) at each distinct score, taken as the threshold."""
    by = by or []
    s = running_totals(score_steps(df, label, score, by), by, "score", ["pos", "neg"])
    n = s.groupBy(*by).agg(F.sum("pos").alias("n_pos"))
    s = with_few(s, n, by) if by else s.crossJoin(n)  # one row a group
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return s.select(*by, "score", "pos", tp.alias("tp"), fp.alias("fp"), "n_pos", (tp / (tp + fp)).alias("precision"), F.when(F.col("n_pos") > 0, tp / F.col("n_pos")).otherwise(0.0).alias("recall"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """(by, ap): sum of precision times the step in recall."""
    by = by or []
    t = pr_table(df, label, score, by)
    return t.groupBy(*by).agg(F.sum(F.when(F.col("n_pos") > 0, F.col("precision") * F.col("pos") / F.col("n_pos")).otherwise(0.0)).alias("ap"))


def pr_auc(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """(by, pr_auc): area under straight lines between the points, from recall 0 at precision 1. Not the same number as `average_precision`."""
    by = by or []
    # The point before a row is known from its own counts, unless it is the first.
    tp, fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    t = running_totals(score_steps(df, label, score, by), by, "score", ["pos", "neg"]).withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})
    n = t.groupBy(*by).agg(F.sum("pos").alias("n_pos"))
    t = with_few(t, n, by) if by else t.crossJoin(n)  # one row a group
    before = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)
    area = F.col("pos") / F.col("n_pos") * (F.col("tp") / (F.col("tp") + F.col("fp")) + before) / 2
    return t.groupBy(*by).agg(F.sum(F.when(F.col("n_pos") > 0, area).otherwise(0.0)).alias("pr_auc"))


def areas(steps: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, n_pos, auc, ap, pr_auc) from rows (by, score, pos, neg), one for each distinct score, by one running total."""
    t = running_totals(steps, by, "score", ["pos", "neg"])
    n = steps.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    t = with_few(t, n, by) if by else t.crossJoin(n)  # one row a group
    tp, fp, p, q = F.col("cum_pos"), F.col("cum_neg"), F.col("_p"), F.col("_q")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    precision, before = tp / (tp + fp), F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(1.0)
    part = F.when(p > 0, F.col("pos") / p).otherwise(0.0)
    won = F.col("pos") * (q - fp) + F.col("pos") * F.col("neg") / 2
    a = t.groupBy(*by).agg(F.first("_p").alias("n_pos"), F.first("_q").alias("_n"), F.sum(won).alias("_w"), F.sum(part * precision).alias("ap"), F.sum(part * (precision + before) / 2).alias("pr_auc"))
    pairs = F.col("n_pos") * F.col("_n")
    return a.select(*by, (F.col("n_pos") + F.col("_n")).alias("n"), "n_pos", F.when(pairs > 0, F.col("_w") / pairs).otherwise(0.5).alias("auc"), "ap", "pr_auc")


def best_f1(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """(by, threshold, f1): the best of every distinct score, F1 = 2PR / (P + R + 1e-10); of equals the lowest threshold."""
    by = by or []
    t = pr_table(df, label, score, by).withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-10))
    best = t.groupBy(*by).agg(F.max(F.struct("f1", (-F.col("score")).alias("s"))).alias("b"))
    return best.select(*by, (-F.col("b.s")).alias("threshold"), F.col("b.f1").alias("f1"))


def best_f1_fixed(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None, steps: int = 99) -> DataFrame:
    """(by, threshold, f1) over thresholds .01 to .99 (score >= threshold); the first of equals. Scores fall into bins first, then bins are summed."""
    by = by or []
    bins = df.groupBy(*by, F.least(F.lit(steps), F.greatest(F.lit(0), F.floor(F.round(F.col(score) * (steps + 1), 9)))).cast("int").alias("bin")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) != 1).cast("long")).alias("neg"))
    at = with_each(bins, ["k"], [(k,) for k in range(1, steps + 1)])
    g = at.groupBy(*by, "k").agg(F.sum(F.when(F.col("bin") >= F.col("k"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("bin") >= F.col("k"), F.col("neg")).otherwise(0)).alias("fp"), F.sum("pos").alias("p"))
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p"))).otherwise(0.0)
    best = g.groupBy(*by).agg(F.max(F.struct(f1.alias("f1"), (-F.col("k")).alias("k"))).alias("b"))
    return best.select(*by, (-F.col("b.k") / (steps + 1)).alias("threshold"), F.col("b.f1").alias("f1"))


def percentile_sweep(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(pct, threshold, precision, recall, f1, kept, rejected, fp_reduction_rate) at the exact score percentiles 5 to 95."""
    at = [p / 100 for p in range(5, 100, 5)]
    cuts = percentiles(df, score, at).select(F.posexplode("p").alias("k", "threshold"))
    cut_row = cuts.agg(F.sort_array(F.collect_list(F.struct("k", "threshold"))).alias("cuts"))
    s = score_steps(df, label, score, []).crossJoin(F.broadcast(cut_row)).select("score", "pos", "neg", F.inline("cuts"))
    kept = F.col("score") >= F.col("threshold")
    g = s.groupBy("k", "threshold").agg(F.sum(F.when(kept, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(kept, F.col("neg")).otherwise(0)).alias("fp"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    g = g.withColumn("precision", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)).withColumn("recall", F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(0.0))
    p, r = F.col("precision"), F.col("recall")
    return g.select((5 * (F.col("k") + 1)).alias("pct"), "threshold", "precision", "recall", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), (F.col("tp") + F.col("fp")).alias("kept"), (F.col("p") + F.col("n") - F.col("tp") - F.col("fp")).alias("rejected"), F.when(F.col("n") > 0, 1 - F.col("fp") / F.col("n")).otherwise(0.0).alias("fp_reduction_rate"))


def unpivot(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return df.select(*keys, F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))))


def feature_auc_ranking(df: DataFrame, features: list[str], label: str = "label", k: int = 10) -> DataFrame:
    """(feature, auc, pr_auc, rank): the ``k`` features of the highest AUC."""
    long = unpivot(df, [label], features)
    a = roc_auc(long, label, "value", ["feature"]).join(pr_auc(long, label, "value", ["feature"]), "feature")
    return a.select("feature", "auc", "pr_auc", F.row_number().over(Window.orderBy(F.desc("auc"), "feature")).alias("rank")).where(F.col("rank") <= k)


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """P(Z > z) of a standard normal variable."""
    return z.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2)) if x == x else np.nan)


def mann_whitney(df: DataFrame, value: str = "value", label: str = "label", by: list[str] | None = None, alternative: str = "two-sided") -> DataFrame:
    """(by, n1, n0, median1, median0, u, z, p, stars): asymptotic, corrected for ties and by 0.5; groups with fewer than 3 on a side are left out."""
    by = by or []
    steps = running_totals(score_steps(df, label, value, by), by, "score", ["pos", "neg"], descending=False)
    t = (F.col("pos") + F.col("neg")).cast("double")
    u = F.col("pos") * (F.col("cum_neg") - F.col("neg")) + F.col("pos") * F.col("neg") / 2
    a = steps.groupBy(*by).agg(F.sum("pos").alias("n1"), F.sum("neg").alias("n0"), F.sum(u).cast("double").alias("u"), F.sum(t * t * t - t).alias("_ties"))
    med = percentiles(df.withColumn("_side", F.col(label) == 1), value, [0.5], [*by, "_side"]).withColumn("_m", F.get("p", F.lit(0)))
    med = med.groupBy(*by).agg(F.max(F.when(F.col("_side"), F.col("_m"))).alias("median1"), F.max(F.when(~F.col("_side"), F.col("_m"))).alias("median0"))
    a = (a.join(med, by) if by else a.crossJoin(med)).where("n1 >= 3 and n0 >= 3")  # one row a group
    n1, n0, n = F.col("n1").cast("double"), F.col("n0").cast("double"), (F.col("n1") + F.col("n0")).cast("double")
    sd = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    d = F.col("u") - n1 * n0 / 2
    z = {"greater": (d - 0.5) / sd, "less": (-d - 0.5) / sd, "two-sided": (F.abs(d) - 0.5) / sd}[alternative]
    a = a.withColumn("z", F.when(sd > 0, z).otherwise(0.0))
    p = normal_tail("z")
    a = a.withColumn("p", F.least(F.lit(1.0), 2 * p) if alternative == "two-sided" else p)
    stars = F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise("")
    return a.select(*by, "n1", "n0", "median1", "median0", "u", "z", "p", stars.alias("stars"))


def clean_number(c: Column) -> Column:
    """NaN to 0, infinities to plus and minus a million."""
    return F.when(F.isnan(c), 0.0).when(c == float("inf"), 1e6).when(c == float("-inf"), -1e6).otherwise(c)


def standardise(df: DataFrame, features: list[str]) -> DataFrame:
    """Features less their mean, by their population deviation (0 counts as 1), after `clean_number`."""
    df = df.withColumns({f: clean_number(F.col(f).cast("double")) for f in features})
    m = df.agg(*(F.avg(f).alias("_m_" + f) for f in features), *(F.stddev_pop(f).alias("_s_" + f) for f in features))
    j = df.crossJoin(F.broadcast(m))  # one row
    made = {f: (F.col(f) - F.col("_m_" + f)) / F.when(F.col("_s_" + f) > 0, F.col("_s_" + f)).otherwise(1.0) for f in features}
    return j.withColumns(made).select(*df.columns)


def _kl(hist: DataFrame, by: str, n_bins: int) -> DataFrame:
    """All ordered pairs of groups from (by, bin, q)."""
    a, b = (hist.select(F.col(by).alias(x), "bin", F.col("q").alias("q" + x)) for x in ("a", "b"))
    return a.join(b, "bin").groupBy("a", "b").agg(F.sum(F.col("qa") * F.ln(F.col("qa") / F.col("qb"))).alias("kl"))


def kl_matrix(df: DataFrame, by: str, value: str, n_bins: int = 20, low: float = -3.0, high: float = 3.0) -> DataFrame:
    """(a, b, kl) for all groups: shares over equal bins of [low, high] (last one closed; values outside dropped) plus 1e-10, not renormalised."""
    width = (high - low) / n_bins
    kept = df.where((F.col(value) >= low) & (F.col(value) <= high))
    bins = kept.groupBy(by, F.least(F.lit(n_bins - 1), F.floor((F.col(value) - low) / width)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = df.groupBy(by).agg(F.lit(1).alias("_")).join(bins.groupBy(by).agg(F.sum("n").alias("total")), by, "left")
    every = with_each(total, ["bin"], [(i,) for i in range(n_bins)])
    q = every.join(bins, [by, "bin"], "left").withColumn("q", F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)) + 1e-10)
    return _kl(q, by, n_bins)


def kl_adaptive(df: DataFrame, by: str, value: str, n_bins: int = 20) -> DataFrame:
    """(a, b, kl): bins over the pooled range of each pair of groups; shares plus 1e-8, renormalised. -1 with fewer than 3 values, 0 for an empty range.

    Equal values of a group are one row before they meet the pairs that the group is in; groups are few.
    """
    folded = df.groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("_c"))
    s = df.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    pairs = all_pairs_of_keys(df.select(by).distinct().withColumn("_o", F.col(by)), by, "_o", "a", "b")
    for x in ("a", "b"):
        pairs = pairs.join(s.select(F.col(by).alias(x), F.col("lo").alias("lo" + x), F.col("hi").alias("hi" + x), F.col("n").alias("n" + x)), x)
    pairs = pairs.withColumn("lo", F.least("loa", "lob")).withColumn("hi", F.greatest("hia", "hib"))
    sides = []
    for x in ("a", "b"):
        j = pairs.select("a", "b", "lo", "hi", F.col("n" + x).alias("n"), F.col(x).alias(by)).join(folded, by)
        at = F.least(F.lit(n_bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n_bins)).cast("int")
        sides.append(j.where("hi > lo").groupBy("a", "b", at.alias("bin")).agg((F.sum("_c") / F.first("n")).alias("q" + x)))
    every = with_each(pairs, ["bin"], [(i,) for i in range(n_bins)])
    q = every.join(sides[0], ["a", "b", "bin"], "left").join(sides[1], ["a", "b", "bin"], "left").fillna(0.0, ["qa", "qb"])
    norm = 1 + n_bins * 1e-8
    pa_, pb = (F.col("qa") + 1e-8) / norm, (F.col("qb") + 1e-8) / norm
    g = q.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.sum(pa_ * F.ln(pa_ / pb)).alias("_kl"))
    return g.select("a", "b", F.when((F.col("na") < 3) | (F.col("nb") < 3), -1.0).when(F.col("hi") <= F.col("lo"), 0.0).otherwise(F.col("_kl")).alias("kl"))


def normal_range(df: DataFrame, by: str, features: list[str], label: str = "label") -> DataFrame:
    """(by, feature, p5, p50, p95, n, outside): share of each group's label-0 rows outside the 5 to 95 percent range of all label-1 rows; 3 rows at least."""
    long = unpivot(df, [by, label], features)
    r = percentiles(long.where(F.col(label) == 1), "value", [0.05, 0.5, 0.95], ["feature"])
    r = r.select("feature", *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("p5", "p50", "p95"))))
    j = with_few(long.where(F.col(label) != 1), r, "feature")  # a row a feature
    out = (F.col("value") < F.col("p5")) | (F.col("value") > F.col("p95"))
    return j.groupBy(by, "feature").agg(F.first("p5").alias("p5"), F.first("p50").alias("p50"), F.first("p95").alias("p95"), F.count("*").alias("n"), F.avg(out.cast("double")).alias("outside")).where("n >= 3")


def calibration(df: DataFrame, label: str = "label", score: str = "score", n_bins: int = 10) -> DataFrame:
    """(bin, low, n, observed): the share of positives in equal bins of [0, 1); an empty bin has null, a score of 1 falls out."""
    binned = df.where((F.col(score) >= 0) & (F.col(score) < 1)).groupBy(F.floor(F.col(score) * n_bins).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("observed"))
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return bins.join(binned, "bin", "left").select("bin", (F.col("bin") / n_bins).alias("low"), F.coalesce("n", F.lit(0)).alias("n"), "observed")


def trajectory_metrics(df: DataFrame, label: str = "label", scores: str = "scores", certainties: str = "certainties") -> DataFrame:
    """(tick, auc, accuracy, mean_certainty) from arrays of one value a tick; accuracy takes scores above 0.5."""
    long = df.select(F.col(label).alias("label"), F.posexplode(F.arrays_zip(F.col(scores).alias("s"), F.col(certainties).alias("c"))).alias("tick", "z")).select("label", "tick", F.col("z.s").alias("score"), F.col("z.c").alias("certainty"))
    acc = long.groupBy("tick").agg(F.avg(((F.col("score") > 0.5).cast("int") == F.col("label")).cast("double")).alias("accuracy"), F.avg("certainty").alias("mean_certainty"))
    return roc_auc(long, "label", "score", ["tick"]).join(acc, "tick").select("tick", "auc", "accuracy", "mean_certainty")


def best_tick(metrics: DataFrame, by: str = "auc") -> DataFrame:
    """(best_tick, best, final, gain): of `trajectory_metrics` rows the first tick of the highest value, that value, the last tick's, and how much the
    best is above it."""
    value = F.round(F.col(by), 12)
    top = metrics.agg(F.max(F.struct(value.alias("v"), (-F.col("tick")).alias("t"))).alias("b"), F.max(F.struct("tick", value.alias("v"))).alias("l"))
    return top.select((-F.col("b.t")).cast("int").alias("best_tick"), F.col("b.v").alias("best"), F.col("l.v").alias("final"), (F.col("b.v") - F.col("l.v")).alias("gain"))


def trajectory_stops(df: DataFrame, scores: str = "scores", certainties: str = "certainties", least: float = 0.8) -> DataFrame:
    """``df`` with first_certain (first tick of certainty ``least``, else the number of ticks) and score_at_peak (score at the most certain tick)."""
    first = F.array_position(F.transform(certainties, lambda c: c >= least), F.lit(True))
    peak = F.get(F.col(scores), (F.array_position(F.col(certainties), F.array_max(certainties)) - 1).cast("int"))
    return df.withColumn("first_certain", F.when(first > 0, first - 1).otherwise(F.size(certainties)).cast("int")).withColumn("score_at_peak", peak)


def class_trajectories(df: DataFrame, label: str = "label", scores: str = "scores") -> DataFrame:
    long = df.select(F.col(label).alias("label"), F.posexplode(scores).alias("tick", "score"))
    return long.groupBy("label", "tick").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
