"""Histories of training and federation rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def convergence(rounds: DataFrame, by: str = "exp", order: str = "round") -> DataFrame:
    """By experiment: best map50 and map with the 1-based row of each (first of equals), first row of map50 >= .95 of the final, the row of least val_loss,
    whether val_loss rises (last > 1.1 * least), and the gain over the last 20 rows (0 with fewer)."""
    w = Window.partitionBy(by).orderBy(order)
    d = rounds.withColumn("_n", F.row_number().over(w)).withColumn("_back", F.lag("map50", 19).over(w))
    last = d.groupBy(by).agg(F.max(F.struct("_n", "map50", "val_loss", "_back")).alias("l"))
    d = d.join(last, by)  # a row an experiment
    best = lambda c: F.max(F.struct(F.col(c).alias("v"), (-F.col("_n")).alias("n")))
    a = d.groupBy(by).agg(best("map50").alias("a"), best("map").alias("b"), F.min(F.when(F.col("map50") >= 0.95 * F.col("l.map50"), F.col("_n"))).alias("first_95"), F.min(F.struct("val_loss", "_n")).alias("v"), F.first("l").alias("l"))
    rising = F.when(F.col("l.val_loss") > 1.1 * F.col("v.val_loss"), "increasing").otherwise("stable")
    return a.select(by, F.col("a.v").alias("best_map50"), (-F.col("a.n")).alias("best_map50_row"), F.col("b.v").alias("best_map"), (-F.col("b.n")).alias("best_map_row"), "first_95", F.col("v._n").alias("min_val_loss_row"), rising.alias("val_loss_trend"), F.when(F.col("l._back").isNotNull(), F.col("l.map50") - F.col("l._back")).otherwise(0.0).alias("gain_20"))


def round_summary(rounds: DataFrame, by: str = "exp", order: str = "round", metric: str = "map50") -> DataFrame:
    """Best and final value, first round of .95 or more, total and mean improvement a round."""
    w = Window.partitionBy(by).orderBy(order)
    d = rounds.withColumn("_step", F.col(metric) - F.lag(metric).over(w))
    a = d.groupBy(by).agg(F.max(metric).alias("best"), F.max_by(metric, order).alias("final"), F.min_by(metric, order).alias("_first"), F.min(F.when(F.col(metric) >= 0.95, F.col(order))).alias("first_095"), F.avg("_step").alias("mean_improvement"))
    return a.select(by, "best", "final", "first_095", (F.col("final") - F.col("_first")).alias("total_improvement"), F.coalesce("mean_improvement", F.lit(0.0)).alias("mean_improvement"))


def client_gap(round_clients: DataFrame, by: str = "exp", order: str = "round", metric: str = "map50", warn: float = 0.05) -> DataFrame:
    """(exp, round, gap, warning): how far the clients of a round lie apart."""
    g = round_clients.groupBy(by, order).agg((F.max(metric) - F.min(metric)).alias("gap"))
    return g.withColumn("warning", F.col("gap") > warn)


def client_pivot(round_clients: DataFrame, clients: list[str], by: str = "exp", order: str = "round", metric: str = "map50") -> DataFrame:
    return round_clients.groupBy(by, order).pivot("client", clients).agg(F.first(metric))


def strategy_table(rounds: DataFrame, by: list[str], order: str = "round", metric: str = "map50") -> DataFrame:
    """Final and best value, the round of the best, the gap between them and the first round of .95 of the best."""
    best = rounds.groupBy(*by).agg(F.max(metric).alias("best"))
    d = rounds.join(best, by)  # a row a strategy
    return d.groupBy(*by).agg(F.max_by(metric, order).alias("final"), F.first("best").alias("best"), F.min(F.when(F.col(metric) == F.col("best"), F.col(order))).alias("best_round"), F.min(F.when(F.col(metric) >= 0.95 * F.col("best"), F.col(order))).alias("convergence_round")).withColumn("drop_from_best", F.col("best") - F.col("final"))


def strategy_pivot(table: DataFrame, scenario: str, strategy: str, scenarios: list[str], value: str = "final") -> DataFrame:
    return table.groupBy(strategy).pivot(scenario, scenarios).agg(F.first(value))


def mu_sensitivity(rounds: DataFrame, mu: str = "mu", by: str = "exp", order: str = "round", metric: str = "map50") -> DataFrame:
    """(mu, n_runs, mean_final, best_final, mean_best, drop): the runs of each strength of the pull towards the global model; drop is how far its mean final
    value lies below that of the best strength."""
    runs = strategy_table(rounds, [mu, by], order, metric)
    table = runs.groupBy(mu).agg(F.count("*").alias("n_runs"), F.avg("final").alias("mean_final"), F.max("final").alias("best_final"), F.avg("best").alias("mean_best"))
    return table.withColumn("drop", F.max("mean_final").over(Window.partitionBy(F.lit(0))) - F.col("mean_final"))  # a row a strength


def specialist_gap(round_clients: DataFrame, ap: str = "per_class_ap", dominant: str = "dominant") -> DataFrame:
    """(exp, round, client, dominant_ap, other_ap, gap): mean AP of the client's dominant classes less that of the others."""
    long = round_clients.select("exp", "round", "client", dominant, F.explode(ap).alias("c", "v"))
    own = F.array_contains(dominant, F.col("c").cast("int"))
    g = long.groupBy("exp", "round", "client").agg(F.avg(F.when(own, F.col("v"))).alias("dominant_ap"), F.avg(F.when(~own, F.col("v"))).alias("other_ap"))
    return g.withColumn("gap", F.coalesce("dominant_ap", F.lit(0.0)) - F.coalesce("other_ap", F.lit(0.0)))


def readiness_score(rounds: DataFrame, class_table: DataFrame, by: str = "exp", order: str = "round") -> DataFrame:
    """25 points each for map50 > .85, class imbalance < 5, spread of map over classes > .05 and a stable loss; ready from 75, cautious from 50.

    class_table: (exp, cls, instances, map).
    """
    r = rounds.groupBy(by).agg(F.max("map50").alias("m"), F.max_by("val_loss", order).alias("last"), F.min("val_loss").alias("least"))
    c = class_table.groupBy(by).agg((F.max("instances") / F.greatest(F.lit(1), F.min("instances"))).alias("imbalance"), (F.max("map") - F.min("map")).alias("spread"))
    j = r.join(c, by, "left")
    tests = {"quality_ok": F.col("m") > 0.85, "balance_ok": F.col("imbalance") < 5, "spread_ok": F.col("spread") > 0.05, "loss_ok": F.col("last") <= 1.1 * F.col("least")}
    j = j.withColumns({n: F.coalesce(t, F.lit(False)) for n, t in tests.items()})
    score = sum((25 * F.col(n).cast("int") for n in tests), F.lit(0))
    j = j.withColumn("score", score)
    return j.select(by, *tests, "score", F.when(F.col("score") >= 75, "ready").when(F.col("score") >= 50, "cautious").otherwise("not_ready").alias("verdict"))


def best_round(rounds: DataFrame, by: str = "exp", order: str = "round", metric: str = "map") -> DataFrame:
    """The row of the highest metric (first of equals) of each experiment."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(metric), order))
    return rounds.withColumn("_n", n).where("_n = 1").drop("_n")


def round_averages(round_clients: DataFrame, by: str = "exp", order: str = "round") -> DataFrame:
    """Mean training loss and accuracy over the clients of each round."""
    return round_clients.groupBy(by, order).agg(F.avg("train_loss").alias("train_loss"), F.avg("train_acc").alias("train_acc"))
