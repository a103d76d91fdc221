"""Exact ranks and percentiles by narrowing, against sorted lists; no task may put more than a bounded number of a group's rows in order."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from petriflow.functions.lineage import checkpointed
from petriflow.operators import order_stats as O
from petriflow.operators import ranking as K


@pytest.fixture(scope="module")
def values():
    r = random.Random(4)
    a = [r.gauss(0, 1) for _ in range(9_000)]
    b = [float(r.randint(0, 5)) for _ in range(6_000)]  # few values, many times
    c = [10.0 ** r.randint(-300, 300) for _ in range(5_000)] + [-0.0, 0.0, float("-inf")]
    return [("a", x) for x in a] + [("b", x) for x in b] + [("c", x) for x in c] + [("d", 2.5)] + [("d", None), ("e", None), (None, 1.0), (None, 4.0)]


@pytest.fixture(scope="module")
def rows(spark, values):
    return checkpointed(spark.createDataFrame(values, "k string, x double").repartition(5))


@pytest.mark.parametrize("small", [O.SMALL_ROWS, 400, 1])
def test_percentiles_by_group(rows, values, small, monkeypatch):
    monkeypatch.setattr(O, "SMALL_ROWS", small)
    shares = [0.0, 0.05, 0.5, 0.777, 0.95, 1.0]
    if small == 1:
        rows, values = rows.where("k <> 'c' AND k <> 'a'"), [v for v in values if v[0] not in ("a", "c", None)]
    got = {r.k: r.p for r in O.percentiles(rows, "x", shares, ["k"]).collect()}
    assert set(got) == {k for k, _ in values} - ({None} if small == 1 else set())
    for k, p in got.items():
        x = [v for g, v in values if g == k and v is not None]
        if not x:
            assert p is None or all(v is None for v in p)
            continue
        with np.errstate(all="ignore"):
            want = np.quantile(np.array(x), shares)
        want = [w if w == w else float("-inf") for w in want]  # numpy makes a number of infinities that it cannot subtract
        assert p == pytest.approx(want, rel=1e-12)


def test_every_rank_of_one_group(rows, values, monkeypatch):
    monkeypatch.setattr(O, "SMALL_ROWS", 500)
    spark = rows.sparkSession
    x = sorted(v for g, v in values if g == "a")
    ranks = [*range(0, len(x), 91), len(x) - 1, len(x), 10**9]
    wanted = spark.createDataFrame([("a", r, r) for r in ranks], "g string, r long, t long")
    got = {r.t: r.v for r in O.select_ranks(rows.select(F.col("k").alias("g"), F.col("x").alias("v")), wanted).collect()}
    assert got == {r: x[r] for r in ranks if r < len(x)}


def test_stretches_shrink_and_repeated_values_are_settled_at_once(rows, values):
    wanted = rows.sparkSession.createDataFrame([(k, n // 2, k) for k, n in (("a", 9_000), ("b", 6_000))], "g string, r long, t string")
    r = rows.select(F.col("k").alias("g"), F.col("x").alias("v")).where("g IN ('a', 'b')")
    settled, kept, left = O._round(r, wanted, [0.5 - 2 / O.ACCURACY, 0.5 + 2 / O.ACCURACY])
    assert [tuple(x) for x in settled.where("t = 'b'").collect()] == [("b", sorted(v for g, v in values if g == "b")[3_000])]
    assert kept.count() <= 9_000 * 8 / O.ACCURACY + 10
    assert left.count() + settled.count() == 2


def test_metrics_are_the_same_by_narrowing(spark, sf_dir, monkeypatch):
    from petriflow.plans.standins import scores

    s = scores(spark, sf_dir)
    run = lambda: [sorted(map(str, f.collect())) for f in (K.percentile_sweep(s), K.mann_whitney(s, "conf", "label", ["grp"]), K.normal_range(s, "grp", ["score", "conf"]))]
    plain = run()
    monkeypatch.setattr(O, "SMALL_ROWS", 300)
    assert run() == plain


def test_no_rows(rows):
    none = rows.where("false")
    assert O.percentiles(none, "x", [0.5], ["k"]).count() == 0
    assert O.select_ranks(none.select(F.col("k").alias("g"), F.col("x").alias("v")), rows.sparkSession.createDataFrame([("a", 0, 0)], "g string, r long, t long")).count() == 0
