"""Findings of the fourth round."""

import numpy as np
import pytest

from petriflow.operators import neighbours as N
from petriflow.operators import vectors as V


def test_report_compares_pairs_once(spark, monkeypatch):
    pairs, made = spark.sparkContext.accumulator(0), N._product

    def counted(*how):
        product = made(*how)

        def run(left, right):
            pairs.add(len(left) * len(right))
            return product(left, right)

        return run

    monkeypatch.setattr(N, "_product", counted)
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, i % 3, int(rng.integers(0, 2)), rng.normal(size=6).tolist()) for i in range(300)], "id long, client int, label int, values array<double>")
    assert V.local_vs_global_report(rows).count() == 3
    assert pairs.value == 300 * 300 + 3 * 100 * 100


@pytest.mark.parametrize("pivots", [None, 12])
def test_scores_equal_after_rounding_go_by_id(spark, pivots):
    x = np.random.default_rng(3).normal(size=(600, 8)) * 3e-9
    ids = np.random.default_rng(4).permutation(600)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, values array<double>")
    want = set()
    for i, v in zip(ids, x, strict=True):
        d = np.round(np.sqrt(((x - v) ** 2).sum(1)), 9)
        want |= {(int(i), int(j), r + 1) for r, j in enumerate([ids[j] for j in np.lexsort((ids, d)) if ids[j] != i][:5])}
    assert {(r.query_id, r.id, r.rank) for r in N.knn(rows, rows, 5, exclude_self=True, pivots=pivots).collect()} == want


def test_a_sweep_shuffles_boxes_once_and_sums(spark, sf_dir):
    from petriflow.plans import registry

    d = registry.queries()["filter_sweep"](spark, sf_dir)
    assert d.count() == 19
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    # Boxes by image, then sums by filter.
    assert d._jdf.queryExecution().sparkPlan().toString().count("FlatMapGroups") == 1
    assert plan.split("== Initial Plan ==")[0].count("Exchange") <= 2


def test_sweep_of_images_on_one_side_and_of_many_filters(spark):
    from petriflow.operators import det_metrics as D

    corners = "x1 double, y1 double, x2 double, y2 double"
    rng = np.random.default_rng(6)
    # Image 0 has detections alone, 1 reference boxes alone, -1 both (negative numbers had no name before); 2 is large, its pairs known by their places.
    det = [(0, 1, 0.0, 0.0, 9.0, 9.0, 0.2, None, 1.0, 1.0), (-1, 1, 0.0, 0.0, 9.0, 9.0, 0.9, 1.0, 1.0, 1.0), (-1, 2, 0.0, 0.0, 9.0, 9.0, None, 1.0, 1.0, 1.0)]
    gt = [(1, 1, 0.0, 0.0, 9.0, 9.0), (-1, 1, 0.0, 0.0, 9.0, 9.0)]
    at = rng.permutation(2000)
    det += [(2, i, 20.0 * p, 5.0, 20.0 * p + 10, 15.0, 0.5, 1.0, 1.0, 1.0) for i, p in enumerate(at.tolist())]
    gt += [(2, i, 20.0 * i, 5.0, 20.0 * i + 10, 15.0) for i in range(2000)]
    d = spark.createDataFrame(det, f"image long, idx long, {corners}, score double, circularity double, solidity double, aspect_ratio double")
    g = spark.createDataFrame(gt, f"image long, idx long, {corners}")
    filters = {f"f{i}": (i / 100, 0.0, 0.0, 0.0) for i in range(100)} | {"round": (0.0, 0.5, 0.0, 0.0)}
    got = {r.config: r for r in D.filter_sweep(d, g, filters).collect()}
    count = lambda n: (got[n].n_images, got[n].tp, got[n].fp, got[n].fn, round(got[n].map, 9))
    assert set(got) == set(filters)
    assert count("f0") == (4, 2001, 1, 1, 0.5)
    assert count("f30") == (3, 2001, 0, 1, round(2 / 3, 9))
    assert count("f70") == (3, 1, 0, 2001, round(1 / 3, 9))
    assert count("f95") == (3, 0, 0, 2002, 0.0)
    assert count("round") == (3, 2001, 1, 1, round(2 / 3, 9))
