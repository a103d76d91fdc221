"""Nearest boxes and order-dependent merging of images with many boxes, against plain versions and against one group an image."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from petriflow.operators import matching as M
from petriflow.operators import merging as G

BOX = "image long, idx long, x1 double, y1 double, x2 double, y2 double, score double"


def boxes(image, n, seed, spread):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = r.uniform(0, spread), r.uniform(0, spread), r.uniform(5, 40), r.uniform(5, 40)
        out.append((image, i, round(x, 1), round(y, 1), round(x + w, 1), round(y + h, 1), round(r.random(), 3)))
    return out


def test_nearest_box_of_a_large_image(spark):
    rng = np.random.default_rng(1)
    # Most boxes in one tight cluster, some far away, and many of one centre.
    c = np.concatenate([rng.normal(5000, 3, (30_000, 2)), rng.uniform(0, 20_000, (19_000, 2)), np.full((1_000, 2), 100.0)])
    gt = spark.createDataFrame([(1, i, float(x - 5), float(y - 5), float(x + 5), float(y + 5)) for i, (x, y) in enumerate(c)] + [(2, 0, 0.0, 0.0, 1.0, 1.0)], BOX.rpartition(",")[0])
    p = np.concatenate([rng.uniform(-3000, 25_000, (300, 2)), rng.normal(5000, 5, (100, 2)), [[101.0, 101.0]]])
    fp = spark.createDataFrame([(1, i, float(x - 1), float(y - 1), float(x + 1), float(y + 1), 0.5) for i, (x, y) in enumerate(p)] + [(2, 0, 5.0, 5.0, 6.0, 6.0, 0.5), (3, 0, 0.0, 0.0, 1.0, 1.0, 0.5)], BOX)
    got = {(r.image, r.idx): (r.gt_idx, r.distance) for r in M.nearest_gt(fp, gt).collect()}
    centre, points = np.array([[((x - 5) + (x + 5)) / 2, ((y - 5) + (y + 5)) / 2] for x, y in c]), np.array([[((x - 1) + (x + 1)) / 2, ((y - 1) + (y + 1)) / 2] for x, y in p])
    for i, q in enumerate(points):
        d = np.sqrt((centre[:, 0] - q[0]) ** 2 + (centre[:, 1] - q[1]) ** 2)
        k = int(np.lexsort((np.arange(len(d)), d))[0])
        assert got[1, i] == (k, pytest.approx(d[k], rel=1e-12)), i
    assert got[2, 0][0] == 0 and got[3, 0] == (None, float("inf"))
    g = gt.where("image = 1").select("image", F.col("idx").alias("gt_idx"), *(F.col(x).alias("g_" + x) for x in ("x1", "y1", "x2", "y2")))
    some = M.near_candidates(fp.where("image = 1").select("image", F.col("idx").alias("row"), ((F.col("x1") + F.col("x2")) / 2).alias("px"), ((F.col("y1") + F.col("y2")) / 2).alias("py")), g)
    per = some.groupBy("row").count().agg(F.avg("count"), F.max("count")).first()
    assert per[0] < 60 and per[1] < 400


@pytest.mark.parametrize("spread", [400, 1500])
def test_regions_give_what_whole_images_give(spark, monkeypatch, spread):
    a = spark.createDataFrame(boxes(1, 250, 1, spread) + boxes(2, 30, 2, 200) + [(1, 900, 50.0, 50.0, 50.0, 50.0, 0.4), (1, 901, 0.0, 0.0, 0.0, 9.0, 0.0)], BOX)
    b = spark.createDataFrame(boxes(1, 200, 3, spread) + boxes(3, 10, 4, 100), BOX)
    rules = [lambda: G.soft_nms(a), lambda: G.anchor_fusion(a, 0.3), lambda: G.weighted_boxes_fusion([a, b], 0.3)]
    rows = lambda f: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in f().select("image", "idx", *(["x1", "y1", "x2", "y2"]), "score").collect())
    plain = [rows(f) for f in rules]
    monkeypatch.setattr(G, "GROUP_BOXES", 100)
    assert [rows(f) for f in rules] == plain
    regions = G._regions(a.where("image = 1"), False).groupBy("_g").count().count()
    hulls = G._regions(a.where("image = 1"), True).groupBy("_g").count().count()
    assert regions >= hulls >= 1 and (spread == 400 or hulls > 20)
