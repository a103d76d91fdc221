"""Measures of irregular polygons against a plain hull, and the inventory of files as they lie in folders."""

import math
import random

import pytest

from petriflow.operators import boxes as B
from petriflow.sources import readers as R


def hull_area(points):
    """By the area to the left of every line of two points that has no point to its right."""
    pts = sorted(set(points))
    total = 0.0
    for p in pts:
        for q in pts:
            side = [(q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]) for r in pts if r not in (p, q)]
            if p != q and all(x > 0 for x in side):
                total += p[0] * q[1] - q[0] * p[1]
    return total / 2


def test_irregular_polygons(spark):
    r, rows = random.Random(6), []
    for i in range(40):  # stars with spikes of any length
        k = r.randint(3, 12)
        spikes = [(r.uniform(1, 9), 2 * math.pi * (j + r.uniform(0, 0.8)) / k) for j in range(k)]
        rows.append((i, [50 + d * math.cos(t) for d, t in spikes], [20 + d * math.sin(t) for d, t in spikes]))
    circle = [2 * math.pi * j / 256 for j in range(256)]
    rows += [(100, [5 * math.cos(t) for t in circle], [5 * math.sin(t) for t in circle]), (101, [0.0, 1.0, 2.0], [0.0, 1.0, 2.0]), (102, [3.0], [3.0]), (103, [0.0, 4.0, 4.0, 4.0, 0.0], [0.0, 0.0, 2.0, 4.0, 4.0])]
    got = {x.i: x for x in B.shape_measures(spark.createDataFrame(rows, "i long, xs array<double>, ys array<double>")).collect()}
    for i, xs, ys in rows[:40]:
        area = abs(sum(xs[j - 1] * ys[j] - xs[j] * ys[j - 1] for j in range(len(xs)))) / 2
        assert got[i].area == pytest.approx(area) and got[i].solidity == pytest.approx(area / hull_area(list(zip(xs, ys, strict=True))))
        assert got[i].perimeter == pytest.approx(sum(math.dist((xs[j - 1], ys[j - 1]), (xs[j], ys[j])) for j in range(len(xs))))
    assert min(got[i].solidity for i in range(40)) < 0.8
    assert got[100].circularity == pytest.approx(1, abs=1e-3) and got[100].solidity == pytest.approx(1) and got[100].aspect_ratio == pytest.approx(1)
    assert all(getattr(got[i], c) == 0 for i in (101, 102) for c in ("area", "circularity", "solidity", "perimeter"))
    assert got[103].solidity == pytest.approx(1) and got[103].area == 16


def test_inventory_of_files(spark, tmp_path):
    names = ["t0_x.json", "t1_a.json", "annotator_c_1.json", "notes.txt"]
    for split in ("train", "test"):
        for image in ("i1", "i2"):
            folder = tmp_path / split / "cls" / "plate" / image
            folder.mkdir(parents=True)
            for n in names:
                (folder / n).write_text("{}")
    (tmp_path / "top.json").write_text("{}")
    got = sorted(tuple(r) for r in R.inventory_files(spark, str(tmp_path)).where("cls = 'cls'").collect())
    assert got == sorted((s, "cls", "plate", a, 2) for s in ("train", "test") for a in ("t0", "t1_a", "annotator_c"))
    assert R.inventory_files(spark, str(tmp_path), "*.txt").agg({"n": "sum"}).first()[0] == 4
