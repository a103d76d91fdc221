"""Hand-made cases and brute-force twins of the box helpers."""

import itertools
import random

import pytest

from petriflow.operators import boxes as B
from petriflow.operators import det_metrics as D
from petriflow.operators import matching as M
from petriflow.operators import merging as G

SPEC = "image long, idx long, x1 double, y1 double, x2 double, y2 double, score double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0, w) * max(0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def some(seed, images=3, n=25):
    r = random.Random(seed)
    rows = []
    for image in range(images):
        for i in range(n):
            x, y = r.randint(0, 300), r.randint(0, 300)
            rows.append((image, i, float(x), float(y), float(x + r.randint(20, 160)), float(y + r.randint(20, 160)), r.randint(1, 9) / 10))
    return rows


@pytest.mark.parametrize("other,want", [((20.0, 0.0, 30.0, 10.0), 0.0), ((10.0, 0.0, 20.0, 10.0), 0.0), ((0.0, 0.0, 10.0, 10.0), 1.0), ((2.0, 2.0, 4.0, 4.0), 0.04), ((5.0, 5.0, 5.0, 5.0), 0.0)])
def test_iou(spark, other, want):
    d = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, *other)], "a1 double, a2 double, a3 double, a4 double, b1 double, b2 double, b3 double, b4 double")
    from pyspark.sql import functions as F

    got = d.select(B.iou([F.col(f"a{i}") for i in range(1, 5)], [F.col(f"b{i}") for i in range(1, 5)]).alias("v")).first().v
    assert got == pytest.approx(want)


@pytest.mark.parametrize("cell", [16, 128, 1000])
def test_pairs_do_not_depend_on_the_cell(spark, cell):
    a, b = some(1), some(2)
    got = {(r.image, r.l_idx, r.r_idx) for r in M.iou_pairs(spark.createDataFrame(a, SPEC), spark.createDataFrame(b, SPEC), 0.2, cell).collect()}
    assert got == {(x[0], x[1], y[1]) for x, y in itertools.product(a, b) if x[0] == y[0] and iou(x[2:6], y[2:6]) >= 0.2}


def greedy(det, gt, thr, by_score, strict):
    out = {}
    for image in {d[0] for d in det}:
        used = set()
        ds = [d for d in det if d[0] == image]
        for d in sorted(ds, key=lambda d: (-d[6], d[1])) if by_score else sorted(ds, key=lambda d: d[1]):
            left = [(-iou(d[2:6], g[2:6]), g[1]) for g in gt if g[0] == image and g[1] not in used]
            if left and (v := -min(left)[0]) and (v > thr if strict else v >= thr):
                used.add(min(left)[1])
                out[image, d[1]] = min(left)[1]
    return out


@pytest.mark.parametrize("by_score,strict", [(True, False), (False, False), (True, True)])
def test_greedy_matching(spark, by_score, strict):
    det, gt = some(3), some(4)
    got = M.match_greedy(spark.createDataFrame(det, SPEC), spark.createDataFrame(gt, SPEC), 0.3, by_score, strict).where("matched").collect()
    assert {(r.image, r.idx): r.gt_idx for r in got} == greedy(det, gt, 0.3, by_score, strict)


def test_two_detections_of_one_box(spark):
    det = spark.createDataFrame([(0, 0, 0.0, 0.0, 10.0, 10.0, 0.5), (0, 1, 0.0, 0.0, 10.0, 10.0, 0.9)], SPEC)
    gt = spark.createDataFrame([(0, 0, 0.0, 0.0, 10.0, 10.0, 1.0)], SPEC)
    assert [r.matched for r in M.match_greedy(det, gt).orderBy("idx").collect()] == [False, True]
    ap = D.ap_per_image(det, gt).first()
    assert (ap.tp, ap.fp, ap.fn, ap.ap) == (1, 1, 0, 1.0)


def test_image_without_boxes_or_detections(spark):
    one = [(0, 0, 0.0, 0.0, 10.0, 10.0, 0.5)]
    full, none = spark.createDataFrame(one, SPEC), spark.createDataFrame([], SPEC)
    a = D.ap_per_image(full, none).first()
    assert (a.n_gt, a.tp, a.fp, a.fn, a.ap) == (0, 0, 0, 0, 0.0)
    b = D.ap_per_image(none, full).first()
    assert (b.n_gt, b.tp, b.fp, b.fn, b.ap) == (1, 0, 0, 1, 0.0)


def test_nms_chain_keeps_what_a_suppressed_box_overlaps(spark):
    rows = [(0, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (0, 1, 0.0, 3.0, 10.0, 13.0, 0.8), (0, 2, 0.0, 6.0, 10.0, 16.0, 0.7)]
    assert sorted(r.idx for r in G.nms(spark.createDataFrame(rows, SPEC), 0.5).collect()) == [0, 2]


def test_nms_against_brute_force(spark):
    rows = some(5)
    kept = set()
    for image in range(3):
        held = []
        for d in sorted((d for d in rows if d[0] == image), key=lambda d: (-d[6], d[1])):
            if all(iou(d[2:6], k[2:6]) < 0.4 for k in held):
                held.append(d)
        kept |= {(image, d[1]) for d in held}
    assert {(r.image, r.idx) for r in G.nms(spark.createDataFrame(rows, SPEC), 0.4).collect()} == kept


def test_union_penalises_what_only_one_side_has(spark):
    a = spark.createDataFrame([(0, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (0, 1, 0.0, 1.0, 10.0, 11.0, 0.8)], SPEC)
    none = spark.createDataFrame([], SPEC)
    for x, y in ((a, none), (none, a)):
        assert sorted(round(r.score, 9) for r in G.ensemble_union(x, y).collect()) == [0.56, 0.63]


def test_an_anchor_without_any_score_goes(spark):
    d = spark.createDataFrame([(0, 0, 0.0, 0.0, 10.0, 10.0, 0.0), (0, 1, 50.0, 50.0, 60.0, 60.0, 0.5)], SPEC)
    assert [(r.idx, r.score) for r in G.anchor_fusion(d).collect()] == [(1, 0.5)]


def test_consensus_of_three_raters_against_brute_force(spark):
    rows = [(i, j, *b, "abc"[j % 3]) for i, j, *b, _ in (r for seed in range(4) for r in some(seed))]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    d = spark.createDataFrame(rows, "image long, idx long, x1 double, y1 double, x2 double, y2 double, rater string")
    got = {(r.image, r.idx): (round(r.x1, 9), round(r.confidence, 9), r.n_matched, r.kind) for r in G.label_consensus(d, ["a", "b", "c"], 0.3).collect()}
    want = {}
    for image in {r[0] for r in rows}:
        sides = {k: sorted(r for r in rows if r[0] == image and r[6] == k) for k in "abc"}
        sides = {k: v for k, v in sides.items() if v}
        base, n, used = min(sides), len(sides), set()
        for r in sides[base]:
            group = [r]
            for k in sorted(sides):
                best = max(((iou(r[2:6], o[2:6]), -o[1], o) for o in sides[k] if k != base and o[:2] not in used), default=None)
                if best and best[0] >= 0.3:
                    used.add(best[2][:2])
                    group.append(best[2])
            m = len(group)
            want[r[:2]] = (round(sum(g[2] for g in group) / m, 9), round(0.5 if n == 1 else m / n, 9), m, "consensus" if m > 1 else "single")
        want |= {o[:2]: (round(o[2], 9), round(1 / n, 9), 1, "single") for k in sides if k != base for o in sides[k] if o[:2] not in used}
    assert got == want


def test_consensus(spark):
    from pyspark.sql import functions as F

    rows = [(0, 0, 0.0, 0.0, 10.0, 10.0, 1.0), (0, 1, 0.0, 0.0, 10.0, 10.0, 1.0), (0, 2, 50.0, 50.0, 60.0, 60.0, 1.0), (1, 0, 0.0, 0.0, 5.0, 5.0, 1.0)]
    b = spark.createDataFrame(rows, SPEC).withColumn("rater", F.when((F.col("idx") == 0), "a").otherwise("b"))
    got = {(r.image, r.kind, r.n_matched, r.confidence) for r in G.label_consensus(b, ["a", "b", "c"]).collect()}
    assert got == {(0, "consensus", 2, 1.0), (0, "single", 1, 0.5), (1, "single", 1, 0.5)}


def test_soft_nms_and_fusion_keep_disjoint_boxes(spark):
    rows = [(0, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (0, 1, 100.0, 100.0, 110.0, 110.0, 0.5), (0, 2, 0.0, 0.0, 10.0, 10.0, 0.4)]
    d = spark.createDataFrame(rows, SPEC)
    soft = {r.idx: r.score for r in G.soft_nms(d).collect()}
    assert soft[0] == 0.9 and soft[1] == 0.5 and soft[2] == pytest.approx(0.4 * 2.718281828 ** -2)
    assert sorted(r.n for r in G.anchor_fusion(d).collect()) == [1, 2]
    wbf = {r.n: r.score for r in G.weighted_boxes_fusion([d.where("idx < 2"), d.where("idx = 2")]).collect()}
    assert wbf[2] == pytest.approx(0.65) and wbf[1] == pytest.approx(0.25)
