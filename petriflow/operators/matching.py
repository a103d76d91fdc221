"""Joins between box sets by overlap, distance or tolerance. Boxes carry (image, idx, x1, y1, x2, y2[, score])."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petriflow.functions.lineage import checkpointed
from petriflow.operators.boxes import CORNERS, corners, iou

#: Side of a grid cell in pixels: near the usual box size, so that a box falls into few cells.
CELL = 128


def _side(boxes: DataFrame, prefix: str, cell: float, extra: list[str]) -> DataFrame:
    b = boxes.select("image", *(F.col(c).alias(prefix + c) for c in ("idx", *CORNERS, *extra)))
    cells = lambda a: F.sequence(F.floor(F.col(f"{prefix}{a}1") / cell), F.floor(F.col(f"{prefix}{a}2") / cell))
    return b.withColumn("cell_x", F.explode(cells("x"))).withColumn("cell_y", F.explode(cells("y")))


def iou_pairs(left: DataFrame, right: DataFrame, thr: float = 0.0, cell: float = CELL, left_extra: list[str] | None = None, right_extra: list[str] | None = None) -> DataFrame:
    """(image, l_*, r_*, iou) of overlapping pairs with iou >= ``thr`` (> 0 if that is 0).

    Both sides are put into the grid cells that they touch and joined on equal cells; a pair that meets in several is kept in the
    cell of its intersection's corner alone, so no pair needs to be made distinct.
    """
    a, b = _side(left, "l_", cell, left_extra or []), _side(right, "r_", cell, right_extra or [])
    j = a.join(b, ["image", "cell_x", "cell_y"])
    own = (F.floor(F.greatest("l_x1", "r_x1") / cell) == F.col("cell_x")) & (F.floor(F.greatest("l_y1", "r_y1") / cell) == F.col("cell_y"))
    j = j.where(own).withColumn("iou", iou(corners("l_"), corners("r_"))).drop("cell_x", "cell_y")
    return j.where(F.col("iou") >= thr if thr > 0 else F.col("iou") > 0)


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs in order of image, detection and preference to the ones taken: each detection takes its first reference box that is left."""
    image = det = None
    used: set[int] = set()
    for batch in batches:
        at = []
        for i, (im, d, r) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("image", "l_idx", "r_idx")), strict=True)):
            if im != image:
                image, det = im, None
                used.clear()
            if d != det and r not in used:
                used.add(r)
                det = d
                at.append(i)
        yield batch.take(pa.array(at, pa.int64()))


def match_greedy(det: DataFrame, gt: DataFrame, thr: float = 0.5, by_score: bool = True, strict: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """Detections with matched (boolean), gt_idx and match_iou under one-to-one greedy matching within each image.

    Pairs below ``thr`` can never win and go first; a task streams through its images' candidate pairs in order. by_score:
    highest score first (ties: lower idx), else input order (idx). strict: iou must exceed ``thr``.
    """
    pairs = iou_pairs(det, gt, thr, left_extra=["score"]) if pairs is None else pairs.where(F.col("iou") >= thr)
    if strict:
        pairs = pairs.where(F.col("iou") > thr)
    # One shuffle: whole images in a partition, each in order; the walk keeps one image's used boxes and nothing else.
    order = [F.desc("l_score"), "l_idx"] if by_score else ["l_idx"]
    ranked = pairs.repartition("image").sortWithinPartitions("image", *order, F.desc("iou"), "r_idx")
    found = ranked.select("image", "l_idx", "r_idx", "iou").mapInArrow(_greedy, "image long, l_idx long, r_idx long, iou double")
    return det.join(found.select("image", F.col("l_idx").alias("idx"), F.col("r_idx").alias("gt_idx"), F.col("iou").alias("match_iou")), ["image", "idx"], "left").withColumn("matched", F.col("gt_idx").isNotNull())


def match_best_any(det: DataFrame, gt: DataFrame, thr: float = 0.5) -> DataFrame:
    """Each detection takes its best reference box, used or not; of those that take one box the highest score is right, the rest are wrong."""
    pairs = iou_pairs(det, gt, thr, left_extra=["score"])
    best = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("image", "l_idx").orderBy(F.desc("iou"), "r_idx"))).where("_n = 1")
    first = best.withColumn("_n", F.row_number().over(Window.partitionBy("image", "r_idx").orderBy(F.desc("l_score"), "l_idx"))).withColumn("matched", F.col("_n") == 1)
    found = first.select("image", F.col("l_idx").alias("idx"), F.col("r_idx").alias("gt_idx"), F.col("iou").alias("match_iou"), "matched")
    return det.join(found, ["image", "idx"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


#: Reference boxes of an image up to which all of them meet a detection; those of a leaf of the search tree, and the tree's depth (16 cells a level).
WHOLE_IMAGE, LEAF, DEPTH = 256, 16, 10


def _centre(prefix: str, axis: str) -> Column:
    return (F.col(f"{prefix}{axis}1") + F.col(f"{prefix}{axis}2")) / 2


def _cell(level: int, axis: str) -> Column:
    """The cell of a centre on an axis at a level of its image's tree."""
    at = (F.col(f"c{axis}") - F.col(f"o{axis}")) / F.col("side") * 4**level
    return F.greatest(F.lit(0), F.least(F.lit(4**level - 1), F.floor(at))).cast("int")


def _to_box(low: bool) -> Column:
    """Distance of a point (px, py) to the nearest or the farthest point of the hull of a cell's centres."""
    if low:
        part = lambda a: F.greatest(F.lit(0.0), F.col(f"lo{a}") - F.col(f"p{a}"), F.col(f"p{a}") - F.col(f"hi{a}"))
    else:
        part = lambda a: F.greatest(F.abs(F.col(f"p{a}") - F.col(f"lo{a}")), F.abs(F.col(f"p{a}") - F.col(f"hi{a}")))
    return F.sqrt(F.pow(part("x"), 2) + F.pow(part("y"), 2))


def near_candidates(points: DataFrame, gt: DataFrame) -> DataFrame:
    """(image, row, gt_idx, g_ corners) for points (image, row, px, py): reference boxes, few a point, that hold the nearest one (ties: least gt_idx).

    All images' centres lie in trees of 16 cells a level. Points go down level by level: a cell is left out once another's farthest centre is
    nearer than its nearest one, so a point meets about the cells at its neighbour's distance, however many boxes the image has. Of boxes with one centre the
    least gt_idx stands for all.
    """
    ids = ["image", "gt_idx", *("g_" + c for c in CORNERS)]
    one = gt.groupBy("image", _centre("g_", "x").alias("cx"), _centre("g_", "y").alias("cy")).agg(F.min(F.struct("gt_idx", *ids[2:])).alias("b"))
    hull = one.groupBy("image").agg(F.min("cx").alias("ox"), F.min("cy").alias("oy"), F.greatest(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy"), F.lit(1e-300)).alias("side"))
    one = checkpointed(one.join(hull, "image").select("image", "cx", "cy", "ox", "oy", "side", "b.*"))
    open_ = points.withColumns({"in_x": F.lit(0), "in_y": F.lit(0), "bound": F.lit(float("inf"))})
    found = []
    for level in range(1, DEPTH + 1):
        cells = one.groupBy("image", _cell(level, "x").alias("x"), _cell(level, "y").alias("y")).agg(F.count("*").alias("n"), *(f(f"c{a}").alias(f"{n}{a}") for a in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))))
        cells = cells.withColumns({"in_x": F.floor(F.col("x") / 4).cast("int"), "in_y": F.floor(F.col("y") / 4).cast("int")})
        met = open_.join(cells, ["image", "in_x", "in_y"]).withColumn("far", _to_box(False)).withColumn("near", _to_box(True))
        best = F.least("bound", F.min("far").over(Window.partitionBy("image", "row")))
        left = met.withColumn("bound", best * (1 + 1e-12)).where("near <= bound").select(*points.columns, F.col("x").alias("in_x"), F.col("y").alias("in_y"), "bound", "n")
        left = checkpointed(left)
        ended = F.col("n") <= (LEAF if level < DEPTH else 2**62)
        leaf = left.where(ended).select("image", "row", "in_x", "in_y")
        found.append(leaf.join(one.withColumns({"in_x": _cell(level, "x"), "in_y": _cell(level, "y")}), ["image", "in_x", "in_y"]).select("row", *ids))
        open_ = left.where(~ended).drop("n")
        if open_.isEmpty():
            break
    return reduce(DataFrame.union, found).select("image", "row", *ids[1:])


def nearest_gt(fp: DataFrame, gt: DataFrame) -> DataFrame:
    """The nearest reference box of the image by centre distance: gt_idx, distance, gt_iou, dist_ratio, diagonal; infinite without one.

    In an image of up to `WHOLE_IMAGE` reference boxes a detection meets all of them, in a larger one those of `near_candidates`.
    """
    g = gt.select("image", F.col("idx").alias("gt_idx"), *(F.col(c).alias("g_" + c) for c in CORNERS))
    big = checkpointed(g.groupBy("image").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE_IMAGE).select("image"))
    longest = F.greatest(F.col("g_x2") - F.col("g_x1"), F.col("g_y2") - F.col("g_y1"))
    diagonal = F.sqrt(F.pow(F.col("g_x2") - F.col("g_x1"), 2) + F.pow(F.col("g_y2") - F.col("g_y1"), 2))
    inf = F.lit(float("inf"))
    near = ["gt_idx", "distance", *("g_" + c for c in CORNERS)]
    iou_ = F.when(F.col("gt_idx").isNotNull(), iou(corners(), corners("g_"))).otherwise(0.0)
    told = [*fp.columns, "gt_idx", F.coalesce("distance", inf).alias("distance"), iou_.alias("gt_iou"), F.coalesce(F.col("distance") / longest, inf).alias("dist_ratio"), F.coalesce(diagonal, F.lit(0.0)).alias("diagonal")]
    # An image's reference boxes, few, come as one array, so that no pair is a row that is shuffled or sorted.
    few = g if big.isEmpty() else g.join(big, "image", "left_anti")
    boxes = few.groupBy("image").agg(F.collect_list(F.struct("gt_idx", *("g_" + c for c in CORNERS))).alias("_g"))
    centre = lambda b, a: (b[f"g_{a}1"] + b[f"g_{a}2"]) / 2
    apart = lambda b: F.sqrt(F.pow(_centre("", "x") - centre(b, "x"), 2) + F.pow(_centre("", "y") - centre(b, "y"), 2))
    first = F.array_min(F.transform("_g", lambda b: F.struct(apart(b).alias("distance"), b["gt_idx"].alias("gt_idx"), *(b["g_" + c].alias("g_" + c) for c in CORNERS))))
    small = (fp if big.isEmpty() else fp.join(big, "image", "left_anti")).join(boxes, "image", "left")
    j = small.select(*fp.columns, first.alias("_b")).select(*fp.columns, *(F.col("_b." + c).alias(c) for c in near))
    if not big.isEmpty():
        rows = checkpointed(fp.join(big, "image", "left_semi").withColumn("row", F.monotonically_increasing_id()))
        some = near_candidates(rows.select("image", "row", _centre("", "x").alias("px"), _centre("", "y").alias("py")), g.join(big, "image", "left_semi"))
        met = rows.join(some, ["image", "row"])
        met = met.withColumn("distance", F.sqrt(F.pow(_centre("", "x") - _centre("g_", "x"), 2) + F.pow(_centre("", "y") - _centre("g_", "y"), 2)))
        best = met.groupBy("row", *fp.columns).agg(F.min(F.struct("distance", "gt_idx", *near[2:])).alias("_b"))
        j = j.unionByName(best.select(*fp.columns, *(F.col("_b." + c).alias(c) for c in near)))
    return j.select(*told)


def classify_false_positives(near: DataFrame) -> DataFrame:
    """category of `nearest_gt` rows; the order of the tests matters."""
    kind = F.when(F.col("gt_iou") >= 0.3, "partial_overlap").when(F.col("distance") < F.col("diagonal"), "near_miss").when(F.col("distance") < 2 * F.col("diagonal"), "vicinity").otherwise("isolated")
    return near.withColumn("category", kind)


def missed_candidates(classified: DataFrame, min_conf: float = 0.4) -> DataFrame:
    """False positives that may be annotations somebody missed, by image: n, mean confidence and counts by category."""
    hits = classified.where((F.col("score") > min_conf) & F.col("category").isin("partial_overlap", "near_miss"))
    count = lambda k: F.sum(F.when(F.col("category") == k, 1).otherwise(0)).alias(f"n_{k}")
    return hits.groupBy("image").agg(F.count("*").alias("n"), F.avg("score").alias("mean_confidence"), count("partial_overlap"), count("near_miss"))


def compare_labels(expected: DataFrame, actual: DataFrame, tol: float = 0.01) -> DataFrame:
    """By image: n_expected, n_actual, n_unmatched_expected, n_unmatched_actual and ok, where boxes match if all corners differ by less than ``tol``.

    Matching is not exclusive. Boxes are joined on coordinates rounded to the tolerance and its neighbours, not on the image alone.
    """
    a = expected.select("image", F.col("idx").alias("e_idx"), *(F.col(c).alias("e_" + c) for c in CORNERS))
    for c in ("x1", "y1"):
        at = F.floor(F.col("e_" + c) / tol)
        a = a.withColumn("_" + c, F.explode(F.array(at - 1, at, at + 1)))
    b = actual.select("image", F.col("idx").alias("a_idx"), *(F.col(c).alias("a_" + c) for c in CORNERS))
    for c in ("x1", "y1"):
        b = b.withColumn("_" + c, F.floor(F.col("a_" + c) / tol))
    hit = a.join(b, ["image", "_x1", "_y1"])
    for c in CORNERS:
        hit = hit.where(F.abs(F.col("e_" + c) - F.col("a_" + c)) < tol)
    e = expected.join(hit.select("image", F.col("e_idx").alias("idx")).distinct().withColumn("hit", F.lit(1)), ["image", "idx"], "left").groupBy("image").agg(F.count("*").alias("n_expected"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("n_unmatched_expected"))
    n = actual.join(hit.select("image", F.col("a_idx").alias("idx")).distinct().withColumn("hit", F.lit(1)), ["image", "idx"], "left").groupBy("image").agg(F.count("*").alias("n_actual"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("n_unmatched_actual"))
    out = e.join(n, "image", "full_outer").fillna(0)
    return out.withColumn("ok", (F.col("n_unmatched_expected") == 0) & (F.col("n_unmatched_actual") == 0))


def mask_iou_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(image, l_idx, r_idx, iou) of masks given as runs (image, idx, row, col_from, col_to), ends exclusive."""
    size = lambda d: d.groupBy("image", "idx").agg(F.sum(F.col("col_to") - F.col("col_from")).alias("area"))
    a = left.select("image", "row", F.col("idx").alias("l_idx"), F.col("col_from").alias("l_from"), F.col("col_to").alias("l_to"))
    b = right.select("image", "row", F.col("idx").alias("r_idx"), F.col("col_from").alias("r_from"), F.col("col_to").alias("r_to"))
    both = F.least("l_to", "r_to") - F.greatest("l_from", "r_from")
    inter = a.join(b, ["image", "row"]).where(both > 0).groupBy("image", "l_idx", "r_idx").agg(F.sum(both).alias("inter"))
    j = inter.join(size(left).select("image", F.col("idx").alias("l_idx"), F.col("area").alias("l_area")), ["image", "l_idx"])
    j = j.join(size(right).select("image", F.col("idx").alias("r_idx"), F.col("area").alias("r_area")), ["image", "r_idx"])
    return j.select("image", "l_idx", "r_idx", (F.col("inter") / (F.col("l_area") + F.col("r_area") - F.col("inter"))).alias("iou"))


def label_by_iou_band(det: DataFrame, ref: DataFrame, pos: float = 0.5, neg: float = 0.1, rescue_quality: float = 0.8, rescue_iou: float = 0.3, rescue_score: float = 0.05) -> DataFrame:
    """(image, idx, score, best_iou, target, rescued): 1 from ``pos`` up, 0 below ``neg``, the band between dropped.

    Reference boxes of quality ``rescue_quality`` that no detection overlaps by ``rescue_iou`` come in as positives of a low score.
    """
    pairs = iou_pairs(det, ref)
    best = pairs.groupBy("image", F.col("l_idx").alias("idx")).agg(F.max("iou").alias("best_iou"))
    d = det.join(best, ["image", "idx"], "left").fillna(0.0, ["best_iou"])
    d = d.withColumn("target", F.when(F.col("best_iou") >= pos, 1).when(F.col("best_iou") < neg, 0)).where("target is not null")
    seen = pairs.where(F.col("iou") >= rescue_iou).select("image", F.col("r_idx").alias("idx"))
    saved = ref.where(F.col("quality") >= rescue_quality).join(seen, ["image", "idx"], "left_anti")
    return d.select("image", "idx", "score", "best_iou", "target", F.lit(False).alias("rescued")).unionByName(saved.select("image", "idx", F.lit(rescue_score).alias("score"), F.lit(0.0).alias("best_iou"), F.lit(1).alias("target"), F.lit(True).alias("rescued")))


def mine_hard_negatives(det: DataFrame, gt: DataFrame, width: float, height: float, thr: float = 0.3) -> DataFrame:
    """Crop windows, half a side wider all round, of detections that match nothing at ``thr`` in input order; named image_idx."""
    from petriflow.operators.boxes import crop_window

    fp = match_greedy(det, gt, thr, by_score=False).where(~F.col("matched"))
    return crop_window(fp, width, height, 0.5, True, 10).withColumn("name", F.concat_ws("_", "image", "idx"))


def merge_new(originals: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """All originals, and the new rows whose key no original has."""
    return originals.unionByName(new.join(originals.select(key), key, "left_anti"), allowMissingColumns=True)
