"""Detection metrics from matched detections."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petriflow.functions.grid import all_pairs_of_keys, with_each
from petriflow.functions.lineage import checkpointed
from petriflow.operators.boxes import CORNERS
from petriflow.operators.matching import iou_pairs, match_best_any, match_greedy
from petriflow.operators.merging import AT_ONCE, _meeting
from petriflow.operators.ranking import running_totals


def ap_from_matches(matched: DataFrame, gt_counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_gt, tp, fp, fn, ap) from rows with matched and score: all-point average precision under the precision envelope.

    A group without reference boxes counts nothing and has ap 0; one without detections has fn = n_gt.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "idx")
    m = matched.join(gt_counts.where("n_gt > 0"), keys).withColumn("tp", F.col("matched").cast("long"))
    m = m.withColumn("_rank", F.row_number().over(order)).withColumn("_tp", F.sum("tp").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("_p", F.col("_tp") / F.col("_rank"))
    # The envelope runs from the last row back: Spark computes a frame that ends at the last row anew for each row.
    back = Window.partitionBy(*keys).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("_env", F.max("_p").over(back))
    a = m.groupBy(*keys).agg(F.sum("tp").alias("tp"), F.sum(1 - F.col("tp")).alias("fp"), F.sum(F.when(F.col("tp") == 1, F.col("_env")).otherwise(0.0)).alias("_area"))
    out = gt_counts.join(a, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    fn = (F.col("n_gt") - F.coalesce("tp", F.lit(0))).cast("long").alias("fn")
    return out.select(*keys, F.col("n_gt").cast("long").alias("n_gt"), zero("tp"), zero("fp"), fn, F.when(F.col("n_gt") > 0, F.coalesce("_area", F.lit(0.0)) / F.col("n_gt")).otherwise(0.0).alias("ap"))


def gt_counts(det: DataFrame, gt: DataFrame, keys: list[str]) -> DataFrame:
    """Every group of either side with its number of reference boxes."""
    n = gt.groupBy(*keys).agg(F.count("*").alias("n_gt"))
    return n.unionByName(det.select(*keys).distinct().join(n, keys, "left_anti").withColumn("n_gt", F.lit(0).cast("long")))


def ap_per_image(det: DataFrame, gt: DataFrame, thr: float = 0.5, pairs: DataFrame | None = None) -> DataFrame:
    return ap_from_matches(match_greedy(det, gt, thr, pairs=pairs), gt_counts(det, gt, ["image"]), ["image"])


def map_range(det: DataFrame, gt: DataFrame, thresholds: tuple[float, ...] = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))) -> DataFrame:
    """(image, thr, ap): matching is run again for each threshold, on pairs that are found once. A threshold is part of the group key."""
    pairs = iou_pairs(det, gt, min(thresholds), left_extra=["score"])
    n = len(thresholds)
    steps = [(float(t), i) for i, t in enumerate(thresholds)]
    many = lambda d: with_each(d, ["thr", "k"], steps).withColumn("image", F.col("image") * n + F.col("k")).drop("k")
    # What is multiplied is narrow: of boxes their place and score, of the counts a row an image.
    narrow = pairs.select("image", "l_idx", "r_idx", "l_score", "iou")
    d = many(det.select("image", "idx", "score")).drop("thr")
    matched = match_greedy(d, gt, 0.0, pairs=many(narrow).where(F.col("iou") >= F.col("thr")).drop("thr"))
    ap = ap_from_matches(matched, many(gt_counts(det, gt, ["image"])).drop("thr"), ["image"])
    out = ap.withColumn("k", F.col("image") % n).withColumn("image", F.floor(F.col("image") / n))
    out = out.withColumn("thr", F.get(F.array(*(F.lit(float(t)) for t in thresholds)), F.col("k").cast("int")))
    return out.select("image", "thr", "ap", "tp", "fp", "fn")


def ap_101_pooled(det: DataFrame, gt: DataFrame, thr: float = 0.5, cls: str = "cls") -> DataFrame:
    """(cls, n_gt, ap): images pooled by class, `match_best_any` within image and class, 101 recall points; a class without reference boxes has 0.

    The pooled order is taken over distinct scores (counts first), by `running_totals`: no window holds a whole class.
    """
    key = F.concat_ws("/", "image", cls)
    matched = match_best_any(det.withColumn("_i", F.col("image")).withColumn("image", key), gt.withColumn("image", key), thr)
    g = gt.groupBy(cls).agg(F.count("*").alias("n_gt"))
    steps = checkpointed(matched.groupBy(cls, "score").agg(F.sum(F.col("matched").cast("long")).alias("t"), F.count("*").alias("n")))
    run = running_totals(steps, [cls], "score", ["t", "n"]).withColumn("precision", F.col("cum_t") / F.col("cum_n"))
    run = running_totals(checkpointed(run), [cls], "score", ["precision"], descending=False, most_so_far=True).join(g, cls)
    # The envelope at recall r is that of the first step that reaches r; each step fills the points after the one before, the first one point 0 as well.
    reached = lambda t: F.floor(t / F.col("n_gt") * 100 + 1e-9)
    points = reached(F.col("cum_t")) - F.when(F.col("cum_n") == F.col("n"), F.lit(-1)).otherwise(reached(F.col("cum_t") - F.col("t")))
    ap = run.withColumn("_points", points.cast("double")).groupBy(cls).agg((F.sum(F.col("_points") * F.col("cum_precision")) / 101).alias("ap"))
    classes = det.select(cls).union(gt.select(cls)).distinct()
    return classes.join(g, cls, "left").join(ap, cls, "left").select(cls, F.coalesce("n_gt", F.lit(0)).alias("n_gt"), F.coalesce("ap", F.lit(0.0)).alias("ap"))


def prf_summary(per_image: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and F1 of summed counts, and the mean ap over images."""
    s = per_image.groupBy(*by).agg(F.count("*").alias("n_images"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("ap").alias("map"))
    return _rates(s)


def _rates(s: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    s = s.withColumn("precision", F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)).withColumn("recall", F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0))
    p, r = F.col("precision"), F.col("recall")
    return s.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


# The filter sets of the sweep by name; least confidence, circularity, solidity and aspect ratio.
FILTERS: dict[str, tuple[float, float, float, float]] = {
    "baseline (no filter)": (0.0, 0.0, 0.0, 0.0),
    "conf>=0.4": (0.4, 0.0, 0.0, 0.0),
    "conf>=0.5": (0.5, 0.0, 0.0, 0.0),
    "conf>=0.6": (0.6, 0.0, 0.0, 0.0),
    "circ>=0.3": (0.0, 0.3, 0.0, 0.0),
    "circ>=0.4": (0.0, 0.4, 0.0, 0.0),
    "circ>=0.5": (0.0, 0.5, 0.0, 0.0),
    "solid>=0.90": (0.0, 0.0, 0.90, 0.0),
    "solid>=0.95": (0.0, 0.0, 0.95, 0.0),
    "ar>=0.5": (0.0, 0.0, 0.0, 0.5),
    "ar>=0.6": (0.0, 0.0, 0.0, 0.6),
    "conf>=0.4 + circ>=0.3": (0.4, 0.3, 0.0, 0.0),
    "conf>=0.4 + solid>=0.90": (0.4, 0.0, 0.90, 0.0),
    "conf>=0.4 + ar>=0.5": (0.4, 0.0, 0.0, 0.5),
    "conf>=0.5 + circ>=0.3": (0.5, 0.3, 0.0, 0.0),
    "conf>=0.5 + solid>=0.90": (0.5, 0.0, 0.90, 0.0),
    "conf>=0.4 + circ>=0.3 + solid>=0.90": (0.4, 0.3, 0.90, 0.0),
    "conf>=0.4 + circ>=0.3 + ar>=0.5": (0.4, 0.3, 0.0, 0.5),
    "conf>=0.5 + circ>=0.3 + solid>=0.90": (0.5, 0.3, 0.90, 0.0),
}


#: Images whose boxes come to a task's sweep at once, filters whose answers are bits of one number, and numbers of a table of a sweep at most, about.
TOGETHER, BITS, SWEPT = 16, 62, 1 << 21


def filter_sweep(det: DataFrame, gt: DataFrame, filters: dict[str, tuple[float, float, float, float]] | None = None, thr: float = 0.5) -> DataFrame:
    """One `prf_summary` row for each named filter: detections are filtered and matched anew."""
    measures = ["score", "circularity", "solidity", "aspect_ratio"]
    g = F.floor(F.col("image") / TOGETHER).alias("g")
    d = det.select(g, "image", "idx", *CORNERS, *measures, F.lit(True).alias("detected"))
    r = gt.select(g, "image", "idx", *CORNERS, *(F.lit(None).cast("double").alias(c) for c in measures), F.lit(False).alias("detected"))
    return filter_sweep_together(d.unionByName(r), filters, thr)


def filter_sweep_together(rows: DataFrame, filters: dict[str, tuple[float, float, float, float]] | None = None, thr: float = 0.5) -> DataFrame:
    """`filter_sweep` of detections and, where not ``detected``, reference boxes in one table; an image's rows have one number g, few images each.

    A box comes once, with a bit for each filter that it passes; neither boxes nor pairs are multiplied by the filters. Rows that lie by g (`boxes` with
    ``together``) are not shuffled again, and of a task's images only sums by filter are.
    """
    filters = FILTERS if filters is None else filters
    names, bits = list(filters), []
    for low in range(0, len(names), BITS):
        bit = F.lit(0).cast("long")
        for i, name in enumerate(names[low : low + BITS]):
            passes = reduce(and_, (F.coalesce(F.col(c), F.lit(0.0)) >= float(least) for c, least in zip(("score", "circularity", "solidity", "aspect_ratio"), filters[name], strict=True)))
            bit = bit + F.when(passes, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        bits.append(bit.alias(f"_m{low // BITS}"))
    narrow = rows.select("g", "image", "idx", *CORNERS, "detected", "score", *bits)
    schema = "k int, n_images long, tp long, fp long, fn long, ap double"
    part = narrow.groupBy("g").applyInArrow(_swept(len(names), thr), schema)
    s = part.groupBy("k").agg(*(F.sum(c).alias(c) for c in ("n_images", "tp", "fp", "fn")), (F.sum("ap") / F.sum("n_images")).alias("map"))
    config = F.get(F.array(*(F.lit(x) for x in names)), F.col("k")).alias("config")
    return _rates(s.select(config, "n_images", "tp", "fp", "fn", "map"))


def _swept(n: int, thr: float):
    """Counts and the sum of average precisions of some images' boxes by filter, for filters with an image only."""

    def run(rows: pa.Table) -> pa.Table:
        of = lambda c: rows[c].to_numpy()
        image, idx, detected, score = of("image"), of("idx"), of("detected").astype(bool), of("score").astype(float)
        # Highest score first; one that is not a number counts as the highest, and without one as the lowest, as in an order by score.
        last = np.where(np.isnan(score), np.where(rows["score"].is_null().to_numpy(), np.inf, -np.inf), -score)
        order = np.lexsort((idx, np.where(detected, last, 0), ~detected, image))
        image, detected, box = image[order], detected[order], np.column_stack([of(c).astype(float) for c in CORNERS])[order]
        masks = [of(f"_m{i}")[order] for i in range(-(-n // BITS))]
        passes = [int(m) for m in masks[0]] if len(masks) == 1 else [sum(int(v) << BITS * i for i, v in enumerate(m)) for m in zip(*masks, strict=True)]
        starts = np.flatnonzero(np.r_[True, image[1:] != image[:-1]])
        ends = np.r_[starts[1:], len(image)]
        n_det = np.add.reduceat(detected.astype(np.int64), starts)
        n_gt = ends - starts - n_det
        right = [0] * len(image)  # the filters under which a detection takes a reference box
        for low, high, k in zip(starts[n_gt > 0].tolist(), ends[n_gt > 0].tolist(), n_det[n_gt > 0].tolist(), strict=True):
            i, j, o = _close(box[low : low + k], box[low + k : high], thr) if k else ((), (), ())
            used: dict[int, int] = {}
            if len(i):
                free = dict.fromkeys(i.tolist())
                free = {p: passes[low + p] for p in free}
                # Detections in order, each with its reference boxes from the most overlap on: all filters' walks at once, by a bit each.
                along = np.lexsort((j, -o, i))
                for p, q in zip(i[along].tolist(), j[along].tolist(), strict=True):
                    takes = free[p] & ~used.get(q, 0)
                    if takes:
                        used[q] = used.get(q, 0) | takes
                        free[p] &= ~takes
                        right[low + p] |= takes
        at = np.repeat(np.arange(len(starts)), ends - starts)
        at, told = at[detected], np.flatnonzero(detected)
        first = np.cumsum(n_det) - n_det
        some = np.flatnonzero(n_det > 0)
        out = np.zeros((n, 4), np.int64)
        area = np.zeros(n)
        step = max(1, SWEPT // max(1, len(told)))
        for low in range(0, n, step):
            few = range(low, min(n, low + step))
            has = _bits([passes[i] for i in told.tolist()], few)
            tp = _bits([right[i] for i in told.tolist()], few)
            n_has, n_tp = np.zeros((len(starts), len(few)), np.int64), np.zeros((len(starts), len(few)), np.int64)
            if len(some):
                n_has[some], n_tp[some] = np.add.reduceat(has, first[some]), np.add.reduceat(tp, first[some])
            known = (n_gt > 0)[:, None]
            out[low : low + step] = np.stack([(known | (n_has > 0)).sum(0), n_tp.sum(0), np.where(known, n_has - n_tp, 0).sum(0), np.where(known, n_gt[:, None] - n_tp, 0).sum(0)], 1)
            if len(some):
                # Rank and right ones so far within the image, and from the last back the best precision; images are kept apart by whole numbers.
                rank, good = (np.cumsum(c, 0) - (np.cumsum(s, 0) - s)[at] for c, s in ((has, n_has), (tp, n_tp)))
                precision = np.where(has > 0, good / np.maximum(rank, 1), 0)
                place = 2.0 * (len(starts) - at)[:, None]
                best = np.maximum.accumulate((precision + place)[::-1])[::-1] - place
                area[low : low + step] = (np.where(tp > 0, best, 0) / np.maximum(n_gt, 1)[at][:, None]).sum(0)
        kept = out[:, 0] > 0
        counts = {c: out[kept, i] for i, c in enumerate(("n_images", "tp", "fp", "fn"))}
        return pa.table({"k": np.flatnonzero(kept).astype(np.int32), **counts, "ap": area[kept]})

    return run


def _bits(numbers: list[int], which: range) -> np.ndarray:
    """The bits ``which`` of numbers, of any length, as columns of 0 and 1."""
    if which.stop <= BITS:
        return (np.array(numbers, np.int64)[:, None] >> np.array(which)[None]) & 1
    return np.array([[v >> i & 1 for i in which] for v in numbers], np.int64).reshape(len(numbers), len(which))


def _close(b: np.ndarray, c: np.ndarray, thr: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `_meeting`; where there are many boxes, some from left to right meet only those that their stretch may touch."""
    if len(b) * len(c) <= AT_ONCE**2:
        return _meeting(b, c, thr)
    p, q = np.argsort(b[:, 0], kind="stable"), np.argsort(c[:, 0], kind="stable")
    left, wide, found = c[q, 0], (c[:, 2] - c[:, 0]).max(), []
    for low in range(0, len(p), AT_ONCE):
        some = p[low : low + AT_ONCE]
        near = q[np.searchsorted(left, b[some[0], 0] - wide) : np.searchsorted(left, b[some, 2].max(), "right")]
        if len(near):
            i, j, o = _meeting(b[some], c[near], thr)
            found.append((some[i], near[j], o))
    none = np.empty(0, int)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, np.empty(0))  # type: ignore[return-value]


def pool_experiments(per_batch: DataFrame, batch: str = "batch") -> DataFrame:
    """Counts by batch and in total (null batch) with precision, recall and F1."""
    return _rates(per_batch.rollup(batch).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))


def detection_summary(det: DataFrame) -> DataFrame:
    """One row: total, mean confidence and mean, least and largest area; zeros for no detections."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    s = det.agg(F.count("*").alias("total"), F.avg("score").alias("mean_confidence"), F.avg(area).alias("mean_area"), F.min(area).alias("min_area"), F.max(area).alias("max_area"))
    return s.fillna(0.0)


def class_counts(det: DataFrame, cls: str = "cls") -> DataFrame:
    return det.groupBy(cls).agg(F.count("*").alias("n"), F.avg("score").alias("mean_confidence"))


def confusion_matrix(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) for every pair of classes that occur, zeros included. Classes are few."""
    n = rows.groupBy(actual, predicted).agg(F.count("*").alias("n"))
    classes = n.select(F.col(actual).alias("c")).union(n.select(predicted))
    grid = all_pairs_of_keys(classes.withColumn("d", F.col("c")), "c", "d", actual, predicted)
    return grid.join(n, [actual, predicted], "left").fillna(0, ["n"])


def per_class_accuracy(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Recall of each class that is actual or predicted; 0 without rows."""
    right = F.sum((F.col(actual) == F.col(predicted)).cast("long"))
    a = rows.groupBy(F.col(actual).alias("cls")).agg(F.count("*").alias("n"), right.alias("n_right"))
    other = rows.select(F.col(predicted).alias("cls")).distinct().join(a, "cls", "left_anti").select("cls", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_right"))
    return a.unionByName(other).withColumn("accuracy", F.when(F.col("n") > 0, F.col("n_right") / F.col("n")).otherwise(0.0))


