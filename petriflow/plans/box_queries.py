"""Registered queries over boxes: tiling, matching, merging, detection metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petriflow.operators import boxes as B
from petriflow.operators import det_metrics as D
from petriflow.operators import matching as M
from petriflow.operators import merging as G
from petriflow.operators import tiling as T
from petriflow.plans import standins as S
from petriflow.plans import walk_sql

IOU = """(CASE WHEN (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) > 0
  THEN greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) /
  ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))) ELSE 0 END)"""

#: Pairs of model boxes and ground truth; every table is made once.
PAIRS = f"""WITH {S.BOXES.strip().replace("boxes AS (", "boxes AS MATERIALIZED (", 1)},
det AS MATERIALIZED (SELECT * FROM boxes WHERE role = 'R'), gt AS MATERIALIZED (SELECT * FROM boxes WHERE role = 'N'),
pairs AS MATERIALIZED (SELECT a.image, a.idx AS d, b.idx AS g, a.score, {IOU} AS iou FROM det a JOIN gt b ON a.image = b.image AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2)"""

#: The same, the greedy match in score order as a walk over each image's candidate detections, and all detections with it.
GREEDY = f"""WITH RECURSIVE {S.BOXES},
det AS (SELECT * FROM boxes WHERE role = 'R'), gt AS (SELECT * FROM boxes WHERE role = 'N'),
pairs AS (SELECT a.image, a.idx AS d, b.idx AS g, a.score, {IOU} AS iou FROM det a JOIN gt b ON a.image = b.image AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2),
cand AS (SELECT *, dense_rank() OVER (PARTITION BY image ORDER BY score DESC, d) AS n FROM pairs WHERE iou >= 0.5),
walk AS (
  SELECT image, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS d, NULL::BIGINT AS g FROM cand GROUP BY image
  UNION ALL
  SELECT image, n, CASE WHEN g IS NULL THEN used ELSE list_append(used, g) END, d, g FROM (
    SELECT w.image, w.n + 1 AS n, w.used, c.d AS d, (min({{'i': -c.iou, 'g': c.g}}) FILTER (WHERE NOT list_contains(w.used, c.g))).g AS g
    FROM walk w JOIN cand c ON c.image = w.image AND c.n = w.n + 1 GROUP BY w.image, w.n, w.used, c.d)),
matched AS (SELECT det.*, walk.g AS gt_idx, walk.g IS NOT NULL AS matched FROM det LEFT JOIN walk ON det.image = walk.image AND det.idx = walk.d)"""

AP = """ngt AS (SELECT image, count(*) AS n_gt FROM gt GROUP BY image),
every AS (SELECT image, n_gt FROM ngt UNION ALL SELECT DISTINCT image, 0 FROM det WHERE image NOT IN (SELECT image FROM ngt)),
run AS (SELECT m.image, matched::INT AS tp, idx, score, n_gt, sum(matched::INT) OVER o / row_number() OVER o AS p FROM matched m JOIN ngt USING (image) WINDOW o AS (PARTITION BY m.image ORDER BY score DESC, idx ROWS UNBOUNDED PRECEDING)),
env AS (SELECT *, max(p) OVER (PARTITION BY image ORDER BY score DESC, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM run),
area AS (SELECT image, sum(tp) AS tp, sum(1 - tp) AS fp, sum(CASE WHEN tp = 1 THEN e ELSE 0 END) AS s FROM env GROUP BY image),
ap AS (SELECT image, n_gt::BIGINT AS n_gt, coalesce(tp, 0)::BIGINT AS tp, coalesce(fp, 0)::BIGINT AS fp, (n_gt - coalesce(tp, 0))::BIGINT AS fn, CASE WHEN n_gt > 0 THEN coalesce(s, 0) / n_gt ELSE 0 END AS ap FROM every LEFT JOIN area USING (image))"""


_SHAPE = ("area", "perimeter", "circularity", "aspect_ratio", "solidity")


def _notched(b: DataFrame) -> DataFrame:
    """Boxes without a corner: polygons that are not convex, with hulls that cut the notch in half."""
    x, y = (F.col(f"{a}2") - (F.col(f"{a}2") - F.col(f"{a}1")) * (3 - F.col("idx") % n) / 4 for a, n in (("x", 3), ("y", 2)))
    return b.select("image", "idx", F.array("x1", "x2", "x2", x, x, "x1").alias("xs"), F.array("y1", "y1", y, y, "y2", "y2").alias("ys"))


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = S.boxes(spark, d)
    return tuple(b.where(F.col("role") == r) for r in ("R", "A", "N"))  # type: ignore[return-value]


def r9(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


def detection_quality(spark: SparkSession, d: str) -> DataFrame:
    r, _, n = _split(spark, d)
    return r9(D.prf_summary(D.ap_per_image(r, n).withColumn("model", F.lit("R")), ["model"]), "map", "precision", "recall", "f1")


def _images(spark: SparkSession, d: str) -> DataFrame:
    return S.boxes(spark, d).select("image").distinct().select("image", (1000 + F.col("image") % 100).cast("int").alias("width"), (700 + F.col("image") % 500).cast("int").alias("height"), F.when(F.col("image") % 5 == 0, "test").otherwise("train").alias("split"))


_IMAGES = "images AS (SELECT image, (1000 + image % 100)::INT AS width, (700 + image % 500)::INT AS height, CASE WHEN image % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM (SELECT DISTINCT image FROM boxes))"
_TILES = "tiles AS (SELECT image, split, tx, ty, least(320, width - tx)::INT AS tw, least(320, height - ty)::INT AS th FROM (SELECT *, unnest(range(0, height, 320))::INT AS ty FROM (SELECT *, unnest(range(0, width, 320))::INT AS tx FROM images)) WHERE least(320, width - tx) >= 160 AND least(320, height - ty) >= 160)"
_PLACED = """placed AS (SELECT image, tx, ty, idx, least(greatest(x1 - tx, 0), 320) AS x1, least(greatest(y1 - ty, 0), 320) AS y1, least(greatest(x2 - tx, 0), 320) AS x2, least(greatest(y2 - ty, 0), 320) AS y2
  FROM boxes JOIN tiles USING (image) WHERE role = 'N' AND (x1 + x2) / 2 >= tx AND (x1 + x2) / 2 < tx + 320 AND (y1 + y2) / 2 >= ty AND (y1 + y2) / 2 < ty + 320)"""


def _tiles(spark, d):
    return T.tile_grid(_images(spark, d), 320, 320).select("image", "split", "tx", "ty", "tw", "th")


def _placed(spark, d, boundary=True):
    gt = S.boxes(spark, d).where("role = 'N'").select("image", "idx", "x1", "y1", "x2", "y2")
    return T.assign_boxes_to_tiles(gt, _tiles(spark, d), 320, 320, boundary)


def _runs(b: DataFrame) -> DataFrame:
    """Masks of boxes: every tenth row as one run."""
    rows = F.explode(F.sequence(F.ceil(F.col("y1") / 10).cast("int"), F.floor(F.col("y2") / 10).cast("int"))).alias("row")
    return b.select("image", "idx", rows, F.col("x1").cast("long").alias("col_from"), F.col("x2").cast("long").alias("col_to"))


_RUN = "SELECT image, idx, unnest(range(ceil(y1 / 10)::INT, floor(y2 / 10)::INT + 1)) AS row, x1::BIGINT AS f, x2::BIGINT AS t FROM boxes WHERE role = "

QUERIES = {
    "detection_quality": (detection_quality, f"""{GREEDY}, {AP}, s AS (SELECT count(*) AS n_images, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, avg(ap) AS map FROM ap)
SELECT 'R' AS model, n_images, tp, fp, fn, round(map, 9) AS map, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1 FROM s"""),
    "match_greedy": (lambda s, d: (lambda r, a, n: M.match_greedy(r, n).select("image", "idx", "matched", "gt_idx"))(*_split(s, d)), f"{GREEDY} SELECT image, idx, matched, gt_idx FROM matched"),
    "ap_per_image": (lambda s, d: (lambda r, a, n: r9(D.ap_per_image(r, n), "ap"))(*_split(s, d)), f"{GREEDY}, {AP} SELECT image, n_gt, tp, fp, fn, round(ap, 9) AS ap FROM ap"),
    "iou_pairs": (lambda s, d: (lambda r, a, n: M.iou_pairs(r, n, 0.3).select("image", "l_idx", "r_idx", F.round("iou", 9).alias("iou")))(*_split(s, d)), f"{PAIRS} SELECT image, d AS l_idx, g AS r_idx, round(iou, 9) AS iou FROM pairs WHERE iou >= 0.3"),
    "box_formats": (lambda s, d: (lambda b: b.select("image", "idx", *B.centre_from_corners(1000.0, 1000.0)).select("image", "idx", *(F.round(c, 9).alias(c) for c in ("xc", "yc", "w", "h"))))(S.boxes(s, d)), f"WITH {S.BOXES} SELECT image, idx, round((x1 + x2) / 2 / 1000, 9) AS xc, round((y1 + y2) / 2 / 1000, 9) AS yc, round((x2 - x1) / 1000, 9) AS w, round((y2 - y1) / 1000, 9) AS h FROM boxes"),
    "box_round_trip": (lambda s, d: S.boxes(s, d).select("image", "idx", *B.centre_from_corners(1000.0, 1000.0)).select("image", "idx", *B.corners_from_centre("xc", "yc", "w", "h", 1000.0, 1000.0, True)).select("image", "idx", *(F.round(c, 6).alias(c) for c in B.CORNERS)), f"WITH {S.BOXES} SELECT image, idx, least(x1, 1000) AS x1, least(y1, 1000) AS y1, least(x2, 1000) AS x2, least(y2, 1000) AS y2 FROM boxes"),
    "clip_and_drop": (lambda s, d: B.clip_and_drop(S.boxes(s, d), 900, 900, 80).select("image", "idx", *B.CORNERS), f"WITH {S.BOXES} SELECT image, idx, greatest(x1, 0) AS x1, greatest(y1, 0) AS y1, least(x2, 900) AS x2, least(y2, 900) AS y2 FROM boxes WHERE x2 - x1 >= 80 AND y2 - y1 >= 80 AND x2 > 0 AND y2 > 0 AND x1 < 900 AND y1 < 900"),
    "crop_window": (lambda s, d: B.crop_window(S.boxes(s, d), 1000, 1000, 0.5, True, 100).select("image", "idx", "cx1", "cy1", "cx2", "cy2"), f"WITH {S.BOXES}, c AS (SELECT image, idx, greatest(0, trunc(x1 - (x2 - x1) * 0.5))::INT AS cx1, greatest(0, trunc(y1 - (y2 - y1) * 0.5))::INT AS cy1, least(1000, trunc(x2 + (x2 - x1) * 0.5))::INT AS cx2, least(1000, trunc(y2 + (y2 - y1) * 0.5))::INT AS cy2 FROM boxes) SELECT * FROM c WHERE cx2 - cx1 >= 100 AND cy2 - cy1 >= 100"),
    "filter_by_morphology": (lambda s, d: B.filter_by_morphology(S.boxes(s, d), 0.2, 0.2, 0.2, 0.6).select("image", "idx"), f"WITH {S.BOXES} SELECT image, idx FROM boxes WHERE score >= 0.2 AND circularity >= 0.2 AND solidity >= 0.2 AND aspect_ratio >= 0.6"),
    "out_of_bounds": (lambda s, d: B.out_of_bounds(S.boxes(s, d).withColumns({c: F.col(c) / 1000 for c in B.CORNERS})).select("image", "idx"), f"WITH {S.BOXES} SELECT image, idx FROM boxes WHERE x1 < 0 OR y1 < 0 OR x2 > 1000 OR y2 > 1000"),
    "shape_measures_notched": (
        lambda s, d: r9(B.shape_measures(_notched(S.boxes(s, d))).select("image", "idx", *_SHAPE), *_SHAPE),
        f"""WITH {S.BOXES}, n AS (SELECT image, idx, x2 - x1 AS w, y2 - y1 AS h, (x2 - x1) * (3 - idx % 3) / 4 * (y2 - y1) * (3 - idx % 2) / 4 AS cut FROM boxes)
SELECT image, idx, round(w * h - cut, 9) AS area, round(2 * (w + h), 9) AS perimeter, round(pi() * (w * h - cut) / pow(w + h, 2), 9) AS circularity, round(least(w, h) / greatest(w, h), 9) AS aspect_ratio,
  round((w * h - cut) / (w * h - cut / 2), 9) AS solidity FROM n""",
    ),
    "shape_measures": (lambda s, d: B.shape_measures(S.boxes(s, d).select("image", "idx", F.array("x1", "x2", "x2", "x1").alias("xs"), F.array("y1", "y1", "y2", "y2").alias("ys"))).select("image", "idx", *(F.round(c, 9).alias(c) for c in ("area", "perimeter", "circularity", "aspect_ratio", "solidity"))), f"WITH {S.BOXES} SELECT image, idx, (x2 - x1) * (y2 - y1) AS area, 2 * (x2 - x1 + y2 - y1) AS perimeter, round(4 * pi() * (x2 - x1) * (y2 - y1) / pow(2 * (x2 - x1 + y2 - y1), 2), 9) AS circularity, round(aspect_ratio, 9) AS aspect_ratio, 1.0::DOUBLE AS solidity FROM boxes"),
    "tile_grid": (_tiles, f"WITH {S.BOXES}, {_IMAGES}, {_TILES} SELECT image, split, tx, ty, tw, th FROM tiles"),
    "sliding_windows": (lambda s, d: T.sliding_windows(_images(s, d), 512, 0.3).select("image", "tx", "ty", "tw", "th"), f"WITH {S.BOXES}, {_IMAGES} SELECT image, tx, ty, least(512, width - tx)::INT AS tw, least(512, height - ty)::INT AS th FROM (SELECT *, unnest(range(0, height, 358))::INT AS ty FROM (SELECT *, unnest(range(0, width, 358))::INT AS tx FROM images)) WHERE least(512, width - tx) >= 256 AND least(512, height - ty) >= 256"),
    "assign_boxes_to_tiles": (lambda s, d: _placed(s, d).select("image", "tx", "ty", "idx", *B.CORNERS), f"WITH {S.BOXES}, {_IMAGES}, {_TILES}, {_PLACED} SELECT image, tx, ty, idx, x1, y1, x2, y2 FROM placed WHERE x2 - x1 >= 2 AND y2 - y1 >= 2"),
    "boxes_over_tiles": (lambda s, d: _placed(s, d, False).select("image", "tx", "ty", "idx", *B.CORNERS), f"WITH {S.BOXES}, {_IMAGES}, {_TILES}, p AS (SELECT image, tx, ty, idx, least(greatest(x1 - tx, 0), 320) AS x1, least(greatest(y1 - ty, 0), 320) AS y1, least(greatest(x2 - tx, 0), 320) AS x2, least(greatest(y2 - ty, 0), 320) AS y2 FROM boxes JOIN tiles USING (image) WHERE role = 'N') SELECT * FROM p WHERE x2 - x1 >= 2 AND y2 - y1 >= 2"),
    "select_tiles": (lambda s, d: T.select_tiles(_tiles(s, d), _placed(s, d), 5, True, 2).select("image", "tx", "ty", "n_objects"), f"WITH {S.BOXES}, {_IMAGES}, {_TILES}, {_PLACED}, n AS (SELECT image, tx, ty, split, count(idx) AS n_objects FROM tiles LEFT JOIN (SELECT * FROM placed WHERE x2 - x1 >= 2 AND y2 - y1 >= 2) USING (image, tx, ty) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY image, n_objects >= 5 ORDER BY ty, tx) AS k FROM n) SELECT image, tx, ty, n_objects FROM r WHERE n_objects >= 5 OR (split = 'train' AND k <= 2)"),
    "windows_to_image": (lambda s, d: T.windows_to_image(S.boxes(s, d).withColumn("window", F.col("idx") % 4), _images(s, d).select("image", F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("window"), (F.col("window") * 100).alias("tx"), (F.col("window") * 50).alias("ty"), F.lit(2).alias("downsample"))).select("image", "idx", *B.CORNERS), f"WITH {S.BOXES} SELECT image, idx, idx % 4 * 100 + x1 * 2 AS x1, idx % 4 * 50 + y1 * 2 AS y1, idx % 4 * 100 + x2 * 2 AS x2, idx % 4 * 50 + y2 * 2 AS y2 FROM boxes"),
    "match_best_any": (lambda s, d: (lambda r, a, n: M.match_best_any(r, n).select("image", "idx", "gt_idx", "matched"))(*_split(s, d)), f"""{PAIRS},
b1 AS (SELECT * FROM pairs WHERE iou >= 0.5 QUALIFY row_number() OVER (PARTITION BY image, d ORDER BY iou DESC, g) = 1), f AS (SELECT *, row_number() OVER (PARTITION BY image, g ORDER BY score DESC, d) AS k FROM b1)
SELECT det.image, det.idx, f.g AS gt_idx, coalesce(f.k = 1, false) AS matched FROM det LEFT JOIN f ON det.image = f.image AND det.idx = f.d"""),
    "nearest_gt": (lambda s, d: (lambda r, a, n: r9(M.classify_false_positives(M.nearest_gt(r.select("image", "idx", "score", *B.CORNERS), n)).select("image", "idx", "gt_idx", "distance", "gt_iou", "dist_ratio", "category"), "distance", "gt_iou", "dist_ratio"))(*_split(s, d)), f"""WITH {S.BOXES}, p AS (SELECT a.image, a.idx, b.idx AS gt_idx, sqrt(pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) AS distance, {IOU} AS gt_iou, greatest(b.x2 - b.x1, b.y2 - b.y1) AS longest, sqrt(pow(b.x2 - b.x1, 2) + pow(b.y2 - b.y1, 2)) AS diagonal
  FROM (SELECT * FROM boxes WHERE role = 'R') a LEFT JOIN (SELECT * FROM boxes WHERE role = 'N') b ON a.image = b.image QUALIFY row_number() OVER (PARTITION BY a.image, a.idx ORDER BY distance, b.idx) = 1)
SELECT image, idx, gt_idx, round(coalesce(distance, 'inf'::DOUBLE), 9) AS distance, round(coalesce(gt_iou, 0), 9) AS gt_iou, round(coalesce(distance / longest, 'inf'::DOUBLE), 9) AS dist_ratio, CASE WHEN gt_iou >= 0.3 THEN 'partial_overlap' WHEN distance < diagonal THEN 'near_miss' WHEN distance < 2 * diagonal THEN 'vicinity' ELSE 'isolated' END AS category FROM p"""),
    "missed_candidates": (lambda s, d: (lambda r, a, n: r9(M.missed_candidates(M.classify_false_positives(M.nearest_gt(M.match_greedy(r, n).where("not matched").select("image", "idx", "score", *B.CORNERS), n))), "mean_confidence"))(*_split(s, d)), f"""{GREEDY}, p AS (SELECT a.image, a.idx, a.score, sqrt(pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) AS distance, {IOU} AS iou, sqrt(pow(b.x2 - b.x1, 2) + pow(b.y2 - b.y1, 2)) AS diagonal FROM matched a JOIN gt b ON a.image = b.image WHERE NOT matched QUALIFY row_number() OVER (PARTITION BY a.image, a.idx ORDER BY distance, b.idx) = 1)
SELECT image, count(*) AS n, round(avg(score), 9) AS mean_confidence, sum((iou >= 0.3)::INT)::BIGINT AS n_partial_overlap, sum((iou < 0.3)::INT)::BIGINT AS n_near_miss FROM p WHERE score > 0.4 AND (iou >= 0.3 OR distance < diagonal) GROUP BY image"""),
    "compare_labels": (lambda s, d: (lambda r, a, n: M.compare_labels(r, a, 12.0))(*_split(s, d)), f"""WITH {S.BOXES}, h AS (SELECT a.image, a.idx AS e, b.idx AS f FROM boxes a JOIN boxes b ON a.image = b.image AND a.role = 'R' AND b.role = 'A' WHERE abs(a.x1 - b.x1) < 12 AND abs(a.y1 - b.y1) < 12 AND abs(a.x2 - b.x2) < 12 AND abs(a.y2 - b.y2) < 12),
e AS (SELECT image, count(*) AS n_expected, count(*) FILTER (WHERE (image, idx) NOT IN (SELECT (image, e) FROM h)) AS u FROM boxes WHERE role = 'R' GROUP BY image), f AS (SELECT image, count(*) AS n_actual, count(*) FILTER (WHERE (image, idx) NOT IN (SELECT (image, f) FROM h)) AS u FROM boxes WHERE role = 'A' GROUP BY image)
SELECT coalesce(e.image, f.image) AS image, coalesce(n_expected, 0) AS n_expected, coalesce(e.u, 0) AS n_unmatched_expected, coalesce(n_actual, 0) AS n_actual, coalesce(f.u, 0) AS n_unmatched_actual, coalesce(e.u, 0) = 0 AND coalesce(f.u, 0) = 0 AS ok FROM e FULL JOIN f ON e.image = f.image"""),
    "mask_iou_runs": (lambda s, d: (lambda r, a, n: r9(M.mask_iou_runs(_runs(r), _runs(n)).where("iou >= 0.3"), "iou"))(*_split(s, d)), f"WITH {S.BOXES}, a AS ({_RUN}'R'), b AS ({_RUN}'N'), i AS (SELECT a.image, a.idx AS l_idx, b.idx AS r_idx, sum(least(a.t, b.t) - greatest(a.f, b.f)) AS inter FROM a JOIN b ON a.image = b.image AND a.row = b.row AND least(a.t, b.t) > greatest(a.f, b.f) GROUP BY 1, 2, 3), sa AS (SELECT image, idx, sum(t - f) AS s FROM a GROUP BY 1, 2), sb AS (SELECT image, idx, sum(t - f) AS s FROM b GROUP BY 1, 2) SELECT i.image, l_idx, r_idx, round(inter / (sa.s + sb.s - inter), 9) AS iou FROM i JOIN sa ON i.image = sa.image AND i.l_idx = sa.idx JOIN sb ON i.image = sb.image AND i.r_idx = sb.idx WHERE inter / (sa.s + sb.s - inter) >= 0.3"),
    "label_by_iou_band": (lambda s, d: (lambda r, a, n: r9(M.label_by_iou_band(r, n.withColumn("quality", F.col("score"))), "best_iou", "score"))(*_split(s, d)), f"""WITH {S.BOXES}, p AS (SELECT a.image, a.idx, b.idx AS g, {IOU} AS iou FROM boxes a JOIN boxes b ON a.image = b.image AND a.role = 'R' AND b.role = 'N' AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2), m AS (SELECT image, idx, max(iou) AS iou FROM p GROUP BY 1, 2),
l AS (SELECT boxes.image, boxes.idx, score, coalesce(iou, 0) AS best_iou FROM boxes LEFT JOIN m USING (image, idx) WHERE role = 'R')
SELECT image, idx, round(score, 9) AS score, round(best_iou, 9) AS best_iou, (best_iou >= 0.5)::INT AS target, false AS rescued FROM l WHERE best_iou >= 0.5 OR best_iou < 0.1 UNION ALL SELECT image, idx, 0.05, 0.0, 1, true FROM boxes WHERE role = 'N' AND score >= 0.8 AND (image, idx) NOT IN (SELECT (image, g) FROM p WHERE iou >= 0.3)"""),
    "mine_hard_negatives": (lambda s, d: (lambda r, a, n: M.mine_hard_negatives(r, n, 1000, 1000).select("name", "cx1", "cy1", "cx2", "cy2"))(*_split(s, d)), walk_sql.SQL["mine_hard_negatives"]),
    "nms": (lambda s, d: G.nms(S.boxes(s, d).where("role = 'R'"), 0.5).select("image", "idx"), f"""WITH RECURSIVE {S.BOXES}, det AS (SELECT * FROM boxes WHERE role = 'R'), p AS (SELECT a.image, a.idx AS a, b.idx AS b FROM det a JOIN det b ON a.image = b.image AND (a.score > b.score OR (a.score = b.score AND a.idx < b.idx)) AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2 WHERE {IOU} >= 0.5),
c AS (SELECT image, idx, row_number() OVER (PARTITION BY image ORDER BY score DESC, idx) AS n FROM det WHERE (image, idx) IN (SELECT (image, a) FROM p UNION SELECT (image, b) FROM p)),
q AS (SELECT c.image, c.n, c.idx, list(p.a) FILTER (WHERE p.a IS NOT NULL) AS over FROM c LEFT JOIN p ON p.image = c.image AND p.b = c.idx GROUP BY 1, 2, 3),
w AS (SELECT image, 0::BIGINT AS n, []::BIGINT[] AS kept FROM q GROUP BY image UNION ALL SELECT w.image, w.n + 1, CASE WHEN list_has_any(w.kept, coalesce(q.over, []::BIGINT[])) THEN w.kept ELSE list_append(w.kept, q.idx) END FROM w JOIN q ON q.image = w.image AND q.n = w.n + 1),
k AS (SELECT image, unnest(kept) AS idx FROM w), z AS (SELECT DISTINCT image, idx FROM k)
SELECT image, idx FROM det WHERE (image, idx) NOT IN (SELECT (image, idx) FROM c) UNION ALL SELECT image, idx FROM z"""),
    "soft_nms": (lambda s, d: r9(G.soft_nms(S.boxes(s, d).where("role = 'R'"), 0.5, 0.001, 0.1).select("image", "idx", "score"), "score"), walk_sql.SQL["soft_nms"]),
    "anchor_fusion": (lambda s, d: r9(G.anchor_fusion(S.boxes(s, d).where("role = 'R'"), 0.5), *B.CORNERS, "score"), walk_sql.SQL["anchor_fusion"]),
    "pairwise_decay": (lambda s, d: r9(G.pairwise_decay(S.boxes(s, d).where("role = 'R'"), 0.3, 0.1).select("image", "idx", "score"), "score"), f"WITH {S.BOXES}, p AS (SELECT a.image, a.idx, product(1 - {IOU}) AS f FROM boxes a JOIN boxes b ON a.image = b.image AND a.role = 'R' AND b.role = 'R' AND a.idx <> b.idx WHERE {IOU} > 0.3 GROUP BY 1, 2) SELECT image, idx, round(score * coalesce(f, 1), 9) AS score FROM boxes LEFT JOIN p USING (image, idx) WHERE role = 'R' AND score * coalesce(f, 1) >= 0.1"),
    "top_n_per_image": (lambda s, d: G.top_n_per_image(S.boxes(s, d), 20).select("image", "idx"), f"WITH {S.BOXES} SELECT image, idx FROM boxes QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, idx) <= 20"),
    "ensemble_intersection": (lambda s, d: (lambda r, a, n: r9(G.ensemble_intersection(r, n), *B.CORNERS, "score"))(*_split(s, d)), f"{GREEDY} SELECT m.image, m.idx, round((m.x1 + g.x1) / 2, 9) AS x1, round((m.y1 + g.y1) / 2, 9) AS y1, round((m.x2 + g.x2) / 2, 9) AS x2, round((m.y2 + g.y2) / 2, 9) AS y2, round((m.score + g.score) / 2, 9) AS score FROM matched m JOIN gt g ON m.image = g.image AND m.gt_idx = g.idx"),
    "ensemble_union": (lambda s, d: (lambda r, a, n: r9(G.ensemble_union(r, a), *B.CORNERS, "score"))(*_split(s, d)), walk_sql.SQL["ensemble_union"]),
    "weighted_boxes_fusion": (lambda s, d: (lambda r, a, n: r9(G.weighted_boxes_fusion([r, a]), *B.CORNERS, "score"))(*_split(s, d)), walk_sql.SQL["weighted_boxes_fusion"]),
    "label_consensus": (lambda s, d: r9(G.label_consensus(S.boxes(s, d).where("role = 'N'"), ["F", "O"]), *B.CORNERS, "confidence"), walk_sql.SQL["label_consensus"]),
    "consensus_report": (lambda s, d: r9(G.consensus_report(G.label_consensus(S.boxes(s, d).where("role = 'N'"), ["F", "O"]).withColumn("split", F.when(F.col("image") % 5 == 0, "test").otherwise("train"))), "agreed_pct"), walk_sql.SQL["consensus_report"]),
    "map_range": (lambda s, d: (lambda r, a, n: D.map_range(r, n).groupBy("thr").agg(F.round(F.avg("ap"), 9).alias("map"), F.sum("tp").alias("tp")))(*_split(s, d)), walk_sql.SQL["map_range"]),
    "ap_101_pooled": (lambda s, d: (lambda r, a, n: r9(D.ap_101_pooled(r, n), "ap"))(*_split(s, d)), walk_sql.SQL["ap_101_pooled"]),
    "filter_sweep": (lambda s, d: r9(D.filter_sweep_together(S.boxes(s, d, D.TOGETHER).where("role IN ('R', 'N')").withColumn("detected", F.col("role") == "R")), "map", "precision", "recall", "f1"), walk_sql.SQL["filter_sweep"]),
    "pool_experiments": (lambda s, d: (lambda r, a, n: r9(D.pool_experiments(D.ap_per_image(r, n).withColumn("batch", F.col("image") % 3)), "precision", "recall", "f1"))(*_split(s, d)), f"{GREEDY}, {AP}, s AS (SELECT image % 3 AS batch, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ap GROUP BY ROLLUP (image % 3)) SELECT batch, tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM s"),
    "detection_summary": (lambda s, d: r9(D.detection_summary(S.boxes(s, d)), "mean_confidence", "mean_area"), f"WITH {S.BOXES} SELECT count(*) AS total, round(avg(score), 9) AS mean_confidence, round(avg((x2 - x1) * (y2 - y1)), 9) AS mean_area, min((x2 - x1) * (y2 - y1)) AS min_area, max((x2 - x1) * (y2 - y1)) AS max_area FROM boxes"),
    "class_counts": (lambda s, d: r9(D.class_counts(S.boxes(s, d)), "mean_confidence"), f"WITH {S.BOXES} SELECT cls, count(*) AS n, round(avg(score), 9) AS mean_confidence FROM boxes GROUP BY cls"),
    "confusion_matrix": (lambda s, d: D.confusion_matrix(S.boxes(s, d), "role", "rater"), f"WITH {S.BOXES}, c AS (SELECT role AS c FROM boxes UNION SELECT rater FROM boxes) SELECT a.c AS role, b.c AS rater, count(boxes.image) AS n FROM c a CROSS JOIN c b LEFT JOIN boxes ON boxes.role = a.c AND boxes.rater = b.c GROUP BY 1, 2"),
    "per_class_accuracy": (lambda s, d: r9(D.per_class_accuracy(S.boxes(s, d).withColumn("guess", (F.col("idx") % 3).cast("int")), "cls", "guess"), "accuracy"), f"WITH {S.BOXES} SELECT cls, count(*) AS n, sum((cls = idx % 3)::INT)::BIGINT AS n_right, round(avg((cls = idx % 3)::INT), 9) AS accuracy FROM boxes GROUP BY cls"),
}
