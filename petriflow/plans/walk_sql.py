"""SQL for the box queries whose rules go through an image's boxes in order, as recursive walks over lists."""

from __future__ import annotations

from petriflow.operators.det_metrics import FILTERS
from petriflow.plans import standins as S

DET = "det AS (SELECT * FROM boxes WHERE role = 'R')"
GT = "gt AS (SELECT * FROM boxes WHERE role = 'N')"
MEET = "a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2"


def iou(a: str = "a", b: str = "b") -> str:
    inter = f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
    union = f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {inter})"
    return f"(CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0 END)"


def greedy(name: str, det: str, gt: str, thr: str, by_score: bool = True) -> str:
    """CTEs ending in ``name``: the rows of ``det`` with gt_idx and matched. ``thr`` may name a column of ``det`` (alias a)."""
    order = "score DESC, d" if by_score else "d"
    return f"""{name}_p AS (SELECT a.image, a.idx AS d, b.idx AS g, a.score, {iou()} AS iou FROM {det} a JOIN {gt} b ON a.image = b.image AND {MEET} WHERE {iou()} >= {thr}),
{name}_c AS (SELECT *, dense_rank() OVER (PARTITION BY image ORDER BY {order}) AS n FROM {name}_p),
{name}_w AS (
  SELECT image, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS d, NULL::BIGINT AS g FROM {name}_c GROUP BY image
  UNION ALL
  SELECT image, n, CASE WHEN g IS NULL THEN used ELSE list_append(used, g) END, d, g FROM (
    SELECT w.image, w.n + 1 AS n, w.used, c.d AS d, (min({{'i': -c.iou, 'g': c.g}}) FILTER (WHERE NOT list_contains(w.used, c.g))).g AS g
    FROM {name}_w w JOIN {name}_c c ON c.image = w.image AND c.n = w.n + 1 GROUP BY w.image, w.n, w.used, c.d)),
{name} AS (SELECT d.*, w.g AS gt_idx, w.g IS NOT NULL AS matched FROM {det} d LEFT JOIN {name}_w w ON d.image = w.image AND d.idx = w.d)"""


def ap(name: str, matched: str, det: str, gt: str) -> str:
    """CTEs ending in ``name`` (image, n_gt, tp, fp, fn, ap)."""
    return f"""{name}_n AS (SELECT image, count(*) AS n_gt FROM {gt} GROUP BY image),
{name}_e AS (SELECT image, n_gt FROM {name}_n UNION ALL SELECT DISTINCT image, 0 FROM {det} WHERE image NOT IN (SELECT image FROM {name}_n)),
{name}_r AS (SELECT m.image, matched::INT AS tp, idx, score, sum(matched::INT) OVER o / row_number() OVER o AS p FROM {matched} m JOIN {name}_n USING (image) WINDOW o AS (PARTITION BY m.image ORDER BY score DESC, idx ROWS UNBOUNDED PRECEDING)),
{name}_v AS (SELECT *, max(p) OVER (PARTITION BY image ORDER BY score DESC, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM {name}_r),
{name}_a AS (SELECT image, sum(tp) AS tp, sum(1 - tp) AS fp, sum(CASE WHEN tp = 1 THEN e ELSE 0 END) AS s FROM {name}_v GROUP BY image),
{name} AS (SELECT image, n_gt::BIGINT AS n_gt, coalesce(tp, 0)::BIGINT AS tp, coalesce(fp, 0)::BIGINT AS fp, (n_gt - coalesce(tp, 0))::BIGINT AS fn, CASE WHEN n_gt > 0 THEN coalesce(s, 0) / n_gt ELSE 0 END AS ap FROM {name}_e LEFT JOIN {name}_a USING (image))"""


def nms(name: str, det: str, thr: float) -> str:
    """CTEs ending in ``name`` (image, idx): what suppression keeps."""
    return f"""{name}_p AS (SELECT a.image, a.idx AS a, b.idx AS b FROM {det} a JOIN {det} b ON a.image = b.image AND (a.score > b.score OR (a.score = b.score AND a.idx < b.idx)) AND {MEET} WHERE {iou()} >= {thr}),
{name}_c AS (SELECT image, idx, row_number() OVER (PARTITION BY image ORDER BY score DESC, idx) AS n FROM {det}),
{name}_q AS (SELECT c.image, c.n, c.idx, list(p.a) FILTER (WHERE p.a IS NOT NULL) AS over FROM {name}_c c LEFT JOIN {name}_p p ON p.image = c.image AND p.b = c.idx GROUP BY 1, 2, 3),
{name}_w AS (SELECT image, 0::BIGINT AS n, []::BIGINT[] AS kept FROM {name}_q GROUP BY image UNION ALL SELECT w.image, w.n + 1, CASE WHEN list_has_any(w.kept, coalesce(q.over, []::BIGINT[])) THEN w.kept ELSE list_append(w.kept, q.idx) END FROM {name}_w w JOIN {name}_q q ON q.image = w.image AND q.n = w.n + 1),
{name} AS (SELECT image, unnest(kept) AS idx FROM (SELECT * FROM {name}_w QUALIFY row_number() OVER (PARTITION BY image ORDER BY n DESC) = 1))"""


_ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in ("x1", "y1", "x2", "y2", "score"))
_BOX = "'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2"
_MEANS = ", ".join(f"(m.{c} + g.{c}) / 2 AS {c}" for c in ("x1", "y1", "x2", "y2", "score"))

SOFT_NMS = f"""WITH RECURSIVE {S.BOXES}, {DET},
w AS (SELECT image, list({{'idx': idx, {_BOX}, 's': score}} ORDER BY idx) AS l, NULL::BIGINT AS idx, NULL::DOUBLE AS score FROM det GROUP BY image
  UNION ALL
  SELECT image, [{{'idx': x.idx, 'x1': x.x1, 'y1': x.y1, 'x2': x.x2, 'y2': x.y2, 's': CASE WHEN {iou('x', 'b')} > 0 THEN x.s * exp(-pow({iou('x', 'b')}, 2) / 0.5) ELSE x.s END}} for x in l if x.idx <> b.idx], b.idx, b.s
  FROM (SELECT image, l, list_sort([{{'k': -x.s, 'i': x.idx, 'b': x}} for x in l])[1].b AS b FROM w WHERE len(l) > 0) WHERE b.s >= 0.001)
SELECT image, idx, round(score, 9) AS score FROM w WHERE idx IS NOT NULL AND score >= 0.1"""

_TAKES = f"({iou('x', 'a')} >= 0.5 OR ((x.x1 + x.x2) / 2 BETWEEN a.x1 AND a.x2 AND (x.y1 + x.y2) / 2 BETWEEN a.y1 AND a.y2) OR ((a.x1 + a.x2) / 2 BETWEEN x.x1 AND x.x2 AND (a.y1 + a.y2) / 2 BETWEEN x.y1 AND x.y2) OR x.idx = a.idx)"
ANCHORS = f"""WITH RECURSIVE {S.BOXES}, {DET},
w AS (SELECT image, list({{'idx': idx, {_BOX}, 's': score}} ORDER BY score DESC, idx) AS l, NULL::BIGINT AS idx, []::STRUCT(idx BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, s DOUBLE)[] AS t FROM det GROUP BY image
  UNION ALL
  SELECT image, [x for x in l if NOT {_TAKES}], a.idx, [x for x in l if {_TAKES}] FROM (SELECT image, l, l[1] AS a FROM w WHERE len(l) > 0)),
o AS (SELECT image, idx, list_sum([x.s for x in t]) AS total, t FROM w WHERE idx IS NOT NULL)
SELECT image, idx, {", ".join(f"round(list_sum([x.s * x.{c} for x in t]) / total, 9) AS {c}" for c in ("x1", "y1", "x2", "y2"))}, round(list_max([x.s for x in t]), 9) AS score, len(t)::BIGINT AS n FROM o WHERE total > 0"""

UNION = f"""WITH RECURSIVE {S.BOXES}, {DET}, other AS (SELECT * FROM boxes WHERE role = 'A'), {greedy('m', 'det', 'other', '0.5')},
parts AS (SELECT m.image, 'both' AS source, m.idx AS own, {_MEANS} FROM m JOIN other g ON m.image = g.image AND m.gt_idx = g.idx
  UNION ALL SELECT image, 'a', idx, x1, y1, x2, y2, score * 0.7 FROM m WHERE NOT matched
  UNION ALL SELECT image, 'b', idx, x1, y1, x2, y2, score * 0.7 FROM other WHERE (image, idx) NOT IN (SELECT (image, gt_idx) FROM m WHERE matched)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, source, own) AS idx, image IN (SELECT image FROM det) AND image IN (SELECT image FROM other) AS two FROM parts),
pair AS (SELECT * FROM numbered WHERE two), {nms('k', 'pair', 0.5)}
SELECT image, source, own, {_ROUNDED} FROM numbered WHERE NOT two OR (image, idx) IN (SELECT (image, idx) FROM k)"""

_MERGED = ", ".join(f"'{c}': (x.{c} * x.w + b.s * b.{c}) / (x.w + b.s)" for c in ("x1", "y1", "x2", "y2"))
FUSION = f"""WITH RECURSIVE {S.BOXES},
w AS (SELECT image, list({{{_BOX}, 's': score}} ORDER BY score DESC, role = 'A', idx) AS l, 0::BIGINT AS n, []::STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, w DOUBLE, n BIGINT)[] AS f FROM boxes WHERE role IN ('R', 'A') GROUP BY image
  UNION ALL
  SELECT image, l, n + 1, CASE WHEN best > 0.55 THEN list_transform(f, lambda x, i: CASE WHEN i = list_position(o, best) THEN {{{_MERGED}, 'w': x.w + b.s, 'n': x.n + 1}} ELSE x END)
    ELSE list_append(f, {{'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'w': b.s, 'n': 1}}) END
  FROM (SELECT *, coalesce(list_max(o), -1) AS best FROM (SELECT *, [{iou('x', 'b')} for x in f] AS o FROM (SELECT *, l[n + 1] AS b FROM w WHERE n < len(l))))),
z AS (SELECT image, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS idx FROM w WHERE n = len(l))
SELECT image, idx, {", ".join(f"round(x.{c}, 9) AS {c}" for c in ("x1", "y1", "x2", "y2"))}, round(x.w / x.n * least(x.n, 2) / 2, 9) AS score, x.n AS n FROM z"""

_CONSENSUS = f"""WITH RECURSIVE {S.BOXES}, known AS (SELECT * FROM boxes WHERE role = 'N' AND rater IN ('F', 'O')),
sides AS (SELECT image, min(rater) AS base, count(DISTINCT rater) AS n FROM known GROUP BY image),
base AS (SELECT known.*, n FROM known JOIN sides USING (image) WHERE rater = base), other AS (SELECT known.*, n FROM known JOIN sides USING (image) WHERE rater <> base),
{greedy('m', 'base', 'other', '0.5', False)},
consensus AS (SELECT m.image, m.idx, m.rater, {", ".join(f"CASE WHEN m.matched THEN (m.{c} + g.{c}) / 2 ELSE m.{c} END AS {c}" for c in ("x1", "y1", "x2", "y2"))}, CASE WHEN m.n = 1 THEN 0.5 ELSE (1 + m.matched::INT) / m.n END AS confidence, 1 + m.matched::BIGINT AS n_matched, CASE WHEN m.matched THEN 'consensus' ELSE 'single' END AS kind
  FROM m LEFT JOIN other g ON m.image = g.image AND m.gt_idx = g.idx
  UNION ALL SELECT image, idx, rater, x1, y1, x2, y2, 1 / n, 1, 'single' FROM other WHERE (image, idx) NOT IN (SELECT (image, gt_idx) FROM m WHERE matched))"""
CONSENSUS = f"""{_CONSENSUS} SELECT image, idx, rater, {", ".join(f"round({c}, 9) AS {c}" for c in ("x1", "y1", "x2", "y2", "confidence"))}, n_matched, kind FROM consensus"""
CONSENSUS_REPORT = f"""{_CONSENSUS} SELECT split, image, count(*) AS total, sum((n_matched >= 2)::INT)::BIGINT AS n_agreed, sum((n_matched < 2)::INT)::BIGINT AS n_single, round(100 * sum((n_matched >= 2)::INT) / count(*), 9) AS agreed_pct
FROM (SELECT *, CASE WHEN image % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM consensus) GROUP BY ROLLUP (split, image)"""

HARD_NEGATIVES = f"""WITH RECURSIVE {S.BOXES}, {DET}, {GT}, {greedy('m', 'det', 'gt', '0.3', False)},
c AS (SELECT image || '_' || idx AS name, greatest(0, trunc(x1 - (x2 - x1) * 0.5))::INT AS cx1, greatest(0, trunc(y1 - (y2 - y1) * 0.5))::INT AS cy1, least(1000, trunc(x2 + (x2 - x1) * 0.5))::INT AS cx2, least(1000, trunc(y2 + (y2 - y1) * 0.5))::INT AS cy2 FROM m WHERE NOT matched)
SELECT name, cx1, cy1, cx2, cy2 FROM c WHERE cx2 - cx1 >= 10 AND cy2 - cy1 >= 10"""

MAP_RANGE = f"""WITH RECURSIVE {S.BOXES}, t AS (SELECT k, round(0.5 + 0.05 * k, 2)::DOUBLE AS thr FROM range(0, 10) r(k)),
d AS (SELECT boxes.* REPLACE (image * 10 + k AS image), thr FROM boxes, t WHERE role = 'R'), g AS (SELECT boxes.* REPLACE (image * 10 + k AS image) FROM boxes, t WHERE role = 'N'),
{greedy('m', 'd', 'g', 'a.thr')}, {ap('ap', 'm', 'd', 'g')} SELECT thr, round(avg(ap), 9) AS map, sum(tp)::BIGINT AS tp FROM ap JOIN t ON t.k = image % 10 GROUP BY thr"""

_GRID = ", ".join(f"({k}, '{name}', {', '.join(f'{v}::DOUBLE' for v in values)})" for k, (name, values) in enumerate(FILTERS.items()))
FILTER_SWEEP = f"""WITH RECURSIVE {S.BOXES}, t AS (SELECT * FROM (VALUES {_GRID}) t(k, config, c0, c1, c2, c3)),
d AS (SELECT boxes.* REPLACE (image * {len(FILTERS)} + k AS image) FROM boxes, t WHERE role = 'R' AND score >= c0 AND circularity >= c1 AND solidity >= c2 AND aspect_ratio >= c3), g AS (SELECT boxes.* REPLACE (image * {len(FILTERS)} + k AS image) FROM boxes, t WHERE role = 'N'),
{greedy('m', 'd', 'g', '0.5')}, {ap('ap', 'm', 'd', 'g')}, s AS (SELECT config, count(*) AS n_images, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, avg(ap) AS map FROM ap JOIN t ON t.k = image % {len(FILTERS)} GROUP BY config),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM s)
SELECT config, n_images, tp, fp, fn, round(map, 9) AS map, round(p, 9) AS precision, round(q, 9) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 9) AS f1 FROM r"""

POOLED = f"""WITH {S.BOXES}, {DET}, {GT},
p AS (SELECT a.image, a.cls, a.idx, a.score, b.idx AS g, {iou()} AS iou FROM det a JOIN gt b ON a.image = b.image AND a.cls = b.cls AND {MEET}),
b1 AS (SELECT * FROM p WHERE iou >= 0.5 QUALIFY row_number() OVER (PARTITION BY image, idx ORDER BY iou DESC, g) = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY image, g ORDER BY score DESC, idx) = 1 AS matched FROM b1),
m AS (SELECT det.cls, det.score, coalesce(f.matched, false)::INT AS t FROM det LEFT JOIN f USING (image, idx)),
n AS (SELECT cls, count(*) AS n_gt FROM gt GROUP BY cls),
s AS (SELECT cls, score, sum(sum(t)) OVER o AS tp, sum(count(*)) OVER o AS k FROM m GROUP BY cls, score WINDOW o AS (PARTITION BY cls ORDER BY score DESC)),
r AS (SELECT cls, tp / n_gt AS recall, tp / k AS precision FROM s JOIN n USING (cls)),
q AS (SELECT cls, i, coalesce(max(precision) FILTER (WHERE recall >= i / 100 - 1e-9), 0) AS best FROM r, range(0, 101) t(i) GROUP BY cls, i)
SELECT cls, n_gt, round(avg(best), 9) AS ap FROM q JOIN n USING (cls) GROUP BY cls, n_gt"""

SQL: dict[str, str] = {
    "mine_hard_negatives": HARD_NEGATIVES,
    "soft_nms": SOFT_NMS,
    "anchor_fusion": ANCHORS,
    "ensemble_union": UNION,
    "weighted_boxes_fusion": FUSION,
    "label_consensus": CONSENSUS,
    "consensus_report": CONSENSUS_REPORT,
    "map_range": MAP_RANGE,
    "ap_101_pooled": POOLED,
    "filter_sweep": FILTER_SWEEP,
}
