"""Registered queries over dealt rows, parameters, histories, audit chains and annotation texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petriflow.functions.lineage import checkpointed, remove, shared_dir
from petriflow.operators import audit as A
from petriflow.operators import federation as E
from petriflow.operators import history as H
from petriflow.operators import partition as P
from petriflow.plans import standins as S
from petriflow.plans.box_queries import r9
from petriflow.sources import readers as R
from petriflow.sources import sinks as W


def members(s: SparkSession, d: str) -> DataFrame:
    return S.members(s, d)


def _numbered(rows: str, by: str, seed: str, key: str = "id", name: str = "n") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"SELECT *, row_number() OVER ({part}ORDER BY md5('{seed}|' || {key}::VARCHAR), {key}) AS {name} FROM {rows}"


_DOMINANT = {0: ["AUTOMOBILE", "BUILDING"], 1: ["FURNITURE"], 2: ["MACHINERY", "HOUSEHOLD"]}
_SQL_DOMINANT = "dom AS (SELECT * FROM (VALUES (0, 'AUTOMOBILE'), (0, 'BUILDING'), (1, 'FURNITURE'), (2, 'MACHINERY'), (2, 'HOUSEHOLD')) t(client, cls)), cl AS (SELECT * FROM (VALUES (0, 2), (1, 1), (2, 2)) t(client, k))"


def _files(s: SparkSession, d: str) -> DataFrame:
    t = S.table(s, d, "documents")
    return t.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("batch"), (F.col("doc_id") % 50).cast("string").alias("name"), F.col("text").alias("content"))


def _paths(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("t0.json", "x_annotator_a.json", "t1_a.json", "Annotator_B.json", "t1_b.json", "t1.json", "notes.json", "annotator_c.json")))
    t = S.table(s, d, "customer")
    k = F.col("c_custkey")
    return t.select(F.concat_ws("/", F.lit("root"), F.when(k % 3 == 0, "test").otherwise("train"), F.concat(F.lit("C"), (k % 4).cast("string")), F.concat(F.lit("P"), (k % 5).cast("string")), F.concat(F.lit("img"), (k % 30).cast("string")), F.get(names, (k % 8).cast("int"))).alias("path"))


_PATHS = """f AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'test' ELSE 'train' END AS split, 'C' || (c_custkey % 4)::VARCHAR AS cls, 'P' || (c_custkey % 5)::VARCHAR AS plate, 'img' || (c_custkey % 30)::VARCHAR AS image,
  ['t0.json', 'x_annotator_a.json', 't1_a.json', 'Annotator_B.json', 't1_b.json', 't1.json', 'notes.json', 'annotator_c.json'][c_custkey % 8 + 1] AS name,
  ['t0', 'annotator_a', 't1_a', 'annotator_b', 't1_b', 't1_unknown', 'other', 'annotator_c'][c_custkey % 8 + 1] AS annotator FROM customer)"""


def _label_rows(s: SparkSession, d: str) -> DataFrame:
    b = S.boxes(s, d).where("role = 'N'")
    return b.select((F.col("image") % 3).alias("batch"), "image", "idx", "cls", ((F.col("x1") + F.col("x2")) / 2000).alias("xc"), ((F.col("y1") + F.col("y2")) / 2000).alias("yc"), ((F.col("x2") - F.col("x1")) / 1000).alias("w"), ((F.col("y2") - F.col("y1")) / 1000).alias("h"))


_LABELS = "lab AS (SELECT image % 3 AS batch, image, idx, cls, (x1 + x2) / 2000 AS xc, (y1 + y2) / 2000 AS yc, (x2 - x1) / 1000 AS w, (y2 - y1) / 1000 AS h FROM boxes WHERE role = 'N')"


def _chain(s: SparkSession, d: str) -> DataFrame:
    return A.build_chain(S.events(s, d))


_CHAIN = f"""WITH RECURSIVE {S.EVENTS}, b AS (SELECT chain_id, 0::BIGINT AS index, min(ts) AS ts, 'Genesis' AS operation, NULL::VARCHAR AS details FROM ev GROUP BY chain_id UNION ALL SELECT chain_id, index, ts, operation, details FROM ev),
chain AS (SELECT chain_id, index, ts, operation, details, '0' AS prev_hash, sha256('0:' || ts || ':' || operation || ':0:0') AS hash FROM b WHERE index = 0
  UNION ALL SELECT b.chain_id, b.index, b.ts, b.operation, b.details, c.hash, sha256(b.index::VARCHAR || ':' || b.ts || ':' || b.operation || ':' || c.hash || ':0') FROM chain c JOIN b ON b.chain_id = c.chain_id AND b.index = c.index + 1)"""


def _tampered(s: SparkSession, d: str) -> DataFrame:
    """Every fifth chain has a changed operation in its fourth block."""
    bad = (F.col("chain_id").cast("long") % 5 == 0) & (F.col("index") == 3)
    return _chain(s, d).withColumn("operation", F.when(bad, "forged").otherwise(F.col("operation")))


def _round_clients(s: SparkSession, d: str) -> DataFrame:
    c = S.client_stats(s, d)
    return c.select("exp", "round", "client", "map50", (1 - F.col("map50")).alias("train_loss"), F.col("map50").alias("train_acc"), F.map_from_arrays(F.array(*(F.lit(str(i)) for i in range(4))), F.array(*(F.round(F.col("map50") * (i + 1) / 4, 9) for i in range(4)))).alias("per_class_ap"), F.array(F.lit(0), F.lit(1)).alias("dominant"))


#: The fold of updates in order of round and client: the first two rounds by samples, then by signal against the cached one.
_SOFT_GATE = f"""WITH RECURSIVE {S.CLIENT_STATS}, o AS (SELECT exp, round, client, map50 AS s, n_samples::DOUBLE AS k, row_number() OVER (PARTITION BY exp ORDER BY round, client) AS n, dense_rank() OVER (PARTITION BY exp ORDER BY round) AS place FROM client_stats),
w AS (SELECT exp, n, round, [{{'r': round, 'c': client, 'w': 1.0::DOUBLE}}] AS model, k AS count, 0.0::DOUBLE AS cache FROM o WHERE n = 1
  UNION ALL
  SELECT exp, n, round, list_append([{{'r': x.r, 'c': x.c, 'w': x.w * (1 - share)}} for x in model], {{'r': round, 'c': client, 'w': share}}), count + CASE WHEN place <= 2 THEN k ELSE 0 END, CASE WHEN place <= 2 THEN cache ELSE share * s + (1 - share) * cache END
  FROM (SELECT o.*, w.model, w.count, w.cache, CASE WHEN o.place <= 2 THEN o.k / (o.k + w.count) ELSE greatest(o.s, 1e-8) / (greatest(o.s, 1e-8) + greatest(w.cache, 1e-8)) END AS share FROM w JOIN o ON o.exp = w.exp AND o.n = w.n + 1)),
e AS (SELECT exp, round, unnest(model) AS x FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY exp, round ORDER BY n DESC) = 1))
SELECT exp, round, x.r AS source_round, x.c AS client, round(x.w, 9) AS weight FROM e WHERE x.w > 0"""

def _label_profile(s: SparkSession, d: str) -> DataFrame:
    labels = _label_rows(s, d)
    images = S.boxes(s, d).select((F.col("image") % 3).alias("batch"), "image").distinct()
    # The files' lines as they are written; of boxes of rater O the last number is missing.
    lines = S.boxes(s, d).select((F.col("image") % 3).alias("batch"), F.concat_ws(" ", F.col("cls").cast("string"), F.round("x1", 2).cast("string"), F.round("y1", 2).cast("string"), F.lit("1e-3"), F.when(F.col("rater") == "F", "0.5")).alias("line"))
    out = P.label_profile(images, labels, lines=lines)
    return r9(out, "min_area", "max_area", "mean_area", *(f"{k}_{c}" for c in ("w", "h") for k in ("min", "max", "mean"))).withColumn("classes", F.to_json("classes"))


_LABEL_PROFILE = f"""WITH {S.BOXES}, {_LABELS}, i AS (SELECT DISTINCT image % 3 AS batch, image FROM boxes), p AS (SELECT i.batch, i.image, count(lab.idx) AS k FROM i LEFT JOIN lab ON lab.image = i.image GROUP BY 1, 2),
q AS (SELECT batch, count(*) AS n_images, sum((k = 0)::INT)::BIGINT AS images_0, sum((k BETWEEN 1 AND 2)::INT)::BIGINT AS images_1_2, sum((k BETWEEN 3 AND 5)::INT)::BIGINT AS images_3_5, sum((k BETWEEN 6 AND 10)::INT)::BIGINT AS images_6_10, sum((k > 10)::INT)::BIGINT AS images_more FROM p GROUP BY batch),
b AS (SELECT batch, count(*) AS n_boxes, sum((xc - w / 2 < 0 OR yc - h / 2 < 0 OR xc + w / 2 > 1 OR yc + h / 2 > 1)::INT)::BIGINT AS n_outside, sum((w * h <= 0)::INT)::BIGINT AS n_zero_area, sum((w * h > 0 AND w * h < 0.001)::INT)::BIGINT AS n_tiny, sum((w * h > 0.5)::INT)::BIGINT AS n_huge,
  round(min(w * h), 9) AS min_area, round(max(w * h), 9) AS max_area, round(avg(w * h), 9) AS mean_area, round(min(w), 9) AS min_w, round(max(w), 9) AS max_w, round(avg(w), 9) AS mean_w, round(min(h), 9) AS min_h, round(max(h), 9) AS max_h, round(avg(h), 9) AS mean_h FROM lab GROUP BY batch),
c AS (SELECT batch, '[' || string_agg('{{"cls":' || cls || ',"n":' || n || '}}', ',' ORDER BY cls) || ']' AS classes FROM (SELECT batch, cls, count(*) AS n FROM lab GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT image % 3 AS batch, sum((rater <> 'F')::INT)::BIGINT AS n_malformed FROM boxes GROUP BY 1)
SELECT *, 0::BIGINT AS n_labels_without_image FROM q JOIN b USING (batch) JOIN c USING (batch) JOIN m USING (batch)"""

#: Softmax regression of every client by recursion: 3 rounds of 20 steps, models averaged by samples after each round.
_ROUNDS_SQL = f"""WITH RECURSIVE {S.VECTORS},
x AS MATERIALIZED (SELECT id, client, cls AS y, j, CASE WHEN j = 17 THEN 1.0 ELSE values[j] END::DOUBLE AS x FROM vectors, range(1, 18) t(j)),
size AS MATERIALIZED (SELECT client, count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS total FROM vectors GROUP BY client),
w AS (
  SELECT 0 AS t, client, j, k, 0.0::DOUBLE AS w FROM size, range(1, 18) a(j), range(0, 10) b(k)
  UNION ALL
  SELECT t, client, j, k, CASE WHEN t % 20 = 0 THEN sum(w * n) OVER (PARTITION BY j, k) / total ELSE w END AS w FROM (
    SELECT w.t + 1 AS t, w.client, w.j, w.k, w.w - 0.5 * g.g / size.n AS w, size.n, size.total FROM w JOIN size USING (client) JOIN (
      SELECT x.client, x.j, q.k, sum(x.x * (q.e / q.s - (q.y = q.k)::INT)) AS g FROM x JOIN (
        SELECT *, sum(e) OVER (PARTITION BY id) AS s FROM (SELECT id, y, k, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM (
          SELECT x.id, x.y, w.k, sum(x.x * w.w) AS z FROM x JOIN w USING (client, j) GROUP BY x.id, x.y, w.k))) q USING (id)
      GROUP BY x.client, x.j, q.k) g USING (client, j, k) WHERE w.t < 60)),
m AS (SELECT t, j, k, any_value(w) AS w FROM w WHERE t IN (20, 40, 60) GROUP BY t, j, k),
z AS (SELECT t, x.id, x.y, m.k, sum(x.x * m.w) AS z FROM x JOIN m USING (j) GROUP BY t, x.id, x.y, m.k),
p AS (SELECT t, id, y, arg_min(k, (-z, k)) AS best, max(z) FILTER (WHERE k = y) - max(z) - ln(sum(exp(z - top))) AS l FROM (SELECT *, max(z) OVER (PARTITION BY t, id) AS top FROM z) GROUP BY t, id, y)
SELECT (t // 20)::INT AS round, round(avg((best = y)::INT), 9) AS accuracy, round(-avg(l), 9) AS loss, (SELECT count(*) FROM size)::INT AS n_clients FROM p GROUP BY t"""


def _through_files(s: SparkSession, write, read) -> DataFrame:
    """What ``read`` finds in a new folder of the shared file system after ``write`` filled it. The folder goes again."""
    path = f"{shared_dir(s)}/files-{uuid.uuid4().hex}"
    write(path)
    out = checkpointed(read(path))
    remove(s, path)
    return out


#: Images of a JSON document.
DOCUMENT = 64


def _documents(rows: DataFrame, value, path: str) -> None:
    """One JSON document for the images of each g, each a file by itself in one folder: a folder of its own for each would be a task to list. Rows that come
    from `boxes` with ``together`` are not shuffled again."""
    rows.groupBy("g").agg(value.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)


def _read_box_annotations(s: SparkSession, d: str) -> DataFrame:
    b = S.boxes(s, d, DOCUMENT).groupBy("g", "image").agg(F.collect_list(F.when(F.col("role") == "N", F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h")))).alias("bboxes"))
    one = F.struct(F.concat(F.lit("i"), F.col("image").cast("string")).alias("image"), F.size("bboxes").alias("n_organoids"), "bboxes", F.array(F.lit(1000), F.lit(700)).alias("image_size"))
    found = _through_files(s, lambda p: _documents(b, F.to_json(F.collect_list(one)), p), lambda p: R.read_box_annotations(s, p))
    return found.select("image", "n_organoids", "width", "height", "x1", "y1", "x2", "y2")


def _read_detections(s: SparkSession, d: str, layout: str) -> DataFrame:
    measures = [F.col(c) for c in ("circularity", "solidity", "aspect_ratio")]
    b = S.boxes(s, d, DOCUMENT).where("role = 'R'")
    box, name = F.array("x1", "y1", "x2", "y2").alias("bbox"), F.concat(F.lit("a/"), F.col("image").cast("string")).alias("image")
    conf = F.when(F.col("idx") % 2 == 0, F.col("score"))
    if layout == "flat":
        one = F.struct(name, F.col("idx").cast("int").alias("det_idx"), box, conf.alias("rfdetr_conf"), F.col("score").alias("confidence"), *measures)
        value = F.to_json(F.collect_list(one))
    else:
        one = F.struct("idx", box, conf.alias("confidence"), *measures, (F.col("cls") == 1).alias("is_tp"))
        b = b.groupBy("g", "image").agg(F.sort_array(F.collect_list(one)).alias("detections"))
        value = F.to_json(F.struct(F.collect_list(F.struct(name, "detections")).alias("per_image")))
    found = _through_files(s, lambda p: _documents(b, value, p), lambda p: R.read_detections(s, p, layout))
    return r9(found.select("cache_key", "image", "det_idx", "x1", "y1", "x2", "y2", "score", "circularity", "solidity", "aspect_ratio", "area", "matched"), "score", "circularity", "solidity", "aspect_ratio")


def _read_training_csv(s: SparkSession, d: str) -> DataFrame:
    t = S.rounds(s, d).select(F.concat(F.lit(" "), F.col("round").cast("string")).alias(" epoch "), F.when(F.col("round") % 3 > 0, F.col("map50")).alias("metrics/mAP50(B)"), F.substring("exp", 2, 1).alias("  run"))
    return _through_files(s, lambda p: t.write.option("header", True).csv(p), lambda p: R.read_training_csv(s, p)).withColumnRenamed("metrics/mAP50(B)", "map50")


def _report(s: SparkSession, d: str) -> DataFrame:
    rows = S.client_stats(s, d)
    return r9(_through_files(s, lambda p: W.write_report(rows, p, "csv"), lambda p: s.read.option("header", True).schema(rows.schema).csv(p)), "map50")


def _json_lines(s: SparkSession, d: str) -> DataFrame:
    return A.verify_chain(_through_files(s, lambda p: A.append_json_lines(_chain(s, d), p), lambda p: A.read_json_lines(s, p)))


def _aggregated(weight: str, pulled: bool) -> str:
    """Parameters averaged by ``weight``, drawn towards the first update of client c0 before if ``pulled``."""
    value = "CASE WHEN p.is_int OR g.value IS NULL THEN p.value ELSE 0.9 * p.value + 0.1 * g.value END" if pulled else "p.value"
    return f"""WITH {S.PARAMS}, {S.CLIENT_STATS}, q AS (SELECT p.* REPLACE ({value} AS value) FROM params p LEFT JOIN (SELECT * FROM params WHERE client = 'c0' AND round = 0) g ON g.param = p.param AND g.pos = p.pos)
SELECT exp, round, param, pos, round(CASE WHEN bool_or(is_int) THEN arg_min(value, client) ELSE sum({weight} * value) / sum({weight}) END, 9) AS value FROM q JOIN client_stats USING (exp, round, client) GROUP BY exp, round, param, pos"""


_DETECTED = "CASE WHEN idx % 2 = 0 THEN score ELSE {other} END"

QUERIES = {
    "read_box_annotations": (_read_box_annotations, f"WITH {S.BOXES}, n AS (SELECT image, sum((role = 'N')::INT)::INT AS k FROM boxes GROUP BY image) SELECT 'i' || image AS image, k AS n_organoids, 1000::INT AS width, 700::INT AS height, x1, y1, x2, y2 FROM n LEFT JOIN (SELECT * FROM boxes WHERE role = 'N') b USING (image)"),
    "read_detections": (lambda s, d: _read_detections(s, d, "nested"), f"WITH {S.BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY idx) - 1 AS k FROM boxes WHERE role = 'R') SELECT 'a_' || image || '_' || k AS cache_key, 'a/' || image AS image, k::INT AS det_idx, x1, y1, x2, y2, round({_DETECTED.format(other='0.5')}, 9) AS score, round(circularity, 9) AS circularity, round(solidity, 9) AS solidity, round(aspect_ratio, 9) AS aspect_ratio, 0.0::DOUBLE AS area, cls = 1 AS matched FROM r"),
    "read_detections_flat": (lambda s, d: _read_detections(s, d, "flat"), f"WITH {S.BOXES} SELECT 'a_' || image || '_' || idx AS cache_key, 'a/' || image AS image, idx::INT AS det_idx, x1, y1, x2, y2, round(score, 9) AS score, round(circularity, 9) AS circularity, round(solidity, 9) AS solidity, round(aspect_ratio, 9) AS aspect_ratio, 0.0::DOUBLE AS area, false AS matched FROM boxes WHERE role = 'R'"),
    "read_training_csv": (_read_training_csv, f"WITH {S.ROUNDS} SELECT round::DOUBLE AS epoch, CASE WHEN round % 3 > 0 THEN map50 ELSE 0 END AS map50, substr(exp, 2, 1)::DOUBLE AS run FROM rounds"),
    "write_report": (_report, f"WITH {S.CLIENT_STATS} SELECT exp, round, client, n_samples, round(map50, 9) AS map50 FROM client_stats"),
    "audit_json_lines": (_json_lines, f"{_CHAIN} SELECT chain_id, count(*) AS n_blocks, true AS valid, NULL::BIGINT AS first_bad_index FROM chain GROUP BY chain_id"),
    "split_by_image": (lambda s, d: P.split_by_image(S.boxes(s, d)).select("image", "idx", "split"), f"WITH {S.BOXES}, i AS ({_numbered('(SELECT DISTINCT image FROM boxes)', '', '42', 'image')}), t AS (SELECT image, CASE WHEN n <= floor(c * 0.7) THEN 'train' WHEN n <= floor(c * 0.7) + floor(c * 0.15) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, count(*) OVER () AS c FROM i)) SELECT image, idx, split FROM boxes JOIN t USING (image)"),
    "balance_classes": (lambda s, d: P.balance_classes(members(s, d), "cls", "id"), f"WITH {S.MEMBERS}, m AS ({_numbered('members', 'cls', '42')}) SELECT id, cls FROM m WHERE n <= (SELECT min(c) FROM (SELECT count(*) AS c FROM members GROUP BY cls))"),
    "sample_per_class": (lambda s, d: P.sample_per_class(members(s, d), "cls", "id", {"BUILDING": 20, "FURNITURE": 10}), f"WITH {S.MEMBERS}, m AS ({_numbered('members', 'cls', '42')}) SELECT id, cls FROM m WHERE (cls = 'BUILDING' AND n <= 20) OR (cls = 'FURNITURE' AND n <= 10)"),
    "split_iid": (lambda s, d: P.split_iid(members(s, d), "id", 7), f"WITH {S.MEMBERS}, m AS ({_numbered('members', '', '42')}) SELECT id, cls, least((n - 1) // (count(*) OVER () // 7), 6)::INT AS client FROM m"),
    "split_iid_dropped": (lambda s, d: P.split_iid(members(s, d), "id", 7, keep_remainder=False), f"WITH {S.MEMBERS}, m AS ({_numbered('members', '', '42')}), c AS (SELECT id, cls, ((n - 1) // (count(*) OVER () // 7))::INT AS client FROM m) SELECT * FROM c WHERE client < 7"),
    "split_skew": (lambda s, d: P.split_skew(members(s, d), "cls", "id", 4, 0.5), f"""WITH {S.MEMBERS}, m AS (SELECT *, count(*) OVER (PARTITION BY cls) AS c FROM ({_numbered('members', 'cls', '42')})), k AS (SELECT cls, (row_number() OVER (ORDER BY cls) - 1) % 4 AS p FROM (SELECT DISTINCT cls FROM members)),
o AS (SELECT m.*, p, ('0x' || substr(md5('42o|' || id::VARCHAR), 1, 8))::BIGINT % 3 AS o FROM m JOIN k USING (cls)) SELECT id, cls, (CASE WHEN n <= floor(c * (0.3::DOUBLE + 0.7::DOUBLE * 0.5::DOUBLE)) THEN p WHEN o < p THEN o ELSE o + 1 END)::INT AS client FROM o"""),
    "split_dominant": (lambda s, d: P.split_dominant(members(s, d), "cls", "id", _DOMINANT, 0.7), f"""WITH {S.MEMBERS}, {_SQL_DOMINANT}, x AS (SELECT m.id, m.cls, cl.client, cl.k, dom.cls IS NOT NULL AS own, m.c FROM (SELECT *, count(*) OVER (PARTITION BY cls) AS c FROM members) m CROSS JOIN cl LEFT JOIN dom ON dom.client = cl.client AND dom.cls = m.cls),
n AS (SELECT *, row_number() OVER (PARTITION BY client, cls ORDER BY md5('42|' || client::VARCHAR || '|' || id::VARCHAR), client::VARCHAR || '|' || id::VARCHAR) AS n FROM x) SELECT id, client FROM n WHERE n <= CASE WHEN own THEN floor(c * 0.7) ELSE greatest(1, floor(c * (1 - 0.7) / ((SELECT count(DISTINCT cls) FROM members) - k))) END"""),
    "holdout_plan": (lambda s, d: P.holdout_plan(members(s, d), "cls", "id", {"BUILDING": (6, 2, 2), "FURNITURE": (12, 4, 4)}), f"WITH {S.MEMBERS}, n AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY id) AS n, CASE cls WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 END AS f FROM members), s AS (SELECT id, cls, n, CASE WHEN n <= 6 * f THEN 'train' WHEN n <= 8 * f THEN 'val' WHEN n <= 10 * f THEN 'test' END AS split FROM n) SELECT id, cls, split, coalesce(split = 'train', false) AND n <= 3 AS few_shot FROM s"),
    "holdout_every": (lambda s, d: P.holdout_every(members(s, d), "cls", "id", 0.2), f"WITH {S.MEMBERS} SELECT id, cls, CASE WHEN (row_number() OVER (PARTITION BY cls ORDER BY id) - 1) % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM members"),
    "client_distribution": (lambda s, d: P.client_distribution(P.split_iid(members(s, d), "id", 7)), f"WITH {S.MEMBERS}, m AS ({_numbered('members', '', '42')}), c AS (SELECT cls, least((n - 1) // (count(*) OVER () // 7), 6)::INT AS client FROM m) SELECT a.client, b.cls, count(c.cls) AS n FROM (SELECT DISTINCT client FROM c) a CROSS JOIN (SELECT DISTINCT cls FROM c) b LEFT JOIN c ON c.client = a.client AND c.cls = b.cls GROUP BY 1, 2"),
    "client_totals": (lambda s, d: P.client_totals(members(s, d).withColumn("client", (F.col("id") % 3).cast("int"))), f"WITH {S.MEMBERS} SELECT (id % 3)::INT AS client, cls, count(*) AS n FROM members GROUP BY CUBE ((id % 3)::INT, cls)"),
    "merge_domains": (lambda s, d: (lambda m: P.domain_totals(P.merge_domains({"a": m.where("id % 2 = 0"), "b": m.where("id % 2 = 1")}, "id").withColumn("label", (F.col("cls") == "BUILDING").cast("int"))))(members(s, d)), f"WITH {S.MEMBERS} SELECT CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS domain, count(*) AS n, count(*) FILTER (WHERE cls = 'BUILDING') AS n_tp, count(*) FILTER (WHERE cls <> 'BUILDING') AS n_fp FROM members GROUP BY ROLLUP (CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END)"),
    "client_summary": (lambda s, d: r9(P.client_summary(S.boxes(s, d).select(P.client_of_path(F.concat_ws("/", "role", "rater", "idx")).alias("client"), (F.col("cls") == 1).cast("int").alias("label"))), "tp_pct"), f"WITH {S.BOXES} SELECT role || '_' || rater AS client, count(*) AS n, count(*) FILTER (WHERE cls = 1) AS n_tp, count(*) FILTER (WHERE cls <> 1) AS n_fp, round(100 * count(*) FILTER (WHERE cls = 1) / count(*), 9) AS tp_pct FROM boxes GROUP BY 1"),
    "duplicate_content": (lambda s, d: P.duplicate_content(_files(s, d)), "SELECT digest, source || '/' || doc_id::VARCHAR AS path, n FROM (SELECT *, md5(text) AS digest, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1"),
    "same_names": (lambda s, d: P.same_names(_files(s, d)), "WITH f AS (SELECT (doc_id % 50)::VARCHAR AS name, lang AS batch, md5(text) AS digest FROM documents) SELECT name, count(*) AS n, count(DISTINCT digest) AS n_contents, count(DISTINCT digest) = 1 AS same FROM f GROUP BY 1 HAVING count(DISTINCT batch) > 1"),
    "pairing_check": (lambda s, d: (lambda o: P.pairing_check(o.select("batch", F.concat(F.lit("a"), "k").alias("name")), o.select("batch", F.concat(F.lit("b"), "k").alias("name")), o.select("batch", F.concat(F.lit("a"), "k").alias("left"), F.concat(F.lit("b"), F.when(F.col("batch") == 1, F.col("k")).otherwise("x")).alias("right"))))(S.table(s, d, "supplier").select((F.col("s_suppkey") % 3).alias("batch"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("k"))), "WITH t AS (SELECT s_suppkey % 3 AS batch, lpad(s_suppkey::VARCHAR, 9, '0') AS k FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY k) AS n, count(*) OVER (PARTITION BY batch) AS c FROM t) SELECT batch, count(*) AS n, sum((batch <> 1)::INT)::BIGINT AS n_wrong, sum((batch <> 1 OR 2 * n <> c + 1)::INT)::BIGINT AS n_wrong_reversed FROM r GROUP BY batch"),
    "compare_names": (lambda s, d: P.compare_names(S.table(s, d, "customer").select(F.col("c_custkey").alias("name")), S.table(s, d, "orders").select((F.col("o_custkey") + 5).alias("name"))), "WITH a AS (SELECT c_custkey AS name FROM customer), b AS (SELECT DISTINCT o_custkey + 5 AS name FROM orders) SELECT name, 'both' AS side FROM a WHERE name IN (SELECT name FROM b) UNION ALL SELECT name, 'left' FROM a WHERE name NOT IN (SELECT name FROM b) UNION ALL SELECT name, 'right' FROM b WHERE name NOT IN (SELECT name FROM a)"),
    "label_profile": (_label_profile, _LABEL_PROFILE),
    "fedavg": (lambda s, d: r9(E.fedavg(S.params(s, d), S.client_stats(s, d).select("exp", "round", "client", F.col("n_samples").cast("double").alias("weight"))), "value"), f"WITH {S.PARAMS}, {S.CLIENT_STATS} SELECT exp, round, param, pos, round(CASE WHEN bool_or(is_int) THEN arg_min(value, client) ELSE sum(n_samples * value) / sum(n_samples) END, 9) AS value FROM params JOIN client_stats USING (exp, round, client) GROUP BY exp, round, param, pos"),
    "fedavg_equal": (lambda s, d: r9(E.fedavg(S.params(s, d)), "value"), f"WITH {S.PARAMS} SELECT exp, round, param, pos, round(CASE WHEN bool_or(is_int) THEN arg_min(value, client) ELSE avg(value) END, 9) AS value FROM params GROUP BY exp, round, param, pos"),
    "quality_weights": (lambda s, d: r9(E.quality_weights(S.client_stats(s, d), warmup=2, warm="samples"), "weight"), f"WITH {S.CLIENT_STATS} SELECT exp, round, client, round(CASE WHEN round < 2 THEN n_samples / sum(n_samples) OVER w ELSE map50 / sum(map50) OVER w END, 9) AS weight FROM client_stats WINDOW w AS (PARTITION BY exp, round)"),
    "fedprox_pull": (lambda s, d: (lambda p: r9(E.fedprox_pull(p, p.where("client = 'c0' and round = 0"), 0.1), "value"))(S.params(s, d)), f"WITH {S.PARAMS} SELECT p.exp, p.round, p.client, p.param, p.pos, round(CASE WHEN p.is_int OR g.value IS NULL THEN p.value ELSE 0.9 * p.value + 0.1 * g.value END, 9) AS value, p.is_int FROM params p LEFT JOIN (SELECT * FROM params WHERE client = 'c0' AND round = 0) g ON g.param = p.param AND g.pos = p.pos"),
    "aggregate_round": (lambda s, d: r9(E.aggregate_round(S.params(s, d), S.client_stats(s, d), "EWA-v2"), "value"), f"WITH {S.PARAMS}, {S.CLIENT_STATS} SELECT exp, round, param, pos, round(CASE WHEN bool_or(is_int) THEN arg_min(value, client) ELSE sum(map50 * value) / sum(map50) END, 9) AS value FROM params JOIN client_stats USING (exp, round, client) GROUP BY exp, round, param, pos"),
    "aggregate_round_fedavg": (lambda s, d: r9(E.aggregate_round(S.params(s, d), S.client_stats(s, d), "FedAvg"), "value"), _aggregated("n_samples", False)),
    "aggregate_round_fedprox": (lambda s, d: (lambda p: r9(E.aggregate_round(p, S.client_stats(s, d), "FedProx", p.where("client = 'c0' and round = 0"), 0.1), "value"))(S.params(s, d)), _aggregated("n_samples", True)),
    "aggregate_round_ewa_fedprox": (lambda s, d: (lambda p: r9(E.aggregate_round(p, S.client_stats(s, d), "EWA-FedProx", p.where("client = 'c0' and round = 0"), 0.1), "value"))(S.params(s, d)), _aggregated("map50", True)),
    "node_order_fixed": (lambda s, d: E.node_order(S.client_stats(s, d)), f"WITH {S.CLIENT_STATS} SELECT exp, round, client, row_number() OVER (PARTITION BY exp, round ORDER BY client)::INT AS place FROM client_stats"),
    "node_order_reversed": (lambda s, d: E.node_order(S.client_stats(s, d), "reversed"), f"WITH {S.CLIENT_STATS} SELECT exp, round, client, row_number() OVER (PARTITION BY exp, round ORDER BY client DESC)::INT AS place FROM client_stats"),
    "node_order_random": (lambda s, d: E.node_order(S.client_stats(s, d), "random", 3), f"WITH {S.CLIENT_STATS} SELECT exp, round, client, row_number() OVER (PARTITION BY exp, round ORDER BY md5('3|' || round || '|' || client))::INT AS place FROM client_stats"),
    "sequential_gate_local": (lambda s, d: (lambda c: r9(E.sequential_gate(c, E.node_order(c), "local", n_nodes=6), "weight"))(S.client_stats(s, d)), f"WITH {S.CLIENT_STATS} SELECT a.exp, a.round, b.round AS source_round, b.client, round(1 / 6, 9) AS weight FROM (SELECT DISTINCT exp, round FROM client_stats) a JOIN client_stats b ON a.exp = b.exp AND b.round <= a.round QUALIFY row_number() OVER (PARTITION BY a.exp, a.round, b.client ORDER BY b.map50 DESC, b.round) = 1"),
    "holdout_tail": (lambda s, d: P.holdout_every(members(s, d), "cls", "id", 0.2, tail=True).select("id", "cls", "split"), f"WITH {S.MEMBERS} SELECT id, cls, CASE WHEN row_number() OVER (PARTITION BY cls ORDER BY id) > count(*) OVER (PARTITION BY cls) - floor(count(*) OVER (PARTITION BY cls) * 0.2) THEN 'val' ELSE 'train' END AS split FROM members"),
    "node_order": (lambda s, d: E.node_order(S.client_stats(s, d), "quality"), f"WITH {S.CLIENT_STATS}, l AS (SELECT *, lag(map50) OVER (PARTITION BY exp, client ORDER BY round) AS last FROM client_stats) SELECT exp, round, client, row_number() OVER (PARTITION BY exp, round ORDER BY coalesce(last, 0) DESC, client)::INT AS place FROM l"),
    "sequential_gate": (lambda s, d: (lambda c: r9(E.sequential_gate(c, E.node_order(c), "soft"), "weight"))(S.client_stats(s, d)), _SOFT_GATE),
    "sequential_gate_none": (lambda s, d: (lambda c: r9(E.sequential_gate(c, E.node_order(c), "none"), "weight"))(S.client_stats(s, d)), f"WITH {S.CLIENT_STATS} SELECT a.exp, a.round, b.round AS source_round, b.client, round(b.n_samples / sum(b.n_samples) OVER (PARTITION BY a.exp, a.round), 9) AS weight FROM (SELECT DISTINCT exp, round FROM client_stats) a JOIN client_stats b ON a.exp = b.exp AND b.round <= a.round"),
    "sequential_gate_hard": (lambda s, d: (lambda c: E.sequential_gate(c, E.node_order(c), "hard"))(S.client_stats(s, d)), f"""WITH RECURSIVE {S.CLIENT_STATS}, o AS (SELECT exp, round, client, map50, row_number() OVER (PARTITION BY exp ORDER BY round, client) AS n FROM client_stats),
w AS (SELECT exp, n, round, round AS source_round, client, map50 AS cache FROM o WHERE n = 1 UNION ALL SELECT w.exp, o.n, o.round, CASE WHEN o.map50 > w.cache THEN o.round ELSE w.source_round END, CASE WHEN o.map50 > w.cache THEN o.client ELSE w.client END, greatest(o.map50, w.cache) FROM w JOIN o ON o.exp = w.exp AND o.n = w.n + 1)
SELECT exp, round, source_round, client, 1.0::DOUBLE AS weight FROM w QUALIFY row_number() OVER (PARTITION BY exp, round ORDER BY n DESC) = 1"""),
    "gated_average": (lambda s, d: (lambda c: r9(E.gated_average(S.params(s, d), E.sequential_gate(c, E.node_order(c), "none")), "value"))(S.client_stats(s, d)), f"WITH {S.PARAMS}, {S.CLIENT_STATS}, k AS (SELECT a.exp, a.round AS target, b.round, b.client, b.n_samples, b.n_samples / sum(b.n_samples) OVER (PARTITION BY a.exp, a.round) AS weight FROM (SELECT DISTINCT exp, round FROM client_stats) a JOIN client_stats b ON a.exp = b.exp AND b.round <= a.round) SELECT exp, target AS round, param, pos, round(CASE WHEN bool_or(is_int) THEN list({{'n': n_samples, 'c': client, 'v': value}} ORDER BY n_samples DESC, client DESC)[1].v ELSE sum(weight * value) END, 9) AS value FROM params JOIN k USING (exp, round, client) GROUP BY exp, target, param, pos"),
    "federated_rounds": (lambda s, d: r9(E.federated_rounds(S.vectors(s, d).select("client", "cls", *(F.get("values", F.lit(i)).alias(f"f{i}") for i in range(16))), [f"f{i}" for i in range(16)], "cls", "client", 10), "accuracy", "loss"), _ROUNDS_SQL),
    "convergence": (lambda s, d: r9(H.convergence(S.rounds(s, d)), "gain_20"), f"""WITH {S.ROUNDS}, r AS (SELECT *, lag(map50, 19) OVER (PARTITION BY exp ORDER BY round) AS back, last_value(map50) OVER w AS fin, last_value(val_loss) OVER w AS fl FROM rounds WINDOW w AS (PARTITION BY exp ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT exp, max(map50) AS best_map50, (min(round) FILTER (WHERE map50 = m))::INT AS best_map50_row, max(map) AS best_map, (min(round) FILTER (WHERE map = p))::INT AS best_map_row, min(round) FILTER (WHERE map50 >= 0.95 * fin) AS first_95, min(round) FILTER (WHERE val_loss = v) AS min_val_loss_row, CASE WHEN any_value(fl) > 1.1 * min(val_loss) THEN 'increasing' ELSE 'stable' END AS val_loss_trend, round(coalesce(any_value(fin) - arg_max(back, round), 0), 9) AS gain_20
FROM (SELECT *, max(map50) OVER (PARTITION BY exp) AS m, max(map) OVER (PARTITION BY exp) AS p, min(val_loss) OVER (PARTITION BY exp) AS v FROM r) GROUP BY exp"""),
    "round_summary": (lambda s, d: r9(H.round_summary(S.rounds(s, d)), "total_improvement", "mean_improvement"), f"WITH {S.ROUNDS} SELECT exp, max(map50) AS best, arg_max(map50, round) AS final, min(round) FILTER (WHERE map50 >= 0.95) AS first_095, round(arg_max(map50, round) - arg_min(map50, round), 9) AS total_improvement, round((arg_max(map50, round) - arg_min(map50, round)) / (count(*) - 1), 9) AS mean_improvement FROM rounds GROUP BY exp"),
    "client_gap": (lambda s, d: r9(H.client_gap(_round_clients(s, d)), "gap"), f"WITH {S.CLIENT_STATS} SELECT exp, round, round(max(map50) - min(map50), 9) AS gap, max(map50) - min(map50) > 0.05 AS warning FROM client_stats GROUP BY exp, round"),
    "client_pivot": (lambda s, d: r9(H.client_pivot(_round_clients(s, d), ["c0", "c1"]), "c0", "c1"), f"WITH {S.CLIENT_STATS} SELECT exp, round, round(max(map50) FILTER (WHERE client = 'c0'), 9) AS c0, round(max(map50) FILTER (WHERE client = 'c1'), 9) AS c1 FROM client_stats GROUP BY exp, round"),
    "strategy_table": (lambda s, d: r9(H.strategy_table(S.rounds(s, d), ["exp"]), "drop_from_best"), f"WITH {S.ROUNDS}, b AS (SELECT *, max(map50) OVER (PARTITION BY exp) AS m FROM rounds) SELECT exp, arg_max(map50, round) AS final, any_value(m) AS best, min(round) FILTER (WHERE map50 = m) AS best_round, min(round) FILTER (WHERE map50 >= 0.95 * m) AS convergence_round, round(any_value(m) - arg_max(map50, round), 9) AS drop_from_best FROM b GROUP BY exp"),
    "mu_sensitivity": (lambda s, d: r9(H.mu_sensitivity(S.rounds(s, d).withColumn("mu", F.substring("exp", 2, 1).cast("int") % 2 / 10)), "mean_final", "mean_best", "drop"), f"WITH {S.ROUNDS}, r AS (SELECT exp, (substr(exp, 2, 1)::INT % 2) / 10 AS mu, arg_max(map50, round) AS final, max(map50) AS best FROM rounds GROUP BY exp), t AS (SELECT mu, count(*) AS n_runs, avg(final) AS f, max(final) AS best_final, avg(best) AS b FROM r GROUP BY mu) SELECT mu, n_runs, round(f, 9) AS mean_final, best_final, round(b, 9) AS mean_best, round(max(f) OVER () - f, 9) AS drop FROM t"),
    "specialist_gap": (lambda s, d: H.specialist_gap(_round_clients(s, d)).withColumns({c: F.round(c, 6) for c in ("dominant_ap", "other_ap", "gap")}), f"WITH {S.CLIENT_STATS} SELECT exp, round, client, round(map50 * 3 / 8, 6) AS dominant_ap, round(map50 * 7 / 8, 6) AS other_ap, round(-map50 / 2, 6) AS gap FROM client_stats"),
    "readiness_score": (lambda s, d: H.readiness_score(S.rounds(s, d), S.rounds(s, d).select("exp", F.col("round").alias("instances"), "map")), f"WITH {S.ROUNDS}, t AS (SELECT exp, max(map50) > 0.85 AS quality_ok, max(round) / greatest(1, min(round)) < 5 AS balance_ok, max(map) - min(map) > 0.05 AS spread_ok, arg_max(val_loss, round) <= 1.1 * min(val_loss) AS loss_ok FROM rounds GROUP BY exp), u AS (SELECT *, (25 * (quality_ok::INT + balance_ok::INT + spread_ok::INT + loss_ok::INT))::INT AS score FROM t) SELECT *, CASE WHEN score >= 75 THEN 'ready' WHEN score >= 50 THEN 'cautious' ELSE 'not_ready' END AS verdict FROM u"),
    "best_round": (lambda s, d: H.best_round(S.rounds(s, d)).select("exp", "round", "map"), f"WITH {S.ROUNDS} SELECT exp, round, map FROM rounds QUALIFY row_number() OVER (PARTITION BY exp ORDER BY map DESC, round) = 1"),
    "round_averages": (lambda s, d: r9(H.round_averages(_round_clients(s, d)), "train_loss", "train_acc"), f"WITH {S.CLIENT_STATS} SELECT exp, round, round(avg(1 - map50), 9) AS train_loss, round(avg(map50), 9) AS train_acc FROM client_stats GROUP BY exp, round"),
    "build_chain": (lambda s, d: _chain(s, d).select("chain_id", "index", "operation", "prev_hash", "hash"), f"{_CHAIN} SELECT chain_id, index, operation, prev_hash, hash FROM chain"),
    "block_hash": (lambda s, d: S.events(s, d).withColumn("prev_hash", F.lit("0")).withColumn("nonce", F.lit(0)).select("chain_id", "index", A.block_hash().alias("hash")), f"WITH {S.EVENTS} SELECT chain_id, index, sha256(index::VARCHAR || ':' || ts || ':' || operation || ':0:0') AS hash FROM ev"),
    "json_block_hash": (lambda s, d: S.events(s, d).select("chain_id", "index", A.json_block_hash("index", "ts", "operation", F.lit("x"), F.lit("0")).alias("hash")), f"""WITH {S.EVENTS} SELECT chain_id, index, sha256('{{"details": "x", "index": ' || index::VARCHAR || ', "operation": "' || operation || '", "prev_hash": "0", "timestamp": "' || ts || '"}}') AS hash FROM ev"""),
    "verify_chain": (lambda s, d: A.verify_chain(_tampered(s, d)), f"WITH {S.EVENTS}, c AS (SELECT chain_id, count(*) + 1 AS n, max(index) FILTER (WHERE index = 3) AS has FROM ev GROUP BY chain_id) SELECT chain_id, n AS n_blocks, NOT (chain_id::BIGINT % 5 = 0 AND has IS NOT NULL) AS valid, CASE WHEN chain_id::BIGINT % 5 = 0 THEN has END AS first_bad_index FROM c"),
    "recent_blocks": (lambda s, d: A.recent(_chain(s, d), 3).select("chain_id", "index", "place"), f"{_CHAIN} SELECT chain_id, index, row_number() OVER (PARTITION BY chain_id ORDER BY index DESC)::INT AS place FROM b QUALIFY place <= 3"),
    "audit_trail": (lambda s, d: A.trail(_chain(s, d), 2, "click").select("chain_id", "index", "place"), f"{_CHAIN}, t AS (SELECT chain_id, index FROM b WHERE operation = 'click' QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY index DESC) <= 2) SELECT chain_id, index, row_number() OVER (PARTITION BY chain_id ORDER BY index)::INT AS place FROM t"),
    "retained_chain": (lambda s, d: A.verify_chain(A.retain(_chain(s, d), 5)), f"{_CHAIN} SELECT chain_id, least(count(*), 5) AS n_blocks, true AS valid, NULL::BIGINT AS first_bad_index FROM b GROUP BY chain_id"),
    "audit_stats": (lambda s, d: A.audit_stats(_chain(s, d)).select("chain_id", "length", "valid", "latest_hash", F.to_json("operations").alias("operations")), f"""{_CHAIN}, o AS (SELECT chain_id, '{{' || string_agg('"' || operation || '":' || n, ',' ORDER BY operation) || '}}' AS operations FROM (SELECT chain_id, operation, count(*) AS n FROM chain GROUP BY 1, 2) GROUP BY 1)
SELECT chain_id, count(*) AS length, true AS valid, substr(arg_max(hash, index), 1, 16) || '...' AS latest_hash, any_value(operations) AS operations FROM chain JOIN o USING (chain_id) GROUP BY chain_id"""),
    "audit_display": (lambda s, d: A.display(_chain(s, d)).select("chain_id", "index", "details", "hash"), f"{_CHAIN} SELECT chain_id, index, substr(details, 1, 80) AS details, substr(hash, 1, 16) AS hash FROM chain"),
    "read_label_lines": (lambda s, d: r9(R.label_lines_of(W.label_lines(_label_rows(s, d), "image").withColumnRenamed("image", "source").drop("idx")), "xc", "yc", "w", "h"), f"WITH {S.BOXES}, {_LABELS} SELECT image AS source, cls, round(xc, 6) AS xc, round(yc, 6) AS yc, round(w, 6) AS w, round(h, 6) AS h FROM lab"),
    "read_polygons": (lambda s, d: R.polygons_of(W.polygon_json(S.boxes(s, d)).withColumnRenamed("image", "source")).select("source", "key", "x1", "y1", "x2", "y2"), f"WITH {S.BOXES} SELECT image AS source, (row_number() OVER (PARTITION BY image ORDER BY idx) - 1)::VARCHAR AS key, x1, y1, x2, y2 FROM boxes"),
    "inventory_files": (lambda s, d: R.inventory(R.classify_paths(_paths(s, d))), f"WITH {_PATHS} SELECT split, cls, plate, annotator, count(*) AS n FROM f GROUP BY ALL"),
    "pick_primary_annotator": (lambda s, d: R.pick_primary_annotator(R.classify_paths(_paths(s, d))).select("split", "cls", "plate", "image", "annotator"), f"WITH {_PATHS} SELECT split, cls, plate, image, annotator FROM f QUALIFY row_number() OVER (PARTITION BY split, cls, plate, image ORDER BY coalesce(list_position(['t0', 'annotator_a', 't1_a', 'annotator_b', 't1_b', 'other'], annotator), 6), name) = 1"),
    "parse_class_table": (lambda s, d: R.parse_class_table(S.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("all 1 2\n  early  10 "), F.col("p_size").cast("string"), F.lit(" 0.5 0.25 0.75 0.4\nodd 1 2 3 4 5 6")).alias("value")), ["early"]), "SELECT p_partkey AS id, 'early' AS cls, 10::INT AS images, p_size::INT AS instances, 0.5::DOUBLE AS precision, 0.25::DOUBLE AS recall, 0.75::DOUBLE AS map50, 0.4::DOUBLE AS map FROM part"),
}
