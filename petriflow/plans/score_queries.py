"""Registered queries over scores and vectors: ranking metrics, fusion, neighbours, cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petriflow.operators import cases as C
from petriflow.operators import fusion as U
from petriflow.operators import ranking as K
from petriflow.operators import neighbours as N
from petriflow.operators import vectors as V
from petriflow.plans import standins as S
from petriflow.plans.box_queries import r9


def _auc(rows: str, by: str, name: str = "auc") -> str:
    """CTEs ending in ``name`` (by, n, n_pos, auc) from ``rows`` (by, label, score)."""
    part = f"PARTITION BY {by} " if by else ""
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""{name}_s AS (SELECT {keys}score, sum((label = 1)::INT) AS pos, sum((label <> 1)::INT) AS neg FROM {rows} GROUP BY {keys}score),
{name}_c AS (SELECT *, sum(neg) OVER ({part}ORDER BY score) - neg AS below FROM {name}_s),
{name} AS (SELECT {keys}sum(pos + neg)::BIGINT AS n, sum(pos)::BIGINT AS n_pos, CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(pos * below + pos * neg / 2) / (sum(pos) * sum(neg)) ELSE 0.5 END AS auc FROM {name}_c {group})"""


def _pr(rows: str, by: str, name: str = "pr") -> str:
    """CTEs ending in ``name`` (by, ap, pr_auc) and name_t (by, score, tp, fp, n_pos, pos, neg)."""
    part = f"PARTITION BY {by} " if by else ""
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""{name}_s AS (SELECT {keys}score, sum((label = 1)::INT) AS pos, sum((label <> 1)::INT) AS neg FROM {rows} GROUP BY {keys}score),
{name}_t AS (SELECT *, sum(pos) OVER ({part}ORDER BY score DESC) AS tp, sum(neg) OVER ({part}ORDER BY score DESC) AS fp, sum(pos) OVER ({part.strip()}) AS n_pos FROM {name}_s),
{name} AS (SELECT {keys}sum(CASE WHEN n_pos > 0 THEN tp / (tp + fp) * pos / n_pos ELSE 0 END) AS ap,
  sum(CASE WHEN n_pos > 0 THEN pos / n_pos * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / (tp - pos + fp - neg) ELSE 1 END) / 2 ELSE 0 END) AS pr_auc FROM {name}_t {group})"""


def scores(s: SparkSession, d: str) -> DataFrame:
    return S.scores(s, d)


_TRAJ = "traj AS (SELECT vec_id AS id, (label < 5)::INT AS label, [round(x::DOUBLE * 2 + 0.5, 3) for x in embedding[1:8]] AS s, [round(abs(x::DOUBLE) * 4, 3) for x in embedding[9:16]] AS c FROM embeddings)"


def trajectories(s: SparkSession, d: str) -> DataFrame:
    e = S.table(s, d, "embeddings")
    cut = lambda a, f: F.transform(F.slice("embedding", a, 8), lambda x: F.round(f(x.cast("double")), 3))
    return e.select(F.col("vec_id").alias("id"), (F.col("label") < 5).cast("int").alias("label"), cut(1, lambda x: x * 2 + 0.5).alias("scores"), cut(9, lambda x: F.abs(x) * 4).alias("certainties"))


def _near(metric: str, k: int, where: str = "TRUE", queries: str = "vectors") -> str:
    score = "round(sqrt(list_aggregate(list_transform(list_zip(a.values, b.values), lambda z: pow(z[1] - z[2], 2)), 'sum')), 9)" if metric == "euclidean" else "-round(list_aggregate(list_transform(list_zip(a.values, b.values), lambda z: z[1] * z[2]), 'sum') / sqrt(list_aggregate(list_transform(a.values, lambda x: x * x), 'sum')) / sqrt(list_aggregate(list_transform(b.values, lambda x: x * x), 'sum')), 12)"
    return f"near AS (SELECT a.id AS query_id, b.id, a.client AS qc, b.client AS bc, b.label AS blabel, {score} AS s, row_number() OVER (PARTITION BY a.id ORDER BY {score}, b.id) AS rank FROM {queries} a CROSS JOIN vectors b WHERE {where} QUALIFY rank <= {k})"


#: Rows of the three rules' scans by parameter, and their average precision.
_HARD = "SELECT round(i * 0.05, 2)::DOUBLE AS param, label, CASE WHEN score >= round(i * 0.05, 2)::DOUBLE THEN round(conf, 12) ELSE 0 END AS score, score >= round(i * 0.05, 2)::DOUBLE AS k FROM scores CROSS JOIN range(1, 19) t(i)"
_SOFT = "SELECT round(i * 0.1, 1)::DOUBLE AS param, label, round(conf * (1 - round(i * 0.1, 1)::DOUBLE * (1 - score)), 12) AS score FROM scores CROSS JOIN range(1, 10) t(i)"
_GEOMETRIC = "SELECT round(0.1 + 0.05 * i, 2)::DOUBLE AS param, label, round(pow(conf + 1e-8, round(0.1 + 0.05 * i, 2)::DOUBLE) * pow(score + 1e-8, 1 - round(0.1 + 0.05 * i, 2)::DOUBLE), 12) AS score FROM scores CROSS JOIN range(0, 17) t(i)"
_BEST = f"""WITH {S.SCORES}, h AS ({_HARD}), s AS ({_SOFT}), g AS ({_GEOMETRIC}), c AS (SELECT label, conf AS score FROM scores),
{_pr('h', 'param', 'ph')}, {_pr('s', 'param', 'ps')}, {_pr('g', 'param', 'pg')}, {_pr('c', '', 'pc')},
u AS (SELECT 'hard_filter' AS rule, param, ap FROM ph WHERE param IN (SELECT param FROM h WHERE k GROUP BY param HAVING count(*) >= 10) UNION ALL SELECT 'soft_penalize', param, ap FROM ps UNION ALL SELECT 'geometric_mean', param, ap FROM pg),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY rule ORDER BY ap DESC, param) = 1)
SELECT rule, CASE WHEN b.ap > pc.ap THEN param END AS param, round(greatest(b.ap, pc.ap), 9) AS ap, round(pc.ap, 9) AS baseline FROM b CROSS JOIN pc"""

_PROTOTYPES = [("p01", [1.0 if i % 2 else -1.0 for i in range(64)], [1.0 if i % 3 else -1.0 for i in range(64)]), ("p02", [float(i % 5) for i in range(64)], [float(i % 7) for i in range(64)])]


def _cosine(values: str, p: list[float]) -> str:
    return f"list_sum(list_transform(list_zip({values}, {p}::DOUBLE[]), lambda z: z[1] * z[2])) / (sqrt(list_sum([x * x for x in {values}])) * sqrt({sum(x * x for x in p)}::DOUBLE))"


_MARGIN = " UNION ALL ".join(f"SELECT client, label, '{name}' AS pair, round({_cosine('values', p)} - {_cosine('values', n)}, 12) AS score FROM vectors" for name, p, n in _PROTOTYPES)
#: Vectors standardised by position.
_STANDARD = S.VECTORS.replace("vectors AS", "raw AS") + ", long AS (SELECT id, client, label, cls, i, values[i] AS x FROM raw CROSS JOIN range(1, 65) t(i)), moments AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY i), vectors AS (SELECT id, client, label, cls, list((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END ORDER BY i) AS values FROM long JOIN moments USING (i) GROUP BY ALL)"
_OUTLIER = f"""{_near('euclidean', 5, "b.label = 1 AND a.client <> b.client AND a.client IN (SELECT client FROM vectors WHERE label <> 1 GROUP BY client HAVING count(*) >= 3)")},
outlier AS (SELECT query_id AS id, avg(s) AS distance FROM near GROUP BY 1 HAVING count(*) = 5)"""
_LOCAL = _near('cosine', 7, 'a.id <> b.id AND a.client = b.client AND a.client IN (SELECT client FROM c)').replace("near AS", "near_l AS")
_REPORT = f"""WITH {S.VECTORS}, c AS (SELECT client FROM vectors GROUP BY client HAVING count(*) > 8 AND count(DISTINCT label) > 1), {_LOCAL}, {_near('cosine', 7, 'a.id <> b.id')},
vl AS (SELECT query_id AS id, avg(blabel) AS vote FROM near_l GROUP BY 1), vg AS (SELECT query_id AS id, avg(blabel) AS vote FROM near GROUP BY 1),
l AS (SELECT client, label, coalesce(vote, 0.5) AS score FROM vectors LEFT JOIN vl USING (id)), g AS (SELECT client, label, coalesce(vote, 0.5) AS score FROM vectors LEFT JOIN vg USING (id)),
{_auc('l', 'client', 'al')}, {_auc('g', 'client', 'ag')}, {_pr('l', 'client', 'rl')}, {_pr('g', 'client', 'rg')}
SELECT client, al.n, al.n_pos, round(al.auc, 9) AS local_auc, round(ag.auc, 9) AS global_auc, round(rl.pr_auc, 9) AS local_pr, round(rg.pr_auc, 9) AS global_pr, round(ag.auc - al.auc, 9) AS delta_auc FROM al JOIN ag USING (client) JOIN rl USING (client) JOIN rg USING (client)"""
_OUTLIER_REPORT = f"""WITH {S.VECTORS}, {_OUTLIER}, o AS (SELECT client, label, distance, -distance AS score FROM outlier JOIN vectors USING (id)), {_auc('o', 'client')}, v AS (SELECT client, label, distance AS score FROM o), {_auc('v', 'client', 'd')},
t AS (SELECT client, sum(pow(pos + neg, 3) - (pos + neg)) AS ties, sum(pos * below + pos * neg / 2) AS u, sum(pos)::DOUBLE AS n1, sum(neg)::DOUBLE AS n0 FROM d_c GROUP BY client),
m AS (SELECT client, median(distance) FILTER (WHERE label = 1) AS median1, median(distance) FILTER (WHERE label <> 1) AS median0 FROM o GROUP BY client)
SELECT client, round(auc.auc, 9) AS auc, round(median1, 9) AS median1, round(median0, 9) AS median0, u::DOUBLE AS u, round((-(u - n1 * n0 / 2) - 0.5) / sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))), 9) AS z FROM auc JOIN t USING (client) JOIN m USING (client) WHERE n1 >= 3 AND n0 >= 3"""
_SILHOUETTE = f"""WITH {S.VECTORS}, p AS (SELECT a.id, a.cls AS c, b.cls AS o, sum(sqrt(list_sum(list_transform(list_zip(a.values, b.values), lambda z: pow(z[1] - z[2], 2))))) AS d FROM vectors a CROSS JOIN vectors b GROUP BY 1, 2, 3),
n AS (SELECT cls AS o, count(*) AS n FROM vectors GROUP BY 1), m AS (SELECT id, c, max(CASE WHEN o = c THEN d / nullif(n - 1, 0) END) AS a, min(CASE WHEN o <> c THEN d / n END) AS b FROM p JOIN n USING (o) GROUP BY 1, 2)
SELECT c AS cls, round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM m GROUP BY c"""


def _queries100(v: DataFrame) -> DataFrame:
    return v.where(F.col("id") % 100 == 0)


def _case_rows(s: SparkSession, d: str) -> DataFrame:
    v = S.vectors(s, d)
    kinds = F.array(F.lit("healthy"), F.lit("early_stage"), F.lit("late_stage"))
    return v.select("id", "values", F.concat(F.lit("h"), (F.col("id") % 4).cast("string")).alias("hospital_id"), F.get(kinds, F.col("cls") % 3).alias("diagnosis"), ((F.col("id") % 10) / 10).alias("confidence"))


def _approx_recall(s, d):
    """(n_queries, n_neighbours, recall_reached, fewer_vectors): whether the inverted file finds 0.9 of the exact neighbours, comparing at most a fifth of the pairs by whole
    vectors."""
    v = N.checkpointed(S.vectors(s, d).select("id", "values"))
    q = _queries100(v)
    found, exact = N.checkpointed(N.approx_knn(q, v, 10)), V.knn_euclidean(q, v, 10)
    pairs = q.agg(F.count("*").alias("q")).crossJoin(v.agg(F.count("*").alias("n"))).select((F.col("q") * F.col("n")).alias("pairs"))  # one row each
    compared = found.groupBy("query_id").agg(F.max("n_compared").alias("n")).agg(F.sum("n").alias("compared"))
    counts = exact.agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_neighbours"))
    out = counts.crossJoin(N.recall_at_k(found, exact)).crossJoin(compared).crossJoin(pairs)  # one row each
    return out.select("n_queries", "n_neighbours", (F.col("recall") >= 0.9).alias("recall_reached"), (5 * F.col("compared") <= F.col("pairs")).alias("fewer_vectors"))


def _estimate(s, d):
    """Whether the estimate from 24 rows of each class lies as near the exact silhouette as it says."""
    v = N.checkpointed(S.vectors(s, d))
    both = V.silhouette(v).withColumnRenamed("silhouette", "exact").join(V.silhouette_estimate(v, per_cluster=24), "cls")  # a row a class
    return both.select("cls", (F.abs(F.col("exact") - F.col("silhouette")) <= F.col("margin") + 1e-9).alias("within"))


def _leading(s, d):
    """The first of three components of every row, sign aside, and its share of the variance."""
    out, share = V.pca_project(S.vectors(s, d), 3)
    return out.select("id", F.round(F.abs(F.get("pc", F.lit(0))), 6).alias("first"), F.lit(round(float(share[0]), 6)).alias("share"))


def _power(k: int) -> str:
    """The correlation matrix squared ``k`` times, each time scaled by its largest entry: its columns turn into the first component."""
    step = "c{1} AS MATERIALIZED (SELECT i, j, v / max(abs(v)) OVER () AS v FROM (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM c{0} a JOIN c{0} b ON a.j = b.i GROUP BY a.i, b.j))"
    return ",\n".join(step.format(n, n + 1) for n in range(k))


_LEADING = f"""WITH {S.VECTORS}, l AS (SELECT id, i, values[i] AS x FROM vectors, range(1, 65) t(i)), z AS MATERIALIZED (SELECT id, i, (x - avg(x) OVER (PARTITION BY i)) / stddev_samp(x) OVER (PARTITION BY i) AS z FROM l),
c0 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.z * b.z) / (count(*) - 1) AS v FROM z a JOIN z b USING (id) GROUP BY a.i, b.i),
{_power(14)},
u AS (SELECT i, v / sqrt(sum(v * v) OVER ()) AS v FROM c14 WHERE j = (SELECT i FROM c14 WHERE i = j ORDER BY v DESC, i LIMIT 1)),
e AS (SELECT sum(a.v * c0.v * b.v) / 64 AS share FROM c0 JOIN u a ON a.i = c0.i JOIN u b ON b.i = c0.j)
SELECT id, round(abs(sum(z * v)), 6) AS first, round(any_value(share), 6) AS share FROM z JOIN u USING (i), e GROUP BY id"""


_CASES = "cases AS (SELECT id, values, client, label, 'h' || (id % 4)::VARCHAR AS hospital_id, ['healthy', 'early_stage', 'late_stage'][cls % 3 + 1] AS diagnosis, (id % 10) / 10 AS confidence FROM vectors)"


def _profiles(s: SparkSession, d: str) -> DataFrame:
    t = S.table(s, d, "part")
    return t.select(F.col("p_partkey").alias("id"), (F.col("p_size") * 800.0).alias("area"), (F.col("p_size") * 15.0).alias("perimeter"), ((F.col("p_partkey") % 11) / 10).alias("circularity"), ((F.col("p_partkey") % 7) / 7).alias("solidity"), F.lit(None).cast("double").alias("aspect_ratio"), ((F.col("p_partkey") % 13) / 10).alias("eccentricity"), (F.col("p_partkey") % 60).cast("double").alias("n_organoids"), F.lit(100.0).alias("avg_area"), F.lit(-5.0).alias("std_area"), F.lit(None).cast("array<double>").alias("class_distribution"))


_PROFILE = "SELECT p_partkey AS id, p_size * 800.0 AS area, p_size * 15.0 AS perimeter, (p_partkey % 11) / 10 AS circularity, (p_partkey % 7) / 7 AS solidity, (p_partkey % 13) / 10 AS eccentricity, (p_partkey % 60)::DOUBLE AS n_organoids FROM part"


def _vlm(s: SparkSession, d: str) -> DataFrame:
    t = S.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), S.round3(F.col("o_totalprice") / 500000).alias("p"), (F.col("o_custkey") % 3).alias("k"))
    good = F.concat(F.lit('Answer: {"is_organoid": '), F.col("p").cast("string"), F.lit(', "confidence": 0.25, "reason": "ok"} end'))
    bad = F.concat(F.lit("confidence: "), F.col("p").cast("string"), F.lit(" is_organoid = 0.75"))
    return t.select("id", F.when(F.col("k") == 0, good).when(F.col("k") == 1, bad).otherwise("nothing").alias("raw"))


QUERIES = {
    "roc_auc": (lambda s, d: r9(K.roc_auc(scores(s, d), by=["grp"]), "auc"), f"WITH {S.SCORES}, {_auc('scores', 'grp')} SELECT grp, n, n_pos, round(auc, 9) AS auc FROM auc"),
    "roc_auc_overall": (lambda s, d: r9(K.roc_auc(scores(s, d)), "auc"), f"WITH {S.SCORES}, {_auc('scores', '')} SELECT n, n_pos, round(auc, 9) AS auc FROM auc"),
    "average_precision": (lambda s, d: r9(K.average_precision(scores(s, d), by=["grp"]), "ap"), f"WITH {S.SCORES}, {_pr('scores', 'grp')} SELECT grp, round(ap, 9) AS ap FROM pr"),
    "pr_auc": (lambda s, d: r9(K.pr_auc(scores(s, d), by=["grp"]), "pr_auc"), f"WITH {S.SCORES}, {_pr('scores', 'grp')} SELECT grp, round(pr_auc, 9) AS pr_auc FROM pr"),
    "best_f1": (lambda s, d: r9(K.best_f1(scores(s, d), by=["grp"]), "f1", "threshold"), f"WITH {S.SCORES}, {_pr('scores', 'grp')}, f AS (SELECT grp, score, 2 * (tp / (tp + fp)) * (tp / n_pos) / (tp / (tp + fp) + tp / n_pos + 1e-10) AS f1 FROM pr_t) SELECT grp, score AS threshold, round(f1, 9) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY grp ORDER BY f1 DESC, score) = 1"),
    "best_f1_fixed": (lambda s, d: r9(K.best_f1_fixed(scores(s, d), by=["grp"]), "f1", "threshold"), f"WITH {S.SCORES}, g AS (SELECT grp, k, sum((round(score * 100, 9) >= k AND label = 1)::INT) AS tp, sum((round(score * 100, 9) >= k AND label <> 1)::INT) AS fp, sum((label = 1)::INT) AS p FROM scores CROSS JOIN range(1, 100) t(k) GROUP BY 1, 2) SELECT grp, round(k / 100, 9) AS threshold, round(CASE WHEN tp > 0 THEN 2 * tp / (tp + fp + p) ELSE 0 END, 9) AS f1 FROM g QUALIFY row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN tp > 0 THEN 2 * tp / (tp + fp + p) ELSE 0 END DESC, k) = 1"),
    "percentile_sweep": (lambda s, d: r9(K.percentile_sweep(scores(s, d)), "threshold", "precision", "recall", "f1", "fp_reduction_rate"), f"WITH {S.SCORES}, c AS (SELECT unnest(range(5, 100, 5)) AS pct, unnest(quantile_cont(score, [x / 100 for x in range(5, 100, 5)])) AS threshold FROM scores), g AS (SELECT pct, threshold, sum((score >= threshold AND label = 1)::INT) AS tp, sum((score >= threshold AND label <> 1)::INT) AS fp, sum((label = 1)::INT) AS p, sum((label <> 1)::INT) AS n FROM scores CROSS JOIN c GROUP BY 1, 2) SELECT pct::INT AS pct, round(threshold, 9) AS threshold, round(tp / (tp + fp), 9) AS precision, round(tp / p, 9) AS recall, round(2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p), 9) AS f1, (tp + fp)::BIGINT AS kept, (p + n - tp - fp)::BIGINT AS rejected, round(1 - fp / n, 9) AS fp_reduction_rate FROM g"),
    "feature_auc_ranking": (lambda s, d: r9(K.feature_auc_ranking(scores(s, d), ["score", "conf", "area", "perimeter"], k=3), "auc", "pr_auc"), f"WITH {S.SCORES}, l AS (SELECT feature, label, value AS score FROM (SELECT label, score, conf, area, perimeter FROM scores) UNPIVOT (value FOR feature IN (score, conf, area, perimeter))), {_auc('l', 'feature')}, {_pr('l', 'feature')} SELECT feature, round(auc, 9) AS auc, round(pr_auc, 9) AS pr_auc, row_number() OVER (ORDER BY auc DESC, feature)::INT AS rank FROM auc JOIN pr USING (feature) QUALIFY rank <= 3"),
    "mann_whitney": (lambda s, d: r9(K.mann_whitney(scores(s, d), "conf", "label", ["grp"]), "z", "median1", "median0").withColumn("p", F.round("p", 6)), f"""WITH {S.SCORES}, v AS (SELECT grp, label, conf AS score FROM scores), {_auc('v', 'grp')}, t AS (SELECT grp, sum(pow(pos + neg, 3) - (pos + neg)) AS ties, sum(pos * below + pos * neg / 2) AS u FROM auc_c GROUP BY grp), m AS (SELECT grp, median(conf) FILTER (WHERE label = 1) AS median1, median(conf) FILTER (WHERE label <> 1) AS median0 FROM scores GROUP BY grp),
z AS (SELECT grp, n_pos AS n1, n - n_pos AS n0, median1, median0, u, (abs(u - n_pos * (n - n_pos) / 2) - 0.5) / sqrt(n_pos * (n - n_pos) / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM auc JOIN t USING (grp) JOIN m USING (grp)),
p AS (SELECT grp, least(1, 2 * sum(exp(-pow(z + i * 0.004, 2) / 2) * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 0.004 / 3 / sqrt(2 * pi())) AS p FROM z CROSS JOIN range(0, 4001) r(i) GROUP BY grp)
SELECT grp, n1, n0, round(median1, 9) AS median1, round(median0, 9) AS median0, u, round(z, 9) AS z, round(p, 6) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM z JOIN p USING (grp)"""),
    "standardise": (lambda s, d: r9(K.standardise(scores(s, d).select("id", "conf", "area"), ["conf", "area"]), "conf", "area"), f"WITH {S.SCORES} SELECT id, round((conf - avg(conf) OVER ()) / stddev_pop(conf) OVER (), 9) AS conf, round((area - avg(area) OVER ()) / stddev_pop(area) OVER (), 9) AS area FROM scores"),
    "kl_matrix": (lambda s, d: r9(K.kl_matrix(scores(s, d).withColumn("v", F.col("conf") * 8 - 4), "grp", "v"), "kl"), f"WITH {S.SCORES}, v AS (SELECT grp, conf * 8 - 4 AS v FROM scores), b AS (SELECT grp, least(19, floor((v + 3) / 0.3))::INT AS bin, count(*) AS n FROM v WHERE v >= -3 AND v <= 3 GROUP BY 1, 2), q AS (SELECT g.grp, r.bin, coalesce(n / sum(n) OVER (PARTITION BY g.grp), 0) + 1e-10 AS q FROM (SELECT DISTINCT grp FROM v) g CROSS JOIN range(0, 20) r(bin) LEFT JOIN b ON b.grp = g.grp AND b.bin = r.bin) SELECT a.grp AS a, b.grp AS b, round(sum(a.q * ln(a.q / b.q)), 9) AS kl FROM q a JOIN q b USING (bin) GROUP BY 1, 2"),
    "kl_adaptive": (lambda s, d: r9(K.kl_adaptive(scores(s, d), "grp", "conf"), "kl"), f"""WITH {S.SCORES}, r AS (SELECT grp, min(conf) AS lo, max(conf) AS hi, count(conf) AS n FROM scores GROUP BY grp), p AS (SELECT a.grp AS a, b.grp AS b, least(a.lo, b.lo) AS lo, greatest(a.hi, b.hi) AS hi, a.n AS na, b.n AS nb FROM r a CROSS JOIN r b),
qa AS (SELECT a, b, least(19, floor((conf - lo) / (hi - lo) * 20))::INT AS bin, count(*) AS c FROM p JOIN scores ON grp = a GROUP BY 1, 2, 3), qb AS (SELECT a, b, least(19, floor((conf - lo) / (hi - lo) * 20))::INT AS bin, count(*) AS c FROM p JOIN scores ON grp = b GROUP BY 1, 2, 3),
q AS (SELECT p.a, p.b, (coalesce(qa.c, 0) / na + 1e-8) / (1 + 2e-7) AS x, (coalesce(qb.c, 0) / nb + 1e-8) / (1 + 2e-7) AS y FROM p CROSS JOIN range(0, 20) t(bin) LEFT JOIN qa ON qa.a = p.a AND qa.b = p.b AND qa.bin = t.bin LEFT JOIN qb ON qb.a = p.a AND qb.b = p.b AND qb.bin = t.bin) SELECT a, b, round(sum(x * ln(x / y)), 9) AS kl FROM q GROUP BY 1, 2"""),
    "normal_range": (lambda s, d: r9(K.normal_range(scores(s, d), "grp", ["score", "conf"]), "p5", "p50", "p95", "outside"), f"WITH {S.SCORES}, l AS (SELECT grp, label, feature, value FROM (SELECT grp, label, score, conf FROM scores) UNPIVOT (value FOR feature IN (score, conf))), r AS (SELECT feature, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM l WHERE label = 1 GROUP BY feature) SELECT grp, feature, round(any_value(p5), 9) AS p5, round(any_value(p50), 9) AS p50, round(any_value(p95), 9) AS p95, count(*) AS n, round(avg((value < p5 OR value > p95)::INT), 9) AS outside FROM l JOIN r USING (feature) WHERE label <> 1 GROUP BY grp, feature HAVING count(*) >= 3"),
    "calibration": (lambda s, d: r9(K.calibration(scores(s, d)), "observed", "low"), f"WITH {S.SCORES}, b AS (SELECT floor(score * 10)::INT AS bin, count(*) AS n, avg(label) AS observed FROM scores WHERE score >= 0 AND score < 1 GROUP BY 1) SELECT t.bin::INT AS bin, t.bin / 10 AS low, coalesce(n, 0) AS n, round(observed, 9) AS observed FROM range(0, 10) t(bin) LEFT JOIN b USING (bin)"),
    "trajectory_metrics": (lambda s, d: r9(K.trajectory_metrics(trajectories(s, d)), "auc", "accuracy", "mean_certainty"), f"WITH {_TRAJ}, l AS (SELECT label, t::INT AS tick, s[t + 1] AS score, c[t + 1] AS c FROM traj CROSS JOIN range(0, 8) r(t)), {_auc('l', 'tick')} SELECT tick, round(auc, 9) AS auc, round(a, 9) AS accuracy, round(c, 9) AS mean_certainty FROM auc JOIN (SELECT tick, avg(((score > 0.5)::INT = label)::INT) AS a, avg(c) AS c FROM l GROUP BY tick) USING (tick)"),
    "best_tick": (lambda s, d: r9(K.best_tick(K.trajectory_metrics(trajectories(s, d))), "best", "final", "gain"), f"WITH {_TRAJ}, l AS (SELECT label, t::INT AS tick, s[t + 1] AS score FROM traj CROSS JOIN range(0, 8) r(t)), {_auc('l', 'tick')}, r AS (SELECT tick, round(auc, 12) AS auc FROM auc) SELECT (SELECT tick FROM r ORDER BY auc DESC, tick LIMIT 1) AS best_tick, round(max(auc), 9) AS best, round(arg_max(auc, tick), 9) AS final, round(max(auc) - arg_max(auc, tick), 9) AS gain FROM r"),
    "trajectory_stops": (lambda s, d: K.trajectory_stops(trajectories(s, d)).select("id", "first_certain", "score_at_peak"), f"WITH {_TRAJ} SELECT id, coalesce(list_position([x >= 0.8 for x in c], true) - 1, 8)::INT AS first_certain, s[list_position(c, list_max(c))] AS score_at_peak FROM traj"),
    "class_trajectories": (lambda s, d: r9(K.class_trajectories(trajectories(s, d)), "mean", "sd"), f"WITH {_TRAJ} SELECT label, t::INT AS tick, round(avg(s[t + 1]), 9) AS mean, round(stddev_pop(s[t + 1]), 9) AS sd FROM traj CROSS JOIN range(0, 8) r(t) GROUP BY 1, 2"),
    "weighted_scan": (lambda s, d: r9(U.weighted_scan(scores(s, d)), "auc", "pr_auc", "delta_auc"), f"WITH {S.SCORES}, m AS (SELECT i, round(i * 0.05, 2)::DOUBLE AS w, label, score AS a, conf AS b FROM scores CROSS JOIN range(0, 21) t(i)), l AS (SELECT w, label, round(w * a + (1 - w) * b, 12) AS score FROM m), {_auc('l', 'w')}, {_pr('l', 'w')} SELECT w, round(auc, 9) AS auc, round(pr_auc, 9) AS pr_auc, round(auc - max(CASE WHEN w = 0 THEN auc END) OVER (), 9) AS delta_auc, row_number() OVER (ORDER BY auc DESC, w) = 1 AS best FROM auc JOIN pr USING (w)"),
    "soft_penalize": (lambda s, d: r9(U.soft_penalize(scores(s, d)), "ap"), f"WITH {S.SCORES}, l AS (SELECT round(i * 0.1, 1)::DOUBLE AS param, label, round(conf * (1 - round(i * 0.1, 1)::DOUBLE * (1 - score)), 12) AS score FROM scores CROSS JOIN range(1, 10) t(i)), {_pr('l', 'param')} SELECT 'soft_penalize' AS rule, param, round(ap, 9) AS ap FROM pr"),
    "hard_filter": (lambda s, d: r9(U.hard_filter(scores(s, d)), "ap"), f"WITH {S.SCORES}, l AS (SELECT round(i * 0.05, 2)::DOUBLE AS param, label, CASE WHEN score >= round(i * 0.05, 2)::DOUBLE THEN round(conf, 12) ELSE 0 END AS score, score >= round(i * 0.05, 2)::DOUBLE AS k FROM scores CROSS JOIN range(1, 19) t(i)), {_pr('l', 'param')} SELECT 'hard_filter' AS rule, param, round(ap, 9) AS ap FROM pr WHERE param IN (SELECT param FROM l WHERE k GROUP BY param HAVING count(*) >= 10)"),
    "geometric_mean": (lambda s, d: r9(U.geometric_mean(scores(s, d)), "ap"), f"WITH {S.SCORES}, l AS ({_GEOMETRIC}), {_pr('l', 'param')} SELECT 'geometric_mean' AS rule, param, round(ap, 9) AS ap FROM pr"),
    "best_rules": (lambda s, d: r9(U.best_rules(scores(s, d)), "ap", "baseline"), _BEST),
    "correlations": (lambda s, d: r9(U.correlations(scores(s, d)), "pearson", "spearman"), f"WITH {S.SCORES}, r AS (SELECT score, conf, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS a, rank() OVER (ORDER BY conf) + (count(*) OVER (PARTITION BY conf) - 1) / 2 AS b FROM scores) SELECT round(corr(score, conf), 9) AS pearson, round(corr(a, b), 9) AS spearman FROM r"),
    "adaptive_score": (lambda s, d: U.adaptive_score(scores(s, d), "grp").groupBy("grp", "rule").agg(F.round(F.sum("fused"), 6).alias("fused")), f"WITH {S.SCORES}, l AS (SELECT grp, label, conf AS score FROM scores), {_auc('l', 'grp')} SELECT grp, CASE WHEN auc < 0.7 THEN 'classifier' WHEN auc < 0.85 THEN 'product' ELSE 'confidence' END AS rule, round(sum(CASE WHEN auc < 0.7 THEN score WHEN auc < 0.85 THEN score * conf ELSE conf END), 6) AS fused FROM scores JOIN auc USING (grp) GROUP BY 1, 2"),
    "distilled_score": (lambda s, d: r9(U.distilled_score(scores(s, d), "grp"), "zero_shot_auc", "distilled_auc", "improvement"), f"WITH {S.SCORES}, l AS (SELECT grp, label, conf AS score FROM scores), m AS (SELECT grp, label, round(conf * score, 12) AS score FROM scores), {_auc('l', 'grp', 'x')}, {_auc('m', 'grp', 'y')} SELECT grp, round(x.auc, 9) AS zero_shot_auc, round(y.auc, 9) AS distilled_auc, round(y.auc - x.auc, 9) AS improvement FROM x JOIN y USING (grp)"),
    "lr_meta": (lambda s, d: U.lr_meta(scores(s, d), ["score", "conf"]).groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 3).alias("mean_prob")), None),
    "calibration_left_out": (
        lambda s, d: U.calibration_left_out(scores(s, d), "grp", ["score", "conf", "area"]).select("grp", "n", "n_pos", F.round("mean_prob", 6).alias("mean_prob")),
        f"WITH {S.SCORES}, t AS (SELECT grp, count(*) AS n, sum(label) AS p FROM scores GROUP BY grp) SELECT a.grp, sum(b.n)::BIGINT AS n, sum(b.p)::BIGINT AS n_pos, round(sum(b.p) / sum(b.n), 6) AS mean_prob FROM t a JOIN t b ON a.grp <> b.grp GROUP BY a.grp",
    ),
    "leave_one_group_out": (lambda s, d: r9(U.leave_one_group_out(scores(s, d), "grp", ["score", "conf", "area"]), "auc"), None),
    "similarity_margin": (lambda s, d: r9(U.similarity_margin(S.vectors(s, d), _PROTOTYPES), "auc"), f"WITH {S.VECTORS}, l AS ({_MARGIN}), {_auc('l', 'client, pair')} SELECT client, pair, round(auc, 9) AS auc, row_number() OVER (PARTITION BY client ORDER BY auc DESC, pair) = 1 AS best FROM auc"),
    "parse_score_text": (lambda s, d: U.parse_score_text(_vlm(s, d)).select("id", "is_organoid", "morphology_typical", "confidence", "reason"), """WITH t AS (SELECT o_orderkey AS id, round(o_totalprice / 500000, 3) AS p, o_custkey % 3 AS k FROM orders)
SELECT id, CASE k WHEN 0 THEN p WHEN 1 THEN 0.75 ELSE 0.5 END AS is_organoid, 0.5::DOUBLE AS morphology_typical, CASE k WHEN 0 THEN 0.25 WHEN 1 THEN p ELSE 0.5 END AS confidence, CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'confidence: ' || p::VARCHAR || ' is_organoid = 0.75' ELSE 'nothing' END AS reason FROM t"""),
    "conflict_check": (lambda s, d: U.conflict_check(scores(s, d)).groupBy("conflict").agg(F.count("*").alias("n"), F.round(F.sum("adjusted"), 6).alias("adjusted")), f"WITH {S.SCORES}, c AS (SELECT *, CASE WHEN score > 0.7 AND conf < 0.4 THEN 'hallucination' WHEN score < 0.3 AND conf > 0.7 THEN 'missed' ELSE 'none' END AS conflict FROM scores) SELECT conflict, count(*) AS n, round(sum(CASE WHEN conflict <> 'none' THEN (score + conf) / 2 ELSE score END), 6) AS adjusted FROM c GROUP BY conflict"),
    "upsert_results": (lambda s, d: (lambda e: U.upsert_results(e.where("seq % 2 = 0"), e.where("seq % 2 = 1")))(S.table(s, d, "events").select(F.col("user_id").alias("cache_key"), F.col("event_id").alias("seq"), "value")), "SELECT user_id AS cache_key, event_id AS seq, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"),
    "pending_items": (lambda s, d: U.pending(S.table(s, d, "customer").select(F.col("c_custkey").alias("cache_key")), S.table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("cache_key"))), "SELECT c_custkey AS cache_key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "upsert_vectors": (lambda s, d: (lambda v: V.upsert_vectors(v.where("id % 2 = 0").withColumn("seq", F.lit(1)), v.withColumn("seq", F.lit(2)).withColumn("values", F.when(F.col("id") % 5 == 0, F.slice("values", 1, 3)).otherwise(F.transform("values", lambda x: x + 1))), 64).select("id", "seq", F.size("values").alias("dim"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total")))(S.vectors(s, d).select("id", "values")), f"WITH {S.VECTORS} SELECT id, CASE WHEN id % 5 <> 0 THEN 2 ELSE 1 END::INT AS seq, 64::INT AS dim, round(list_sum(values) + CASE WHEN id % 5 <> 0 THEN 64 ELSE 0 END, 6) AS total FROM vectors WHERE id % 5 <> 0 OR id % 2 = 0"),
    "delete_vectors": (lambda s, d: (lambda v: V.delete_vectors(v.select("id", "cls"), v.where("id % 3 = 0").select("id"))[0])(S.vectors(s, d)), f"WITH {S.VECTORS} SELECT id, cls FROM vectors WHERE id % 3 <> 0"),
    "metadata_filter": (lambda s, d: V.metadata_filter(S.vectors(s, d).withColumn("metadata", F.create_map(F.lit("cls"), F.col("cls").cast("string"))), {"cls": "3"}).select("id"), f"WITH {S.VECTORS} SELECT id FROM vectors WHERE cls = 3"),
    "knn_euclidean": (lambda s, d: (lambda v: V.knn_euclidean(_queries100(v), v, 5).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank"))(S.vectors(s, d)), f"WITH {S.VECTORS}, q AS (SELECT * FROM vectors WHERE id % 100 = 0), {_near('euclidean', 5, queries='q')} SELECT query_id, id, round(s, 6) AS distance, rank::INT AS rank FROM near"),
    "knn_cosine": (lambda s, d: (lambda v: V.knn_cosine(_queries100(v), v, 5, 0.1).select("query_id", "id", F.round("similarity", 9).alias("similarity"), "rank"))(S.vectors(s, d)), f"WITH {S.VECTORS}, q AS (SELECT * FROM vectors WHERE id % 100 = 0), {_near('cosine', 5, queries='q')} SELECT query_id, id, round(-s, 9) AS similarity, rank::INT AS rank FROM near WHERE -s >= 0.1"),
    "class_match_rate": (lambda s, d: (lambda v: r9(V.class_match_rate(V.knn_cosine(_queries100(v), v, 10), v), "match_rate"))(S.vectors(s, d)), f"WITH {S.VECTORS}, q AS (SELECT * FROM vectors WHERE id % 100 = 0), {_near('cosine', 10, queries='q')} SELECT query_id, round(avg((x.cls = y.cls)::INT), 9) AS match_rate FROM near JOIN vectors x ON x.id = query_id JOIN vectors y ON y.id = near.id GROUP BY query_id"),
    "knn_vote": (lambda s, d: (lambda v: r9(V.knn_vote(v.where("id % 4 <> 0"), v.where("id % 4 = 0")), "vote"))(S.vectors(s, d)), f"WITH {S.VECTORS}, q AS (SELECT * FROM vectors WHERE id % 4 = 0), {_near('cosine', 7, 'b.id % 4 <> 0', 'q')} SELECT query_id AS id, round(avg(blabel), 9) AS vote FROM near GROUP BY 1"),
    "knn_vote_loo": (lambda s, d: r9(V.knn_vote_loo(S.vectors(s, d)), "vote"), f"WITH {S.VECTORS}, {_near('cosine', 7, 'a.id <> b.id')} SELECT query_id AS id, round(avg(blabel), 9) AS vote FROM near GROUP BY 1"),
    "knn_vote_local": (lambda s, d: r9(V.knn_vote_loo(S.vectors(s, d), scope="local"), "vote"), f"WITH {S.VECTORS}, c AS (SELECT client FROM vectors GROUP BY client HAVING count(*) > 8 AND count(DISTINCT label) > 1), {_near('cosine', 7, 'a.id <> b.id AND a.client = b.client AND a.client IN (SELECT client FROM c)')}, v AS (SELECT query_id AS id, avg(blabel) AS vote FROM near GROUP BY 1) SELECT vectors.id, round(coalesce(vote, 0.5), 9) AS vote FROM vectors LEFT JOIN v USING (id)"),
    "local_vs_global_report": (lambda s, d: r9(V.local_vs_global_report(S.vectors(s, d)), "local_auc", "global_auc", "local_pr", "global_pr", "delta_auc"), _REPORT),
    "knn_outlier": (lambda s, d: (lambda o: o.select("id", "client", "label", F.round("distance", 6).alias("distance")))(V.knn_outlier(V.standardised(S.vectors(s, d)))), f"WITH {_STANDARD}, {_OUTLIER} SELECT id, client, label, round(distance, 6) AS distance FROM outlier JOIN vectors USING (id)"),
    "knn_outlier_report": (lambda s, d: (lambda v: r9(V.knn_outlier_report(V.knn_outlier(v)), "auc", "median1", "median0", "z"))(S.vectors(s, d)), _OUTLIER_REPORT),
    "approx_knn": (lambda s, d: (lambda v: V.approx_knn(_queries100(v), v, 10))(S.vectors(s, d)), None),
    "approx_knn_recall": (_approx_recall, f"""WITH {S.VECTORS}, q AS (SELECT * FROM vectors WHERE id % 100 = 0), {_near('euclidean', 10, queries='q')}
SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_neighbours, true AS recall_reached, true AS fewer_vectors FROM near"""),
    "kmeans_clusters": (lambda s, d: V.kmeans_clusters(S.vectors(s, d), 4).groupBy("cluster").agg(F.max("n").alias("n"), F.round(F.max("pct"), 6).alias("pct")), None),
    "pca_leading": (_leading, _LEADING),
    "pca_project": (lambda s, d: V.pca_project(S.vectors(s, d), 64)[0].select("id", F.round(F.aggregate("pc", F.lit(0.0), lambda a, x: a + x * x), 6).alias("energy")), f"WITH {S.VECTORS}, l AS (SELECT id, i, values[i] AS x FROM vectors CROSS JOIN range(1, 65) t(i)), m AS (SELECT i, avg(x) AS m, stddev_samp(x) AS s FROM l GROUP BY i) SELECT id, round(sum(pow((x - m) / s, 2)), 6) AS energy FROM l JOIN m USING (i) GROUP BY id"),
    "mixture_score": (lambda s, d: V.mixture_score(S.vectors(s, d)).select("id", "label", F.round("log_likelihood", 3).alias("log_likelihood")), None),
    "centroid_spread": (lambda s, d: r9(V.centroid_spread(S.vectors(s, d)), "mean_distance", "sd_distance"), f"WITH {S.VECTORS}, l AS (SELECT id, cls, i, values[i] AS x, avg(values[i]) OVER (PARTITION BY cls, i) AS m FROM (SELECT *, unnest(range(1, 65)) AS i FROM vectors)), r AS (SELECT id, cls, sqrt(sum(pow(x - m, 2))) AS dist FROM l GROUP BY 1, 2) SELECT cls, count(*) AS n, round(avg(dist), 9) AS mean_distance, round(stddev_pop(dist), 9) AS sd_distance FROM r GROUP BY cls"),
    "calinski_harabasz": (lambda s, d: r9(V.calinski_harabasz(S.vectors(s, d)), "score"), f"WITH {S.VECTORS}, l AS (SELECT cls, i, values[i] AS x, avg(values[i]) OVER (PARTITION BY cls, i) AS m, avg(values[i]) OVER (PARTITION BY i) AS g FROM (SELECT *, unnest(range(1, 65)) AS i FROM vectors)) SELECT round(sum(pow(m - g, 2)) / (count(DISTINCT cls) - 1) / (sum(pow(x - m, 2)) / (count(*) / 64 - count(DISTINCT cls))), 9) AS score FROM l"),
    "silhouette_estimate": (_estimate, f"WITH {S.VECTORS} SELECT cls::BIGINT AS cls, true AS within FROM vectors GROUP BY cls"),
    "silhouette": (lambda s, d: V.silhouette(S.vectors(s, d)).withColumn("silhouette", F.round("silhouette", 6)), _SILHOUETTE),
    "channel_stats": (lambda s, d: V.channel_stats(S.vectors(s, d).select("id", "values"), ["values"], -0.5, 0.5).select("id", F.round("values_mean", 9).alias("values_mean"), F.round("values_sd", 9).alias("values_sd"), F.array_join(F.transform("values_hist", lambda x: F.format_string("%.6f", x)), " ").alias("values_hist")), f"WITH {S.VECTORS} SELECT id, round(list_avg(values), 9) AS values_mean, round(list_stddev_pop(values), 9) AS values_sd, array_to_string([printf('%.6f', len([x for x in values if x >= -0.5 + i * 0.125 AND (x < -0.5 + (i + 1) * 0.125 OR (i = 7 AND x <= 0.5))]) / 64) for i in range(0, 8)], ' ') AS values_hist FROM vectors"),
    "encode_profile": (lambda s, d: C.encode_profile(_profiles(s, d)).select("id", F.posexplode("values").alias("pos", "v")).select("id", "pos", F.round("v", 9).alias("v")), f"WITH p AS ({_PROFILE}), v AS (SELECT id, [round(least(1, greatest(0, x)), 9) for x in [(area - 100) / 49900, (perimeter - 50) / 1950, circularity, (solidity - 0.5) / 0.5, 0, eccentricity, (n_organoids - 1) / 19, 0, 0]] || [0.33, 0.33, 0.34]::DOUBLE[] AS values FROM p) SELECT id, (i - 1)::INT AS pos, values[i] AS v FROM v CROSS JOIN range(1, 13) t(i)"),
    "decode_profile": (lambda s, d: r9(C.decode_profile(C.encode_profile(_profiles(s, d)).select("id", "values")).select("id", *C.RANGES, F.array_join(F.transform("class_distribution", lambda x: F.format_string("%.6f", x)), " ").alias("shares")), *C.RANGES), f"WITH p AS ({_PROFILE}) SELECT id, round(greatest(100, least(50000, area)), 9) AS area, round(greatest(50, least(2000, perimeter)), 9) AS perimeter, round(least(1, circularity), 9) AS circularity, round(greatest(0.5, least(1, solidity)), 9) AS solidity, 0.3::DOUBLE AS aspect_ratio, round(least(1, eccentricity), 9) AS eccentricity, round(greatest(1, least(20, n_organoids)), 9) AS n_organoids, 100.0::DOUBLE AS avg_area, 0.0::DOUBLE AS std_area, '0.330000 0.330000 0.340000' AS shares FROM p"),
    "case_report": (lambda s, d: (lambda c: C.case_report(_queries100(c), c, 5).select("query_id", "status", "n_cases", "n_hospitals", "diagnosis", "vote_share", "mean_confidence", F.array_join(F.transform("breakdown", lambda b: F.concat_ws(":", b.diagnosis, b.n.cast("string"), F.format_string("%.6f", b.weight))), " ").alias("breakdown")))(_case_rows(s, d)), f"""WITH {S.VECTORS}, {_CASES}, q AS (SELECT * FROM vectors WHERE id % 100 = 0), {_near('cosine', 5, queries='q')}, j AS (SELECT near.*, -s AS sim, hospital_id, diagnosis, confidence FROM near JOIN cases USING (id)), v AS (SELECT query_id, diagnosis, sum(sim) AS w, min(rank) AS f FROM j GROUP BY 1, 2), b AS (SELECT *, w / sum(w) OVER (PARTITION BY query_id) AS share FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(w, 12) DESC, f) = 1)
SELECT query_id, 'ok' AS status, n_cases, n_hospitals, diagnosis, round(share, 3) AS vote_share, round(c, 3) AS mean_confidence, breakdown FROM (SELECT query_id, string_agg(diagnosis || ':' || n || ':' || printf('%.6f', w), ' ' ORDER BY w DESC, diagnosis DESC) AS breakdown FROM (SELECT query_id, diagnosis, count(*) AS n, sum(sim) AS w FROM j GROUP BY 1, 2) GROUP BY 1) JOIN (SELECT query_id, count(*) AS n_cases, count(DISTINCT hospital_id) AS n_hospitals, avg(confidence) AS c FROM j GROUP BY 1) USING (query_id) JOIN b USING (query_id)"""),
    "recommendations": (lambda s, d: C.recommendations(_profiles(s, d).withColumn("diagnosis", F.element_at(F.array(F.lit("late_stage"), F.lit("early_stage"), F.lit("healthy")), (F.col("id") % 3 + 1).cast("int")))).select("id", F.array_join("recommendations", " | ").alias("recommendations")), f"""WITH p AS ({_PROFILE}) SELECT id, concat_ws(' | ', CASE id % 3 WHEN 0 THEN 'Late stage: test for drug response.' WHEN 1 THEN 'Early stage: keep the culture as it is.' ELSE 'Healthy: fit for further assays.' END, CASE WHEN id % 3 = 0 AND eccentricity > 0.6 THEN 'Elongated outlines: follow growth closely.' END,
  CASE WHEN id % 3 = 1 AND circularity < 0.5 THEN 'Irregular outlines: look for early stress.' END, CASE WHEN solidity < 0.7 THEN 'Hollow outlines: look for budding or fragments.' END, CASE WHEN n_organoids > 10 THEN 'Many organoids: check the seeding density.' END) AS recommendations FROM p"""),
    "anonymize_id": (lambda s, d: S.table(s, d, "customer").select("c_custkey", C.anonymize_id(F.col("c_name")).alias("anon")), "SELECT c_custkey, substr(sha256(c_name), 1, 16) AS anon FROM customer"),
    "case_stats": (lambda s, d: C.case_stats(_case_rows(s, d)), f"WITH {S.VECTORS}, {_CASES} SELECT hospital_id, diagnosis, count(*) AS n FROM cases GROUP BY GROUPING SETS ((hospital_id), (diagnosis), ())"),
}
