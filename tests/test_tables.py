"""Cases for vectors, scores, splits, federation, audit chains, sources and streams."""

import pytest
from pyspark.sql import functions as F

from petriflow.operators import audit as A
from petriflow.operators import cases as C
from petriflow.operators import federation as E
from petriflow.operators import partition as P
from petriflow.operators import ranking as K
from petriflow.operators import vectors as V
from petriflow.sources import readers as R
from petriflow.sources import sinks as W
from petriflow.streaming import streams as T

VEC = "id long, values array<double>"


def test_nearest_is_itself_and_k_beyond_the_rows(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.9, 0.1, 0.0])], VEC)
    q = spark.createDataFrame([(9, [1.0, 0.0, 0.0])], VEC)
    got = V.knn_euclidean(q, base, 2).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 3] and got[0].distance < 0.01
    assert V.knn_euclidean(q, base, 10).count() == 3
    assert V.knn_euclidean(q, base.where("id < 0"), 3).count() == 0
    assert V.knn_cosine(spark.createDataFrame([(9, [0.0, 0.0, 0.0])], VEC), base, 2).count() == 0


def test_wrong_length_is_split_off_and_the_last_write_wins(spark):
    t = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], VEC + ", seq int")
    b = spark.createDataFrame([(1, [4.0, 5.0, 6.0], 2), (2, [1.0, 2.0], 3), (3, None, 3)], VEC + ", seq int")
    good, bad = V.split_batch(b, 3)
    assert (good.count(), bad.count()) == (1, 2)
    got = V.upsert_vectors(t, b, 3).collect()
    assert len(got) == 1 and got[0]["values"] == [4.0, 5.0, 6.0]
    left, gone = V.delete_vectors(t, spark.createDataFrame([(1,), (7,)], "id long"))
    assert left.count() == 0 and gone.count() == 1


def test_vote_counts_duplicates_but_not_the_row_itself(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i % 2)], i % 2, 0) for i in range(6)], VEC + ", label int, client int")
    got = {r.id: r.vote for r in V.knn_vote_loo(rows, 2).collect()}
    assert all(got[i] == i % 2 for i in range(6))
    assert {r.vote for r in V.knn_vote_loo(rows, 5, "local").collect()} == {0.5}


def test_auc_of_ties_and_of_one_class(spark):
    d = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5)], "label int, score double")
    assert K.roc_auc(d).first().auc == 0.5
    assert K.roc_auc(d.where("label = 1")).first().auc == 0.5
    e = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.8)], "label int, score double")
    assert K.roc_auc(e).first().auc == 1.0 and K.average_precision(e).first().ap == 1.0


def test_mann_whitney_with_ties(spark):
    d = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 2.0, 5.0)] + [(0, v) for v in (2.0, 3.0, 4.0, 6.0)], "label int, value double")
    r = K.mann_whitney(d).first()
    assert r.u == 4.0 and 0.2 < r.p < 0.4 and r.stars == ""


def test_splits_are_disjoint_and_do_not_depend_on_the_layout(spark):
    d = spark.range(1000).select(F.col("id"), (F.col("id") % 97).alias("image"), (F.col("id") % 5).cast("string").alias("cls"))
    a = {r.id: r.split for r in P.split_by_image(d).collect()}
    b = {r.id: r.split for r in P.split_by_image(d.repartition(7)).collect()}
    assert a == b
    assert P.split_by_image(d).groupBy("image").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    sizes = {r.client: r["count"] for r in P.split_iid(d, "id", 7).groupBy("client").count().collect()}
    assert sizes == {**{c: 142 for c in range(6)}, 6: 148}


def test_average_of_two_clients(spark):
    p = spark.createDataFrame([("e", 0, c, "w", 0, v, False) for c, v in (("a", 1.0), ("b", 3.0))] + [("e", 0, c, "n", 0, v, True) for c, v in (("b", 7.0), ("a", 5.0))], "exp string, round int, client string, param string, pos int, value double, is_int boolean")
    got = {r.param: r.value for r in E.fedavg(p).collect()}
    assert got == {"w": 2.0, "n": 5.0}


@pytest.mark.parametrize(
    "kind,want",
    [
        ("none", {(0, 0, "a"): 0.25, (0, 0, "b"): 0.75, (1, 0, "a"): 0.125, (1, 0, "b"): 0.375, (1, 1, "a"): 0.25, (1, 1, "b"): 0.25}),
        ("hard", {(0, 0, "b"): 1.0, (1, 1, "a"): 1.0}),
        ("soft", None),  # worked out below
        ("local", {(0, 0, "a"): 0.5, (0, 0, "b"): 0.5, (1, 1, "a"): 0.5, (1, 1, "b"): 0.5}),
    ],
)
def test_gates_over_two_rounds(spark, kind, want):
    rows = [("e", 0, "a", 10, 0.4), ("e", 0, "b", 30, 0.6), ("e", 1, "a", 20, 0.9), ("e", 1, "b", 20, 0.78)]
    s = spark.createDataFrame(rows, "exp string, round int, client string, n_samples long, map50 double")
    measured = spark.createDataFrame([("e", 0, 0.6)], "exp string, round int, signal double")
    if kind == "soft":
        a = 0.9 / 1.5
        cache = a * 0.9 + (1 - a) * 0.6
        b = 0.78 / (0.78 + cache)
        want = {(0, 0, "a"): 0.25, (0, 0, "b"): 0.75, (1, 0, "a"): 0.25 * (1 - a) * (1 - b), (1, 0, "b"): 0.75 * (1 - a) * (1 - b), (1, 1, "a"): a * (1 - b), (1, 1, "b"): b}
    got = {(r["round"], r.source_round, r.client): r.weight for r in E.sequential_gate(s, E.node_order(s), kind, warmup=1, measured=measured, n_nodes=2).collect()}
    assert got == pytest.approx(want)


def _chain(spark, n=4):
    ev = spark.createDataFrame([("c", i, f"2024-01-01T00:00:0{i}", "Insert", "x") for i in range(1, n)], "chain_id string, index long, ts string, operation string, details string")
    return A.build_chain(ev)


def test_chain_is_valid_and_tampering_is_found(spark):
    c = _chain(spark).cache()
    assert (A.verify_chain(c).first().valid, A.verify_chain(c).first().n_blocks) == (True, 4)
    bad = c.withColumn("operation", F.when(F.col("index") == 2, "Delete").otherwise(F.col("operation")))
    r = A.verify_chain(bad).first()
    assert not r.valid and r.first_bad_index == 2
    assert A.recent(c, 3).orderBy("place").first()["index"] == 3
    kept = A.retain(c, 2)
    assert kept.count() == 2 and A.verify_chain(kept).first().valid


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    A.append_json_lines(_chain(spark), path)
    A.append_json_lines(_chain(spark).where("index = 0"), path)
    (tmp_path / "log" / "bad.json").write_text("no json\n")
    got = A.read_json_lines(spark, path)
    assert got.count() == 4 and A.verify_chain(got).first().valid


def test_profile_and_report(spark):
    spec = "id long, hospital_id string, diagnosis string, confidence double, area double, circularity double"
    c = spark.createDataFrame([(1, "h1", "healthy", 0.9, 5000.0, 0.9), (2, "h2", "late_stage", 0.7, 40000.0, 0.2)], spec)
    for f in C.RANGES:
        c = c if f in c.columns else c.withColumn(f, F.lit(None).cast("double"))
    v = C.encode_profile(c.withColumn("class_distribution", F.lit(None).cast("array<double>")))
    assert all(len(r["values"]) == 12 for r in v.collect())
    r = C.case_report(v.where("id = 1"), v, 1).first()
    assert (r.status, r.diagnosis, r.case_ids) == ("ok", "healthy", [1])
    assert C.case_report(v.where("id = 1"), v.where("id > 5"), 1).first().status == "no_similar_cases"


def test_label_files_round_trip(spark, tmp_path):
    b = spark.createDataFrame([("p1", 0, 1, 0.5, 0.5, 0.25, 0.125), ("p1", 1, 0, 0.1, 0.2, 0.3, 0.4)], "patch string, idx int, cls int, xc double, yc double, w double, h double")
    W.write_label_lines(b, str(tmp_path / "labels"))
    got = R.label_lines_of(spark.read.text(str(tmp_path / "labels"))).orderBy("cls").collect()
    assert [(r.cls, r.xc) for r in got] == [(0, 0.1), (1, 0.5)]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "img.txt").write_text("0 0.5 0.5 0.1\n\n1 0.5 0.5 0.1 0.1 9\nx y z a b\n")
    assert [(r.source, r.cls) for r in R.read_label_lines(spark, str(tmp_path / "one")).collect()] == [("img", 1)]
    assert R.malformed_lines(spark, str(tmp_path / "one")).count() == 1


def test_annotation_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text('{"0": [[0, 0], [0, 10], [20, 10]], "1": [[1, 1], [2, 2]], "2": {"vertices": [[5, 5], [5, 9], [8, 9]]}}')
    got = R.read_polygons(spark, str(tmp_path / "p")).orderBy("key").collect()
    assert [(r.source, r.key, r.x1, r.y2) for r in got] == [("a", "0", 0.0, 20.0), ("a", "2", 5.0, 8.0)]
    (tmp_path / "b.json").write_text('[{"image": "i", "bboxes": [{"x": 1, "y": 2, "w": 3, "h": 4}], "image_size": [10, 20]}, {"image": "j", "bboxes": []}]')
    rows = R.read_box_annotations(spark, str(tmp_path / "b.json")).orderBy("image").collect()
    assert (rows[0].x2, rows[0].width, rows[1].x1) == (4.0, 10, None)
    (tmp_path / "d.json").write_text('{"per_image": [{"image": "C/P/i.png", "detections": [{"bbox": [1, 2, 3, 4], "confidence": 0.7, "is_tp": true}, {"bbox": [0, 0, 1, 1]}]}]}')
    d = R.read_detections(spark, str(tmp_path / "d.json")).orderBy("det_idx").collect()
    assert [(r.cache_key, r.score, r.matched) for r in d] == [("C_P_i.png_0", 0.7, True), ("C_P_i.png_1", 0.5, False)]
    (tmp_path / "f.json").write_text("[]")
    assert R.read_detections(spark, str(tmp_path / "f.json"), "flat").count() == 0
    (tmp_path / "t.csv").write_text(" epoch , metrics/mAP50(B)\n 1 , 0.5\n2,\n")
    t = R.read_training_csv(spark, str(tmp_path / "t.csv"))
    assert t.columns == ["epoch", "metrics/mAP50(B)"] and [r[1] for r in t.collect()] == [0.5, 0.0]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], VEC).write.parquet(str(src))
    stream = spark.readStream.schema(VEC).parquet(str(src))
    T.ingest_vectors(stream, 2, str(tmp_path / "t"), str(tmp_path / "a"), str(tmp_path / "c")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    spark.createDataFrame([(1, [7.0, 8.0]), (3, [3.0, 4.0])], VEC).write.mode("append").parquet(str(src))
    T.ingest_vectors(stream, 2, str(tmp_path / "t"), str(tmp_path / "a"), str(tmp_path / "c")).awaitTermination(60)
    assert {r.id: r["values"] for r in T.read_vectors(spark, str(tmp_path / "t")).collect()} == {1: [7.0, 8.0], 3: [3.0, 4.0]}
    chain = T.read_audit(spark, str(tmp_path / "a"))
    assert [r.details for r in chain.orderBy("index").collect()] == ["accepted=1 rejected=1", "accepted=2 rejected=0"]
    assert [(r.n_blocks, r.valid) for r in A.verify_chain(chain).collect()] == [(2, True)]


def test_stream_of_blocks_and_rounds(spark, tmp_path):
    c = _chain(spark, 6)
    c.where("index < 3").write.parquet(str(tmp_path / "b"))
    for i, part in enumerate((c.where("index >= 3"), c.where("index = 1"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
    with T.state_store(spark):
        q = T.verify_stream(spark.readStream.schema(A.SCHEMA).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "b")), wait=None).writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    rows = spark.table("verdicts").collect()
    assert sum(r.late for r in rows) == 1 and all(r.hash_ok for r in rows) and sum(r.link_ok for r in rows) == 6
    spec = "exp string, round int, client string, n_samples long, value array<double>"
    spark.createDataFrame([("e", 1, "a", 1, [1.0]), ("e", 1, "b", 3, [5.0]), ("e", 2, "a", 1, [9.0])], spec).coalesce(1).write.parquet(str(tmp_path / "u"))
    with T.state_store(spark):
        q = T.average_rounds(spark.readStream.schema(spec).parquet(str(tmp_path / "u")), 2, None).writeStream.format("memory").queryName("means").outputMode("append").option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["round"], r.n_samples, r.value) for r in spark.table("means").collect()] == [(1, 4, [4.0])]


def test_files_that_are_written_are_read_again(spark, tmp_path):
    rows = [("i", 0, 1.0, 2.0, 3.0, 4.0), ("i", 1, 5.0, 6.0, 7.0, 9.0), ("j", 0, 0.0, 0.0, 2.0, 2.0)]
    boxes = spark.createDataFrame(rows, "image string, idx long, x1 double, y1 double, x2 double, y2 double")
    W.write_polygon_json(boxes, str(tmp_path / "p"))
    got = R.polygons_of(spark.read.text(str(tmp_path / "p")).withColumnRenamed("image", "source"))
    assert sorted((r.source, int(r.key), r.x1, r.y1, r.x2, r.y2) for r in got.collect()) == rows
    for kind, read in (("json", spark.read.json), ("csv", spark.read.option("header", True).csv), ("parquet", spark.read.parquet)):
        W.write_report(boxes, str(tmp_path / kind), kind)
        assert read(str(tmp_path / kind)).count() == 3
    (tmp_path / "f.json").write_text('[{"cache_key": "k1", "image": "a/b.png", "det_idx": 3, "bbox": [1, 2, 3, 4], "confidence": 0.25, "matched": true, "area": 9.0}, {"cache_key": null, "image": "a/b.png", "det_idx": 4, "bbox": [0, 0, 1, 1], "rfdetr_conf": 0.75}]')
    flat = R.read_detections(spark, str(tmp_path / "f.json"), "flat").orderBy("det_idx").collect()
    assert [(r.cache_key, r.score, r.x2, r.area, r.matched) for r in flat] == [("k1", 0.25, 3.0, 9.0, True), ("a_b.png_4", 0.75, 1.0, 0.0, False)]
    chain = _chain(spark, 4)
    A.append_json_lines(chain, str(tmp_path / "l"))
    assert A.verify_chain(A.read_json_lines(spark, str(tmp_path / "l"))).first().valid


def test_running_totals_do_not_depend_on_ranges(spark, monkeypatch):
    import random

    r = random.Random(3)
    rows = [(g, r.choice([r.random(), 1e9, -5.0]), r.randint(0, 3)) for g in range(3) for _ in range(200)]
    d = spark.createDataFrame(rows, "g int, x double, n long").groupBy("g", "x").agg(F.sum("n").alias("n"))
    for descending in (True, False):
        want = {(a.g, a.x): a.cum_n for a in K.running_totals(d, ["g"], "x", ["n"], descending).collect()}
        monkeypatch.setattr(K, "RANGE_ROWS", 17)
        assert {(a.g, a.x): a.cum_n for a in K.running_totals(d, ["g"], "x", ["n"], descending).collect()} == want
        monkeypatch.undo()
        for g in range(3):
            own = sorted(((x, n) for (h, x), n in ((k, sum(m for a, b, m in rows if (a, b) == k)) for k in want) if h == g), reverse=descending)
            total = 0
            for x, n in own:
                total += n
                assert want[g, x] == total


def _cloud(spark, n=300, dim=16, seed=0):
    import numpy as np

    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dim)) + 3 * (np.arange(n)[:, None] % 3 == np.arange(dim)[None, :] % 3)
    rows = [(i, i % 5, int(i % 3 == 0), i % 3, v.tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, client int, label int, cls int, values array<double>")


def test_neighbours_do_not_depend_on_blocks(spark, monkeypatch):
    import numpy as np

    x, v = _cloud(spark)
    want = {}
    for i in range(len(x)):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 9)
        want[i] = np.lexsort((np.arange(len(x)), d))[:4].tolist()
    for block in (10_000, 37):
        monkeypatch.setattr(V, "BLOCK_ROWS", block)
        monkeypatch.setattr(V, "CELLS", 8 * 40 * 5)
        got = {}
        for r in V.knn(v, v, 4).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want
        own = V.knn(v, v, 3, group="client", same_group=True).join(v.select("id", "client"), "id").join(v.select(F.col("id").alias("query_id"), F.col("client").alias("c")), "query_id")
        assert own.where("client <> c").count() == 0 and own.count() == 3 * len(x)


def test_approximate_neighbours_compare_few_rows(spark, sf_dir):
    from petriflow.plans import standins as S

    for v in (_cloud(spark, 400)[1], S.vectors(spark, sf_dir)):
        n, q = v.count(), v.where("id % 20 = 0")
        found, exact = V.approx_knn(q, v, 5), V.knn_euclidean(q, v, 5)
        assert V.recall_at_k(found, exact).first().recall >= 0.9
        assert found.agg(F.max("n_compared").alias("n")).first().n < 0.2 * n
        assert found.join(exact.withColumnRenamed("distance", "d"), ["query_id", "id"]).where("abs(distance - d) > 1e-6").count() == 0


def test_clusters_and_mixtures_against_numpy(spark):
    import numpy as np

    x, v = _cloud(spark)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    rows = V.kmeans_clusters(v, 3, 4).collect()
    of = np.array([r.cluster for r in sorted(rows, key=lambda r: r.id)])
    centre = np.stack([z[of == c].mean(0) for c in range(3)])
    far = ((z[:, None] - centre[None]) ** 2).sum(2)
    assert (far.argmin(1) == of).mean() > 0.98 and {r.n for r in rows} == {*np.bincount(of).tolist()}
    assert all(abs(r.distance - far[r.id, r.cluster] ** 0.5) < 1e-2 for r in rows)
    # The made clusters are found again.
    assert all(len({*(of[np.arange(300) % 3 == k]).tolist()}) == 1 for k in range(3))
    scored = {r.id: r.log_likelihood for r in V.mixture_score(v, 2, 4).collect()}
    _, _, t = np.linalg.svd(z, full_matrices=False)
    p, good = z @ t[:4].T, np.arange(300) % 3 == 0
    d = p - p[good].mean(0)
    cov = np.cov(p[good].T, ddof=0)
    one = -0.5 * (np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1] + 4 * np.log(2 * np.pi))
    got = np.array([scored[i] for i in range(300)])
    # A posterior of diagonal components under a prior of one row fits the rows nearly as well as one free Gaussian, and tells the other rows apart.
    assert -0.3 < (got - one)[good].mean() < 1 and got[good].min() > np.median(got[~good])


def test_fits_against_gradient_descent(spark):
    import numpy as np

    from petriflow.operators import fusion as U

    draw = np.random.default_rng(2)
    a, b = draw.normal(size=400), draw.normal(size=400)
    y = (draw.random(400) < 1 / (1 + np.exp(-(1.5 * a - b)))).astype(int)
    d = spark.createDataFrame([(i, i % 4, int(y[i]), float(a[i]), float(b[i])) for i in range(400)], "id long, grp int, label int, a double, b double")
    prob = U.lr_meta(d, ["a", "b"]).collect()
    assert len(prob) == 400 and {r.fold for r in prob} == set(range(5))
    by = {r.id: (r.fold, r.prob) for r in prob}
    fold = np.array([by[i][0] for i in range(400)])
    for f in range(5):
        train, test = fold != f, fold == f
        x = np.c_[a, b]
        x = (x - x[train].mean(0)) / x[train].std(0, ddof=1)
        one, w = np.c_[x, np.ones(400)], np.zeros(3)
        for _ in range(4000):
            p = 1 / (1 + np.exp(-one[train] @ w))
            w -= 0.5 * (one[train].T @ (p - y[train]) / train.sum() + np.r_[w[:2], 0] / 320)
        assert np.abs(1 / (1 + np.exp(-one[test] @ w)) - np.array([by[i][1] for i in np.flatnonzero(test)])).max() < 0.02
    left = U.leave_one_group_out(d, "grp", ["a", "b"]).collect()
    assert {r.grp for r in left} == {0, 1, 2, 3, None} and all(r.auc > 0.7 for r in left)


def test_rounds_against_a_plain_loop(spark):
    import numpy as np

    draw = np.random.default_rng(4)
    x, y, c = draw.normal(size=(120, 2)), draw.integers(0, 3, 120), draw.integers(0, 3, 120)
    d = spark.createDataFrame([(int(c[i]), int(y[i]), *map(float, x[i])) for i in range(120)], "client int, y int, f0 double, f1 double").repartition(3)
    got = E.federated_rounds(d, ["f0", "f1"], "y", "client", 3, rounds=2, steps=3).collect()
    soft = lambda z: np.exp(z) / np.exp(z).sum(1, keepdims=True)
    one, model = np.c_[x, np.ones(120)], np.zeros((3, 3))
    for r in got:
        parts = []
        for k in range(3):
            m, own = model.copy(), c == k
            for _ in range(3):
                m -= 0.5 * one[own].T @ (soft(one[own] @ m) - np.eye(3)[y[own]]) / own.sum()
            parts.append(m * own.sum() / 120)
        model = sum(parts)
        q = soft(one @ model)
        assert abs(r.accuracy - (q.argmax(1) == y).mean()) < 1e-9 and abs(r.loss + np.log(q[np.arange(120), y]).mean()) < 1e-9


def test_small_helpers(spark):
    from petriflow.operators import fusion as U
    from petriflow.operators import history as H
    from petriflow.operators import matching as M

    gaps = spark.createDataFrame([(0.2,), (0.05,), (-0.01,), (-0.2,)], "g double").select(U.alpha_for_gap(F.col("g")).alias("a"))
    assert [r.a for r in gaps.collect()] == [0.0, 0.2, 0.5, 1.0]
    raw = U.parse_score_text(spark.createDataFrame([(None,), ("",)], "raw string")).collect()
    assert [r.confidence for r in raw] == [None, 0.5]
    scored = spark.createDataFrame([(1, 0.5, 2.0), (1, 1.0, 4.0), (2, 0.0, 1.0)], "client int, conf double, distance double")
    assert sorted(round(r.combined, 6) for r in V.combined_outlier_score(scored).collect()) == [-0.5, 0.0, 0.0]
    table = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 2.0), ("t", "a", 3.0)], "strategy string, scenario string, final double")
    assert {r.strategy: (r.a, r.b) for r in H.strategy_pivot(table, "scenario", "strategy", ["a", "b"]).collect()} == {"s": (1.0, 2.0), "t": (3.0, None)}
    old, new = spark.createDataFrame([("x", 1)], "name string, n int"), spark.createDataFrame([("x", 2), ("y", 3)], "name string, n int")
    assert sorted((r.name, r.n) for r in M.merge_new(old, new).collect()) == [("x", 1), ("y", 3)]
    lines = spark.createDataFrame([(0, "0 0.5 0.5 0.1 0.1"), (0, "0 0.5 0.5 0.1"), (0, "a b c d e"), (0, None), (1, "1 .5 5e-1 +1 2")], "batch int, line string")
    labels = spark.createDataFrame([(0, 1, 2, 0.5, 0.5, 0.1, 0.2)], "batch int, image int, cls int, xc double, yc double, w double, h double")
    prof = P.label_profile(spark.createDataFrame([(0, 1), (1, 5)], "batch int, image int"), labels, lines=lines).orderBy("batch").collect()
    assert [r.n_malformed for r in prof] == [3, 0] and [(c["cls"], c.n) for c in prof[0].classes] == [(2, 1)] and prof[1].classes is None


def test_components_of_a_hub_and_a_chain(spark):
    from petriflow.functions.graph import components

    edges = [(i, 0) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7), (200, 200), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(60)} | {i: 100 for i in range(100, 121)} | {200: 200}


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from petriflow.functions import lineage

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://host:1", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_dir(fake)
