"""Exact neighbours by pivots and approximate ones by an inverted file, against numpy, on vectors in clusters with many copies of one."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from petriflow.functions.lineage import checkpointed
from petriflow.operators import neighbours as N

K = 7


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(60, 12)) * 10
    x = centre[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 12)) * 0.3
    x[:1000] = x[0]
    x[1700] = 0
    return x


@pytest.fixture(scope="module")
def rows(spark, x):
    return checkpointed(spark.createDataFrame([(i, [float(a) for a in v], i % 5) for i, v in enumerate(x)], "id long, values array<double>, g int").repartition(4))


def brute(x, every, k, metric="euclidean", same=None, exclude=False):
    out, g = set(), np.arange(len(x)) % 5
    length = np.linalg.norm(x, axis=1)
    for i in range(0, len(x), every):
        if metric == "cosine":
            s = np.where((length > 0) & (length[i] > 0), np.round(-(x @ x[i]) / np.where(length > 0, length, 1) / (length[i] or 1), 12), np.inf)
        else:
            s = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 6)
        s = np.where((g == g[i]) != same if same is not None else False, np.inf, s)
        if exclude:
            s[i] = np.inf
        out |= {(i, int(j), r + 1) for r, j in enumerate(np.lexsort((np.arange(len(x)), s))[:k]) if np.isfinite(s[j])}
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize(("group", "same", "exclude"), [(None, None, False), ("g", True, True), ("g", False, False)])
def test_pivots_find_the_exact_neighbours(rows, x, metric, group, same, exclude, monkeypatch):
    monkeypatch.setattr(N, "SLICE_ROWS", 300)  # the cell of copies is dealt to slices
    got = N.knn(rows.where("id % 50 = 0"), rows, K, metric, group, same, exclude, pivots=40)
    assert {(r.query_id, r.id, r.rank) for r in got.collect()} == brute(x, 50, K, metric, same, exclude)


def test_vectors_are_shuffled_to_cells_that_may_hold_a_neighbour(rows):
    queries = rows.where("id % 20 = 0")
    for pivots in (20, 60):
        copies = {r.side: r.copies / r.vectors for r in N.shuffled_copies(N.meetings(queries, rows, K, pivots=pivots)).collect()}
        assert copies["queries"] <= 4 and copies["base"] <= 2


def test_few_rows_of_other_groups_meet_all_cells(spark):
    rows = spark.createDataFrame([(i, [float(i), 0.0], int(i == 99)) for i in range(100)], "id long, values array<double>, g int")
    got = N.knn(rows.where("id < 3"), rows, K, group="g", same_group=False, pivots=10)
    assert [(r.query_id, r.id, r.distance) for r in got.orderBy("query_id").collect()] == [(0, 99, 99.0), (1, 99, 98.0), (2, 99, 97.0)]


@pytest.mark.parametrize("pivots", [None, 8])
def test_empty_sides(rows, pivots):
    some = rows.limit(20)
    assert N.knn(some.where("false"), some, K, pivots=pivots).count() == 0
    assert N.knn(some, some.where("false"), K, pivots=pivots).count() == 0


def test_inverted_file_meets_few_codes_and_finds_the_neighbours(rows):
    queries = rows.where("id % 20 = 0 AND id <> 1700")
    found = checkpointed(N.approx_knn(queries, rows, K))
    assert N.recall_at_k(found, N.knn(queries, rows, K)).first().recall >= 0.9
    codes = found.groupBy("query_id").agg(F.max("n_codes").alias("n"), F.max("n_compared").alias("c")).where("query_id >= 1000").agg(F.avg("n"), F.avg("c")).first()
    assert codes[0] < 0.2 * 4000 and codes[1] < 0.1 * 4000
    assert found.groupBy("query_id").count().where(F.col("count") != K).isEmpty()


def test_every_row_is_in_the_index_and_a_search_reads_its_cells_only(rows, spark, tmp_path):
    index = N.fit_index(rows, K, cells=30, sample_rows=500)
    N.write_index(N.encode(rows, index), str(tmp_path))
    codes = spark.read.parquet(str(tmp_path))
    assert codes.count() == rows.count() and codes.select("id").distinct().count() == rows.count()
    assert len([d for d in os.listdir(tmp_path) if d.startswith("cell=")]) == len(index.cells) <= 30
    some = rows.where("id >= 2000 AND id % 100 = 0")
    found = N.search_index(some, rows, codes, index, K)
    assert N.recall_at_k(found, N.knn(some, rows, K)).first().recall >= 0.9
    assert found.agg(F.max("n_codes")).first()[0] < 2000


def test_index_of_an_empty_table(rows):
    none = rows.where("false")
    assert N.approx_knn(rows.limit(5), none, K).count() == 0 and N.approx_knn(none, rows, K).count() == 0


def test_silhouette_estimate_is_within_its_margin(spark):
    from petriflow.operators import vectors as V

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 1, (n, 5)) for c, n in ((0, 400), (3, 150), (5, 30))] + [np.full((1, 5), 9.0)])
    cls = np.repeat([0, 1, 2, 7], [400, 150, 30, 1])
    rows = checkpointed(spark.createDataFrame([(i, [float(a) for a in v], int(c)) for i, (v, c) in enumerate(zip(x, cls, strict=True))], "id long, values array<double>, cls int").repartition(3))
    exact = {r.cls: r.silhouette for r in V.silhouette(rows).collect()}
    whole = {r.cls: (r.silhouette, r.margin) for r in V.silhouette_estimate(rows).collect()}
    assert set(whole) == set(exact) and all(s == pytest.approx(exact[c], abs=1e-6) and m == pytest.approx(0, abs=1e-6) for c, (s, m) in whole.items())
    some = {r.cls: (r.silhouette, r.margin) for r in V.silhouette_estimate(rows, per_cluster=40).collect()}
    assert all(abs(s - exact[c]) <= m + 1e-9 for c, (s, m) in some.items()) and 0 < some[0][1] < 1
    assert V.silhouette_estimate(rows.where("false")).count() == 0
