"""Nearest neighbours by joins on cells. Rows carry (id, values array<double>) of one length.

Exact neighbours (`knn`): every base row is keyed to its nearest *pivot*. A query first meets the cells of its nearest pivots, which bounds the
distance of its k-th neighbour; the triangle inequality then tells which other cells can hold anything nearer, and it meets only these.

Approximate neighbours (`fit_index`, `encode`, `search_index`): an inverted file. Rows are keyed to coarse cells and kept as product-quantised
residuals of a few bytes; a query meets the codes of as many near cells as a bounded sample asks for to reach a target recall,
and the vectors of its best candidates only.

A cell is dealt to slices of a bounded number of rows, and its queries to blocks, so no task grows with a cell, even where copies of one vector
fill it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petriflow.functions.joins import FEW_ROWS, with_few
from petriflow.functions.lineage import checkpointed

#: Rows of a slice of a cell, and of a block of its queries, at most about; bytes of distances that a task holds at a time.
SLICE_ROWS, CELLS = 20_000, 32 << 20
#: Bytes of vectors of a slice where all rows meet, and rows of a slice at least.
SLICE_BYTES, LEAST_ROWS = 48 << 20, 2_000
#: Base rows for each pivot, about, and pivots at most.
PIVOT_ROWS, MOST_PIVOTS = 5_000, 2_048
#: Pivots at most where a group is a part of the key; what is known of a group's cells travels with each query.
GROUP_PIVOTS = 256
#: A model is fitted on a sample of so many rows, and of so many bytes, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 64 << 20
#: Slack of a bound for rounding, relative to the distances compared.
SLACK = 1e-5


def least(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` least numbers of each row, in order; of equals the first. What ties with the last of them is put in order too."""
    every = np.tile(np.arange(s.shape[1]), (len(s), 1))
    if k < s.shape[1]:
        edge = np.partition(s, k - 1, axis=1)[:, k - 1 : k]
        few = int((s <= edge).sum(1).max())
        if few < s.shape[1]:
            every = np.sort(np.argpartition(s, few - 1, axis=1)[:, :few], axis=1)
    return np.take_along_axis(every, np.argsort(np.take_along_axis(s, every, 1), axis=1, kind="stable")[:, :k], 1)


def _array(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), np.float64).reshape(len(values), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1)
    return x / np.where(n > 0, n, 1)[:, None]


def sample(rows: DataFrame, most: int, seed: int) -> np.ndarray:
    """Vectors of up to ``most`` rows (and `SAMPLE_BYTES`), those of the least hashes of id."""
    first = rows.select(F.size("values").alias("n")).first()
    if first is None:
        return np.empty((0, 0))
    most = max(1, min(most, SAMPLE_BYTES // (8 * max(1, first.n))))
    picked = rows.select("id", "values").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most).toPandas()
    return _array(picked["values"])


def _own(rows: DataFrame, *more: str | None) -> DataFrame:
    """Columns of their own, so that two sides that come from one table differ."""
    return rows.select(*(F.col(c).alias(c) for c in ("id", "values", *(c for c in more if c))))


def _dealt(q: DataFrame, b: DataFrame, keys: list[str], fixed: tuple[int, int] | None = None, large: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides with _s and _q, by which a cell's pairs are dealt: base rows to slices, each of which every query meets, and queries to blocks. A base row
    goes to one slice and to as many copies as the cell has blocks, a query to one block and as many copies as it has slices; cells without
    partners are left out. ``fixed``: the numbers of slices and of blocks, where all cells have the same. ``large``: by `_large_slices`."""
    if fixed:
        q, b = (d.withColumn("_ns", F.lit(fixed[0])).withColumn("_nq", F.lit(fixed[1])) for d in (q, b))
        return _spread(q, b)
    sizes = checkpointed((_large_slices if large else _slices)(q, b, keys))
    return _spread(with_few(q, sizes, keys), with_few(b, sizes, keys))


def _slices(q: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _ns, _nq): slices and blocks of each cell that both sides have; a row a cell."""
    n_b = b.groupBy(*keys).agg(F.ceil(F.count("*") / SLICE_ROWS).cast("int").alias("_ns"), F.count("*").alias("_b"))
    n_q = q.groupBy(*keys).agg(F.ceil(F.count("*") / SLICE_ROWS).cast("int").alias("_nq"), F.count("*").alias("_a"))
    return n_b.join(n_q, keys)


def _large_slices(q: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """As `_slices`, where all rows of a key meet: each row is copied once for each slice of the other side, so slices are as large as memory (`SLICE_BYTES`) and an
    even share of the work for every core allow."""
    n = b.groupBy(*keys).agg(F.count("*").alias("_b"), F.max(F.size("values")).alias("_d")).join(q.groupBy(*keys).agg(F.count("*").alias("_a")), keys)
    total = n.agg(F.sum(F.col("_a").cast("double") * F.col("_b")).alias("pairs"), F.max("_d").alias("d")).first()
    rows = SLICE_BYTES // (8 * max(1, total.d or 1))
    side = max(1, min(rows, max(LEAST_ROWS, math.ceil(math.sqrt((total.pairs or 0) / (4 * q.sparkSession.sparkContext.defaultParallelism))))))
    return n.select(*keys, F.ceil(F.col("_b") / side).cast("int").alias("_ns"), F.ceil(F.col("_a") / side).cast("int").alias("_nq"))


def _spread(q: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.withColumn("_q", part("_nq")).withColumn("_s", every("_ns")).drop("_ns", "_nq", "_a", "_b")
    right = b.withColumn("_s", part("_ns")).withColumn("_q", every("_nq")).drop("_ns", "_nq", "_a", "_b")
    return left, right


#: Queries and base rows of a tile of approximate products, candidates that are held for a tile's queries, and pairs whose scores are computed exactly at a time.
TILE_ROWS, TILE_COLUMNS, HELD, EXACT_PAIRS = 2048, 512, 1 << 18, 1 << 16


def _matrix(values: pa.ChunkedArray) -> np.ndarray:
    """Vectors, all of one length, as rows."""
    lists = values.combine_chunks()
    n = pc.min_max(pc.list_value_length(lists)).as_py()
    if lists.null_count or n["min"] != n["max"]:
        raise ValueError("vectors differ in length")
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(lists), -1)


def _true_places(mask: np.ndarray) -> np.ndarray:
    """Places of the true ones, few, of a flat array: eight are looked at together."""
    if mask.size % 8:
        return np.flatnonzero(mask)
    at = (np.flatnonzero(mask.view(np.uint64))[:, None] * 8 + np.arange(8)[None]).ravel()
    return at[mask[at]]


def _first_of_each(row: np.ndarray, k: int) -> np.ndarray:
    """Whether each of the rows, in order, is one of the first ``k`` of its number."""
    return np.arange(len(row)) - np.searchsorted(row, row) < k


def _product(k: int, cosine: bool, group: str | None, same_group: bool | None, exclude_self: bool):
    """The ``k`` least scores (distances, or minus similarities) of each query among a slice of base rows.

    All pairs are compared in single precision (where the numbers allow it) with what a query's k-th neighbour has at most: its score in an earlier round
    (_limit), and that among the slice's first rows. What lies below that by more than the error is a candidate; the least of the candidates are
    computed again in doubles.
    """
    nothing = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    # Scores are rounded, and equal ones are told apart by id.
    unit = 1e-12 if cosine else 1e-9

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return nothing
        to, asked, x, y = right["id"].to_numpy().astype(np.int64), left["id"].to_numpy().astype(np.int64), _matrix(left["values"]), _matrix(right["values"])
        fit, asks = np.isfinite(y).all(1), np.isfinite(x).all(1)  # a vector with a number that is none has no distance
        xx, yy = (np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) if cosine else ((x * x).sum(1), (y * y).sum(1))
        if cosine:
            fit, asks = fit & (yy > 0), asks & (xx > 0)
        at = np.flatnonzero(fit)
        at, ask = at[np.argsort(to[at], kind="stable")], np.flatnonzero(asks)
        if not len(at) or not len(ask):
            return nothing
        to, y, yy, asked, x, xx = to[at], y[at], yy[at], asked[ask], x[ask], xx[ask]
        known = left["_limit"].to_pandas().to_numpy(np.float64, na_value=np.inf)[ask] if "_limit" in left.column_names else np.full(len(x), np.inf)
        apart = bool(group) and same_group is False
        if apart:
            kinds = pd.factorize(np.concatenate([left[group].to_pandas().to_numpy(object)[ask], right[group].to_pandas().to_numpy(object)[at]]))[0].astype(np.int32)
            own, other = kinds[: len(x)], kinds[len(x) :]
        a, b = (x / xx[:, None], y / yy[:, None]) if cosine else (x - y.mean(0), y - y.mean(0))
        size = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
        kind = np.float32 if 1e-10 < size < 1e15 else np.float64
        aa, bb = (a * a).sum(1), (b * b).sum(1)
        slack = 8 * np.finfo(kind).eps * (y.shape[1] + 8) * (aa + bb.max())
        if not cosine:  # a product is then the squared distance, but for the query's own length and a factor
            a, b = np.column_stack([a, np.ones(len(a))]), np.column_stack([b, -bb / 2])
        a, b = a.astype(kind), b.astype(kind)
        # One row more than k where a row may be the query itself.
        least_rows = k + (int(np.unique(to, return_counts=True)[1].max()) if exclude_self else 0)

        def scores(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            dot = (x[i] * y[j]).sum(1)
            return np.round(-dot / xx[i] / yy[j], 12) if cosine else np.round(np.sqrt(np.maximum(xx[i] + yy[j] - 2 * dot, 0)), 9)

        def floor_of(near: np.ndarray, i: np.ndarray) -> np.ndarray:
            """The least product that a neighbour can have if one has ``near``, by the error of products and the rounding of scores."""
            far = np.sqrt(np.maximum(aa[i] - 2 * near, 0) + slack[i])
            return near - slack[i] - (unit if cosine else unit * (far + unit))

        product_of = -known if cosine else (aa - known**2) / 2
        floors = np.where(np.isfinite(known), floor_of(product_of, np.arange(len(x))), -np.inf)
        found, products, marks = [], np.empty(TILE_ROWS * TILE_COLUMNS, kind), np.empty(TILE_ROWS * TILE_COLUMNS, bool)
        for low in range(0, len(x), TILE_ROWS):
            some = a[low : low + TILE_ROWS]
            lines = np.arange(low, low + len(some))
            floor = floors[lines]
            held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind))
            waiting: list = []

            def narrowed(settle: bool) -> tuple:
                """The candidates without those that others leave no place; ``settle``: by exact scores, in order of these."""
                row, col, near = (np.concatenate(c) for c in zip(held, *waiting, strict=True))
                if exclude_self:
                    other_row = asked[low + row] != to[col]
                    row, col, near = row[other_row], col[other_row], near[other_row]
                order = np.lexsort((-near, row))
                row, col, near = row[order], col[order], near[order]
                first = np.searchsorted(row, np.arange(len(some)))
                full = np.flatnonzero(np.searchsorted(row, np.arange(len(some)), "right") - first >= k)
                floor[full] = np.maximum(floor[full], floor_of(near[first[full] + k - 1].astype(np.float64), low + full))
                keep = near >= floor[row].astype(kind)
                row, col, near = row[keep], col[keep], near[keep]
                if not settle and len(row) <= HELD // 2:
                    return row, col, near, None
                exact = [scores(low + row[i : i + EXACT_PAIRS], col[i : i + EXACT_PAIRS]) for i in range(0, len(row), EXACT_PAIRS)]
                score = np.concatenate(exact) if exact else np.empty(0)
                order = np.lexsort((col, score, row))
                order = order[_first_of_each(row[order], k)]
                return row[order], col[order], near[order], score[order]

            for c in range(0, len(y), TILE_COLUMNS):
                part = b[c : c + TILE_COLUMNS]
                shape, n = (len(some), len(part)), len(some) * len(part)
                near = np.matmul(some, part.T, out=products[:n].reshape(shape))
                if apart:
                    near[own[lines][:, None] == other[None, c : c + TILE_COLUMNS]] = -np.inf
                if c == 0 and least_rows <= near.shape[1]:
                    edge = -np.partition(-near, least_rows - 1, axis=1)[:, least_rows - 1].astype(np.float64)
                    sure = np.isfinite(edge)
                    floor[sure] = np.maximum(floor[sure], floor_of(edge[sure], lines[sure]))
                np.greater_equal(near, floor[:, None].astype(kind), out=marks[:n].reshape(shape))
                hit = _true_places(marks[:n])
                if len(hit):
                    row, col = np.divmod(hit, len(part))
                    value = products[hit]
                    real = value > -np.inf
                    waiting.append((row[real], c + col[real], value[real]))
                    if len(held[0]) + sum(len(w[0]) for w in waiting) > HELD:
                        held, waiting = narrowed(False)[:3], []
            row, col, _, score = narrowed(True)
            found.append((asked[low + row], to[col], score))
        query, near_id, score = (np.concatenate(f) for f in zip(*found, strict=True))
        return pa.table({"query_id": query, "id": near_id, "score": score})

    return product


def _met(q: DataFrame, b: DataFrame, keys: list[str], product, fixed: tuple[int, int] | None = None, large: bool = False) -> DataFrame:
    left, right = _dealt(q, b, keys, fixed, large)
    keys = [*keys, "_q", "_s"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(product, "query_id long, id long, score double")


def _keyed(rows: DataFrame, pivots: np.ndarray, cosine: bool) -> DataFrame:
    """``rows`` with _p, the nearest pivot, and _r, the distance to it."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _p int, _r double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = _array(f["values"])
                d = _distances(_unit(x) if cosine else x, pivots)
                yield f.assign(_p=d.argmin(1).astype("int32"), _r=d.min(1))

    return rows.mapInPandas(run, schema)


class Cells:
    """What is known of cells (p, n, lo, hi): rows of a cell lie between lo and hi from its pivot."""

    def __init__(self, rows):
        self.p, self.n = (np.array([r[c] for r in rows], int) for c in ("p", "n"))
        self.lo, self.hi = (np.array([r[c] for r in rows], float) for c in ("lo", "hi"))


def _planned(pivots: np.ndarray, cosine: bool, known: Cells | dict | None, made: str, plan):
    """Rows (id, values, ...) with ``made``, the cells that ``plan(distances to pivots, norms, cells, rows)`` names; ``known``: those of all rows or of each group, None: a row has them in _cells.

    Rows that have the same cells are planned together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = _array(f["values"])
                d, norm = _distances(_unit(x) if cosine else x, pivots), np.linalg.norm(x, axis=1)
                if isinstance(known, dict):
                    parts = [(known.get(g), at) for g, at in f.groupby("_g", dropna=False).indices.items()]
                else:
                    parts = [(Cells(c), np.array([i])) for i, c in enumerate(f["_cells"])] if known is None else [(known, np.arange(len(f)))]
                out: list = [[]] * len(f)
                for cells, at in parts:
                    step = max(1, CELLS // (8 * max(1, len(cells.p)))) if cells is not None else 0
                    for some in (at[i : i + step] for i in range(0, len(at), step)) if step else ():
                        for i, named in zip(some.tolist(), plan(d[some], norm[some], cells, f.iloc[some]), strict=True):
                            out[i] = named
                yield f.drop(columns=[c for c in ("_cells", "_first", "_bound") if c in f]).assign(**{made: out})

    return run


def _named(p: np.ndarray, which: np.ndarray) -> list[np.ndarray]:
    """The cells ``p`` that each line of ``which`` marks."""
    return np.split(p[np.nonzero(which)[1]], np.cumsum(which.sum(1))[:-1])


def _nearest_cells(k: int):
    """The nearest cells, until they hold ``4 k`` rows."""

    def plan(d: np.ndarray, norm: np.ndarray, cells: Cells, rows: pd.DataFrame) -> list[np.ndarray]:
        order = np.argsort(d[:, cells.p], axis=1, kind="stable")
        before = np.cumsum(cells.n[order], axis=1) - cells.n[order]
        which = np.zeros(order.shape, bool)
        np.put_along_axis(which, order, before < 4 * k, 1)
        return _named(cells.p, which)

    return plan


def _other_cells(pivots: np.ndarray):
    """The cells beyond the first that may hold something as near as ``_bound``."""
    apart = _distances(pivots, pivots)

    def plan(d: np.ndarray, norm: np.ndarray, cells: Cells, rows: pd.DataFrame) -> list[np.ndarray]:
        own, to = d.argmin(1), d[:, cells.p]
        ring = np.maximum(to - cells.hi, cells.lo - to)
        gap = apart[own][:, cells.p]
        plane = np.where(gap > 0, (to**2 - d.min(1)[:, None] ** 2) / np.where(gap > 0, 2 * gap, 1), 0)  # a cell's rows are nearer to its pivot than to the query's
        near = np.maximum(ring, plane) <= rows["_bound"].to_numpy()[:, None] + SLACK * (1 + norm[:, None] + to)
        met = np.zeros((len(d), len(pivots)), bool)
        met[np.repeat(np.arange(len(d)), rows["_first"].str.len()), np.concatenate([*rows["_first"], np.empty(0, int)]).astype(int)] = True
        return _named(cells.p, near & ~met[:, cells.p])

    return plan


def _schema(rows: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *more])


@dataclass
class Meetings:
    """What each query meets in the two rounds: queries by cell, and base rows by cell."""

    base: DataFrame
    first: DataFrame
    found: DataFrame
    rest: DataFrame | None
    keys: list[str]


def meetings(queries: DataFrame, base: DataFrame, k: int, metric: str = "euclidean", group: str | None = None, same_group: bool | None = None, exclude_self: bool = False, pivots: int | None = None, seed: int = 1) -> Meetings:
    """Both rounds of an exact search; `knn` merges them."""
    cosine, product = metric == "cosine", _product(k, metric == "cosine", group, same_group, exclude_self)
    q, b = _own(queries, group), _own(base, group)
    keys = ["_p"]
    if group and same_group:  # rows of other groups never meet: the group is a part of the key
        q, b = (d.withColumn("_g", F.col(group)) for d in (q, b))
        keys = ["_g", "_p"]
    n_base = base.count() if pivots is None else 0
    n = max(1, min(GROUP_PIVOTS if keys[1:] else MOST_PIVOTS, n_base // PIVOT_ROWS)) if pivots is None else pivots
    x = sample(b, SAMPLE_ROWS, seed) if n > 1 else ()
    if not len(x):  # one cell
        q, b = (d.withColumn("_p", F.lit(0)) for d in (q, b))
        fixed = None if pivots else (n_base // SLICE_ROWS + 1, queries.count() // SLICE_ROWS + 1)
        return Meetings(b, q, _met(q, b, keys, product, fixed), None, keys)
    x = np.unique(_unit(x) if cosine else x, axis=0)
    spots = centres(x, min(n, len(x)), seed)
    b = checkpointed(_keyed(b, spots, cosine))
    cells = b.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_r").alias("lo"), F.max("_r").alias("hi")).withColumnRenamed("_p", "p")
    cells = checkpointed(cells)
    if keys[1:] and cells.limit(FEW_ROWS + 1).count() <= FEW_ROWS:  # the groups' cells are few: they are told once, and not with each query
        by: dict = {}
        for c in cells.collect():
            by.setdefault(c["_g"], []).append(c)
        known = {g: Cells(c) for g, c in by.items()}
    elif keys[1:]:
        known, cells = None, cells.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("p", "n", "lo", "hi"))).alias("_cells"))  # GROUP_PIVOTS a group at most
    else:
        known = Cells(cells.collect())  # a row a pivot
    told = lambda d: d if known is not None else d.join(cells, "_g")
    first = checkpointed(told(q).mapInPandas(_planned(spots, cosine, known, "_first", _nearest_cells(k)), _schema(q, "_first array<int>")))
    one = first.withColumn("_p", F.explode("_first")).drop("_first")
    found = checkpointed(_met(one, b, keys, product))
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("_n") <= k)
    kth = ranked.groupBy(F.col("query_id").alias("id")).agg(F.max("score").alias("_worst"), F.count("*").alias("_have"))
    worst = F.sqrt(F.greatest(F.lit(0.0), 2 + 2 * F.col("_worst"))) if cosine else F.col("_worst")
    bounded = first.join(kth, "id", "left").withColumn("_bound", F.when(F.col("_have") >= k, worst).otherwise(F.lit(float("inf"))))
    # What a query has found bounds what it looks for.
    bounded = bounded.withColumn("_limit", F.when(F.col("_have") >= k, F.col("_worst"))).drop("_worst", "_have")
    rest = checkpointed(told(bounded).mapInPandas(_planned(spots, cosine, known, "_rest", _other_cells(spots)), _schema(q, "_limit double", "_rest array<int>")))
    # Where the cells tell neighbours apart too little, all rows (of a group) meet in slices: these are larger than cells, so less is copied.
    whole = keys[:-1] or ["_all"]
    q1, b1 = (d if keys[1:] else d.withColumn("_all", F.lit(0)) for d in (rest.drop("_rest"), b.drop("_p", "_r")))
    copies = _slices(q1, b1, whole).agg(F.sum(F.col("_a") * F.col("_ns") + F.col("_b") * F.col("_nq"))).first()[0] or 0
    if (rest.agg(F.sum(F.size("_rest"))).first()[0] or 0) > copies:
        return Meetings(b1, q1, _met(q1, b1, whole, product, large=True), None, whole)
    rest = rest.withColumn("_p", F.explode("_rest")).drop("_rest")
    return Meetings(b, one, found.unionByName(_met(rest, b, keys, product)), rest, keys)


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "euclidean", group: str | None = None, same_group: bool | None = None, exclude_self: bool = False, pivots: int | None = None) -> DataFrame:
    """(query_id, id, distance or similarity, rank): the ``k`` nearest base rows of each query, exactly; ties by id.

    Rows meet by cells of ``pivots`` (None: one for every `PIVOT_ROWS` base rows); a query's copies grow with the cells that may hold a
    neighbour, not with the table. ``same_group`` True or False keeps pairs of equal or of different ``group`` only. A query that finds fewer than
    ``k`` rows in its first cells meets all others. Cosine: queries and base rows of zero length give nothing. Ids of queries differ.
    """
    k = max(1, k)
    part = meetings(queries, base, k, metric, group, same_group, exclude_self, pivots).found
    top = part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k)
    value = (-F.col("score")).alias("similarity") if metric == "cosine" else F.col("score").alias("distance")
    return top.select("query_id", "id", value, "rank")


def shuffled_copies(m: Meetings) -> DataFrame:
    """(side, vectors, copies): how many vectors each side of an exact search has, and how often they are shuffled in all."""
    large = m.keys[-1] != "_p"
    met = m.first if m.rest is None else m.first.select("id", *m.keys).union(m.rest.select("id", *m.keys))
    rounds = [m.first] if m.rest is None else [m.first, m.rest]
    sides = met.agg(F.lit("queries").alias("side"), F.countDistinct("id").alias("vectors"), F.count("*").alias("copies"))
    for r in rounds:
        left, right = _dealt(r.select("id", "values", *m.keys), m.base.select("id", "values", *m.keys), m.keys, large=large)
        sides = sides.union(right.agg(F.lit("base").alias("side"), F.countDistinct("id").alias("vectors"), F.count("*").alias("copies")))
    return sides.groupBy("side").agg(F.max("vectors").alias("vectors"), F.sum("copies").alias("copies"))


# --- models of a bounded sample


def _owner(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, some rows at a time."""
    step, size = max(1, CELLS // (8 * len(c))), (c * c).sum(1)[None]
    return np.concatenate([np.argmin(size - 2 * x[i : i + step] @ c.T, axis=1) for i in range(0, len(x), step)]) if len(x) else np.empty(0, int)


def centres(x: np.ndarray, n: int, seed: int, rounds: int = 12) -> np.ndarray:
    """K-means of a sample: ``n`` centres at most, begun at rows drawn by squared distance; an empty one moves to the farthest row."""
    rng = np.random.default_rng(seed)
    c = [x[rng.integers(len(x))]]
    far = ((x - c[0]) ** 2).sum(1)
    while len(c) < n and far.max() > 0:
        c.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - c[-1]) ** 2).sum(1))
    c = np.array(c)
    for _ in range(rounds):
        own = _owner(x, c)
        size = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[far.argsort()[::-1][: len(c)]] if len(x) >= len(c) else c)
    return c


@dataclass
class Index:
    """Coarse cells (rows), a codebook for each part of a residual, how many cells a query meets, and how many candidates it compares exactly."""

    cells: np.ndarray
    books: list[np.ndarray]
    probes: int
    candidates: int

    def parts(self) -> list[slice]:
        cuts = np.linspace(0, self.cells.shape[1], len(self.books) + 1).astype(int)
        return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code of each part) of vectors."""
        own = _owner(x, self.cells)
        r = x - self.cells[own]
        return own, np.stack([_owner(r[:, s], book).astype(np.uint8) for s, book in zip(self.parts(), self.books, strict=True)], axis=1)

    def estimates(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to coded rows of a cell, from one table a query and part."""
        r = x - self.cells[cell]
        out = np.zeros((len(x), len(codes)), np.float32)
        for j, (s, book) in enumerate(zip(self.parts(), self.books, strict=True)):
            table = (((r[:, s] ** 2).sum(1)[:, None] + (book**2).sum(1)[None]) - 2 * r[:, s] @ book.T).astype(np.float32)
            out += table[:, codes[:, j]]
        return out


def fit_index(base: DataFrame, k: int = 10, cells: int | None = None, parts: int = 16, recall: float = 0.92, seed: int = 1, sample_rows: int = SAMPLE_ROWS) -> Index:
    """An index fitted on a bounded sample of ``base`` (``sample_rows``, and `SAMPLE_BYTES`).

    The sample gives the coarse cells (None: about the root of the table's rows, and a sixteenth of the sample at most), the codebooks of ``parts`` parts, and
    two numbers: how many cells must be met, and how many candidates compared, so that ``recall`` of the ``k`` neighbours of 200 sample rows among the sample
    are found (four fifths of the loss are allowed to the cells; of a table larger than the sample, 8 k candidates at least are compared). In the whole table neighbours are nearer, so its recall is seldom lower; `recall_at_k`
    measures it. Vectors in clusters need few cells; where directions are spread evenly in many dimensions no partition tells neighbours apart, and
    most cells are met.
    """
    x = sample(base, sample_rows, seed)
    if not len(x):
        return Index(np.zeros((1, 1)), [np.zeros((1, 1))], 1, max(1, k))
    n = base.count()
    coarse = centres(x, max(1, min(cells or int(np.sqrt(n)), len(x) // 16)), seed)
    model = Index(coarse, [np.zeros((1, 1))] * min(parts, x.shape[1]), 1, k)
    own = _owner(x, coarse)
    residual = x - coarse[own]
    model.books = [centres(residual[:, s], min(256, len(x)), seed + j) for j, s in enumerate(model.parts())]
    asked = np.random.default_rng(seed).choice(len(x), min(200, len(x)), False)
    d = _distances(x[asked], x)
    d[np.arange(len(asked)), asked] = np.inf
    true = least(d, min(k, len(x) - 1)) if len(x) > 1 else np.zeros((len(asked), 0), int)
    if true.size:
        order = np.argsort(_distances(x[asked], coarse), axis=1)
        place = np.argsort(order, axis=1)  # of each cell in a query's order
        model.probes = int(np.quantile(np.take_along_axis(place, own[true], 1), 1 - 0.8 * (1 - recall), method="higher")) + 1
        cell, codes = model.encode(x)
        guess = np.empty_like(d, dtype=np.float32)
        for c in np.unique(cell):
            guess[:, cell == c] = model.estimates(x[asked], c, codes[cell == c])
        guess[np.arange(len(asked)), asked] = np.inf
        before = np.stack([(g[None] < g[t][:, None]).sum(1) for g, t in zip(guess, true, strict=True)])
        model.candidates = int(np.quantile(before, 1 - 0.2 * (1 - recall), method="higher")) + 1
    # A larger table has more rows that seem as near as a neighbour does.
    model.candidates = max(8 * k if n > len(x) else k, model.candidates)
    return model


def encode(rows: DataFrame, index: Index) -> DataFrame:
    """(id, cell, code): the index's entry of every row, 4 bytes and one for each part. Any row is encoded, in the sample or not."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                cell, codes = index.encode(_array(f["values"]))
                yield pd.DataFrame({"id": f["id"], "cell": cell.astype("int32"), "code": [c.tobytes() for c in codes]})

    return rows.select("id", "values").mapInPandas(run, "id long, cell int, code binary")


def write_index(codes: DataFrame, path: str) -> None:
    """Codes in folders by cell, so that a search reads the folders of its cells only."""
    codes.write.mode("overwrite").partitionBy("cell").parquet(path)


def search_index(queries: DataFrame, base: DataFrame, codes: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, id, distance, rank, n_codes, n_compared): approximate Euclidean neighbours by the entries ``codes`` of ``base``.

    A query meets the codes of its ``index.probes`` nearest cells, and of more if these hold fewer than ``index.candidates`` rows; n_codes counts
    the codes and the centres that it was compared with. The vectors of its best candidates (n_compared of them) give exact distances; ties by id.
    """
    q = _own(queries)
    sizes = codes.groupBy("cell").agg(F.count("*").alias("n")).toPandas()  # a row a cell of the model
    if not len(sizes):
        return queries.sparkSession.createDataFrame([], "query_id long, id long, distance double, rank int, n_codes long, n_compared long")
    count = np.zeros(len(index.cells), np.int64)
    count[sizes.cell.to_numpy()] = sizes.n.to_numpy()
    most = max(k, index.candidates)

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                order = np.argsort(_distances(_array(f["values"]), index.cells), axis=1, kind="stable")
                held = np.cumsum(count[order], axis=1)
                upto = np.minimum(np.maximum(index.probes, (held < most).sum(1) + 1), len(count))
                yield f.assign(cells=[o[:u].tolist() for o, u in zip(order, upto, strict=True)], n_codes=held[np.arange(len(f)), upto - 1] + len(count))

    met = checkpointed(q.mapInPandas(probe, _schema(q, "cells array<int>", "n_codes long")))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "apart": pd.Series([], dtype="float32")})]
        if len(left) and len(right):
            right = right.sort_values("id")
            x, cell = _array(left["values"]), int(right.cell.iloc[0])
            y = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1)
            step = max(1, CELLS // (8 * len(right)))
            for low in range(0, len(left), step):
                apart = index.estimates(x[low : low + step], cell, y)
                best = least(apart, most)
                rows = np.repeat(np.arange(len(apart)), best.shape[1])
                out.append(pd.DataFrame({"query_id": left.id.to_numpy()[low + rows], "id": right.id.to_numpy()[best.ravel()], "apart": apart[rows, best.ravel()]}))
        return pd.concat(out)

    wanted = sorted({c for r in met.select(F.explode("cells").alias("c")).distinct().collect() for c in r})  # numbers of cells of the model
    left, right = _dealt(met.select("id", "values", F.explode("cells").alias("cell")), codes.where(F.col("cell").isin(wanted)), ["cell"])
    keys = ["cell", "_q", "_s"]
    part = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, "query_id long, id long, apart float")
    best = part.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("apart", "id"))).where(F.col("_n") <= most).select("query_id", "id")
    near = best.join(met.select(F.col("id").alias("query_id"), F.col("values").alias("_x"), "n_codes"), "query_id").join(base.select("id", F.col("values").alias("_y")), "id")
    near = near.select("query_id", "id", F.round(euclidean(F.col("_x"), F.col("_y")), 9).alias("distance"), "n_codes")
    w = Window.partitionBy("query_id")
    ranked = near.withColumn("rank", F.row_number().over(w.orderBy("distance", "id"))).withColumn("n_compared", F.count("*").over(w))
    return ranked.where(F.col("rank") <= k).select("query_id", "id", "distance", "rank", "n_codes", "n_compared")


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))


def approx_knn(queries: DataFrame, base: DataFrame, k: int, **how) -> DataFrame:
    """`search_index` over an index that is fitted to ``base`` (`fit_index` takes ``how``) and encodes all of it."""
    index = fit_index(base, k, **how)
    return search_index(queries, base, checkpointed(encode(base, index)), index, k)


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall): the share of exact neighbours that were found."""
    hit = exact.join(found.select("query_id", "id").withColumn("_hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.agg(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("recall"))
