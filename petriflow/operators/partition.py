"""Dealing rows to splits and clients, and checks on names and contents.

Every random choice is a seeded md5 order, so it does not depend on how Spark laid out the rows. Rows of a class are numbered in hash buckets
first and offset by the buckets before, so a class with most of the rows is never one window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petriflow.functions.grid import all_pairs_of_keys, with_each


#: Rows of a hash bucket in which rows are numbered, about.
BUCKET_ROWS = 100_000


def seeded(key: str | Column, seed: int | str = 0) -> Column:
    """A uniform order over keys: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def numbered(df: DataFrame, by: list[str], key: str, seed: int | str = 0, into: str = "n", buckets: int | None = None) -> DataFrame:
    """``df`` with ``into``: 1, 2, ... in seeded order within ``by``, in two passes over hash buckets: the first ``buckets`` hex digits, by default so
    many that a bucket has ``BUCKET_ROWS`` rows at most, about."""
    if buckets is None:
        buckets = max(1, math.ceil(math.log(max(1, df.count() / BUCKET_ROWS), 16)))
    d = df.withColumn("_nb_h", seeded(key, seed)).withColumn("_nb_p", F.substring("_nb_h", 1, buckets))
    counts = d.groupBy(*by, "_nb_p").agg(F.count("*").alias("_nb_c"))
    before = counts.withColumn("_nb_b", F.sum("_nb_c").over(Window.partitionBy(*by).orderBy("_nb_p")) - F.col("_nb_c")).drop("_nb_c")
    d = d.withColumn("_nb_n", F.row_number().over(Window.partitionBy(*by, "_nb_p").orderBy("_nb_h", key)))
    j = d.join(before, [*by, "_nb_p"])
    return j.withColumn(into, (F.col("_nb_n") + F.col("_nb_b")).cast("long")).drop("_nb_h", "_nb_p", "_nb_n", "_nb_b")


def _with_total(df: DataFrame, by: list[str], into: str = "total") -> DataFrame:
    n = df.groupBy(*by).agg(F.count("*").alias(into))
    return df.join(n, by) if by else df.crossJoin(F.broadcast(n))  # one row


def split_by_image(df: DataFrame, image: str = "image", train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """``df`` with split: images in seeded order, int(train * n) to train, int(val * n) to val, the rest to test; an image is never divided."""
    images = _with_total(numbered(df.select(image).distinct(), [], image, seed), [])
    a, b = F.floor(F.col("total") * train), F.floor(F.col("total") * train) + F.floor(F.col("total") * val)
    split = F.when(F.col("n") <= a, "train").when(F.col("n") <= b, "val").otherwise("test")
    return df.join(images.select(image, split.alias("split")), image)


def balance_classes(df: DataFrame, cls: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each class as the smallest has."""
    least = df.groupBy(cls).count().agg(F.min("count").alias("_least"))
    return numbered(df, [cls], key, seed, "_n").crossJoin(F.broadcast(least)).where(F.col("_n") <= F.col("_least")).drop("_n", "_least")  # one row


def sample_per_class(df: DataFrame, cls: str, key: str, most: dict, seed: int = 42) -> DataFrame:
    """At most ``most[class]`` rows of each class named there."""
    limit = F.create_map(*(F.lit(x) for kv in most.items() for x in kv))
    return numbered(df, [cls], key, seed, "_n").where(F.col("_n") <= F.try_element_at(limit, F.col(cls))).drop("_n")


def split_iid(df: DataFrame, key: str, clients: int, seed: int = 42, keep_remainder: bool = True) -> DataFrame:
    """``df`` with client 0 to clients-1: equal parts in seeded order; the remainder goes to the last one or is dropped."""
    d = _with_total(numbered(df, [], key, seed, "_n"), [], "_t")
    size = F.floor(F.col("_t") / clients)
    c = F.when(size > 0, F.floor((F.col("_n") - 1) / size)).otherwise(F.lit(clients))
    d = d.withColumn("client", (F.least(c, F.lit(clients - 1)) if keep_remainder else c).cast("int"))
    return (d if keep_remainder else d.where(F.col("client") < clients)).drop("_n", "_t")


def split_skew(df: DataFrame, cls: str, key: str, clients: int, skew: float, seed: int = 42) -> DataFrame:
    """``df`` with client: int(n * (.3 + .7 * skew)) rows of each class to its primary client (classes dealt round in sorted order), the others to any other."""
    d = _with_total(numbered(df, [cls], key, seed, "_n"), [cls], "_t")
    order = df.select(cls).distinct().withColumn("_k", F.row_number().over(Window.orderBy(cls)) - 1)  # few classes
    d = d.join(order, cls)
    primary = F.col("_k") % clients
    other = F.conv(F.substring(seeded(key, f"{seed}o"), 1, 8), 16, 10).cast("long") % max(1, clients - 1)
    c = F.when((F.col("_n") <= F.floor(F.col("_t") * (0.3 + 0.7 * skew))) | F.lit(clients == 1), primary).otherwise(F.when(other < primary, other).otherwise(other + 1))
    return d.withColumn("client", c.cast("int")).drop("_n", "_t", "_k")


def split_dominant(df: DataFrame, cls: str, key: str, dominant: dict[int, list], ratio: float, seed: int = 42) -> DataFrame:
    """(key, client), each pair once: client c takes int(ratio * n) rows of its dominant classes and max(1, int((1 - ratio) * n / others)) of each other class,
    in an order of its own, so a row may go to several clients. A ratio up to .34 is `split_iid`."""
    if ratio <= 0.34:
        return split_iid(df.select(key).distinct(), key, len(dominant), seed).select(key, "client")
    clients = sorted(dominant)
    d = _with_total(df.select(key, cls).distinct(), [cls], "_t")
    d = with_each(d, ["client"], [(c,) for c in clients])
    own = F.coalesce(F.array_contains(F.try_element_at(F.create_map(*(x for c in clients for x in (F.lit(c), F.array(*(F.lit(v) for v in dominant[c]))))), F.col("client")), F.col(cls)), F.lit(False))
    n_classes = df.select(F.countDistinct(cls).alias("n")).first().n
    others = F.try_element_at(F.create_map(*(F.lit(x) for c in clients for x in (c, max(1, n_classes - len(dominant[c]))))), F.col("client"))
    take = F.when(own, F.floor(F.col("_t") * ratio)).otherwise(F.greatest(F.lit(1), F.floor(F.col("_t") * (1 - ratio) / others)))
    d = d.withColumn("_take", take).withColumn("_key", F.concat_ws("|", "client", key))
    return numbered(d, ["client", cls], "_key", seed, "_n").where(F.col("_n") <= F.col("_take")).select(key, "client").distinct()


def holdout_plan(df: DataFrame, batch: str, order: str, plan: dict[str, tuple[int, int, int]], few_shot: int = 3) -> DataFrame:
    """``df`` with split and few_shot: fixed train, val and test counts of each batch, by order; rows beyond the plan have no split."""
    n = F.row_number().over(Window.partitionBy(batch).orderBy(order))
    get = lambda i: F.try_element_at(F.create_map(*(F.lit(x) for b, p in plan.items() for x in (b, sum(p[: i + 1])))), F.col(batch))
    d = df.withColumn("_n", n)
    split = F.when(F.col("_n") <= get(0), "train").when(F.col("_n") <= get(1), "val").when(F.col("_n") <= get(2), "test")
    return d.withColumn("split", split).withColumn("few_shot", F.coalesce(F.col("split") == "train", F.lit(False)) & (F.col("_n") <= few_shot)).drop("_n")


def holdout_every(df: DataFrame, by: str, order: str, ratio: float, tail: bool = False) -> DataFrame:
    """``df`` with split: every int(1 / ratio)-th row of a group, or the last int(ratio * n), to val."""
    w = Window.partitionBy(by)
    n = F.row_number().over(w.orderBy(order))
    val = n > F.count("*").over(w) - F.floor(F.count("*").over(w) * ratio) if tail else (n - 1) % max(1, int(1 / ratio)) == 0
    return df.withColumn("split", F.when(val, "val").otherwise("train"))


def client_distribution(df: DataFrame, client: str = "client", cls: str = "cls") -> DataFrame:
    """(client, cls, n) for every combination, zeros included."""
    return all_pairs_of_keys(df, client, cls).join(df.groupBy(client, cls).agg(F.count("*").alias("n")), [client, cls], "left").fillna(0, ["n"])


def client_totals(df: DataFrame, client: str = "client", cls: str = "cls") -> DataFrame:
    """(client, cls, n) with totals by client, by class and overall (nulls)."""
    return df.cube(client, cls).agg(F.count("*").alias("n"))


def merge_domains(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of all domains with domain and a prefixed key; rows without a key go."""
    out = None
    for name, d in parts.items():
        d = d.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").withColumn("domain", F.lit(name)).withColumn(key, F.concat_ws("_", F.lit(name), F.col(key).cast("string")))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def domain_totals(merged: DataFrame, label: str = "label") -> DataFrame:
    """(domain, n, n_tp, n_fp) by domain and overall (null)."""
    return merged.rollup("domain").agg(F.count("*").alias("n"), F.sum((F.col(label) == 1).cast("long")).alias("n_tp"), F.sum((F.col(label) != 1).cast("long")).alias("n_fp"))


def client_of_path(path: str | Column) -> Column:
    """Class_Plate of a path Class/Plate/image."""
    p = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.concat_ws("_", F.get(p, F.lit(0)), F.get(p, F.lit(1)))


def client_summary(df: DataFrame, client: str = "client", label: str = "label") -> DataFrame:
    tp = F.sum((F.col(label) == 1).cast("long"))
    return df.groupBy(client).agg(F.count("*").alias("n"), tp.alias("n_tp"), (F.count("*") - tp).alias("n_fp"), (100 * tp / F.count("*")).alias("tp_pct"))


def duplicate_content(files: DataFrame) -> DataFrame:
    """(digest, path, n): every path whose content (path, content) is found in several places, n of them; null contents are no content.

    Places come as rows: a content that very many files share is never gathered into one.
    """
    named = files.where("content is not null").select(F.md5("content").alias("digest"), "path")
    return named.join(named.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "digest")


def same_names(files: DataFrame, batch: str = "batch", name: str = "name") -> DataFrame:
    """(name, n, n_contents, same): names that occur in several batches, and whether their contents agree."""
    g = files.groupBy(name).agg(F.count("*").alias("n"), F.countDistinct(batch).alias("_b"), F.countDistinct(F.md5("content")).alias("n_contents"))
    return g.where("_b > 1").drop("_b").withColumn("same", F.col("n_contents") == 1)


def pairing_check(left: DataFrame, right: DataFrame, mapping: DataFrame, by: str = "batch") -> DataFrame:
    """(by, n, n_wrong, n_wrong_reversed): sorted names of both sides paired by place, and in reversed order, against a recorded mapping (left, right)."""
    w = Window.partitionBy(by).orderBy("name")
    a = left.select(by, F.col("name").alias("left"), F.row_number().over(w).alias("_n"))
    b = right.select(by, F.col("name").alias("right"), F.row_number().over(w).alias("_n"), (F.count("*").over(Window.partitionBy(by)) + 1 - F.row_number().over(w)).alias("_r"))
    m = mapping.select(by, "left", F.col("right").alias("want"))
    one = a.join(b.select(by, "_n", "right"), [by, "_n"]).join(b.select(by, F.col("_r").alias("_n"), F.col("right").alias("back")), [by, "_n"]).join(m, [by, "left"])
    return one.groupBy(by).agg(F.count("*").alias("n"), F.sum((F.col("right") != F.col("want")).cast("long")).alias("n_wrong"), F.sum((F.col("back") != F.col("want")).cast("long")).alias("n_wrong_reversed"))


def compare_names(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """(name, side): names of both sides, of the left only and of the right only."""
    a, b = left.select(name).distinct(), right.select(name).distinct()
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).withColumn("side", F.lit("left"))).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def label_profile(images: DataFrame, labels: DataFrame, by: str = "batch", lines: DataFrame | None = None) -> DataFrame:
    """One row a batch: boxes, images, images without label, labels without image, boxes outside, of no area, tiny and huge, least, largest and mean
    area, width and height, images by number of boxes (0, 1-2, 3-5, 6-10, more), boxes by class (array of cls and n), and malformed lines.

    labels: (batch, image, cls, xc, yc, w, h); images: (batch, image); lines: (batch, line), the label files' lines, of which a good one has five
    numbers; without them n_malformed is null.
    """
    area = F.col("w") * F.col("h")
    out = (F.col("xc") - F.col("w") / 2 < 0) | (F.col("yc") - F.col("h") / 2 < 0) | (F.col("xc") + F.col("w") / 2 > 1) | (F.col("yc") + F.col("h") / 2 > 1)
    count = lambda c, n: F.sum(c.cast("long")).alias(n)
    size = [f(c).alias(f"{name}_{c}") for c in ("w", "h") for f, name in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))]
    boxes = labels.groupBy(by).agg(F.count("*").alias("n_boxes"), count(out, "n_outside"), count(area <= 0, "n_zero_area"), count((area > 0) & (area < 0.001), "n_tiny"), count(area > 0.5, "n_huge"), F.min(area).alias("min_area"), F.max(area).alias("max_area"), F.avg(area).alias("mean_area"), *size)
    per = images.join(labels.groupBy(by, "image").agg(F.count("*").alias("k")), [by, "image"], "left").fillna(0, ["k"])
    k = F.col("k")
    buckets = per.groupBy(by).agg(F.count("*").alias("n_images"), count(k == 0, "images_0"), count((k >= 1) & (k <= 2), "images_1_2"), count((k >= 3) & (k <= 5), "images_3_5"), count((k >= 6) & (k <= 10), "images_6_10"), count(k > 10, "images_more"))
    lost = labels.select(by, "image").distinct().join(images.select(by, "image"), [by, "image"], "left_anti").groupBy(by).agg(F.count("*").alias("n_labels_without_image"))
    classes = labels.groupBy(by, "cls").agg(F.count("*").alias("n")).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("cls", "n"))).alias("classes"))  # a row a class
    found = buckets.join(boxes, by, "left").join(lost, by, "left").fillna(0).join(classes, by, "left")
    if lines is None:
        return found.withColumn("n_malformed", F.lit(None).cast("long"))
    number = r"[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?"
    bad = ~F.trim("line").rlike(rf"^{number}(\s+{number}){{4}}$")
    return found.join(lines.groupBy(by).agg(count(F.coalesce(bad, F.lit(True)), "n_malformed")), by, "left").fillna(0, ["n_malformed"])
