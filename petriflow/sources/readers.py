"""Annotation files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from petriflow.operators.boxes import corners_from_xywh

_DETECTION = "bbox array<double>, confidence double, rfdetr_conf double, area double, perimeter double, circularity double, solidity double, aspect_ratio double, matched boolean, is_tp boolean, match_iou double"
NESTED = f"per_image array<struct<{', '.join(x.replace(' ', ':', 1) for x in ('image string', 'detections array<struct<' + ', '.join(y.replace(' ', ':', 1) for y in _DETECTION.split(', ')) + '>>'))}>>"
FLAT = f"cache_key string, image string, det_idx int, {_DETECTION}, crop_path string, image_size array<int>, n_gt int"


def stem(path: Column) -> Column:
    """A file's name without folders and suffix."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def polygons_of(text: DataFrame, column: str = "value", min_side: float = 0) -> DataFrame:
    """(source, key, xs, ys, x1, y1, x2, y2, xc, yc) of JSON {key: [[row, col], ...]} or {key: {"vertices": [...]}} texts (source, value).

    Polygons of fewer than 3 points go, on demand those narrower or lower than ``min_side``. Text that is no such JSON gives no rows.
    """
    raw = text.select("source", F.explode(F.from_json(column, "map<string,string>")).alias("key", "body"))
    plain = F.from_json("body", "array<array<double>>")
    held = F.from_json("body", "vertices array<array<double>>")
    pts = F.when(F.col("body").startswith("{"), held["vertices"]).otherwise(plain)
    p = raw.withColumn("pts", pts).where(F.size("pts") >= 3)
    p = p.withColumn("xs", F.transform("pts", lambda q: F.get(q, F.lit(1)))).withColumn("ys", F.transform("pts", lambda q: F.get(q, F.lit(0))))
    p = p.select("source", "key", "xs", "ys", F.array_min("xs").alias("x1"), F.array_min("ys").alias("y1"), F.array_max("xs").alias("x2"), F.array_max("ys").alias("y2"))
    p = p.withColumn("xc", (F.col("x1") + F.col("x2")) / 2).withColumn("yc", (F.col("y1") + F.col("y2")) / 2)
    return p.where((F.col("x2") - F.col("x1") >= min_side) & (F.col("y2") - F.col("y1") >= min_side)) if min_side else p


def read_polygons(spark: SparkSession, path: str, min_side: float = 0) -> DataFrame:
    text = spark.read.option("wholetext", True).text(path).select(stem(F.col("_metadata.file_path")).alias("source"), "value")
    return polygons_of(text, min_side=min_side)


def label_lines_of(lines: DataFrame, column: str = "value") -> DataFrame:
    """(source, cls, xc, yc, w, h) of lines ``cls xc yc w h``; shorter ones and ones that are no numbers are skipped."""
    f = F.split(F.trim(column), r"\s+")
    t = lines.withColumn("_f", f).where(F.size("_f") >= 5)
    num = lambda i: F.get("_f", F.lit(i)).try_cast("double")
    out = t.select(*[c for c in lines.columns if c != column], num(0).cast("int").alias("cls"), num(1).alias("xc"), num(2).alias("yc"), num(3).alias("w"), num(4).alias("h"))
    return out.where("cls is not null and xc is not null and yc is not null and w is not null and h is not null")


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    return label_lines_of(spark.read.text(path).select(stem(F.col("_metadata.file_path")).alias("source"), "value"))


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, value) of lines of fewer than 5 fields that are not blank."""
    t = spark.read.text(path).select(stem(F.col("_metadata.file_path")).alias("source"), "value")
    return t.where((F.trim("value") != "") & (F.size(F.split(F.trim("value"), r"\s+")) < 5))


def read_box_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(image, n_organoids, width, height, x1, y1, x2, y2): a row a box, and one with null corners for an image without boxes."""
    schema = "image string, source_annotated string, source_original string, n_organoids int, bboxes array<struct<x:double,y:double,w:double,h:double>>, image_size array<int>"
    j = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("b", F.explode_outer("bboxes"))
    return j.select("image", "source_annotated", "source_original", "n_organoids", F.get("image_size", F.lit(0)).alias("width"), F.get("image_size", F.lit(1)).alias("height"), *corners_from_xywh("b.x", "b.y", "b.w", "b.h"))


def _detection_columns(d: str) -> list[Column]:
    at = lambda c: F.col(f"{d}{c}")
    zero = lambda c: F.coalesce(at(c), F.lit(0.0)).alias(c)
    return [
        *(F.get(at("bbox"), F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))),
        F.coalesce(at("rfdetr_conf"), at("confidence"), F.lit(0.5)).alias("score"),
        *(zero(c) for c in ("area", "perimeter", "circularity", "solidity", "aspect_ratio")),
        F.coalesce(at("matched"), at("is_tp"), F.lit(False)).alias("matched"),
        zero("match_iou"),
    ]


def read_detections(spark: SparkSession, path: str, layout: str = "nested") -> DataFrame:
    """(cache_key, image, det_idx, x1, y1, x2, y2, score, measures, matched, match_iou) of either layout: nested per_image[].detections[] or a flat list.

    score is rfdetr_conf, else confidence, else 0.5; missing measures are 0; matched falls back to is_tp. The key is the image with _ for / and the number.
    """
    if layout == "nested":
        j = spark.read.schema(NESTED).option("multiLine", True).json(path).select(F.explode("per_image").alias("i"))
        j = j.select(F.col("i.image").alias("image"), F.posexplode("i.detections").alias("det_idx", "d"))
        cols, key = _detection_columns("d."), F.lit(None).cast("string")
    else:
        j = spark.read.schema(FLAT).option("multiLine", True).json(path)
        cols, key = _detection_columns(""), F.col("cache_key")
    made = F.concat_ws("_", F.replace("image", F.lit("/"), F.lit("_")), F.col("det_idx").cast("string"))
    return j.select(F.coalesce(key, made).alias("cache_key"), "image", "det_idx", *cols)


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """A metrics table whose headers and values carry spaces: names trimmed, values as doubles, missing ones 0."""
    t = spark.read.option("header", True).csv(path)
    return t.select(*(F.coalesce(F.trim(F.col(f"`{c}`")).try_cast("double"), F.lit(0.0)).alias(c.strip()) for c in t.columns))


def parse_class_table(texts: DataFrame, known: list[str], column: str = "value") -> DataFrame:
    """(…, cls, images, instances, precision, recall, map50, map) of white-space tables: lines of 7 fields or more whose first is a known class."""
    lines = texts.select(*[c for c in texts.columns if c != column], F.explode(F.split(column, "\n")).alias("_line"))
    f = F.filter(F.split(F.trim("_line"), r"\s+"), lambda x: x != "")
    t = lines.withColumn("_f", f).where((F.size("_f") >= 7) & F.get("_f", F.lit(0)).isin(known))
    num = lambda i, kind="double": F.get("_f", F.lit(i)).try_cast(kind)
    return t.select(*[c for c in texts.columns if c != column], F.get("_f", F.lit(0)).alias("cls"), num(1, "int").alias("images"), num(2, "int").alias("instances"), num(3).alias("precision"), num(4).alias("recall"), num(5).alias("map50"), num(6).alias("map"))


#: Annotators in order of preference.
PRIORITY = ("t0", "annotator_a", "t1_a", "annotator_b", "t1_b", "other")


def annotator_of(name: Column) -> Column:
    """The annotator that a file name tells of, by ordered rules."""
    n = F.lower(name)
    return (
        F.when(n.contains("annotator_a"), "annotator_a")
        .when(n.contains("annotator_b"), "annotator_b")
        .when(n.contains("annotator_c"), "annotator_c")
        .when(n.contains("t0"), "t0")
        .when(n.contains("t1") & n.contains("_a"), "t1_a")
        .when(n.contains("t1") & n.contains("_b"), "t1_b")
        .when(n.contains("t1"), "t1_unknown")
        .otherwise("other")
    )


def classify_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    """(split, cls, plate, image, name, annotator) of paths …/split/cls/plate/image/name."""
    p = F.split(column, "/")
    part = lambda i: F.element_at(p, i)
    ok = paths.where(F.size(p) >= 5)
    return ok.select(part(-5).alias("split"), part(-4).alias("cls"), part(-3).alias("plate"), part(-2).alias("image"), part(-1).alias("name"), annotator_of(part(-1)).alias("annotator"))


def inventory(files: DataFrame) -> DataFrame:
    """Files by split, class, plate and annotator."""
    return files.groupBy("split", "cls", "plate", "annotator").agg(F.count("*").alias("n"))


def inventory_files(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    return inventory(classify_paths(listed))


def pick_primary_annotator(files: DataFrame) -> DataFrame:
    """The file of the most preferred annotator of each image."""
    rank = F.array_position(F.array(*(F.lit(p) for p in PRIORITY)), F.col("annotator"))
    order = F.when(rank > 0, rank).otherwise(len(PRIORITY))
    n = F.row_number().over(Window.partitionBy("split", "cls", "plate", "image").orderBy(order, "name"))
    return files.withColumn("_n", n).where("_n = 1").drop("_n")
