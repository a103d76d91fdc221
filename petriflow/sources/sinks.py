"""Rows as label files, polygon files and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_lines(boxes: DataFrame, by: str = "patch") -> DataFrame:
    """(by, value): one line ``cls xc yc w h`` a box, six decimals, in order of idx."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", F.col("cls").cast("int"), "xc", "yc", "w", "h")
    return boxes.select(by, "idx", line.alias("value"))


def write_label_lines(boxes: DataFrame, path: str, by: str = "patch") -> None:
    """A folder of lines for each patch."""
    label_lines(boxes, by).repartition(by).sortWithinPartitions(by, "idx").select(by, "value").write.partitionBy(by).mode("overwrite").text(path)


def polygon_json(boxes: DataFrame, by: str = "image", pad: float = 0.0) -> DataFrame:
    """(by, value): a JSON object {"0": [[y, x] * 4], ...} of each image's boxes in order of idx, padded on demand."""
    lo = lambda c: F.greatest(F.lit(0.0), F.col(c) - pad)
    hi = lambda c: F.col(c) + pad
    ring = F.array(F.array(lo("y1"), lo("x1")), F.array(lo("y1"), hi("x2")), F.array(hi("y2"), hi("x2")), F.array(hi("y2"), lo("x1")))
    g = boxes.select(by, "idx", ring.alias("r")).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("idx", "r"))).alias("l"))
    entries = F.map_from_entries(F.transform("l", lambda x, i: F.struct(i.cast("string"), x.r)))
    return g.select(by, F.to_json(entries).alias("value"))


def write_polygon_json(boxes: DataFrame, path: str, by: str = "image", pad: float = 0.0) -> None:
    polygon_json(boxes, by, pad).write.partitionBy(by).mode("overwrite").text(path)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A summary table as JSON lines, CSV with a header, or Parquet."""
    w = df.write.mode("overwrite")
    {"json": w.json, "csv": w.option("header", True).csv, "parquet": w.parquet}[kind](path)
