"""Tiles and sliding windows over images, and boxes in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _grid(images: DataFrame, size: int, stride: int) -> DataFrame:
    """Every (tx, ty) corner at multiples of ``stride`` inside the images (image, width, height)."""
    x = images.withColumn("tx", F.explode(F.sequence(F.lit(0), F.col("width").cast("int") - 1, F.lit(stride))))
    return x.withColumn("ty", F.explode(F.sequence(F.lit(0), F.col("height").cast("int") - 1, F.lit(stride))))


def tile_grid(images: DataFrame, tile: int = 640, stride: int = 640) -> DataFrame:
    """Tiles (image, tx, ty, tw, th); the last ones keep their true size, and are left out below half a tile."""
    g = _grid(images, tile, stride)
    g = g.withColumn("tw", F.least(F.lit(tile), F.col("width") - F.col("tx"))).withColumn("th", F.least(F.lit(tile), F.col("height") - F.col("ty")))
    return g.where((F.col("tw") >= tile // 2) & (F.col("th") >= tile // 2))


def sliding_windows(images: DataFrame, window: int = 512, overlap: float = 0.3) -> DataFrame:
    """Windows (image, tx, ty, tw, th) with the given overlap, cut at the image; none larger than its longer side."""
    stride = int(window * (1 - overlap))
    g = _grid(images.where(F.greatest("width", "height") >= window), window, stride)
    g = g.withColumn("tw", F.least(F.lit(window), F.col("width") - F.col("tx"))).withColumn("th", F.least(F.lit(window), F.col("height") - F.col("ty")))
    return g.where((F.col("tw") >= window // 2) & (F.col("th") >= window // 2))


def _cells(low, high, tile: int, stride: int):
    """Corners of all tiles of the grid that reach into [low, high)."""
    first = F.greatest(F.lit(0), F.floor((low - tile) / stride).cast("int") + 1)
    last = F.greatest(F.lit(0), F.ceil(high / stride).cast("int") - 1)
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))


def assign_boxes_to_tiles(boxes: DataFrame, tiles: DataFrame, tile: int = 640, stride: int = 640, drop_boundary: bool = True) -> DataFrame:
    """Boxes in tile coordinates: those whose centre lies in a tile, or with ``drop_boundary=False`` all that overlap it.

    Clipped to the tile, dropped below 2 pixels, and also given relative to the tile (xc, yc, w, h). Each box computes the corners of
    the tiles that it can be in, so the join is on equal keys.
    """
    if drop_boundary:
        cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
        b = boxes.withColumn("_cx", cx).withColumn("_cy", cy)
        point = lambda v: F.when(v >= 0, _cells(v, v + F.lit(1e-9), tile, stride))
        b = b.withColumn("tx", F.explode(point(F.col("_cx")))).withColumn("ty", F.explode(point(F.col("_cy"))))
        b = b.where((F.col("_cx") >= F.col("tx")) & (F.col("_cx") < F.col("tx") + tile) & (F.col("_cy") >= F.col("ty")) & (F.col("_cy") < F.col("ty") + tile)).drop("_cx", "_cy")
    else:
        b = boxes.withColumn("tx", F.explode(_cells(F.col("x1"), F.col("x2"), tile, stride))).withColumn("ty", F.explode(_cells(F.col("y1"), F.col("y2"), tile, stride)))
    j = b.join(tiles.select("image", "tx", "ty"), ["image", "tx", "ty"])
    clip = lambda c, o: F.least(F.greatest(F.col(c) - F.col(o), F.lit(0.0)), F.lit(float(tile)))
    j = j.withColumns({"x1": clip("x1", "tx"), "x2": clip("x2", "tx"), "y1": clip("y1", "ty"), "y2": clip("y2", "ty")})
    j = j.where((F.col("x2") - F.col("x1") >= 2) & (F.col("y2") - F.col("y1") >= 2))
    return j.withColumns({"xc": (F.col("x1") + F.col("x2")) / 2 / tile, "yc": (F.col("y1") + F.col("y2")) / 2 / tile, "w": (F.col("x2") - F.col("x1")) / tile, "h": (F.col("y2") - F.col("y1")) / tile})


def select_tiles(tiles: DataFrame, placed: DataFrame, min_objects: int = 1, negatives: bool = True, max_negatives: int = 10, split: str = "split") -> DataFrame:
    """Tiles with at least ``min_objects`` boxes, and in the train split at most ``max_negatives`` empty ones an image, in row order."""
    counts = placed.groupBy("image", "tx", "ty").agg(F.count("*").alias("n_objects"))
    t = tiles.join(counts, ["image", "tx", "ty"], "left").fillna(0, ["n_objects"])
    rank = F.row_number().over(Window.partitionBy("image", F.col("n_objects") >= min_objects).orderBy("ty", "tx"))
    t = t.withColumn("_rank", rank)
    empty = (F.col(split) == "train") & (F.col("_rank") <= max_negatives) if negatives else F.lit(False)
    return t.where((F.col("n_objects") >= min_objects) | empty).drop("_rank")


def windows_to_image(detections: DataFrame, windows: DataFrame) -> DataFrame:
    """Detections in window coordinates (image, window) moved to the image: offset + coordinate * downsample."""
    j = detections.join(windows.select("image", "window", "tx", "ty", "downsample"), ["image", "window"])
    move = lambda c, o: F.col(o) + F.col(c) * F.col("downsample")
    return j.withColumns({"x1": move("x1", "tx"), "x2": move("x2", "tx"), "y1": move("y1", "ty"), "y2": move("y2", "ty")}).drop("tx", "ty", "downsample")
