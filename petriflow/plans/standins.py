"""Views of the given tables as boxes, scores, vectors, audit events, clients and parameters, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def round3(c: Column) -> Column:
    """To 3 decimals as SQL's round does it, by the double and not by its shortest decimal form: 0.5005, which is less than that, becomes 0.5."""
    return F.round(c * 1000) / 1000


def boxes(spark: SparkSession, sf_dir: str, together: int = 0) -> DataFrame:
    """(image, idx, role, rater, x1, y1, x2, y2, score, cls, circularity, solidity, aspect_ratio): about 120 boxes an image on a 10 x 10 grid.

    role R and A are two models' detections, N is ground truth. idx numbers the boxes of an image. With ``together``, so many images in a row have one number g,
    and lie in one partition.
    """
    key = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    t = table(spark, sf_dir, "lineitem").select(*key, "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    t = t.withColumn("image", F.floor(F.col("l_orderkey") / 30).cast("long"))
    group = ["g"] if together else []
    if together:
        t = t.withColumn("g", F.floor(F.col("image") / together)).repartition("g")
    # The given columns are sorted, fewer than those made of them.
    t = t.withColumn("idx", F.row_number().over(Window.partitionBy(*group, "image").orderBy(*key)).cast("long"))
    slot = F.col("l_partkey") % 100
    t = t.select(
        *group,
        "image",
        "idx",
        F.col("l_returnflag").alias("role"),
        F.col("l_linestatus").alias("rater"),
        (100 * (slot % 10) + F.col("l_suppkey") % 37).cast("double").alias("x1"),
        (100 * F.floor(slot / 10) + F.col("l_partkey") % 31).cast("double").alias("y1"),
        (60 + F.col("l_quantity")).cast("double").alias("w"),
        (60 + 5 * F.col("l_linenumber")).cast("double").alias("h"),
        (F.col("l_extendedprice") / 105000).alias("score"),
        (F.col("l_suppkey") % 3).cast("int").alias("cls"),
        (F.col("l_discount") * 8).alias("circularity"),
        (F.col("l_tax") * 12).alias("solidity"),
    )
    return t.select(*group, "image", "idx", "role", "rater", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"), "score", "cls", "circularity", "solidity", (F.least("w", "h") / F.greatest("w", "h")).alias("aspect_ratio"))


BOXES = """
boxes AS (SELECT image, idx, role, rater, x1, y1, x1 + w AS x2, y1 + h AS y2, score, cls, circularity, solidity, least(w, h) / greatest(w, h) AS aspect_ratio FROM (
  SELECT (l_orderkey // 30)::BIGINT AS image, l_returnflag AS role, l_linestatus AS rater, (100 * ((l_partkey % 100) % 10) + l_suppkey % 37)::DOUBLE AS x1,
    (100 * ((l_partkey % 100) // 10) + l_partkey % 31)::DOUBLE AS y1, (60 + l_quantity)::DOUBLE AS w, (60 + 5 * l_linenumber)::DOUBLE AS h, l_extendedprice / 105000 AS score, (l_suppkey % 3)::INT AS cls,
    l_discount * 8 AS circularity, l_tax * 12 AS solidity,
    row_number() OVER (PARTITION BY l_orderkey // 30 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS idx FROM lineitem))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, grp, label, score, conf, pos): labelled scores in seven groups, with ties."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        (F.col("l_suppkey") % 7).cast("int").alias("grp"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        round3(F.col("l_extendedprice") / 105000).alias("score"),
        (F.col("l_quantity") / 50).alias("conf"),
        F.col("l_discount").alias("area"),
        F.col("l_tax").alias("perimeter"),
    )


SCORES = """
scores AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, (l_suppkey % 7)::INT AS grp, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  round(l_extendedprice / 105000, 3) AS score, l_quantity / 50 AS conf, l_discount AS area, l_tax AS perimeter FROM lineitem)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, client, label, cls, values): seven clients, labels 0 and 1."""
    t = table(spark, sf_dir, "embeddings")
    return t.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 7).cast("int").alias("client"), (F.col("label") < 5).cast("int").alias("label"), F.col("label").cast("int").alias("cls"), F.col("embedding").cast("array<double>").alias("values"))


VECTORS = """
vectors AS (SELECT vec_id AS id, (vec_id % 7)::INT AS client, (label < 5)::INT AS label, label::INT AS cls, embedding::DOUBLE[] AS values FROM embeddings)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain_id, index, ts, operation, details): one audit chain for each user."""
    t = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.select(F.col("user_id").cast("string").alias("chain_id"), F.row_number().over(order).cast("long").alias("index"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.col("event_type").alias("operation"), F.col("props").alias("details"))


EVENTS = """
ev AS (SELECT user_id::VARCHAR AS chain_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS index, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, event_type AS operation, props AS details FROM events)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cls): rows to be dealt to clients."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_mktsegment").alias("cls"))


MEMBERS = """
members AS (SELECT c_custkey::BIGINT AS id, c_mktsegment AS cls FROM customer)"""


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(exp, round, client, param, pos, value, is_int): five rounds of six clients' parameters."""
    t = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5).alias("round"), (F.col("l_suppkey") % 6).alias("client"), (F.col("l_partkey") % 40).alias("pos"), F.col("l_quantity").alias("q"))
    base = t.groupBy("round", "client", "pos").agg(F.sum("q").alias("value"))
    return base.select(F.lit("e").alias("exp"), F.col("round").cast("int").alias("round"), F.concat(F.lit("c"), F.col("client").cast("string")).alias("client"), F.when(F.col("pos") < 30, "layer.weight").otherwise("layer.steps").alias("param"), F.col("pos").cast("int").alias("pos"), F.col("value").cast("double").alias("value"), (F.col("pos") >= 30).alias("is_int"))


PARAMS = """
params AS (SELECT 'e' AS exp, round::INT AS round, 'c' || client::VARCHAR AS client, CASE WHEN pos < 30 THEN 'layer.weight' ELSE 'layer.steps' END AS param, pos::INT AS pos, value::DOUBLE AS value, pos >= 30 AS is_int
  FROM (SELECT l_orderkey % 5 AS round, l_suppkey % 6 AS client, l_partkey % 40 AS pos, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3))"""


def client_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(exp, round, client, n_samples, map50): sizes and quality of each client's update."""
    t = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 5).cast("int").alias("round"), (F.col("l_suppkey") % 6).cast("string").alias("c"))
    out = t.agg(F.count("*").alias("n_samples"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("hits"))
    return out.select(F.lit("e").alias("exp"), "round", F.concat(F.lit("c"), "c").alias("client"), "n_samples", (F.col("hits") / F.col("n_samples")).alias("map50"))


CLIENT_STATS = """
client_stats AS (SELECT 'e' AS exp, (l_orderkey % 5)::INT AS round, 'c' || (l_suppkey % 6)::VARCHAR AS client, count(*) AS n_samples, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*) AS map50 FROM lineitem GROUP BY l_orderkey % 5, l_suppkey % 6)"""


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(exp, round, map50, map, train_loss, val_loss): a history of rounds per experiment, by ship month and supplier."""
    t = table(spark, sf_dir, "lineitem")
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int")
    g = t.groupBy(F.concat(F.lit("x"), (F.col("l_suppkey") % 4).cast("string")).alias("exp"), month.alias("m")).agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.avg("l_quantity").alias("q"))
    order = Window.partitionBy("exp").orderBy("m")
    return g.select("exp", F.row_number().over(order).alias("round"), F.round(F.col("d") * 10, 9).alias("map50"), F.round(F.col("t") * 10, 9).alias("map"), F.round(F.col("q") / 10, 9).alias("val_loss"), F.round(F.col("q") / 9 + F.col("d"), 9).alias("train_loss"))


ROUNDS = """
rounds AS (SELECT exp, row_number() OVER (PARTITION BY exp ORDER BY m)::INT AS round, round(d * 10, 9) AS map50, round(t * 10, 9) AS map, round(q / 10, 9) AS val_loss, round(q / 9 + d, 9) AS train_loss
  FROM (SELECT 'x' || (l_suppkey % 4)::VARCHAR AS exp, (year(l_shipdate) * 12 + month(l_shipdate))::INT AS m, avg(l_discount) AS d, avg(l_tax) AS t, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2))"""
