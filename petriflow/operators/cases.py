"""Case records: profiles as vectors, reports over similar cases, recommendations, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petriflow.operators.vectors import knn_cosine

# The least and largest value of each profile feature, and the class shares of a record without any.
RANGES: dict[str, tuple[float, float]] = {
    "area": (100, 50000),
    "perimeter": (50, 2000),
    "circularity": (0.0, 1.0),
    "solidity": (0.5, 1.0),
    "aspect_ratio": (0.3, 5.0),
    "eccentricity": (0.0, 1.0),
    "n_organoids": (1, 20),
    "avg_area": (100, 30000),
    "std_area": (0, 15000),
}
SHARES = (0.33, 0.33, 0.34)


def encode_profile(df: DataFrame, dim: int = 12, shares: str = "class_distribution", into: str = "values") -> DataFrame:
    """``df`` with its profile vector: nine features scaled to [0, 1] (a missing one counts as 0 before scaling), then three class shares; padded or cut to ``dim``."""
    parts = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - lo) / (hi - lo))) for f, (lo, hi) in RANGES.items()]
    share = F.coalesce(F.col(shares).cast("array<double>"), F.array(*(F.lit(s) for s in SHARES)))
    whole = F.concat(F.array(*parts), F.slice(share, 1, 3))
    padded = F.concat(whole, F.array_repeat(F.lit(0.0), max(0, dim)))
    return df.withColumn(into, F.slice(padded, 1, dim))


def decode_profile(df: DataFrame, values: str = "values") -> DataFrame:
    """The features of a profile vector, and its class shares made to sum to 1."""
    made = {f: F.coalesce(F.get(values, F.lit(i)), F.lit(0.0)) * (hi - lo) + lo for i, (f, (lo, hi)) in enumerate(RANGES.items())}
    tail = F.slice(values, len(RANGES) + 1, 3)
    total = F.aggregate(tail, F.lit(0.0), lambda s, x: s + x)
    return df.withColumns(made).withColumn("class_distribution", F.when(total > 0, F.transform(tail, lambda x: x / total)).otherwise(F.array(*(F.lit(s) for s in SHARES))))


def case_report(queries: DataFrame, cases: DataFrame, k: int = 5, min_similarity: float | None = None) -> DataFrame:
    """(query_id, status, n_cases, n_hospitals, diagnosis, vote_share, mean_confidence, case_ids, breakdown): a similarity-weighted vote of the nearest cases; ties go to
    the diagnosis of the nearest case. breakdown: each diagnosis among them with its number of cases and its weight, the heaviest
    first. A query without similar cases has status no_similar_cases."""
    near = knn_cosine(queries.select(F.col("id"), "values"), cases.select("id", "values"), k, min_similarity)
    j = near.join(cases.select("id", "hospital_id", "diagnosis", "confidence"), "id")
    votes = j.groupBy("query_id", "diagnosis").agg(F.sum("similarity").alias("w"), F.min("rank").alias("first"))
    total = F.sum("w").over(Window.partitionBy("query_id"))
    best = votes.withColumn("share", F.col("w") / total).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("w", 12)), "first"))).where("n = 1")
    facts = j.groupBy("query_id").agg(F.count("*").alias("n_cases"), F.countDistinct("hospital_id").alias("n_hospitals"), F.round(F.avg("confidence"), 3).alias("mean_confidence"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda s: s.id).alias("case_ids"))
    heavy = diagnosis_breakdown(near, cases).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("weight"), "diagnosis", "n")), asc=False), lambda s: F.struct(s.diagnosis.alias("diagnosis"), s.n.alias("n"), F.round(s.weight, 9).alias("weight"))).alias("breakdown"))
    facts = facts.join(heavy, "query_id")
    out = queries.select(F.col("id").alias("query_id")).join(facts, "query_id", "left").join(best.select("query_id", "diagnosis", F.round("share", 3).alias("vote_share")), "query_id", "left")
    return out.select("query_id", F.when(F.col("n_cases").isNull(), "no_similar_cases").otherwise("ok").alias("status"), F.coalesce("n_cases", F.lit(0)).alias("n_cases"), F.coalesce("n_hospitals", F.lit(0)).alias("n_hospitals"), "diagnosis", "vote_share", "mean_confidence", "case_ids", "breakdown")


def diagnosis_breakdown(near: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, diagnosis, n, weight) over the neighbours of each query."""
    return near.join(cases.select("id", "diagnosis"), "id").groupBy("query_id", "diagnosis").agg(F.count("*").alias("n"), F.sum("similarity").alias("weight"))


def recommendations(df: DataFrame, diagnosis: str = "diagnosis", reports: str | None = None) -> DataFrame:
    """``df`` with recommendations: a line for the diagnosis, and one for each measure out of line with it; the number of reports of similar cases, at most
    three, comes last. Missing measures count as circularity .5, eccentricity 0, solidity .8 and one organoid."""
    has = lambda c, default: F.coalesce(F.col(c).cast("double"), F.lit(default)) if c in df.columns else F.lit(default)
    late, early = F.col(diagnosis) == "late_stage", F.col(diagnosis) == "early_stage"
    lines = [
        F.when(late, "Late stage: test for drug response.").when(early, "Early stage: keep the culture as it is.").otherwise("Healthy: fit for further assays."),
        F.when(late & (has("eccentricity", 0.0) > 0.6), "Elongated outlines: follow growth closely."),
        F.when(early & (has("circularity", 0.5) < 0.5), "Irregular outlines: look for early stress."),
        F.when(has("solidity", 0.8) < 0.7, "Hollow outlines: look for budding or fragments."),
        F.when(has("n_organoids", 1.0) > 10, "Many organoids: check the seeding density."),
    ]
    if reports:
        n = F.least(F.lit(3), F.size(F.coalesce(F.col(reports), F.array().cast("array<string>"))))
        lines.append(F.when(n > 0, F.concat(F.lit("Reports of similar cases: "), n.cast("string"))))
    return df.withColumn("recommendations", F.filter(F.array(*lines), lambda x: x.isNotNull()))


def anonymize_id(c: str | Column) -> Column:
    """The first 16 hex digits of the id's SHA-256."""
    return F.substring(F.sha2(F.col(c) if isinstance(c, str) else c, 256), 1, 16)


def case_stats(cases: DataFrame) -> DataFrame:
    """Counts by hospital, by diagnosis and in total (nulls mark what is summed over)."""
    return cases.groupingSets([["hospital_id"], ["diagnosis"], []], "hospital_id", "diagnosis").agg(F.count("*").alias("n"))
