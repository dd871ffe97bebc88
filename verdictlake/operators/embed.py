"""Embedding centroids and their angles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Clipped to [-1, 1]; null for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(norm, F.lit(0.0))))


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Unit-length mean vector of each group.  Means combine by dimension before the shuffle; no group is gathered."""
    each = rows.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    length = F.sqrt(dot(F.col("mean"), F.col("mean")))
    return mean.select(group, F.transform("mean", lambda x: x / F.when(length == 0, 1.0).otherwise(length)).alias("centroid"))


def centroid_cosines(c: DataFrame, group: str) -> DataFrame:
    """Cosine of every two groups' centroids; there is one centroid for each group."""
    a, b = c.select(F.col(group).alias("left"), F.col("centroid").alias("l")), c.select(F.col(group).alias("right"), F.col("centroid").alias("r"))
    return a.join(b, F.col("left") < F.col("right")).select("left", "right", cosine(F.col("l"), F.col("r")).alias("cosine"))


def direction(c: DataFrame, group: str, toward, away) -> DataFrame:
    """Difference of two centroids."""
    pick = lambda v, n: c.filter(F.col(group) == v).select(F.col("centroid").alias(n))
    return pick(toward, "t").crossJoin(pick(away, "a")).select(F.zip_with("t", "a", lambda x, y: x - y).alias("direction"))


def paired_mean_cosine(rows: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Mean cosine over rows that hold both sides' vectors."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(cosine(F.col(left), F.col(right))).alias("mean_cosine"))
