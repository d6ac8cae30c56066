"""Vector arithmetic on array columns, in double precision and inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "l2")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def score(a: Column, b: Column, metric: str) -> Column:
    """Larger is nearer: ``l2`` is minus the distance."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    return -l2(a, b) if metric == "l2" else dot(a, b) if metric == "dot" else cosine(a, b)


def constant(vector: Sequence[float]) -> Column:
    """One literal that folds to the array; a literal an element takes long to build."""
    if not len(vector):
        return F.array().cast("array<double>")
    return F.split(F.lit(",".join(repr(float(x)) for x in vector)), ",").cast("array<double>")


def mean_vector(df: DataFrame, column: str, name: str = "vec") -> DataFrame:
    """One row: the mean of all vectors, element by element.  No vectors: a null."""
    by_place = df.select(F.posexplode(column).alias("place", "x")).groupBy("place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    places = F.array_sort(F.collect_list(F.struct("place", "x")))
    return by_place.agg(F.when(F.count(F.lit(1)) > 0, F.transform(places, lambda s: s["x"])).alias(name))


def mean_of_word_vectors(df: DataFrame, text: str, id_col: str, words: DataFrame) -> DataFrame:
    """``id, vec``: the mean vector of each text's known words (``words``: word, vec); zeros where none is known."""
    tokens = df.select(F.col(id_col).alias("id"), F.explode_outer(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), "\\s+")).alias("word"))
    known = tokens.join(words, "word").select("id", F.posexplode("vec").alias("place", "x"))
    means = known.groupBy("id", "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = means.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("vec"))
    size = words.select(F.size("vec").alias("n")).limit(1)
    ids = df.select(F.col(id_col).alias("id")).distinct()
    return ids.join(vectors, "id", "left").join(F.broadcast(size)).select("id", F.coalesce("vec", F.array_repeat(F.lit(0.0), F.col("n"))).alias("vec"))
