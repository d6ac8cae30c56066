"""Results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import mean_of_word_vectors


def csv_lines(df: DataFrame) -> DataFrame:
    """One column ``value``: each row as a line of CSV."""
    return df.select(F.to_csv(F.struct(*df.columns)).alias("value"))


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text_vectors(texts: DataFrame, text: str, id_col: str, words: DataFrame, path: str) -> None:
    """The vectors of all texts as Parquet part files of ``id, vec``; a vector is the mean of its text's known words (``words``: word, vec)."""
    mean_of_word_vectors(texts, text, id_col, words).write.mode("overwrite").parquet(path)


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    (df.repartition(by) if by else df).write.mode("overwrite").parquet(path)
