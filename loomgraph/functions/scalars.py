"""The loaders' and retrieval's scalar functions, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The day that day numbers count from (fixed value).
DAY_ZERO = "2019-01-01"


def day_number(date: Column, zero: str = DAY_ZERO) -> Column:
    return F.datediff(F.to_date(date), F.to_date(F.lit(zero)))


def part_key(path: Column) -> Column:
    """Rank and number of a file ``part_<rank>_<number>.<ending>``; null for other names."""
    number = lambda k: F.nullif(F.regexp_extract(path, "part_([0-9]+)_([0-9]+)[.][A-Za-z]+$", k), F.lit("")).cast("long")
    return F.struct(number(1).alias("rank"), number(2).alias("number"))


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), "\\s+"), lambda w: w != "")


def first_item(values: Column) -> Column:
    return F.get(values, F.lit(0))


def joined_texts(df: DataFrame, by: Sequence[str], text: str, order: Sequence[str], between: str = " ", name: str = "context") -> DataFrame:
    """For each group ``by``, its texts in ``order`` as one; a null text is empty.

    Equal order is decided by the text, so the result is the same each time.
    """
    parts = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("_text"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(parts, lambda s: s["_text"]), between).alias(name))


def prompt(question: Column, context: Column) -> Column:
    return F.format_string("Question: Given the information below, %s\n%s\nAnswer:", question, F.coalesce(context, F.lit("")))
