"""Comparisons of a property with a value, or of two saved values."""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class P:
    """A comparison.  A missing (null) property satisfies none, ``neq`` included."""

    name: str
    value: Any

    def __call__(self, column: Column) -> Column:
        return self.against(column, F.lit(self.value) if self.name != "within" else None)

    def against(self, column: Column, other: Column | None) -> Column:
        if self.name == "within":
            return column.isin(*self.value)
        return _COMPARE[self.name](column, other)

    def __str__(self) -> str:
        return f"{self.name}({self.value!r})"

    @staticmethod
    def eq(value: Any) -> P:
        return P("eq", value)

    @staticmethod
    def neq(value: Any) -> P:
        return P("neq", value)

    @staticmethod
    def lt(value: Any) -> P:
        return P("lt", value)

    @staticmethod
    def lte(value: Any) -> P:
        return P("lte", value)

    @staticmethod
    def gt(value: Any) -> P:
        return P("gt", value)

    @staticmethod
    def gte(value: Any) -> P:
        return P("gte", value)

    @staticmethod
    def within(*values: Any) -> P:
        return P("within", tuple(values))


_COMPARE: dict[str, Callable] = {"eq": operator.eq, "neq": operator.ne, "lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}
