"""Keep a costly expression from being evaluated twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: list[str], **expressions: Column) -> DataFrame:
    """`columns` of `df` with `expressions` added or in their place.

    A filter on a projected expression is pushed below the projection, which then evaluates the expression
    a second time. A filter on the output of a generator stays above it.
    """
    values = F.struct(*[expression.alias(name) for name, expression in expressions.items()])
    kept = [c for c in columns if c not in expressions]
    return df.select(*kept, F.inline(F.array(values)))
