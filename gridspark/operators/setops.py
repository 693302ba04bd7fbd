"""Set comparisons per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same_set(found: DataFrame, by: list[str], name: str, required: list[str]) -> DataFrame:
    """(by, same): whether the names of each group are exactly the required ones."""
    names = F.col(name)
    has = [F.bool_or(names == r) for r in required]
    whole = F.bool_and(names.isin(required))
    for h in has:
        whole = whole & h
    return found.groupBy(*by).agg(whole.alias("same"))
