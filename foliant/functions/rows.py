"""Arrays to rows. The plain generators make Catalyst filter on the size of the array first, and so compute whatever the array
is made of twice; the outer ones do not, and the row that they give for an empty array is dropped afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame, items: Column, number: str, item: str, *keep: str) -> DataFrame:
    """One row per item: the columns kept, its number from 1, and the item."""
    found = df.select(*keep, F.posexplode_outer(items).alias("_n", item)).filter("_n IS NOT NULL")
    return found.select(*keep, (F.col("_n") + 1).alias(number), item)


def spread(df: DataFrame, structs: Column, *keep: str) -> DataFrame:
    """One row per struct: the columns kept and the struct's fields."""
    found = df.select(*keep, F.explode_outer(structs).alias("_row")).filter("_row IS NOT NULL")
    return found.select(*keep, "_row.*")
