"""Keeping a strict reader strict."""

from pyspark.sql import DataFrame, functions as F


def read_every_column(df: DataFrame) -> DataFrame:
    """The same rows, by a plan that needs every column of each.

    A strict reader raises for malformed fields, but only in columns that the plan reads, and a count
    reads none. The condition holds for any row; that it does is beyond the optimizer.
    """
    return df.filter(F.xxhash64(*df.columns) % 2 < 2)
