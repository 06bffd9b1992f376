"""Keep costly columns from being computed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, whatever reads them later.

    The optimizer copies a column's expression into every filter on it. Columns
    that come out of a generated row are references and stay so.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.explode(F.array(row)).alias("_row")).select(*df.columns, "_row.*")
