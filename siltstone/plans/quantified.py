"""Comparisons with ANY and ALL of a subquery.

Ordering comparisons look at the subquery's extremes: one row, whatever its size, so that
nothing is joined row by row. Nulls in the subquery are ignored by ordering comparisons; with
``<>`` ALL and ``=`` ANY they have their usual effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ORDER = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _extremes(sub: DataFrame, column: str) -> DataFrame:
    return F.broadcast(sub.agg(F.min(column).alias("_low"), F.max(column).alias("_high"), F.count(column).alias("_some"), F.count(F.lit(1)).alias("_rows")))


def where_all(df: DataFrame, column: str, op: str, sub: DataFrame, sub_column: str) -> DataFrame:
    """Rows of ``df`` whose value compares so with all values of the subquery; all rows if it has none."""
    if op == "<>":
        values = sub.select(F.col(sub_column).alias("_v"))
        state = F.broadcast(values.agg(F.count(F.lit(1)).alias("_rows"), F.count("_v").alias("_some")))
        left = df.crossJoin(state).where("_rows = 0 or _rows = _some")  # one row of counts on the right
        left = left.where(F.col(column).isNotNull() | (F.col("_rows") == 0))
        return left.join(values, left[column] == values["_v"], "left_anti").select(*df.columns)
    one = df.crossJoin(_extremes(sub, sub_column))  # one row of extremes on the right
    if op == "=":
        keep = (F.col("_rows") == 0) | ((F.col("_rows") == F.col("_some")) & (F.col("_low") == F.col("_high")) & (F.col(column) == F.col("_low")))
    else:
        keep = (F.col("_rows") == 0) | _ORDER[op](F.col(column), F.col("_high" if ">" in op else "_low"))
    return one.where(keep).select(*df.columns)


def where_any(df: DataFrame, column: str, op: str, sub: DataFrame, sub_column: str) -> DataFrame:
    """Rows of ``df`` whose value compares so with some value of the subquery."""
    if op == "=":
        values = sub.select(F.col(sub_column).alias("_v")).distinct()
        return df.join(values, df[column] == values["_v"], "left_semi")
    one = df.crossJoin(_extremes(sub, sub_column))
    if op == "<>":
        return one.where((F.col("_some") > 0) & ((F.col(column) != F.col("_low")) | (F.col(column) != F.col("_high")))).select(*df.columns)
    return one.where((F.col("_some") > 0) & _ORDER[op](F.col(column), F.col("_low" if ">" in op else "_high"))).select(*df.columns)
