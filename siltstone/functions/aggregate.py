"""Aggregate functions with the dialect's meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalar import unsigned


def group_concat(x: Column, order: list[Column] | None = None, sep: str = ",", max_len: int = 1024, distinct: bool = False) -> Column:
    """The values of a group, joined and cut at ``max_len`` characters; nulls are left out. In
    the order of ``order``, or of the values, so that the result is the same each time."""
    text = x.cast("string")
    if distinct:
        joined = F.array_join(F.array_sort(F.collect_set(text)), sep)
    else:
        pairs = F.collect_list(F.when(text.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order or [text])], text.alias("v"))))
        joined = F.array_join(F.transform(F.array_sort(pairs), lambda s: s["v"]), sep)
    return F.when(F.count(x) > 0, F.left(joined, F.lit(max_len)))


def group_concat_rows(df: DataFrame, group: list[str], x: Column, order: list[Column] | None = None, sep: str = ",",
                      max_len: int = 1024, distinct: bool = False, out: str = "joined") -> DataFrame:
    """``group_concat`` of groups of any size: a row per group, with its joined values in ``out``.

    Every value after the first adds at least a separator, so no more than ``max_len`` of them
    can show: the rest of a group goes before the group is gathered, and before the shuffle
    where Spark limits the window's groups there. Distinct values come in their own order.
    """
    rows = df.select(*group, x.cast("string").alias("_v"), *[o.alias(f"_o{i}") for i, o in enumerate([] if distinct else order or [])])
    if distinct:
        rows = rows.distinct()
    value, keys = F.col("_v"), [F.col(c) for c in rows.columns if c.startswith("_o")]
    last = value.isNull() if sep else value.isNull() | (value == "")  # what adds nothing stands behind what does
    w = Window.partitionBy(*group).orderBy(last.cast("int"), *keys, value)
    most = -(-max_len // max(1, len(sep))) + 1
    kept = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return kept.groupBy(*group).agg(group_concat(value, [F.col("_n")], sep, max_len).alias(out))


def sum_exact(x: Column) -> Column:
    return F.sum(x.cast("decimal(28,0)"))


def avg_exact(x: Column) -> Column:
    """The mean of whole numbers with four decimals."""
    return F.round(F.avg(x.cast("decimal(28,0)")), 4).cast("decimal(28,4)")


def bit_and(x: Column) -> Column:
    """All ones over no rows."""
    return unsigned(F.coalesce(F.bit_and(x.cast("long")), F.lit(-1).cast("long")))


def bit_or(x: Column) -> Column:
    return unsigned(F.coalesce(F.bit_or(x.cast("long")), F.lit(0).cast("long")))


def bit_xor(x: Column) -> Column:
    return unsigned(F.coalesce(F.bit_xor(x.cast("long")), F.lit(0).cast("long")))


def count_distinct(*xs: Column) -> Column:
    """Distinct tuples without a null."""
    return F.count_distinct(*xs)
