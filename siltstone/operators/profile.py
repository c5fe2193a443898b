"""Column profiles, key cardinality, checksums and constraint checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def analyse(df: DataFrame, max_elements: int = 256) -> DataFrame:
    """A row per column: extremes, lengths, empty or zero values, nulls, mean, deviation and a
    suggested type. One pass over the table for all columns; an enumeration is suggested for
    text of at most about ``max_elements`` values: distinct values are counted approximately."""
    kinds = dict(df.dtypes)
    aggregates = []
    for c in df.columns:
        numeric = kinds[c] in ("int", "bigint", "smallint", "tinyint", "double", "float") or kinds[c].startswith("decimal")
        text, empty = F.col(c).cast("string"), (F.col(c) == 0) if numeric else (F.col(c).cast("string") == "")
        aggregates.append(F.struct(
            F.lit(c).alias("field_name"), F.min(c).cast("string").alias("min_value"), F.max(c).cast("string").alias("max_value"),
            F.min(F.char_length(text)).alias("min_length"), F.max(F.char_length(text)).alias("max_length"),
            F.count_if(empty).alias("empties_or_zeros"), F.count_if(F.col(c).isNull()).alias("nulls"),
            (F.avg(c) if numeric else F.avg(F.char_length(text))).alias("avg_value_or_length"),
            (F.stddev_pop(c) if numeric else F.lit(None).cast("double")).alias("std"),
            F.approx_count_distinct(c).alias("distinct_values"), F.lit(kinds[c]).alias("kind")))
    rows = df.agg(F.array(*aggregates).alias("_r")).select(F.explode("_r").alias("r")).select("r.*")
    bare = F.when(F.col("kind") != "string", F.upper("kind")).when(
        F.col("distinct_values") <= max_elements, F.lit("ENUM")).otherwise(F.concat(F.lit("VARCHAR("), "max_length", F.lit(")")))
    return rows.withColumn("optimal_type", F.concat(bare, F.when(F.col("nulls") == 0, " NOT NULL").otherwise(""))).drop("kind")


def cardinality(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows per distinct value of each prefix of a key, rounded up to one. The whole key is grouped once, each shorter prefix from
    the groups of the one before, so that the table itself is shuffled once, as partial groups."""
    grouped = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    for i in reversed(range(len(key))):
        longer = [F.sum(f"d{j}").alias(f"d{j}") for j in range(i + 2, len(key) + 1)]
        grouped = grouped.groupBy(*key[:i]).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias(f"d{i + 1}"), *longer)
    rows = F.array(*[F.struct(F.lit(i).alias("key_parts"), F.lit(",".join(key[:i])).alias("prefix"),
                              F.greatest(F.lit(1.0), F.coalesce("n", F.lit(0)) / F.greatest(F.coalesce(f"d{i}", F.lit(0)), F.lit(1))).alias("rows_per_key"))
                     for i in range(1, len(key) + 1)])
    return grouped.select(F.explode(rows).alias("r")).select("r.*")


def checksum(df: DataFrame, how: str = "xxhash64") -> DataFrame:
    """One number for a table's rows in any order, and their count. ``how`` is ``xxhash64``, or ``md5``: 60 bits of the digest of a
    row's columns as text with a bar between them, nulls as empty, which any engine can work out."""
    if how == "md5":
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
        one = F.conv(F.left(F.md5(text), F.lit(15)), 16, 10).cast("long")
    else:
        one = F.xxhash64(*df.columns)
    return df.agg(F.coalesce(F.bit_xor(one), F.lit(0)).alias("checksum"), F.count(F.lit(1)).alias("rows"))


def unique_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Values of a key that more than one row has; nulls don't collide."""
    there = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    return df.where(there).groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def foreign_violations(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")).distinct(), child[key] == F.col("_p"), "left_anti")


def first_per_group(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """The first row of each group, as the dialect's users get it from a sorted derived table."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
