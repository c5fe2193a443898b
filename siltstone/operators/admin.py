"""Table maintenance: statistics, checks, compaction, repair, counts of key ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.versioned import read_table, replace_table


def analyze(spark: SparkSession, name: str) -> DataFrame:
    """ANALYZE TABLE: statistics of a catalogued table and its columns for the optimizer, and
    the size that it works with afterwards."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    return spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Statistics'").select(F.lit(name).alias("table"), F.col("data_type").alias("statistics"))


def check(df: DataFrame) -> DataFrame:
    """CHECK TABLE: reads every value, and gives a row per file with its rows and their checksum.
    A file that can't be read fails the query."""
    marked = df.select(F.col("_metadata.file_path").alias("file"), F.xxhash64(*df.columns).alias("_h"))
    return marked.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("_h").alias("checksum"))


def optimize(spark: SparkSession, path: str, key: list[str] | None = None) -> None:
    """OPTIMIZE TABLE: rewrites a table in files of the session's advisory partition size; with
    a key, in its order, so that the files' statistics prune by it. ``read_table`` reads the result."""
    df = read_table(spark, path)
    replace_table(df.repartitionByRange(*key).sortWithinPartitions(*key) if key else df.hint("rebalance"), path)


def fragments(df: DataFrame) -> DataFrame:
    """A scan with the row count of each fragment of a table: its files, with their places. Counts come from the files' footers."""
    return df.select(F.col("_metadata.file_path").alias("fragment")).groupBy("fragment").agg(F.count(F.lit(1)).alias("rows"))


def create_index(df: DataFrame, path: str, key: list[str], include: list[str] = ()) -> None:
    """ALTER TABLE .. ADD [CLUSTERING] INDEX: a copy of the key's columns and the ones included, in the order of the key. Files' and
    row groups' statistics then find a range of keys without the rest."""
    columns = list(dict.fromkeys([*key, *include]))
    df.select(*columns).repartitionByRange(*key).sortWithinPartitions(*key).write.parquet(path)


def repair(spark: SparkSession, path: str, schema: T.StructType, to: str) -> None:
    """REPAIR TABLE: writes what can be read of a table with broken files to a new path. The table itself stays as it is."""
    spark.read.option("ignoreCorruptFiles", "true").schema(schema).parquet(path).write.parquet(to)


def records_in_range(df: DataFrame, key: str, ranges: list[tuple]) -> DataFrame:
    """Rows with a key in each of some ranges (both ends included, None is open), in one pass.
    Only files whose statistics meet a range are read."""
    def inside(low, high):
        test = F.col(key).isNotNull()
        test = test & (F.col(key) >= low) if low is not None else test
        return test & (F.col(key) <= high) if high is not None else test

    tests = [inside(*r) for r in ranges]
    some = tests[0]
    for t in tests[1:]:
        some = some | t
    one = df.where(some).agg(*[F.count_if(t).alias(f"n{i}") for i, t in enumerate(tests)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("range_no"), F.col(f"n{i}").alias("records")) for i in range(len(tests))])).alias("r")).select("r.*")
