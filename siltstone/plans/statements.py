"""Statements with results on the side: found rows, running variables, prepared text, limits on plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


@dataclass
class Found:
    rows: DataFrame
    found_rows: int


def calc_found_rows(df: DataFrame, limit: int, offset: int = 0) -> Found:
    """The rows of a limit, and how many there were without it. The count is a job of its own,
    from which Spark prunes all columns that the count doesn't need."""
    if limit < 0 or offset < 0:
        raise ValueError("a limit is not negative")
    return Found(df.offset(offset).limit(limit), df.count())


def prepare(spark: SparkSession, text: str):
    """A statement with ``?`` in the places of values; call it with the values."""
    return lambda *values: spark.sql(text, args=list(values))


def running(df: DataFrame, partition: list[str], order: list[Column], **columns: Column) -> DataFrame:
    """What ``@v := @v + expr`` adds up row by row, per group: a sum from the group's first row on.
    Without groups, the whole table is added up by many tasks (see ``running_spread``)."""
    if not partition:
        return running_spread(df, partition, order, **columns)
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for name, value in columns.items():
        df = df.withColumn(name, F.sum(value).over(w))
    return df


def running_spread(df: DataFrame, partition: list[str], order: list[Column], **columns: Column) -> DataFrame:
    """``running`` for groups of any size: no task holds a group. Rows are dealt into ranges of
    group and order, summed up inside their range, and raised by the sums of the group's lower
    ranges, of which there are as many as groups and tasks together. Nulls add nothing.

    The ranges are written down, in the folder the cluster shares, before they are used twice:
    they are drawn from a sample, and a task that ran again could draw others.
    """
    names, sums = df.columns, list(columns)
    keyed = df.select(*names, *[v.alias(f"_v{i}") for i, v in enumerate(columns.values())])
    ranges = keyed.repartitionByRange(*partition, *order).withColumn("_b", F.spark_partition_id())
    dealt = stored(ranges, "running").withColumn("_g", F.struct(*partition, F.lit(0)))  # no null, even where its fields are
    inside = Window.partitionBy("_g", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    lower = Window.partitionBy("_bg").orderBy("_bb").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(F.col("_g").alias("_bg"), F.col("_b").alias("_bb")).agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))])
    before = totals.select("_bg", "_bb", *[F.sum(f"_t{i}").over(lower).alias(f"_l{i}") for i in range(len(sums))])
    part = dealt.select("*", *[F.sum(f"_v{i}").over(inside).alias(f"_s{i}") for i in range(len(sums))])
    both = part.join(before, (F.col("_g") == F.col("_bg")) & (F.col("_b") == F.col("_bb")))
    added = [F.coalesce(F.col(f"_s{i}") + F.col(f"_l{i}"), f"_s{i}", f"_l{i}").alias(n) for i, n in enumerate(sums)]
    return both.select(*[n for n in names if n not in sums], *added)


def digest(text: str) -> str:
    """A statement without its values: literals become ``?``, lists of them one, blanks single, words in capitals."""
    import re

    text = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", "?", text)
    text = re.sub(r"\b\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\b|\b0x[0-9a-fA-F]+\b", "?", text)
    text = re.sub(r"\(\s*\?(?:\s*,\s*\?)+\s*\)", "(?)", text)
    return re.sub(r"\s+", " ", text).strip().rstrip(";").upper()


def statement_statistics(log: DataFrame) -> DataFrame:
    """Per digest of a log of statements (digest, seconds, rows): counts, sums and extremes."""
    return log.groupBy("digest").agg(
        F.count(F.lit(1)).alias("statements"), F.sum("seconds").alias("sum_seconds"), F.max("seconds").alias("max_seconds"),
        F.min("seconds").alias("min_seconds"), F.sum("rows").alias("sum_rows"))


def table_statistics(log: DataFrame) -> DataFrame:
    """Per table of a log (table, command): how many of each command."""
    return log.groupBy("table").pivot("command", ["select", "insert", "update", "delete"]).count().na.fill(0)


def wait_summary(waits: DataFrame, *by: str) -> DataFrame:
    """Count, sum and extremes of a table of waits, per event, thread or instance."""
    return waits.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("wait").alias("sum_wait"), F.min("wait").alias("min_wait"),
                                  F.max("wait").alias("max_wait"), F.avg("wait").alias("avg_wait"))


def check_join_size(df: DataFrame, most: int) -> DataFrame:
    """The DataFrame, unless Spark expects it to read more than ``most`` bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > most:
        raise ValueError(f"the plan reads about {size} bytes, more than {most}")
    return df


def io_statistics(df: DataFrame) -> dict[str, int]:
    """Run a query, keep nothing, and tell what it read: files, bytes of them, and rows."""
    plan = df._jdf.queryExecution()
    plan.toRdd().count()
    out = {"files": 0, "bytes": 0, "rows": 0}
    names = {"files": "numFiles", "bytes": "filesSize", "rows": "numOutputRows"}
    todo = [plan.executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if kind in ("FileSourceScanExec", "BatchScanExec"):
            for name, metric in names.items():
                found = node.metrics().get(metric)
                out[name] += found.get().value() if found.isDefined() else 0
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out
