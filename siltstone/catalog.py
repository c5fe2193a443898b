"""Tables of a folder of Parquet files as DataFrames and as views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """Run a statement over the tables of a folder. The tables that it names become views; a
    DataFrame keeps the tables it was made with when the views are put over another folder."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, folder, name).createOrReplaceTempView(name)
    return spark.sql(text)
