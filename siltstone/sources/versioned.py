"""Tables that are replaced whole or in parts, with no moment at which there is none.

A table is a folder. ``_manifest-<n>`` names the data folders that make its n-th version; the
highest number counts. A manifest is written beside its place and renamed into it, which fails where
that number is taken: of two writers one has to start again, and a writer that dies leaves the
version before. Data folders are never changed. A folder without a manifest is a plain Parquet
table, its version 0. Names with ``_`` are invisible to plain readers, so a table with
manifests is read by ``read_table``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _file_system(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    fs, path = _file_system(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def put(spark: SparkSession, name: str, text: str) -> bool:
    """Write a small file that appears whole or not at all; false, and no change, where one is there already."""
    fs, path = _file_system(spark, name)
    draft = spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    done = not fs.exists(path) and fs.rename(draft, path)
    if not done:
        fs.delete(draft, False)
    return done


def get(spark: SparkSession, name: str) -> str:
    """What a small file holds; plain readers of Spark pass over names with ``_``."""
    fs, path = _file_system(spark, name)
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, name: str) -> bool:
    fs, path = _file_system(spark, name)
    return fs.delete(path, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix("_manifest-")) for n in names(spark, path) if n.startswith("_manifest-"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict | None]:
    """The number and the content of a version, the last one if none is named."""
    known = versions(spark, path)
    n = version if version is not None else known[-1] if known else 0
    if n == 0:
        return 0, None
    return n, json.loads(get(spark, f"{path}/_manifest-{n}"))


def commit(spark: SparkSession, path: str, n: int, content: dict) -> None:
    """Make ``content`` version ``n + 1``; an error if another writer was faster."""
    if not put(spark, f"{path}/_manifest-{n + 1}", json.dumps(content)):
        raise RuntimeError(f"{path}: version {n + 1} is there already; read the table again")


def read_table(spark: SparkSession, path: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """A version of a table, or of a keyed table some buckets of it."""
    _, content = manifest(spark, path, version)
    if content is None:
        return spark.read.parquet(path)
    schema = T.StructType.fromJson(content["schema"])
    folders = content["folders"] if isinstance(content["folders"], list) else [
        f for b, f in content["folders"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def replace_table(df: DataFrame, path: str) -> None:
    """The next version of a table, whole. Readers see the old or the new one."""
    spark = df.sparkSession
    n, _ = manifest(spark, path)
    folder = f"_data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    commit(spark, path, n, {"folders": [folder], "schema": df.schema.jsonValue()})


def rollback(spark: SparkSession, path: str, version: int) -> None:
    """ROLLBACK TO SAVEPOINT: what an earlier version held becomes the next version. No data is copied."""
    n, _ = manifest(spark, path)
    _, content = manifest(spark, path, version)
    if content is None:
        replace_table(spark.read.parquet(path), path)
    else:
        commit(spark, path, n, content)


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, key: list[str], buckets: int) -> dict[str, str]:
    """Write rows by bucket; the folder of each bucket that has some."""
    folder = f"_data-{uuid.uuid4().hex}"
    df.withColumn("_bucket", bucket_of(key, buckets)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    found = [n for n in names(df.sparkSession, f"{path}/{folder}") if n.startswith("_bucket=")]
    return {n.removeprefix("_bucket="): f"{folder}/{n}" for n in found}


def keyed_table(df: DataFrame, path: str, key: list[str], buckets: int = 256) -> None:
    """The next version of a table, laid out by the hash of its key, for ``change_table``."""
    spark = df.sparkSession
    n, _ = manifest(spark, path)
    commit(spark, path, n, {"folders": _write(df, path, key, buckets), "schema": df.schema.jsonValue(), "key": key, "buckets": buckets, "done": {}})


def change_table(spark: SparkSession, path: str, keys: DataFrame, change, token: tuple[str, int] | None = None) -> None:
    """The next version of a keyed table: ``change(rows)`` of the buckets that hold ``keys``, the others as they are.

    ``token``, a writer's name and a number, makes a change happen once: a number that is not above the last
    one of that writer changes nothing. No more than the buckets' numbers come to the driver.
    """
    n, content = manifest(spark, path)
    if token is not None and content["done"].get(token[0], -1) >= token[1]:
        return
    key, buckets = content["key"], content["buckets"]
    touched = sorted(r[0] for r in keys.select(bucket_of(key, buckets).alias("b")).distinct().collect())
    folders = {b: f for b, f in content["folders"].items() if int(b) not in touched}
    if touched:
        folders |= _write(change(read_table(spark, path, n, touched)), path, key, buckets)
    done = content["done"] | ({token[0]: token[1]} if token else {})
    commit(spark, path, n, content | {"folders": folders, "done": done})


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the data folders that the last version does not name, and the manifests before it. Nobody may be reading those."""
    n, content = manifest(spark, path)
    if content is None:
        return 0
    named = content["folders"] if isinstance(content["folders"], list) else content["folders"].values()
    keep = {f.split("/")[0] for f in named} | {f"_manifest-{n}"}
    old = [x for x in names(spark, path) if x.startswith(("_data-", "_manifest-")) and x not in keep]
    return sum(remove(spark, f"{path}/{x}") for x in old)
