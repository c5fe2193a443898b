"""Shared pieces: scratch tables in the shared folder, gapless ranks, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What an owner has written: tables of the catalogue, and paths.
_SCRATCH: dict[str, list[tuple[str, str]]] = {}
_OWNER = ["queries"]
#: Partitions of a shuffle and files of a bucketed table at most; only the layout depends on it.
MOST_PARTITIONS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a session on one machine
    (tests) gets a new temporary folder; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def mix64(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, mixed; different ones stay different."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python a thousand rows at a time, unless the session says otherwise: ten
    thousand, Spark's own number, are hundreds of MB where texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def tidy() -> None:
    """Give memory that a Python worker no longer uses back to the machine: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it has
        pass


def of_group(f):
    """A function of one group that leaves nothing behind in its worker but what it returns."""
    def run(table):
        out = f(table)
        tidy()
        return out

    return run


def of_groups(f):
    """As ``of_group``, for two groups of one key."""
    def run(left, right):
        out = f(left, right)
        tidy()
        return out

    return run


@contextlib.contextmanager
def owned(owner: str):
    """Scratch tables written inside belong to ``owner``; ``clear_scratch`` deletes an owner's."""
    _OWNER.append(owner)
    try:
        yield
    finally:
        _OWNER.pop()


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the shared folder; ``clear_scratch`` deletes it unless it is to be kept."""
    path = f"{shared_dir(spark)}/siltstone-{name}-{uuid.uuid4().hex}"
    if not keep:
        _SCRATCH.setdefault(_OWNER[-1], []).append(("path", path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str, deal: bool = True) -> DataFrame:
    """As ``stored``, laid out by ``key`` so that later joins on it move only the other side.
    Where a key's rows already come from one task, ``deal=False`` spares the shuffle."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"siltstone_{name}_{uuid.uuid4().hex}"
    buckets = min(buckets, MOST_PARTITIONS)  # groups of a key share a bucket's file where there are more of them
    ((df.repartition(buckets, key) if deal else df).write.bucketBy(buckets, key).sortBy(key)
       .option("compression", "zstd").option("path", path).format("parquet").saveAsTable(table))
    _SCRATCH.setdefault(_OWNER[-1], []).append(("table", table))
    return spark.table(table)


def clear_scratch(spark: SparkSession, owner: str) -> None:
    """Delete the scratch tables of an owner; results of its that are not written yet become unreadable, no others."""
    for kind, name in reversed(_SCRATCH.pop(owner, [])):
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            fs, path = _file_system(spark, name)
            fs.delete(path, True)


def _file_system(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def list_folder(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    fs, path = _file_system(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def put_text(spark: SparkSession, name: str, text: str) -> None:
    """Write a small file that appears whole or not at all, and never in the place of another."""
    fs, path = _file_system(spark, name)
    draft = spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(path) or not fs.rename(draft, path):
        fs.delete(draft, False)
        raise FileExistsError(name)


def input_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of a text column, one number."""
    small_batches(df.sparkSession)
    return df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def smallest_hashes(wanted: int, of: int) -> int:
    """The signed 64-bit number below which about ``wanted`` of ``of`` hashes lie."""
    return (1 << 63) - 1 if of <= wanted else int((1 << 64) * wanted / of) - (1 << 63)


def pieces(total_bytes: int, each: int, least: int = 12) -> int:
    """How many partitions of about ``each`` bytes hold ``total_bytes``."""
    return max(least, -(-int(total_bytes) // each))


def ranked(rows: DataFrame, buckets: int = 1024) -> DataFrame:
    """Rows (``_row``, a struct of all their columns; ``_h``, a hash; ``_g``, a group; ``_c``, how many rows it stands for) with
    ``_rank``, the first of their numbers in the group.

    No task holds a group: rows are dealt by the upper bits of the hash, numbered inside
    their bucket, and shifted by the counts of the lower buckets (a table whose size is
    groups times buckets). The numbers don't depend on the number of buckets.
    """
    shift = 64 - max(1, (buckets - 1).bit_length())
    keyed = rows.withColumn("_b", F.shiftright("_h", shift)).withColumn(
        "_g", F.coalesce(F.concat(F.lit("v"), F.col("_g").cast("string")), F.lit("n")))
    counts = keyed.groupBy("_g", "_b").agg(F.sum("_c").alias("_n"))
    earlier = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_g", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_g", "_b").orderBy("_h", "_row").rowsBetween(Window.unboundedPreceding, -1)
    numbered = keyed.withColumn("_r", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    return numbered.join(before, ["_g", "_b"]).select("_row", "_c", (F.col("_r") + F.col("_before")).cast("long").alias("_rank"))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): a row (node, root) for each node with a link,
    root the smallest node of its component.

    Alternating large-star and small-star steps until nothing changes; each step is a
    map-side-combined minimum and a join on the node, written to the shared folder. No
    component is ever held by one task.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .where("a <> b").distinct(), "edges")
    sign = _signature(edges)
    while sign[0]:  # the rounds grow with the logarithm of the longest chain
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = (hung.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .union(low.select("u", "m")).distinct())
        edges, before = stored(small, "edges"), sign
        sign = _signature(edges)
        if sign == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select("b", "b").distinct())


def _signature(edges: DataFrame) -> tuple:
    got = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return (got[0], got[1])
