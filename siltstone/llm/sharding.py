"""Weighted rendezvous hashing of stable record keys over shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that wins ``key``: the least of ``-ln(u) / weight`` over the shards,
    u being a uniform number hashed from the key and the shard's number.

    A shard's score depends on nothing but the key, its number and its weight: a further
    shard takes rows into itself only, and a shard's share is its weight's share. Ties go to
    the smaller number. A null key is the key of the empty marker ``\\0``. Weights must be
    positive; a shard is closed by leaving its number out at the end of the list.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("rendezvous needs shards of positive weight")
    name = F.coalesce(key.cast("string"), F.lit("\0"))
    scores = []
    for i, w in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(F.concat(name, F.lit(f"|{i}"))), 11)
        u = (bits.cast("double") + 0.5) / F.lit(float(2**53))
        scores.append(F.struct((-F.log(u) / F.lit(float(w))).alias("score"), F.lit(i).alias("shard")))
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def assign(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row. Keeps all rows and columns; no shuffle. A column
    already named ``out`` is replaced. An empty table gives an empty table."""
    return df.withColumn(out, rendezvous(F.col(key), weights))


#: Copies of a row that are written out at once.
_COPIES = 1 << 16


def slots(df: DataFrame, shard: str, key: str, out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in the order of the key's hash.

    Equal rows are counted before anything is numbered, so that a key that holds a third of
    all rows is one row until the end, and is then written out in blocks of rows. All columns of ``df`` must be groupable and
    orderable. Every row and other column stays, a column ``out`` is replaced, and no other name is taken: columns may have any
    names. An empty table gives an empty table, null shards are a shard, null keys come in one place of the order.
    """
    counted = df.drop(out).select(F.struct("*").alias("_row")).groupBy("_row").agg(F.count(F.lit(1)).alias("_c"))
    placed = ranked(counted.select("_row", "_c", F.col(f"_row.{shard}").alias("_g"), F.xxhash64(F.col(f"_row.{key}").cast("string")).alias("_h")))
    blocks = placed.select("_row", "_c", "_rank", F.explode(F.expr(f"sequence(0L, (_c - 1) div {_COPIES})")).alias("_i"))
    first, last = F.col("_i") * _COPIES, F.least(F.col("_c"), (F.col("_i") + 1) * _COPIES) - 1
    return blocks.select("_row", "_rank", F.explode(F.sequence(first, last)).alias("_j")).select(
        "_row.*", (F.col("_rank") + F.col("_j")).cast("long").alias(out))


#: Shards of the registered query, all of one weight.
SHARDS = 16


def op1_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 by the law ``key``: doc_id and the shard count decide."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"))
    placed = assign(docs, "doc_id", [1.0] * SHARDS)
    placed = assign(placed, "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    return slots(placed, "shard", "doc_id").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
