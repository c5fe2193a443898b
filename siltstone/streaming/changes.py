"""Row-change streams: filters, application, subscriptions and flashback.

A change row has ``seq`` (its place in the log), ``db``, ``tbl``, ``op`` (insert, update, delete)
and the structs ``before`` and ``after``, the row's images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import versioned


def schema(row: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("seq", T.LongType()), T.StructField("db", T.StringType()), T.StructField("tbl", T.StringType()),
                         T.StructField("op", T.StringType()), T.StructField("before", row), T.StructField("after", row)])


def read_changes(spark: SparkSession, path: str, row: T.StructType, files: int | None = None) -> DataFrame:
    """The log as a stream of JSON files; ``files`` of them are one batch."""
    reader = spark.readStream.schema(schema(row))
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(path)


def replication_filter(changes: DataFrame, *, do_db: tuple = (), ignore_db: tuple = (), do_table: tuple = (), ignore_table: tuple = (),
                       wild_do: tuple = (), wild_ignore: tuple = (), rewrite: dict | None = None) -> DataFrame:
    """The changes that a replica takes. Rules on tables hold ``db.table``, with ``%`` and ``_`` in the wild ones; databases are renamed first."""
    for old, new in (rewrite or {}).items():
        changes = changes.withColumn("db", F.when(F.col("db") == old, new).otherwise(F.col("db")))
    full = F.concat_ws(".", "db", "tbl")
    keep = F.lit(True)
    if do_db:
        keep = keep & F.col("db").isin(list(do_db))
    if ignore_db:
        keep = keep & ~F.col("db").isin(list(ignore_db))
    wanted = [full == t for t in do_table] + [full.like(p) for p in wild_do]
    if wanted:
        keep = keep & _any(wanted)
    unwanted = [full == t for t in ignore_table] + [full.like(p) for p in wild_ignore]
    return changes.where(keep & ~_any(unwanted) if unwanted else keep)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def merged(changes: DataFrame, key: list[str]) -> DataFrame:
    """One change per key: the first image before and the last one after. A key that comes and goes inside the log has none."""
    ident = [F.coalesce(F.col(f"after.{k}"), F.col(f"before.{k}")).alias(f"_{k}") for k in key]
    rows = changes.select("*", *ident).groupBy("db", "tbl", *[f"_{k}" for k in key]).agg(
        F.max("seq").alias("seq"), F.min_by(F.struct("before"), "seq").alias("b"), F.max_by(F.struct("after"), "seq").alias("a"))
    rows = rows.select("seq", "db", "tbl", F.col("b.before").alias("before"), F.col("a.after").alias("after"))
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return rows.where("before is not null or after is not null").withColumn("op", op).select("seq", "db", "tbl", "op", "before", "after")


def apply(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """A table after the changes of a log: the last image of each key, the table's own being the first. The key is unique; rows
    with a null in it are named by no change. An update that changes a key counts as a delete and an insert. Table and log are read
    once, and images combine before they are shuffled."""
    image = _row(changes)
    none = F.lit(None).cast(image)
    kept = F.lit(True)
    for k in key:
        kept = kept & F.col(k).isNotNull()
    # an image of null is a row that is gone
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("by"), none.alias("image")),
                   F.struct(F.lit(1).alias("side"), F.col("after").alias("by"), F.col("after").alias("image")))
    log = changes.select("seq", F.explode(F.filter(both, lambda x: x["by"].isNotNull())).alias("e")).select(
        F.struct(F.lit(1).alias("log"), "seq", F.col("e.side").alias("side")).alias("o"), *[F.col(f"e.by.{k}").alias(k) for k in key], F.col("e.image").alias("image"))
    own = table.where(kept).select(F.struct(F.lit(0).alias("log"), F.lit(0).cast(changes.schema["seq"].dataType).alias("seq"), F.lit(0).alias("side")).alias("o"), *key,
                                   F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in image.fields]).alias("image"))
    last = own.unionByName(log).groupBy(*key).agg(F.max_by(F.struct("image"), "o").alias("l"))
    return last.where("l.image is not null").select("l.image.*").select(*table.columns).unionByName(table.where(~kept))


def _row(changes: DataFrame) -> T.DataType:
    return changes.schema["after"].dataType


def apply_stream(changes: DataFrame, path: str, key: list[str], checkpoint: str, available_now: bool = True, interval: str | None = None,
                 buckets: int = 256):
    """Keep a table at ``path`` up to date; ``versioned.read_table`` reads it. A batch rewrites the buckets of the keys that it names and no others, becomes
    a version whole, and changes nothing where that batch is in the table already. A plain Parquet table is laid out by its key first."""
    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        _, content = versioned.manifest(spark, path)
        if content is None or "key" not in content:
            versioned.keyed_table(versioned.read_table(spark, path), path, key, buckets)
        df.persist()
        named = F.explode(F.filter(F.array("before", "after"), lambda x: x.isNotNull()))
        keys = df.select(named.alias("e")).select(*[F.col(f"e.{k}").alias(k) for k in key])
        versioned.change_table(spark, path, keys, lambda rows: apply(rows, df, key), (checkpoint, number))
        df.unpersist()

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=available_now)
    return writer.start()


def flashback(changes: DataFrame) -> DataFrame:
    """The log that undoes a log: its changes inverted, in the opposite order."""
    inverse = F.when(F.col("op") == "insert", "delete").when(F.col("op") == "delete", "insert").otherwise("update")
    return changes.select((-F.col("seq")).alias("seq"), "db", "tbl", inverse.alias("op"), F.col("after").alias("before"), F.col("before").alias("after"))


def diff(old: DataFrame, new: DataFrame, key: list[str], db: str = "db", tbl: str = "t") -> DataFrame:
    """The log that turns one table into another, in the order of the keys."""
    image = lambda side, cols: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in cols])
    o, n = old.withColumn("_there", F.lit(1)).alias("o"), new.withColumn("_there", F.lit(1)).alias("n")
    on = F.lit(True)
    for k in key:
        on = on & (F.col(f"o.{k}") == F.col(f"n.{k}"))
    both = o.join(n, on, "full_outer").select(
        F.when(F.col("o._there").isNotNull(), image("o", old.columns)).alias("before"), F.when(F.col("n._there").isNotNull(), image("n", old.columns)).alias("after"))
    both = both.where(~F.col("before").eqNullSafe(F.col("after")))
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    return both.select(F.xxhash64(*[F.coalesce(F.col(f"after.{k}"), F.col(f"before.{k}")) for k in key]).alias("seq"), F.lit(db).alias("db"), F.lit(tbl).alias("tbl"), op.alias("op"), "before", "after")


def first_events(events: DataFrame, key: str, ts: str, lateness: str) -> DataFrame:
    """Each key once, later repeats dropped while the watermark lasts."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def last_per_key(changes: DataFrame, key: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.col("seq").desc())
    return changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def log_cursor(changes: DataFrame, start: int | None = None, backward: bool = False, limit: int | None = None) -> DataFrame:
    """The entries of a stored log from a place on, forward or backward."""
    if start is not None:
        changes = changes.where(F.col("seq") <= start if backward else F.col("seq") >= start)
    ordered = changes.orderBy(F.col("seq").desc() if backward else F.col("seq").asc())
    return ordered if limit is None else ordered.limit(limit)


def wait_for_batch(query, batch: int, seconds: float) -> bool:
    """Wait until a running stream has applied a batch; false if that takes too long or the stream ends before it."""
    import time

    until = time.monotonic() + seconds
    while True:
        done = query.lastProgress
        if done is not None and done["batchId"] >= batch:
            return True
        if not query.isActive or time.monotonic() > until:
            return False
        time.sleep(0.05)


def every(spark: SparkSession, interval: str, statement, checkpoint: str, starts=None, ends=None):
    """The event scheduler: run ``statement(spark)`` once per interval, from ``starts`` to
    ``ends`` (datetimes; None is open). A run that takes longer than the interval delays the
    next one. Gives the running query, which ends by itself after ``ends``."""
    import datetime
    import threading

    def run(df: DataFrame, _: int) -> None:
        now = datetime.datetime.now(tz=(starts or ends).tzinfo) if starts or ends else None
        if (starts is None or now >= starts) and (ends is None or now <= ends):
            statement(df.sparkSession)
        elif ends is not None and now > ends:
            threading.Thread(target=query.stop).start()  # stopping waits for this batch

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    query = clock.writeStream.foreachBatch(run).trigger(processingTime=interval).option("checkpointLocation", checkpoint).start()
    return query
