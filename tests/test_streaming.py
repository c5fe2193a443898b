"""Change streams from files to a table and back."""

import datetime
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.sources import versioned
from siltstone.streaming import changes as stream

ROW = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def log(spark, *rows):
    data = [(i, db, "t", op, b, a) for i, (db, op, b, a) in enumerate(rows)]
    return spark.createDataFrame(data, stream.schema(ROW))


CHANGES = [("d", "update", (1, "a"), (1, "b")), ("d", "delete", (2, "x"), None), ("d", "insert", None, (9, "n")), ("d", "update", (1, "b"), (7, "moved")),
           ("d", "insert", None, (8, "gone")), ("d", "delete", (8, "gone"), None)]


def rows_of(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_apply_and_flashback(spark):
    table = spark.createDataFrame([(1, "a"), (2, "x"), (3, "s")], ROW)
    done = stream.apply(table, log(spark, *CHANGES), ["k"])
    assert rows_of(done) == [(3, "s"), (7, "moved"), (9, "n")]
    assert rows_of(stream.apply(done, stream.flashback(log(spark, *CHANGES)), ["k"])) == rows_of(table)
    assert rows_of(stream.apply(table, stream.diff(table, done, ["k"]), ["k"])) == rows_of(done)
    assert rows_of(stream.apply(table, log(spark, *CHANGES).limit(0), ["k"])) == rows_of(table)
    nameless = spark.createDataFrame([(None, "a"), (None, "b"), (1, "a")], ROW)
    assert sorted(((r.k, r.v) for r in stream.apply(nameless, log(spark, ("d", "delete", (1, "a"), None)), ["k"]).collect()), key=repr) == [(None, "a"), (None, "b")]


def test_merged(spark):
    got = {(r.op, (r.after or r.before).k) for r in stream.merged(log(spark, ("d", "insert", None, (1, "a")), ("d", "update", (1, "a"), (1, "b")), ("d", "insert", None, (2, "a")), ("d", "delete", (2, "a"), None)), ["k"]).collect()}
    assert got == {("insert", 1)}


def test_filters(spark):
    changes = log(spark, ("a", "insert", None, (1, "x")), ("b", "insert", None, (2, "x")), ("c", "insert", None, (3, "x")))
    keys = lambda df: sorted(r.after.k for r in df.collect())
    assert keys(stream.replication_filter(changes, ignore_db=("b",))) == [1, 3]
    assert keys(stream.replication_filter(changes, rewrite={"b": "a"}, do_db=("a",))) == [1, 2]
    assert keys(stream.replication_filter(changes, wild_do=("%.t",), ignore_table=("c.t",))) == [1, 2]


def test_stream_into_a_table(spark, tmp_path):
    path, source = str(tmp_path / "table"), tmp_path / "log"
    source.mkdir()
    spark.createDataFrame([(1, "a"), (2, "x")], ROW).write.parquet(path)

    def put(name, rows):
        image = lambda r: None if r is None else {"k": r[0], "v": r[1]}
        (source / name).write_text("\n".join(json.dumps({"seq": s, "db": d, "tbl": "t", "op": o, "before": image(b), "after": image(a)}) for s, (d, o, b, a) in rows))

    numbered = list(enumerate(CHANGES))
    put("1.json", numbered[:3])
    put("2.json", numbered[3:])
    query = stream.apply_stream(stream.read_changes(spark, str(source), ROW, files=1), path, ["k"], str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert rows_of(versioned.read_table(spark, path)) == [(7, "moved"), (9, "n")]
    n = versioned.versions(spark, path)[-1]
    query = stream.apply_stream(stream.read_changes(spark, str(source), ROW, files=1), path, ["k"], str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert versioned.versions(spark, path)[-1] == n  # nothing new, nothing written


def test_first_events(spark, tmp_path):
    spark.createDataFrame([(1, "2020-01-01 00:00:00"), (1, "2020-01-01 00:00:05"), (2, "2020-01-01 00:00:07")], "id long, t string").withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1).write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("id long, ts timestamp").parquet(str(tmp_path / "e"))
    query = stream.first_events(events, "id", "ts", "1 minute").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.id for r in spark.table("firsts").collect()) == [1, 2]


def test_log_cursor(spark):
    changes = log(spark, *CHANGES)
    assert [r.seq for r in stream.log_cursor(changes, 2).collect()] == [2, 3, 4, 5]
    assert [r.seq for r in stream.log_cursor(changes, 3, backward=True, limit=2).collect()] == [3, 2]
    assert [r.seq for r in stream.log_cursor(changes).collect()] == [0, 1, 2, 3, 4, 5]


def test_scheduled_statement(spark, tmp_path):
    ran = []
    now = datetime.datetime.now()
    query = stream.every(spark, "1 second", lambda s: ran.append(s.range(3).count()), str(tmp_path / "a"), ends=now + datetime.timedelta(seconds=6))
    try:
        assert stream.wait_for_batch(query, 1, 30)
        assert ran and set(ran) == {3}
        assert query.awaitTermination(30)
        assert not stream.wait_for_batch(query, 10**6, 1)
    finally:
        query.stop()
