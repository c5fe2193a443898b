"""Sources, sinks, changes, profiles and catalogue on small fixtures."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators import admin, fulltext, profile
from siltstone.plans import quantified, statements
from siltstone.sources import changes, files, schema_tables, versioned

SHOP = T.StructType([T.StructField("c1", T.IntegerType()), T.StructField("c2", T.StringType()), T.StructField("c3", T.StringType())])


def test_load_data(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("1,one,2007-01-01\n2,\\N,x\n3\n")
    assert [tuple(r) for r in files.load_data(spark, str(p), SHOP, fields=",").collect()] == [(1, "one", "2007-01-01"), (2, None, "x"), (3, None, None)]
    p.write_text("head\nxxx>1,one,a\nnothing\nyy>2,two,b\n")
    assert [r.c1 for r in files.load_data(spark, str(p), SHOP, fields=",", lines_starting=">").collect()] == [1, 2]
    assert [r.c1 for r in files.load_data(spark, str(p), SHOP, fields=",", lines_starting=">", ignore_lines=2).collect()] == [2]


def test_load_data_marks_with_quotes(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("it's>1,one,a\n")
    assert [r.c1 for r in files.load_data(spark, str(p), SHOP, fields=",", lines_starting="it's>").collect()] == [1]
    assert files.load_file(spark, str(p)) == b"it's>1,one,a\n" and files.load_file(spark, str(p) + "x") is None and files.load_file(spark, str(p), 3) is None


def test_load_xml(spark, tmp_path):
    p = tmp_path / "t.xml"
    p.write_text("<t><row a='1'><b>x</b></row><row><a>2</a><b>y</b></row><row a='z' b='w'/></t>")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    assert sorted(map(tuple, files.load_xml(spark, str(p), schema).collect()), key=repr) == [(1, "x"), (2, "y"), (None, "w")]
    assert files.load_xml(spark, str(p), schema, ignore_rows=2).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    files.into_outfile(df.coalesce(1), str(tmp_path / "out"))
    assert sorted("".join(x.read_text() for x in (tmp_path / "out").glob("part-*")).split("\n")) == ["", "1\ta", "2\t\\N"]
    files.into_dumpfile(df.where("k = 1").select("v"), str(tmp_path / "dump"))
    assert (tmp_path / "dump").read_bytes() == b"a"
    with pytest.raises(ValueError):
        files.into_dumpfile(df.select("v"), str(tmp_path / "dump2"))
    files.archive(df, str(tmp_path / "arc"))
    files.archive(df, str(tmp_path / "arc"))
    assert spark.read.parquet(str(tmp_path / "arc")).count() == 4
    files.blackhole(df)
    files.bulk_load(df, str(tmp_path / "bulk"), ["k"], 2)
    assert [r.k for r in files.handler_read(spark.read.parquet(str(tmp_path / "bulk")), "k", ">=", 1, 5).collect()] == [1, 2]


def test_partition_pruning(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), (5, 50), (120, 10), (999, 999)], "a int, b int")
    files.write_partitioned(df, str(tmp_path / "p"), files.range_partition(F.col("a"), [100, 500, None]))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert {(r.a, r.part) for r in back.collect()} == {(None, 0), (5, 0), (120, 1), (999, 2)}
    assert "PartitionFilters: [isnotnull(part" in back.where("part = 1")._jdf.queryExecution().toString()
    got = df.select(files.columns_partition([F.col("a"), F.col("b")], [(5, 10), (5, None), (None, None)]).alias("p")).collect()
    assert [r.p for r in got][1:] == [1, 2, 2]
    assert [r.p for r in spark.range(8).select(files.hash_partition(F.col("id"), 6, True).alias("p")).collect()] == [0, 1, 2, 3, 4, 5, 2, 3]
    assert df.select(files.list_partition(F.col("a"), [[5, None], [120]]).alias("p")).collect()[3].p is None


def test_replace_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    changes.replace_table(changes.delete(versioned.read_table(spark, path), F.col("id") == 1), path)
    old = versioned.read_table(spark, path)
    changes.replace_table(changes.delete(old, F.col("id") == 0), path)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(old) == [0, 2] and ids(versioned.read_table(spark, path)) == [2] and ids(versioned.read_table(spark, path, 1)) == [0, 2]
    with pytest.raises(RuntimeError):  # another writer was faster
        versioned.commit(spark, path, 1, {"folders": [], "schema": old.schema.jsonValue()})
    versioned.rollback(spark, path, 1)
    assert ids(versioned.read_table(spark, path)) == [0, 2]
    assert versioned.vacuum(spark, path) == 3 and ids(versioned.read_table(spark, path)) == [0, 2]
    changes.replace_table(versioned.read_table(spark, path).limit(0), path)
    assert versioned.read_table(spark, path).count() == 0


def test_keyed_tables_rewrite_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    versioned.keyed_table(spark.createDataFrame([(i, "a") for i in range(40)] + [(None, "n")], "k int, v string"), path, ["k"], 8)
    before = versioned.manifest(spark, path)[1]["folders"]
    one = spark.createDataFrame([(7,)], "k int")
    for token in (("w", 0), ("w", 0), ("x", 0)):
        versioned.change_table(spark, path, one, lambda rows: rows.where("k <> 7 or k is null"), token)
    n, content = versioned.manifest(spark, path)
    assert n == 3 and sum(content["folders"].get(b) != f for b, f in before.items()) == 1
    assert sorted(r.k for r in versioned.read_table(spark, path).where("k is not null").collect()) == [i for i in range(40) if i != 7]
    assert versioned.read_table(spark, path).where("k is null").count() == 1


def test_upserts_with_repeats_and_nulls(spark, monkeypatch):
    table = spark.createDataFrame([(1, 10), (None, 5)], "k int, n int")
    rows = spark.createDataFrame([(2, 21), (2, 22), (None, 6), (None, 6), (1, 1), (1, 2)], "k int, n int")
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(changes.insert_ignore(table, rows, ["k"], "n")) == sorted([(1, 10), (None, 5), (None, 6), (None, 6), (2, 21)], key=repr)
    assert key(changes.replace(table, rows, ["k"], "n")) == sorted([(1, 2), (None, 5), (None, 6), (None, 6), (2, 22)], key=repr)
    for fold in (1, 4096):
        monkeypatch.setattr(changes, "FOLD", fold)
        got = changes.on_duplicate_update(table, rows, ["k"], lambda old, new: {"n": old("n") + new("n")})
        assert key(got) == sorted([(1, 13), (None, 5), (None, 6), (None, 6), (2, 43)], key=repr)
    assert key(changes.on_duplicate_update(table, rows.limit(0), ["k"], lambda old, new: {})) == key(table)
    content, first = changes.insert_auto(table, spark.createDataFrame([(None, 3), (0, 2), (7, 1)], "k int, n int"), "k", "n")
    assert first == 8 and key(content) == sorted([(1, 10), (None, 5), (7, 1), (8, 2), (9, 3)], key=repr)


def test_limits_hit_the_same_rows_in_any_plan(spark, tmp_path):
    spark.range(200).select((F.col("id") % 3).alias("g"), "id").repartition(7).write.parquet(str(tmp_path / "t"))
    for table in (spark.read.parquet(str(tmp_path / "t")), spark.range(200).select((F.col("id") % 3).alias("g"), "id").repartition(7)):
        left = changes.delete(table, F.col("g") == 1, [F.col("g")], 20)
        assert left.count() == 180 and left.where("g = 1").count() == 67 - 20
        done = changes.update(table, F.col("g") == 1, {"id": F.lit(-1)}, None, 5)
        assert done.count() == 200 and done.where("id = -1").count() == 5 and done.columns == ["g", "id"]


def test_triggers_of_updates_and_deletes(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "k int, v int")
    content, told = changes.update_with_triggers(rows, F.col("v") > 4, {"v": F.lit(0)}, after=lambda r: r.select("old.k", "old.v"))
    assert sorted(tuple(r) for r in told.collect()) == [(1, 5), (3, 9)] and content.where("v = 0").count() == 2 and content.count() == 3
    content, told = changes.delete_with_triggers(rows, F.col("v") > 4, before=lambda r: r.where("old.k = 1"), after=lambda r: r.select("old.k"))
    assert sorted(r.k for r in content.collect()) == [2, 3] and [r.k for r in told.collect()] == [1]
    assert changes.row_count(rows, F.col("k") > 0, {"v": F.lit(5)}) == 2


def test_null_conditions_change_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "k int, v int")
    assert [tuple(r) for r in changes.update(df, F.col("v") > 3, {"v": F.lit(0)}).collect()] == [(1, None), (2, 0)]
    assert [r.k for r in changes.delete(df, F.col("v") > 3).collect()] == [1]


def test_quantified_with_nulls(spark):
    t = spark.createDataFrame([(1,), (2,), (100,), (None,)], "c1 int")
    sub, none = spark.createDataFrame([(None,), (2,), (100,)], "v int"), spark.createDataFrame([], "v int")
    values = lambda df: sorted((r.c1 for r in df.collect()), key=lambda x: (x is None, x))
    assert values(quantified.where_all(t, "c1", ">=", sub, "v")) == [100]
    assert values(quantified.where_all(t, "c1", "<>", sub, "v")) == []
    assert values(quantified.where_all(t, "c1", "<=", sub, "v")) == [1, 2]
    assert values(quantified.where_all(t, "c1", ">", none, "v")) == [1, 2, 100, None]
    assert values(quantified.where_any(t, "c1", "=", sub, "v")) == [2, 100]
    assert values(quantified.where_any(t, "c1", "<", none, "v")) == []
    assert values(quantified.where_any(t, "c1", "<>", sub, "v")) == [1, 2, 100]


def test_statements(spark):
    assert statements.digest("select  * from t where a = 5 and b in (1, 2,3) and c = 'it''s';") == "SELECT * FROM T WHERE A = ? AND B IN (?) AND C = ?"
    found = statements.calc_found_rows(spark.range(8), 1)
    assert found.rows.count() == 1 and found.found_rows == 8
    with pytest.raises(ValueError):
        statements.calc_found_rows(spark.range(8), -1)
    with pytest.raises(ValueError):
        statements.check_join_size(spark.range(10**6), 10)


def test_profile(spark):
    df = spark.createDataFrame([(1, "", "x"), (0, "aa", "x"), (3, None, "y")], "i int, e string, b string")
    got = {r.field_name: r for r in profile.analyse(df).collect()}
    assert (got["i"].min_value, got["i"].empties_or_zeros, got["e"].nulls, got["e"].empties_or_zeros) == ("0", 1, 1, 1)
    assert got["b"].optimal_type == "ENUM NOT NULL"
    assert profile.checksum(df).first() == profile.checksum(df.orderBy("i")).first()
    assert [r.rows_per_key for r in profile.cardinality(df, ["b", "i"]).orderBy("key_parts").collect()] == [1.5, 1.0]
    assert profile.unique_violations(df, ["b"]).collect()[0].rows == 2


def test_catalogue(spark):
    spark.range(1).createOrReplaceTempView("seen")
    assert "seen" in [r.table_name for r in schema_tables.tables(spark).collect()]
    assert schema_tables.columns(spark, "seen").first().column_name == "id"
    for made in (schema_tables.schemata, schema_tables.routines, schema_tables.variables, schema_tables.engines, schema_tables.processlist):
        assert made(spark).count() >= 0


def test_fulltext(spark):
    rows = spark.createDataFrame([(1, "testbug"), (2, "steve"), (3, "is"), (4, "cool"), (5, "steve is cool"), (6, "the steve's bug stevens")], "a int, m string")
    score = {r.a: r.score for r in fulltext.relevance(rows, "a", "m", "steve").collect()}
    assert set(score) == {2, 5} and score[2] >= score[5] > 0
    assert {r.a for r in fulltext.boolean(rows, "a", "m", "steve*").collect()} == {2, 5, 6}
    assert {r.a for r in fulltext.boolean(rows, "a", "m", '+steve -"is cool"').collect()} == {2}
    assert {r.a for r in fulltext.boolean(rows, "a", "m", '"steve is"').collect()} == {5}
    assert fulltext.relevance(rows, "a", "m", "").count() == 0


def test_published_scores(spark, tmp_path):
    """Scores that the dialect's own tests publish."""
    rows = spark.createDataFrame([(i + 1, t) for i, t in enumerate(["Testing", "table", "testbug", "steve", "is", "cool", "steve is cool"])], "a int, m string")
    want = {4: "0.905873", 7: "0.895690"}
    assert {r.a: f"{r.score:.6f}" for r in fulltext.relevance(rows, "a", "m", "steve").collect()} == want
    fulltext.build_index(rows, "a", "m", str(tmp_path / "i"))
    assert {r.a: f"{r.score:.6f}" for r in fulltext.search_index(spark, str(tmp_path / "i"), "Steve", "a").collect()} == want
    assert fulltext.search_index(spark, str(tmp_path / "i"), "", "a").count() == 0
    assert {r.a: r.score for r in fulltext.boolean(rows, "a", "m", "steve").collect()} == {4: 1, 7: 1}
    bugs = spark.createDataFrame([(1, "testbug"), (2, "testbug foobar")], "a int, m string")
    assert {r.a: r.score for r in fulltext.boolean(bugs, "a", "m", "t* f*").collect()} == {1: 1, 2: 2}


def test_boolean_operators(spark):
    rows = spark.createDataFrame([(1, "apple pie"), (2, "cherry pie"), (3, "pie"), (4, "apple"), (5, None)], "a int, m string")
    ask = lambda q: {r.a: round(r.score, 6) for r in fulltext.boolean(rows, "a", "m", q).collect()}
    assert ask("+pie +(apple cherry)") == {1: 1, 2: 1}
    assert ask("+pie +(>apple <cherry)") == {1: 1.25, 2: round(0.5 + 1 / 3, 6)}
    assert ask("pie <apple") == {1: round(1 + 1 / 1.5, 6), 2: 1, 3: 1, 4: round(1 / 1.5, 6)}
    assert ask("+pie ~apple") == {1: 0.5, 2: 1, 3: 1}
    assert ask('+pie -"apple pie"') == {2: 1, 3: 1}
    assert ask("-pie") == {} and ask("") == {} and ask("(") == {}
    assert ask("+(pie -(apple cherry") == {3: 1}


def test_running_over_large_groups(spark):
    rows = spark.createDataFrame([(g, i, None if i % 5 == 0 else i) for g in ("a", "b", None) for i in range(300)], "g string, k int, v int").repartition(6)
    want = {(g, i): (sum(x for x in range(i + 1) if x % 5) if i else None, i + 1) for g in ("a", "b", None) for i in range(300)}
    for spread in (statements.running_spread, statements.running):
        got = spread(rows, ["g"], [F.col("k")], s=F.col("v"), n=F.lit(1)).collect()
        assert {(r.g, r.k): (r.s, r.n) for r in got} == want and len(got) == 900
    down = statements.running(rows.where("g = 'a'"), [], [F.col("k").desc()], n=F.lit(1))
    assert {r.k: r.n for r in down.collect()} == {i: 300 - i for i in range(300)}
    assert statements.running(rows.limit(0), [], [F.col("k")], n=F.lit(1)).count() == 0


def test_table_maintenance(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(10).write.parquet(path)
    assert spark.read.parquet(path).transform(admin.check).agg(F.sum("rows"), F.count("file")).first()[:] == (100, 10)
    assert admin.fragments(spark.read.parquet(path)).agg(F.sum("rows")).first()[0] == 100
    admin.optimize(spark, path)
    assert versioned.read_table(spark, path).transform(admin.check).count() < 10
    admin.optimize(spark, path, ["id"])
    assert sorted(r.id for r in versioned.read_table(spark, path).collect()) == list(range(100))
    (tmp_path / "t" / "broken.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception):  # noqa: B017
        admin.check(spark.read.schema("id long").parquet(path)).collect()
    admin.repair(spark, path, spark.range(1).schema, str(tmp_path / "repaired"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "repaired")).collect()) == list(range(100))
    spark.sql(f"CREATE TABLE repaired USING parquet LOCATION '{tmp_path / 'repaired'}'")
    try:
        assert "100 rows" in admin.analyze(spark, "repaired").first().statistics
    finally:
        spark.sql("DROP TABLE repaired")
    counts = admin.records_in_range(spark.createDataFrame([(1,), (5,), (None,)], "k int"), "k", [(1, 4), (None, None), (6, None)])
    assert [tuple(r) for r in counts.collect()] == [(0, 1), (1, 2), (2, 0)]


def test_views_triggers_and_statistics(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (2, None)], "k int, v int")
    assert changes.check_option(rows, F.col("k") < 3).count() == 2
    with pytest.raises(Exception, match="CHECK OPTION"):
        changes.check_option(rows, F.col("v") > 3).collect()
    content, told = changes.with_triggers(rows, rows, before=lambda r: r.withColumn("v", F.coalesce("v", F.lit(0))), after=lambda r: r.select("k"))
    assert sorted(tuple(r) for r in content.na.fill(-1).collect()) == [(1, 5), (1, 5), (2, -1), (2, 0)] and told.count() == 2
    path = str(tmp_path / "io")
    spark.range(50).repartition(2).write.parquet(path)
    read = statements.io_statistics(spark.read.parquet(path).groupBy("id").count())
    assert read["files"] == 2 and read["rows"] == 50 and read["bytes"] > 0


def test_lent_database_keeps_every_value(spark):
    rows = [(1, "a"), (2, None), (3, ""), (4, 'say "so", twice\nü'), (None, "x")]
    url = files.lent(spark.createDataFrame(rows, "k int, v string").repartition(3), "T")
    found = files.federated(spark, url, "T", driver=files.DERBY)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(rows, key=repr)
    assert [r.v for r in found.where("k = 4").collect()] == [rows[3][1]]


def test_federated_table_with_executors_apart(tmp_path):
    """Executors are processes of their own: none sees a database in the memory of another."""
    code = f"""
from pyspark.sql import SparkSession
import __spark_entry__ as e
b = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", "file://{tmp_path}/c").config("spark.ui.enabled", "false")
spark = b.getOrCreate()
spark.createDataFrame([(1, "x", 1), (2, "y", 0), (3, None, 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet("{tmp_path}/nation.parquet")
print("found", sorted(map(tuple, e.queries()["federated_table"](spark, "{tmp_path}").collect())))
spark.stop()
"""
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(__file__))},
                         capture_output=True, text=True, timeout=180)
    assert "found [(1, 'x'), (3, None)]" in ran.stdout, ran.stderr[-3000:]
