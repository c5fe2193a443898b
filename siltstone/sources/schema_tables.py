"""The catalogue as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tables(spark: SparkSession) -> DataFrame:
    rows = [(t.catalog or "", (t.namespace or [""])[0], t.name, t.tableType) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string")


def columns(spark: SparkSession, *names: str) -> DataFrame:
    rows = [(n, c.name, i + 1, c.dataType, "YES" if c.nullable else "NO") for n in names for i, c in enumerate(spark.catalog.listColumns(n))]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string")


def schemata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.catalog or "", d.name, d.locationUri) for d in spark.catalog.listDatabases()], "catalog_name string, schema_name string, location string")


def routines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f.name, f.className) for f in spark.catalog.listFunctions()], "routine_name string, class_name string")


def variables(spark: SparkSession) -> DataFrame:
    return spark.sql("SET").toDF("variable_name", "variable_value")


def engines(spark: SparkSession) -> DataFrame:
    rows = [("PARQUET", "DEFAULT"), ("CSV", "YES"), ("XML", "YES"), ("ARCHIVE", "YES"), ("BLACKHOLE", "YES"), ("MEMORY", "YES"), ("MERGE", "YES"), ("FEDERATED", "YES")]
    return spark.createDataFrame(rows, "engine string, support string")


def processlist(spark: SparkSession) -> DataFrame:
    """The jobs and stages that run now."""
    tracker = spark.sparkContext.statusTracker()
    rows = [(i, s.name, s.numTasks, s.numActiveTasks, s.numCompletedTasks) for i in tracker.getActiveStageIds() if (s := tracker.getStageInfo(i))]
    return spark.createDataFrame(rows, "id int, info string, tasks int, active int, done int")


def views(spark: SparkSession) -> DataFrame:
    rows = [((t.namespace or [""])[0], t.name) for t in spark.catalog.listTables() if t.tableType in ("VIEW", "TEMPORARY")]
    return spark.createDataFrame(rows, "table_schema string, table_name string")


def statistics(spark: SparkSession, indexes: dict[str, dict[str, list[str]]]) -> DataFrame:
    """STATISTICS: a row per column of an index. Indexes are sorted copies (``admin.create_index``), so the caller names them:
    table, then index, then its columns."""
    rows = [(t, i, n + 1, c) for t, own in indexes.items() for i, columns_ in own.items() for n, c in enumerate(columns_)]
    return spark.createDataFrame(rows, "table_name string, index_name string, seq_in_index int, column_name string")


def triggers(spark: SparkSession, known: dict[str, tuple[str, str, str]]) -> DataFrame:
    """TRIGGERS: name, then time, event and table of each; triggers are functions of a statement here, so the caller names them."""
    rows = [(name, time, event, table) for name, (time, event, table) in known.items()]
    return spark.createDataFrame(rows, "trigger_name string, action_timing string, event_manipulation string, event_object_table string")


def default_of(spark: SparkSession, table: str, column: str):
    """DEFAULT(col): the value that a column of a catalogued table has where none is given; null without one."""
    from pyspark.sql import functions as F

    made = spark.table(table).schema[column].metadata.get("CURRENT_DEFAULT")
    return F.expr(made) if made is not None else F.lit(None)
