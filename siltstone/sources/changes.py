"""Inserts, updates and deletes as rewrites: what a table holds afterwards, as a DataFrame.

A Parquet table has no row updates. Each function gives the whole new content;
``versioned.replace_table`` makes it the table's next version.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored
from .versioned import replace_table

__all__ = ["replace_table"]

#: New rows of one key that are folded at once.
FOLD = 4096


def _there(key: list[str]) -> Column:
    """Whether a key collides at all: one with a null never does."""
    out = F.lit(True)
    for k in key:
        out = out & F.col(k).isNotNull()
    return out


def _order(rows: DataFrame, order: str | None, last: bool = False) -> list[Column]:
    """The order of the new rows: by ``order``, then by all their columns."""
    columns = [*([order] if order else []), *rows.columns]
    return [F.col(c).desc() if last else F.col(c).asc() for c in columns]


def _one(rows: DataFrame, key: list[str], order: str | None, last: bool) -> DataFrame:
    """Of the rows of each key the first or the last; rows with a null in their key all."""
    w = Window.partitionBy(*key).orderBy(*_order(rows, order, last))
    own = rows.where(_there(key)).select(F.struct(*rows.columns).alias("r"), F.row_number().over(w).alias("n")).where("n = 1").select("r.*")
    return own.unionByName(rows.where(~_there(key)))


def insert_ignore(table: DataFrame, rows: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """INSERT IGNORE: rows whose key is new are added; of several rows with one new key, the first by ``order`` (without it, the
    smallest row). Keys with a null collide with none."""
    new = _one(rows, key, order, False).select(*table.columns)
    return table.unionByName(new.join(table.select(*key), key, "left_anti").select(*table.columns))


def replace(table: DataFrame, rows: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """REPLACE: rows take the place of those with their key; of several with one key, the last by ``order`` (without it, the
    largest row). Keys with a null collide with none."""
    new = _one(rows, key, order, True)
    return table.join(new.select(*key), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def on_duplicate_update(table: DataFrame, rows: DataFrame, key: list[str], change, order: str | None = None) -> DataFrame:
    """ON DUPLICATE KEY UPDATE: rows with a new key are added; for the others ``change(old, new)`` names new values, ``old`` and ``new``
    being functions from a column's name to its value on either side. Rows of one key are taken one after
    the other, by ``order`` and then by all their columns: each changes what the one before has left.
    Keys with a null collide with none. ``FOLD`` rows of a key are folded at once, so that no task holds all rows of one."""
    columns, types = table.columns, dict(table.dtypes)
    rows = rows.select(*columns, *([order] if order and order not in columns else []))
    w = Window.partitionBy(*key).orderBy(*_order(rows, order))
    numbered = rows.where(_there(key)).select(F.struct(*columns).alias("r"), (F.row_number().over(w) - 1).alias("n"))
    numbered = numbered.withColumn("c", F.expr(f"n div {FOLD}"))
    most = numbered.agg(F.max("c")).first()[0]

    def step(s: Column, new: Column) -> Column:
        old, values = s["r"], change(lambda c: s["r"][c], lambda c: new["r"][c])
        changed = F.struct(*[(values[c] if c in values else old[c]).cast(types[c]).alias(c) for c in columns])
        same = F.struct(*[new["r"][c].cast(types[c]).alias(c) for c in columns])
        return F.struct(F.when(s["there"], changed).otherwise(same).alias("r"), F.lit(True).alias("there"))

    state = table.select(F.struct(*columns).alias("r"))
    for c in range(0 if most is None else int(most) + 1):
        part = numbered.where(F.col("c") == c).groupBy(*[F.col(f"r.{k}").alias(f"_{k}") for k in key]).agg(
            F.sort_array(F.collect_list(F.struct("n", "r"))).alias("new"))
        on = F.lit(True)
        for k in key:
            on = on & (F.col(f"s.r.{k}") == F.col(f"p._{k}"))
        both = state.alias("s").join(part.alias("p"), on, "full_outer")
        first = F.struct(F.col("s.r").alias("r"), F.col("s.r").isNotNull().alias("there"))
        empty = F.coalesce(F.col("p.new"), F.array().cast(part.schema["new"].dataType))
        state = both.select(F.aggregate(empty, first, step, lambda s: s["r"]).alias("r"))
        state = stored(state, "folded") if c else state
    return state.select("r.*").unionByName(rows.where(~_there(key)).select(*columns))


def update(table: DataFrame, where: Column, values: dict[str, Column], order: list | None = None, limit: int | None = None) -> DataFrame:
    """New values where a condition is true; with a limit, for the first so many such rows in an order."""
    hit = F.coalesce(where, F.lit(False))
    if limit is not None:
        table, hit = _first_hits(table, hit, order, limit)
    names = [c for c in table.columns if c not in ("_hit",)]
    return table.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in names if c not in ("_id",)])


def delete(table: DataFrame, where: Column, order: list | None = None, limit: int | None = None) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    if limit is not None:
        table, hit = _first_hits(table, hit, order, limit)
        return table.where(~hit).drop("_id", "_hit")
    return table.where(~hit)


def _numbered(table: DataFrame) -> DataFrame:
    """``table`` with ``_id``, which is the same whenever a row is read: its file and its place there. Rows that come from
    no file are written down with a number first."""
    try:
        return table.select("*", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("n")).alias("_id"))
    except AnalysisException:
        return stored(table.withColumn("_id", F.monotonically_increasing_id()), "numbered")


def _first_hits(table: DataFrame, hit: Column, order: list | None, limit: int):
    """Mark the first hits by rows' places: top-k over the hits, so that no task sorts the table."""
    numbered = _numbered(table)
    first = numbered.where(hit).orderBy(*(order or []), "_id").limit(limit).select(F.col("_id").alias("_hit"))
    return numbered.join(F.broadcast(first) if limit <= 100_000 else first, F.col("_id") == F.col("_hit"), "left"), F.col("_hit").isNotNull()


def update_joined(table: DataFrame, other: DataFrame, key: list[str], values: dict[str, Column]) -> DataFrame:
    """The multi-table update: rows that find a partner get new values; the other side's columns are named ``o.<column>``."""
    t, o = table.alias("t"), other.dropDuplicates(key).alias("o")
    on = F.lit(True)
    for k in key:
        on = on & (F.col(f"t.{k}") == F.col(f"o.{k}"))
    found = F.col(f"o.{key[0]}").isNotNull()
    both = t.join(o, on, "left")
    return both.select(*[F.when(found, values[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in values else F.col(f"t.{c}") for c in table.columns])


def delete_joined(table: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    return table.join(other.select(*key).distinct(), key, "left_anti").select(*table.columns)


def check_option(rows: DataFrame, condition: Column) -> DataFrame:
    """WITH CHECK OPTION: the rows that go through a view. One that the view could not show fails the statement."""
    told = F.raise_error(F.lit("CHECK OPTION failed")).cast("boolean")
    return rows.where(F.when(condition, F.lit(True)).otherwise(told))


def with_triggers(table: DataFrame, rows: DataFrame, before=None, after=None) -> tuple[DataFrame, DataFrame | None]:
    """An insert with its triggers: ``before`` makes each new row what is stored, ``after`` makes
    of the stored new rows the rows of another table. Both are functions of a DataFrame, so the
    triggers are part of the statement's plan. Gives the table's content and the other rows."""
    new = (before(rows) if before else rows).select(*table.columns)
    return table.unionByName(new), after(new) if after else None


def update_with_triggers(table: DataFrame, where: Column, values: dict[str, Column], before=None, after=None) -> tuple[DataFrame, DataFrame | None]:
    """An update with its triggers. ``before`` and ``after`` get the rows that the condition hits, with the structs ``old`` and ``new``;
    ``before`` gives ``old`` and the ``new`` that is stored, ``after`` the rows of another table."""
    hit = F.coalesce(where, F.lit(False))
    made = [(values[c] if c in values else F.col(c)).cast(t).alias(c) for c, t in table.dtypes]
    changed = table.where(hit).select(F.struct(*table.columns).alias("old"), F.struct(*made).alias("new"))
    changed = before(changed) if before else changed
    return table.where(~hit).unionByName(changed.select("new.*").select(*table.columns)), after(changed) if after else None


def delete_with_triggers(table: DataFrame, where: Column, before=None, after=None) -> tuple[DataFrame, DataFrame | None]:
    """A delete with its triggers, which get the rows that go as the struct ``old``. ``before`` gives those that really go: it can
    leave some out, or fail the statement."""
    hit = F.coalesce(where, F.lit(False))
    gone = table.where(hit).select(F.struct(*table.columns).alias("old"))
    if before is None:
        return table.where(~hit), after(gone) if after else None
    goes = before(gone)
    stays = gone.exceptAll(goes.select("old")).select("old.*")
    return table.where(~hit).unionByName(stays), after(goes) if after else None


def row_count(table: DataFrame, where: Column, values: dict[str, Column]) -> int:
    """ROW_COUNT() of an update: the rows that really change, not those that are hit."""
    other = F.lit(False)
    for c, v in values.items():
        other = other | ~F.col(c).eqNullSafe(v.cast(dict(table.dtypes)[c]))
    return table.where(F.coalesce(where, F.lit(False)) & other).count()


def insert_auto(table: DataFrame, rows: DataFrame, column: str, order: str) -> tuple[DataFrame, int]:
    """An insert into a table with an AUTO_INCREMENT column: rows without a number (null or 0) get the next ones in their
    order. Gives the table's content and LAST_INSERT_ID(), the first number that was made (0 if none was). The
    next number is one above the table's and the rows' own; no task holds all rows."""
    from ..plans.statements import running_spread

    empty = F.col(column).isNull() | (F.col(column) == 0)
    highest = table.select(F.max(column)).union(rows.where(~empty).select(F.max(column))).agg(F.max(F.col(table.select(F.max(column)).columns[0]))).first()[0] or 0
    made = running_spread(rows.where(empty), [], [F.col(order)], _next=F.lit(1))
    made = made.withColumn(column, (F.col("_next") + highest).cast(dict(table.dtypes)[column]))
    content = table.unionByName(rows.where(~empty).select(*table.columns)).unionByName(made.select(*table.columns))
    return content, int(highest) + 1 if not rows.where(empty).isEmpty() else 0
