"""Writes as plans: a new state of a table is a DataFrame, or several are a mapping of them; sources.tables writes what belongs
together as one. Rows are carried whole, so callers' columns may have any names."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import named, packed, unpacked


def _numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """row, key (a struct), n: each row's place among those of its key."""
    keys = [named(k) for k in keys]
    return rows.select(packed(rows), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"), F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("n"))


def _keys(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Different keys without a null; as a struct like that of _numbered()."""
    there = F.lit(True)
    for k in keys:
        there = there & named(k).isNotNull()
    return table.where(there).select(F.struct(*[named(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("key")).distinct()


def insert_if_absent(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new whose key is not in table; the first of equal keys by all columns. A null is in no table."""
    one = _numbered(new, keys, [named(c) for c in new.columns]).where("n = 1")
    return one.join(_keys(table, keys), "key", "left_anti").select(*unpacked(new.columns))


def upsert(table: DataFrame, new: DataFrame, key: str, update: Sequence[str] | None = None) -> DataFrame:
    """New state: rows of new win for the columns to update (all but the key by default), others keep what they have."""
    update = [c for c in table.columns if c != key] if update is None else list(update)
    both = table.select(packed(table, "old"), named(key).alias("key")).join(new.select(packed(new, "new"), named(key).alias("key")), "key", "full_outer")
    old, fresh = F.col("old"), F.col("new")

    def cell(c: str) -> Column:
        if c == key:
            return F.col("key").alias(c)
        if c not in new.columns:
            return old.getField(c).alias(c)
        wins = fresh.isNotNull() if c in update else old.isNull()
        return F.when(wins, fresh.getField(c)).otherwise(old.getField(c)).alias(c)

    return both.select(*[cell(c) for c in table.columns])


def save_batch(tables: dict[str, DataFrame], new: DataFrame, update: Sequence[str], extract: Callable[[DataFrame], DataFrame], children: dict[str, tuple[str, DataFrame]] | None = None, table: str = "Event", key: str = "id") -> dict[str, DataFrame]:
    """New states, to be committed as one, for a batch of rows: key data is extracted anew from each (extract: rows with the
    derived columns), known ids take the columns in update, unknown ones come whole, of a repeated id the first row counts;
    children (name -> its foreign key, new rows) of the batch's rows are replaced."""
    rows = _numbered(new, [key], [named(c) for c in new.columns]).where("n = 1").select(*unpacked(new.columns))
    out = {table: upsert(tables[table], extract(rows), key, update)}
    for name, (foreign, child_rows) in (children or {}).items():
        parents = rows.select(named(key).alias(foreign))
        mine = child_rows.join(parents, foreign, "left_semi").select(*[named(c) for c in child_rows.columns])
        out[name] = without(tables[name], parents, [foreign]).unionByName(mine)
    return out


def keep_newest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return _numbered(rows, [key], order).where("n = 1").select(*unpacked(rows.columns))


def without(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deletes by key; a null key is never deleted."""
    rows = table.select(packed(table), F.struct(*[named(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"))
    return rows.join(_keys(gone, keys), "key", "left_anti").select(*unpacked(table.columns))


def replace_children(children: DataFrame, foreign: str, new: DataFrame) -> DataFrame:
    """All children of the parents in new are replaced by its rows."""
    return without(children, new, [foreign]).unionByName(new)


def valid_split(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the quarantine."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def inserted(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new with is_new: whether insert_if_absent would add them (of equal keys the first does)."""
    rows = _numbered(new, keys, [named(c) for c in new.columns])
    there = _keys(table, keys).withColumn("there", F.lit(True))
    return rows.join(there, "key", "left").select(*unpacked(new.columns), ((F.col("n") == 1) & F.col("there").isNull()).alias("is_new"))


def save_counts(table: DataFrame, new: DataFrame, keys: Sequence[str], valid: Column) -> DataFrame:
    """fetched, saved, errors, duplicates of an ingest: rows that aren't valid are errors, known or repeated ones neither."""
    good, bad = valid_split(new, valid)
    marked = inserted(table, good, keys)
    counts = marked.agg(F.count("*").alias("good"), F.count_if("is_new").alias("saved"))
    return counts.crossJoin(bad.agg(F.count("*").alias("errors"))).select((F.col("good") + F.col("errors")).alias("fetched"), "saved", "errors", (F.col("good") - F.col("saved")).alias("duplicates"))


def delete_one(table: DataFrame, **keys) -> DataFrame:
    """The table without the row of a composite key; an error where it isn't there."""
    hit = F.lit(True)
    for name, value in keys.items():
        hit = hit & (F.col(name) == F.lit(value))
    if table.where(hit).isEmpty():
        raise KeyError(f"no row of {keys}")
    return table.where(~F.coalesce(hit, F.lit(False)))


def delete_count(table: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The table without the rows of a condition, and how many those are (deleted; 0 is fine)."""
    return table.where(~F.coalesce(condition, F.lit(False))), table.agg(F.count_if(F.coalesce(condition, F.lit(False))).alias("deleted"))


def update_supplied(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New state: of the rows in new only what it supplies (not null) changes; rows it lacks stay; it adds none."""
    both = table.select(packed(table, "old"), named(key).alias("key")).join(new.select(packed(new, "new"), named(key).alias("key")), "key", "left")
    old, fresh = F.col("old"), F.col("new")
    return both.select(*[(F.coalesce(fresh.getField(c), old.getField(c)) if c in new.columns and c != key else old.getField(c)).alias(c) for c in table.columns])


def with_dimension(rows: DataFrame, name: str, dimension: DataFrame, blank: str = "Unknown Company") -> tuple[DataFrame, DataFrame]:
    """The dimension(id, name) with the names of rows that it lacks (ids from a hash of the name; blank and null ones share a
    name), and rows with their dimension_id."""
    shown = F.when(F.length(F.trim(F.coalesce(name, F.lit("")))) > 0, F.trim(F.col(name))).otherwise(F.lit(blank))
    asked = rows.withColumn("__name", shown)
    new = asked.select(F.col("__name").alias("name")).distinct().join(dimension.select("name"), "name", "left_anti")
    every = dimension.select("id", "name").unionByName(new.select(F.concat(F.lit("org_"), F.hex(F.xxhash64("name"))).alias("id"), "name"))
    return every, asked.join(every.select(F.col("id").alias("dimension_id"), F.col("name").alias("__name")), "__name").drop("__name")


def orphans(children: DataFrame, foreign: str, parents: DataFrame, key: str) -> DataFrame:
    """Audit of a foreign key: children whose parent isn't there; a null refers to none."""
    return children.where(F.col(foreign).isNotNull()).join(parents.select(F.col(key).alias(foreign)), foreign, "left_anti")


def split_nested(events: DataFrame, key: str, lists: Sequence[str]) -> dict[str, DataFrame]:
    """An insert with nested children as rows of each child table: id (deterministic), key, ord, and the child's fields."""
    out = {}
    for name in lists:
        x = events.select(key, F.posexplode(name).alias("ord", "x"))
        fields = ["x.*"] if "struct" in events.schema[name].dataType.elementType.typeName() else [F.col("x").alias("name")]
        out[name] = x.select(F.concat(F.lit(f"{name}_"), F.hex(F.xxhash64(key, "ord"))).alias("id"), key, "ord", *fields)
    return out
