"""Foreign keys and unique keys of a set of tables: deletes that reach their children, and what breaks a constraint.

Tables are a name -> DataFrame mapping; references are child -> {column: parent} as in schemas.REFERENCES. A new state is a
mapping again, to be committed as one (sources.tables)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import named
from ..schemas import REFERENCES, RESTRICTED, UNIQUE

References = Mapping[str, Mapping[str, str]]


def parents_first(references: References = REFERENCES) -> list[str]:
    """All tables, each behind those it refers to (by name where there is a choice); a cycle is an error. A table may refer to
    itself only if a delete needn't follow, so that counts as a cycle too."""
    needs = {t: set() for refs in references.values() for t in refs.values()} | {t: set(refs.values()) for t, refs in references.items()}
    out: list[str] = []
    while needs:
        free = sorted(t for t, on in needs.items() if not on - set(out))
        if not free:
            raise ValueError(f"tables refer to each other: {sorted(needs)}")
        out += free
        needs = {t: on for t, on in needs.items() if t not in free}
    return out


def _key(table: str, keys: Mapping[str, str] | None) -> str:
    return (keys or {}).get(table, "id")


def deleted(tables: Mapping[str, DataFrame], gone: Mapping[str, DataFrame], references: References = REFERENCES, restricted: Iterable[tuple[str, str]] = RESTRICTED, keys: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """What a delete takes from each table it reaches: table -> keys, one column. gone: table -> rows to delete (their key
    column). References in restricted don't pass a delete on (see blocked()); a null refers to nothing.

    One semi-join for each reference into a table that loses rows, parents before children."""
    out: dict[str, DataFrame] = {}
    for table in parents_first(references):
        if table not in tables:
            continue
        key, rows = _key(table, keys), tables[table]
        parts = [gone[table].select(F.col(_key(table, keys)).alias(key))] if table in gone else []
        for column, parent in references.get(table, {}).items():
            if parent in out and (table, column) not in set(restricted):
                lost = out[parent].select(F.col(_key(parent, keys)).alias("__parent"))
                parts.append(rows.join(lost, F.col(column) == F.col("__parent"), "left_semi").select(key))
        if parts:
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p)
            out[table] = whole.distinct()
    return out


def blocked(tables: Mapping[str, DataFrame], lost: Mapping[str, DataFrame], references: References = REFERENCES, restricted: Iterable[tuple[str, str]] = RESTRICTED, keys: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Rows that forbid a delete (lost: of deleted()): "table.column" -> rows of restricted references to lost rows that aren't
    lost themselves."""
    out = {}
    for table, column in restricted:
        parent = references[table][column]
        if parent in lost and table in tables:
            gone = lost[parent].select(F.col(_key(parent, keys)).alias("__parent"))
            rows = tables[table].join(gone, F.col(column) == F.col("__parent"), "left_semi")
            if table in lost:
                rows = rows.join(lost[table], _key(table, keys), "left_anti")
            out[f"{table}.{column}"] = rows
    return out


def delete_cascade(tables: Mapping[str, DataFrame], gone: Mapping[str, DataFrame], references: References = REFERENCES, restricted: Iterable[tuple[str, str]] = RESTRICTED, keys: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """The tables that a delete changes, without the rows it takes; an error where a restricted reference forbids it.

    A row goes by its own key and references: where a table's key repeats, other rows of that key stay."""
    restricted = list(restricted)
    lost = deleted(tables, gone, references, restricted, keys)
    for name, rows in blocked(tables, lost, references, restricted, keys).items():
        if not rows.isEmpty():
            raise ValueError(f"rows of {name} refer to what is to be deleted")
    out = {}
    for t in lost:
        rows = tables[t]
        if t in gone:
            rows = rows.join(gone[t].select(_key(t, keys)), _key(t, keys), "left_anti")
        for column, parent in references.get(t, {}).items():
            if parent in lost and (t, column) not in restricted:
                rows = rows.join(lost[parent].select(F.col(_key(parent, keys)).alias("__parent")), F.col(column) == F.col("__parent"), "left_anti")
        out[t] = rows.select(*[F.col(f"`{c}`") for c in tables[t].columns])
    return out


def unique_violations(tables: Mapping[str, DataFrame], unique: Mapping[str, Sequence[Sequence[str]]] = UNIQUE) -> DataFrame | None:
    """constraint, key (as text), times: values that more than one row has. A null in any of a key's columns breaks nothing."""
    out = None
    for table, all_keys in unique.items():
        for columns in all_keys if table in tables else []:
            values = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias("values")
            full = tables[table].select(values).where(" and ".join(f"values.c{i} is not null" for i in range(len(columns))))
            some = full.groupBy("values").agg(F.count("*").alias("times")).where("times > 1")
            text = F.concat_ws("|", *[F.col(f"values.c{i}").cast("string") for i in range(len(columns))])
            rows = some.select(F.lit(f"{table}({', '.join(columns)})").alias("constraint"), text.alias("key"), "times")
            out = rows if out is None else out.unionByName(rows)
    return out
