"""The tables of the store in a relational database, over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.store import Store

#: Parts in which a table is read at once; keys are UUIDs, so their first digits part it evenly.
PARTS = 16


def ranges(key: str, parts: int = PARTS) -> list[str]:
    """Conditions that cover every row once: ranges of a hexadecimal key's first two digits, rows beyond them in the last or first."""
    edges = [f"{256 * i // parts:02x}" for i in range(1, parts)]
    if not edges:
        return ["1 = 1"]
    first, last = f"{key} < '{edges[0]}' OR {key} IS NULL", f"{key} >= '{edges[-1]}'"
    return [first, *[f"{key} >= '{a}' AND {key} < '{b}'" for a, b in zip(edges, edges[1:], strict=False)], last]


def read(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = PARTS, quote: str = '"', **properties: str) -> DataFrame:
    """A table of the database; with a key it is read in parts at once, filters and columns go to the database.

    ``quote`` is what the database sets around names.
    """
    if key is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, predicates=ranges(f"{quote}{key}{quote}", parts), properties=properties)


def write(rows: DataFrame, url: str, table: str, keys: tuple[str, ...] = (), mode: str = "overwrite", **properties: str) -> None:
    """Write a table; one that exists keeps its definition and is emptied first.  ``keys``, which are never null, become
    columns of 36 letters, which a database can compare.

    Arrays and maps are written as JSON, as databases have no columns for them.
    """
    plain = rows.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes])
    writer = plain.write.mode(mode).option("truncate", True)
    if keys:
        writer = writer.option("createTableColumnTypes", ", ".join(f"{k} VARCHAR(36)" for k in keys))
    writer.jdbc(url, table, properties=properties)


def export(store: Store, url: str, **properties: str) -> list[str]:
    """Write the store's current books, structure, profiles, objects and runs to a database; returns the tables' names."""
    from lectern.plans import registration, runner

    tables = {
        "books": (registration.books(store), ("book_id",)),
        "chapters": (store.stage("chapters", runner.CHAPTERS), ("chapter_id", "book_id")),
        "sections": (store.stage("sections", runner.SECTIONS), ("section_id", "chapter_id", "book_id")),
        "book_profiles": (store.history("profiles", runner.PROFILES), ("profile_id", "book_id")),
        "knowledge_objects": (store.stage("objects", runner.OBJECTS), ("object_id", "book_id")),
        "runs": (store.runs(), ("run_id", "book_id")),
    }
    for name, (rows, keys) in tables.items():
        write(rows, url, name, keys, **properties)
    return list(tables)
