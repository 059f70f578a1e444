"""Mapping detected nodes to authored ones: the k-th of a title claims the k-th of the same title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions.text import normalise_title
from lectern.session import durable


def _nth(df: DataFrame, *keys: str, order: str = "position") -> DataFrame:
    return df.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(order)))


def join_locations(detected: DataFrame, authored: DataFrame) -> DataFrame:
    """``(book_id, record_id, loc)`` for every detected node that an authored one answers to.

    ``detected`` has book_id, record_id, parent_id, kind, title, position; ``authored`` the same with loc and
    parent_loc.  Chapters, front and back matter share one pool; sections claim within their resolved chapter; a
    section of an unresolved chapter may claim the only unclaimed section of its title in the book, the first one.
    """
    # Both sides are read several times below, the claims of chapters and sections too.
    d = durable(detected.withColumn("norm", normalise_title(F.col("title"))), "detected")
    a = durable(authored.withColumn("norm", normalise_title(F.col("title"))), "authored")
    top = _nth(d.where("kind != 'section'"), "book_id", "norm").join(
        _nth(a.where("kind != 'section'"), "book_id", "norm").select("book_id", "norm", "nth", "loc"), ["book_id", "norm", "nth"]
    ).select("book_id", "record_id", "loc")
    top = durable(top, "claims")
    low = d.where("kind = 'section'").join(
        top.select("book_id", F.col("record_id").alias("parent_id"), F.col("loc").alias("parent_loc")), ["book_id", "parent_id"], "left"
    )
    within = _nth(low.where("parent_loc is not null"), "book_id", "parent_loc", "norm").join(
        _nth(a.where("kind = 'section'"), "book_id", "parent_loc", "norm").select("book_id", "parent_loc", "norm", "nth", "loc"),
        ["book_id", "parent_loc", "norm", "nth"],
    ).select("book_id", "record_id", "loc")
    within = durable(within, "claims")
    rest = a.where("kind = 'section'").join(within.select("book_id", "loc"), ["book_id", "loc"], "left_anti")
    single = rest.groupBy("book_id", "norm").agg(F.count("*").alias("n"), F.min("loc").alias("loc")).where("n = 1").drop("n")
    orphans = _nth(low.where("parent_loc is null"), "book_id", "norm").where("nth = 1")
    last = orphans.join(single, ["book_id", "norm"]).select("book_id", "record_id", "loc")
    return top.unionByName(within).unionByName(last)


def locate_hits(hits: DataFrame, links: DataFrame, located: DataFrame) -> DataFrame:
    """Hits with a location; those without keep their place in the ranking as a gap.

    ``hits`` has query_id, rank, record_type, record_id; ``links`` leads knowledge objects to a section or else a
    chapter (record_id, section_id, chapter_id).
    """
    at = hits.join(links, "record_id", "left").withColumn(
        "node", F.when(F.col("record_type") == "knowledge_object", F.coalesce("section_id", "chapter_id")).otherwise(F.col("record_id"))
    )
    return at.join(located.select(F.col("record_id").alias("node"), "loc"), "node").select("query_id", "rank", "record_id", "loc")
