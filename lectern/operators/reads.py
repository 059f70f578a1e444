"""Reads of the relational tables: lists, views, histories, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# The nine types of knowledge.
KNOWLEDGE_TYPES = ("Practice", "Principle", "Tradeoff", "Anti-pattern", "Smell", "Decision Rule", "Definition", "Glossary", "Checklist")
LLM_STAGES = ("profile", "extraction", "summaries")
# Versions of the prompts.
PROMPT_VERSIONS = (("profile", "profile=1"), ("extraction", "extraction=2"), ("summaries", "summary=1"))


class NotFound(LookupError):
    """No row has the id."""


def once(df: DataFrame, key: str) -> DataFrame:
    """Each record once: a row delivered again equals the first in all columns."""
    return df.dropDuplicates([key])


#: Keys of repeated rows that may be sent to every worker.
MOST_REPEATED = 200_000


def once_wide(df: DataFrame, key: str) -> DataFrame:
    """Each record once, for tables of long texts: only rows whose key comes again are exchanged.

    Repeated keys are found on the key column alone.  Up to ``MOST_REPEATED`` of them are broadcast; with more, all
    rows are exchanged by key as in ``once``.
    """
    twice = df.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(key)
    keys = twice.limit(MOST_REPEATED + 1).collect()
    if not keys:
        return df
    if len(keys) > MOST_REPEATED:
        return once(df, key)
    repeated = F.broadcast(df.sparkSession.createDataFrame(keys, twice.schema))
    return df.join(repeated, key, "left_anti").unionByName(df.join(repeated, key, "left_semi").dropDuplicates([key]))


def by_id(df: DataFrame, key: str, value: str) -> DataFrame:
    """The one row of an id; raises where there is none."""
    found = once(df.where(F.col(key) == value), key)
    if found.isEmpty():
        raise NotFound(f"no {key} {value}")
    return found


def list_books(books: DataFrame) -> DataFrame:
    return once(books, "book_id").orderBy("uploaded_at", "book_id")


def book_chapters(chapters: DataFrame, book_id: str) -> DataFrame:
    return once(chapters.where(F.col("book_id") == book_id), "chapter_id").orderBy("position", "chapter_id")


def structure_view(chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """Each chapter with its sections nested in order; a chapter without sections has an empty list."""
    nested = once(sections, "section_id").groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("position", "title"))).alias("sections"))
    top = once(chapters, "chapter_id").select("book_id", "chapter_id", "position", "title", "kind")
    return top.join(nested, "chapter_id", "left").withColumn("sections", F.coalesce("sections", F.array().cast("array<struct<position:int,title:string>>")))


def latest(df: DataFrame, group: str, time: str, key: str) -> DataFrame:
    """The newest version of each group; equal times go to the greater id."""
    order = W.partitionBy(group).orderBy(F.desc(time), F.desc(key))
    return once(df, key).withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def history(df: DataFrame, time: str, key: str, **where: str) -> DataFrame:
    for column, value in where.items():
        df = df.where(F.col(column) == value)
    return once(df, key).orderBy(time, key)


def knowledge(objects: DataFrame, book_id: str | None = None, kind: str | None = None) -> DataFrame:
    if kind is not None and kind not in KNOWLEDGE_TYPES:
        raise ValueError(f"unknown knowledge type {kind}")
    if book_id is not None:
        objects = objects.where(F.col("book_id") == book_id)
    if kind is not None:
        objects = objects.where(F.col("type") == kind)
    return once(objects, "object_id").orderBy("created_at", "object_id")


def token_totals(reports: DataFrame, run: str, stage: str = "stage") -> DataFrame:
    """Billed tokens of each run: null unless it has a stage that calls a model, an unreported count as 0."""
    has = F.max(F.col(stage).isin(*LLM_STAGES))
    total = lambda c: F.when(has, F.sum(F.when(F.col(stage).isin(*LLM_STAGES), F.coalesce(F.col(c), F.lit(0))))).alias(c)
    return reports.groupBy(run).agg(total("input_tokens"), total("output_tokens"), F.count_if(F.col("input_tokens").isNull()).alias("unreported"))


def version_stamps(stages: DataFrame, run: str, stage: str = "stage") -> DataFrame:
    """Prompt versions of the stages that a run has, in a fixed order; null where none has a prompt."""
    parts = [F.max(F.when(F.col(stage) == name, stamp)).alias(name) for name, stamp in PROMPT_VERSIONS]
    grouped = stages.groupBy(run).agg(*parts)
    return grouped.select(run, F.nullif(F.concat_ws(",", *[name for name, _ in PROMPT_VERSIONS]), F.lit("")).alias("prompt_version"))


def update_metadata(books: DataFrame, book_id: str, **fields: object) -> DataFrame:
    """The table with some metadata of a book changed.

    Title and author cannot be cleared, an empty string clears any other field, the year must be a number, and what
    records the file's provenance cannot be edited.
    """
    editable = {"title", "author", "edition", "publication_year", "isbn", "primary_topic", "language", "framework", "methodology", "notes", "trust_level", "intended_use"}
    unknown = sorted(set(fields) - editable)
    if unknown:
        raise ValueError(f"not editable: {', '.join(unknown)}")
    changes = {}
    for name, value in fields.items():
        if value is None:
            continue
        if value == "" and name in ("title", "author"):
            raise ValueError(f"{name} cannot be empty")
        if name == "publication_year" and value != "" and not str(value).lstrip("-").isdigit():
            raise ValueError("publication_year must be a whole number")
        new = F.lit(None if value == "" else value).cast(books.schema[name].dataType)
        changes[name] = F.when(F.col("book_id") == book_id, new).otherwise(F.col(name))
    return books.withColumns(changes) if changes else books


def register(books: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` whose content is not registered yet, one for each hash (the smallest id)."""
    fresh = new.join(books.select("file_hash").distinct(), "file_hash", "left_anti")
    order = W.partitionBy("file_hash").orderBy("book_id")
    return fresh.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def duplicates(books: DataFrame) -> DataFrame:
    """``(book_id, file_hash, kept_id)``: registrations of a file that another registration already has."""
    order = W.partitionBy("file_hash").orderBy("uploaded_at", "book_id")
    ranked = once(books, "book_id").where("file_hash is not null").select("book_id", "file_hash", F.row_number().over(order).alias("rn"), F.first("book_id").over(order).alias("kept_id"))
    return ranked.where("rn > 1").select("book_id", "file_hash", "kept_id")


def detached(objects: DataFrame, chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """Knowledge objects as a reader sees them: links to chapters or sections that are gone are null."""
    c = chapters.select(F.col("chapter_id").alias("chapter_id"), F.lit(True).alias("has_chapter")).distinct()
    s = sections.select("section_id", F.lit(True).alias("has_section")).distinct()
    rows = once(objects, "object_id").join(c, "chapter_id", "left").join(s, "section_id", "left")
    return rows.withColumns(
        {"chapter_id": F.when(F.col("has_chapter"), F.col("chapter_id")), "section_id": F.when(F.col("has_section"), F.col("section_id"))}
    ).drop("has_chapter", "has_section")


def embeddable(chapters: DataFrame, sections: DataFrame, objects: DataFrame) -> DataFrame:
    """``(book_id, ord, record_type, record_id, text)``: what is embedded, in the order that defines batches.

    Chapters and sections count only with a summary; a chapter comes before its sections, objects come last.
    """
    from lectern.functions import text as T

    ch = once(chapters, "chapter_id")
    top = ch.select("book_id", F.lit(0).alias("o1"), F.col("position").alias("o2"), F.lit(-1).alias("o3"), F.lit("chapter").alias("record_type"), F.col("chapter_id").alias("record_id"), F.col("summary").alias("text"))
    low = once(sections, "section_id").select("section_id", "chapter_id", "position", "summary").alias("s").join(ch.select("chapter_id", "book_id", F.col("position").alias("c")), "chapter_id").select(
        "book_id", F.lit(0).alias("o1"), F.col("c").alias("o2"), F.col("s.position").alias("o3"), F.lit("section").alias("record_type"), F.col("section_id").alias("record_id"), F.col("s.summary").alias("text")
    )
    ob = once(objects, "object_id").select(
        "book_id", F.lit(1).alias("o1"), F.lit(0).alias("o2"), F.lit(0).alias("o3"), F.lit("knowledge_object").alias("record_type"), F.col("object_id").alias("record_id"),
        T.embedded_text(F.col("type"), F.col("title"), F.col("summary"), F.col("content")).alias("text"),
    )
    rows = top.where("summary is not null and summary != ''").unionByName(low.where("text is not null and text != ''")).unionByName(ob)
    order = W.partitionBy("book_id").orderBy("o1", "o2", "o3", "record_id")
    return rows.withColumn("ord", F.row_number().over(order) - 1).select("book_id", "ord", "record_type", "record_id", "text")
