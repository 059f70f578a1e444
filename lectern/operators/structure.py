"""Chapters and sections of markdown, for all documents at once.

Headings are found inside each row by higher-order functions (no shuffle, whole texts); what is exploded and windowed
are only the headings, keyed by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions import text as T

# Titles that are front or back matter as a whole, or by their beginning.
FRONT = r"(?i)^(cover|half title|title page|copyright( page)?|contents|table of contents|dedication|epigraph|foreword)$|^(preface|list of (figures|tables|illustrations))\b"
BACK = r"(?i)^(index|bibliography|references|glossary|notes|epilogue|afterword|further reading|credits|colophon|errata)$|^appendix\b"
EITHER = r"(?i)^(acknowledg|about the )"
BARE_NUMBER = r"(?i)^(chapter|part)\s+(\d+|[ivxlcdm]+)\.?$"
#: Lines that a number and its title may be apart.
MERGE_GAP = 3


def _outside_fences(numbered: Column) -> Column:
    """Closed intervals of lines that a code fence covers, as [start, end] structs; an open one runs on."""
    fences = F.filter(numbered, lambda x: x["text"].rlike("^(```|~~~)"))
    events = F.transform(fences, lambda x: F.struct(x["n"].alias("n"), F.substring(x["text"], 1, 3).alias("m")))
    zero = F.struct(F.lit("").alias("open"), F.lit(0).alias("since"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def step(acc: Column, e: Column) -> Column:
        opens, closes = acc["open"] == "", acc["open"] == e["m"]
        return F.struct(
            F.when(opens, e["m"]).when(closes, "").otherwise(acc["open"]).alias("open"),
            F.when(opens, e["n"]).otherwise(acc["since"]).alias("since"),
            F.when(closes & ~opens, F.concat(acc["spans"], F.array(F.struct(acc["since"].alias("a"), e["n"].alias("b"))))).otherwise(acc["spans"]).alias("spans"),
        )

    def finish(acc: Column) -> Column:
        tail = F.array(F.struct(acc["since"].alias("a"), F.lit(2**31 - 1).alias("b")))
        return F.when(acc["open"] != "", F.concat(acc["spans"], tail)).otherwise(acc["spans"])

    return F.aggregate(events, zero, step, finish)


def headings(documents: DataFrame, key: str, markdown: str) -> DataFrame:
    """``(key, level, title, line)`` of every heading outside fenced code; null texts have none."""
    numbered = F.transform(T.lines(F.col(markdown)), lambda x, i: F.struct((i + 1).cast("int").alias("n"), x.alias("text")))
    found = (
        documents.where(F.col(markdown).isNotNull())
        .select(key, numbered.alias("numbered"))
        .select(key, "numbered", _outside_fences(F.col("numbered")).alias("spans"))
        .select(key, F.explode(F.filter("numbered", lambda x: x["text"].startswith("#") & ~F.exists("spans", lambda s: (x["n"] >= s["a"]) & (x["n"] <= s["b"])))).alias("h"))
    )
    pattern = rf"^(#{{1,6}}){T.SPACE}+(.*?){T.SPACE}*#*{T.SPACE}*$"
    raw = F.regexp_extract("h.text", pattern, 2)
    return (
        found.select(key, F.length(F.regexp_extract("h.text", pattern, 1)).alias("level"), T.strip_emphasis(raw).alias("title"), F.col("h.n").alias("line"))
        .where("level > 0 and title != ''")
    )


def detect(documents: DataFrame, key: str = "book_id", markdown: str = "markdown") -> DataFrame:
    """``(key, chapter, section, kind, title, line)``: the tree in document order.

    ``chapter`` and ``section`` are positions from 0; a chapter's own row has a null section.
    """
    h = headings(documents, key, markdown)
    per = W.partitionBy(key)
    h = h.withColumn("top", F.min("level").over(per)).withColumns(
        {"alone": F.count_if(F.col("level") == F.col("top")).over(per) == 1, "deeper": F.max("level").over(per) > F.col("top")}
    )
    h = h.where(~(F.col("alone") & F.col("deeper") & (F.col("level") == F.col("top"))))
    h = h.withColumn("chapter_level", F.min("level").over(per))
    h = h.withColumn("section_level", F.min(F.when(F.col("level") > F.col("chapter_level"), F.col("level"))).over(per))
    order = per.orderBy("line")
    bare = F.col("title").rlike(BARE_NUMBER)
    joins = (
        (F.col("level") == F.col("chapter_level")) & bare & (F.lead("level").over(order) == F.col("chapter_level"))
        & ~F.lead(bare).over(order) & (F.lead("line").over(order) - F.col("line") <= MERGE_GAP)
    )
    h = h.withColumns({"joins": F.coalesce(joins, F.lit(False)), "next": F.lead("title").over(order)})
    h = h.withColumn("taken", F.coalesce(F.lag("joins").over(order), F.lit(False))).where("not taken")
    h = h.withColumn("title", F.when(F.col("joins"), F.concat("title", F.lit(": "), "next")).otherwise(F.col("title")))
    h = h.where((F.col("level") == F.col("chapter_level")) | (F.col("level") == F.col("section_level")))
    is_chapter = F.col("level") == F.col("chapter_level")
    h = h.withColumn("chapter", F.count_if(is_chapter).over(order) - 1).where("chapter >= 0")
    h = h.withColumn("section", F.when(~is_chapter, F.row_number().over(W.partitionBy(key, "chapter").orderBy("line")) - 2))
    return _matter(h, key).select(key, F.col("chapter").cast("int"), F.col("section").cast("int"), "kind", "title", F.col("line").cast("int"))


def _matter(h: DataFrame, key: str) -> DataFrame:
    title = F.col("title")
    row = F.when(F.col("section").isNotNull(), "section").when(title.rlike(FRONT), "front_matter").when(title.rlike(BACK), "back_matter").when(title.rlike(EITHER), "either").otherwise("chapter")
    h = h.withColumn("kind", row)
    before = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.col("kind") == "chapter").over(before), F.lit(False))
    h = h.withColumn("kind", F.when(F.col("kind") == "either", F.when(seen, "back_matter").otherwise("front_matter")).otherwise(F.col("kind")))
    # An unknown first title directly before front matter is the title page.
    second = F.max(F.when((F.col("chapter") == 1) & F.col("section").isNull(), F.col("kind"))).over(W.partitionBy(key))
    page = (F.col("chapter") == 0) & F.col("section").isNull() & (F.col("kind") == "chapter") & (second == "front_matter")
    return h.withColumn("kind", F.when(page, "front_matter").otherwise(F.col("kind")))


def _sliced(documents: DataFrame, starts: DataFrame, key: str, markdown: str, name: str) -> DataFrame:
    """``(key, name, body)``: the lines of each start up to the next one, cut inside the document's row.

    ``starts`` has key, ord (the order of the starts), name and line; a start without a line has the whole document.
    The document moves once, beside the short list of its starts.
    """
    spots = starts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "line", name))).alias("spots"))
    rows = documents.select(key, T.lines(F.col(markdown)).alias("all")).join(spots, key)

    def body(x: Column, i: Column) -> Column:
        stop = F.coalesce(F.get(F.col("spots"), i + 1)["line"], F.size("all") + 1)
        part = F.slice("all", x["line"], F.greatest(stop - x["line"], F.lit(0)))
        return F.struct(x[name].alias(name), F.array_join(F.when(x["line"].isNull(), F.col("all")).otherwise(part), "\n").alias("body"))

    return rows.select(key, F.explode(F.transform("spots", body)).alias("part")).select(key, f"part.{name}", "part.body")


def bodies(documents: DataFrame, tree: DataFrame, key: str = "book_id", markdown: str = "markdown") -> DataFrame:
    """``(key, chapter, body)``: each chapter's lines from its heading to the next chapter's."""
    starts = tree.where("section is null").select(key, F.col("chapter").alias("ord"), F.col("line").cast("int").alias("line"), "chapter")
    return _sliced(documents, starts, key, markdown, "chapter")


def section_slices(documents: DataFrame, tree: DataFrame, key: str = "book_id", markdown: str = "markdown") -> DataFrame:
    """``(key, line, body)``: each node's own lines up to the next heading of either level; a node without line has none."""
    starts = tree.where("line is not null").select(key, F.col("line").alias("ord"), F.col("line").cast("int").alias("line"), F.col("line").alias("at")).distinct()
    return _sliced(documents, starts, key, markdown, "at").withColumnRenamed("at", "line")


def flatten(chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """``(book_id, position, record_id, parent_id, kind, title)``: chapters, each followed by its sections.

    Stored matter kinds become the hyphenated ones of the evaluation; an unknown kind is a chapter.
    """
    kind = F.when(F.col("kind") == "front_matter", "front-matter").when(F.col("kind") == "back_matter", "back-matter").otherwise("chapter")
    top = chapters.select("book_id", F.col("position").alias("c"), F.lit(-1).alias("s"), F.col("chapter_id").alias("record_id"), F.lit(None).cast("string").alias("parent_id"), kind.alias("kind"), "title")
    low = sections.select("section_id", "chapter_id", "position", "title").alias("x").join(chapters.select("chapter_id", "book_id", F.col("position").alias("c")), "chapter_id").select(
        "book_id", "c", F.col("x.position").alias("s"), F.col("x.section_id").alias("record_id"), F.col("chapter_id").alias("parent_id"), F.lit("section").alias("kind"), F.col("x.title").alias("title")
    )
    order = W.partitionBy("book_id").orderBy("c", "s", "record_id")
    return top.unionByName(low).withColumn("position", F.row_number().over(order) - 1).select("book_id", "position", "record_id", "parent_id", "kind", "title")
