"""Prompts as columns: built for all books at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hint fields of a profile prompt with their labels.
HINTS = (("primary_topic", "Primary topic"), ("language", "Language"), ("framework", "Framework"), ("methodology", "Methodology"), ("notes", "Notes"), ("trust_level", "Trust level"), ("intended_use", "Intended use"))


_JSON = " Answer with nothing but JSON."
#: What a model is told about its task, by stage.
SYSTEM = {
    "profile": "You describe a book for readers who look for sources: its subject, its level, what it is good for and what it leaves out. Write plain prose.",
    "extraction": "You take knowledge out of a chapter. Give an array of objects with type (Practice, Principle, Tradeoff, Anti-pattern, Smell, Decision Rule, Definition, Glossary or Checklist), title, "
    "content, summary, confidence (0 to 1), section_index (a number of the list, or null), page and paragraph (numbers or null)." + _JSON,
    "summaries": "You summarise a chapter and each of its numbered sections from its text alone. Give an object with chapter_summary and section_summaries (an array in the order of the list)." + _JSON,
    "claims": "You take a summary apart. Give an array of the single claims it makes, each a sentence that can be checked by itself." + _JSON,
    "verdict": "You check one claim against a source and use no other knowledge. Give an object with supported (true or false) and why." + _JSON,
}


def claim_prompt(summary: str) -> str:
    return f"Summary to take apart:\n{summary}"


def verdict_prompt(claim: str, source: str) -> str:
    return f"Source:\n{source}\n\nClaim to check: {claim}"


def _joined(*parts: Column) -> Column:
    """Lines of the parts that are not null."""
    return F.concat_ws("\n", *parts)


def chapter_scaffold(books: DataFrame, chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """``(chapter_id, book_id, scaffold)``: the part of a chapter's prompt before its text."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "section_id", "title")))
    listed = sections.groupBy("chapter_id").agg(ordered.alias("s")).select(
        "chapter_id", F.array_join(F.transform("s", lambda x, i: F.concat(i.cast("string"), F.lit(". "), x["title"])), "\n").alias("sections")
    )
    rows = chapters.select("chapter_id", "book_id", "position", F.col("title").alias("chapter_title")).join(books.select("book_id", "title", "author"), "book_id").join(listed, "chapter_id", "left")
    scaffold = _joined(
        F.concat(F.lit("Book: "), "title", F.lit(" by "), "author"), F.concat(F.lit("Chapter "), (F.col("position") + 1).cast("string"), F.lit(": "), "chapter_title"),
        F.lit(""), F.lit("Numbered sections in this chapter:"), F.coalesce("sections", F.lit("(none detected)")),
    )
    return rows.select("chapter_id", "book_id", scaffold.alias("scaffold"))


def chapter_prompt(scaffold: Column, body: Column, instruction: str) -> Column:
    return _joined(scaffold, F.lit(""), F.lit("Chapter text:"), body, F.lit(""), F.lit(instruction))


def profile_prompt(books: DataFrame, outline: DataFrame) -> DataFrame:
    """``(book_id, prompt)``; ``outline`` has book_id and the outline's lines as one text, or no row."""
    some = lambda c: (F.col(c).isNotNull()) & (F.col(c).cast("string") != "")
    line = lambda label, c: F.when(some(c), F.concat(F.lit(f"{label}: "), F.col(c).cast("string")))
    hints = F.concat_ws("\n", *[F.when(some(c), F.concat(F.lit(f"- {label}: "), F.col(c))) for c, label in HINTS])
    block = F.when(hints != "", F.concat(F.lit("\nHints supplied by the human curator:\n"), hints))
    rows = books.join(outline, "book_id", "left")
    prompt = _joined(
        F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Author: "), "author"), line("Edition", "edition"), line("Publication year", "publication_year"), line("ISBN", "isbn"), block,
        F.when(F.col("outline").isNotNull(), F.concat(F.lit("\nDetected structure:\n"), "outline")), F.lit(""), F.lit("Write the book profile."),
    )
    return rows.select("book_id", prompt.alias("prompt"))
