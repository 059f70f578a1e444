"""What the texts of source files say about themselves, against what the truth expects of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

# Characters a page below which a file is a scan, and how far a year may be off.
LEAST_CHARS, YEAR_OFF = 200, 1


def _some(*pairs: tuple[Column, Column | str]) -> Column:
    """The texts whose condition holds, as an array."""
    texts = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t) if isinstance(t, str) else t) for c, t in pairs])
    return F.filter(texts, lambda x: x.isNotNull())


def audited(files: DataFrame) -> DataFrame:
    """``files`` with notes and problems, as arrays of texts.

    ``files`` has unreadable, suffix, sha256, chars_per_page and front (the beginning of the text), and of the book it is
    taken for title, edition, year, isbn and pin, which may be null; a file taken for no book has a null title.

    A contradiction is a problem, silence is a note: a text that names other editions but not the expected one, or only
    copyrights from before the expected year.  A later copyright may be a reprint and an ISBN has several forms; both
    are notes.  A file that can't be read has that as its one problem.
    """
    front, book = F.coalesce("front", F.lit("")), F.col("title").isNotNull()
    stated = T.edition_claims(front, F.coalesce("title", F.lit("")))
    wanted = T.ordinal(F.coalesce("edition", F.lit("")))
    years = F.array_sort(F.array_distinct(T.copyright_years(T.normalise_source(front))))
    listed = lambda xs: F.array_join(xs.cast("array<string>"), ", ")
    rows = files.withColumns({"stated": F.when(book, stated).otherwise(F.array().cast("array<int>")), "wanted": F.when(book, wanted), "years": F.when(book, years).otherwise(F.array().cast("array<int>"))})
    some_edition, some_year = F.size("stated") > 0, F.size("years") > 0
    confirmed = F.array_contains("stated", F.col("wanted"))
    nearest = F.array_min(F.transform("years", lambda y: F.struct(F.abs(y - F.col("year")).alias("off"), y.alias("y"))))
    close, before = nearest["off"] <= YEAR_OFF, F.array_min("years") < F.col("year") - YEAR_OFF
    pinned = book & F.col("pin").isNotNull() & ~T.is_placeholder(F.col("pin"))
    isbn = F.contains(F.regexp_replace(front, "[^0-9]", ""), F.col("isbn"))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    edition, year = F.col("edition"), F.col("year")
    has_isbn = book & (F.coalesce("isbn", F.lit("")) != "")
    notes = _some(
        (F.col("suffix") == "epub", "an EPUB is read by one parser alone; a PDF would be read as the other books are"),
        (pinned & (F.col("pin") == F.col("sha256")), "pinned to these bytes"),
        (F.col("wanted").isNotNull() & some_edition & confirmed, said("edition ", edition, " is stated")),
        (F.col("wanted").isNotNull() & ~some_edition, said("edition ", edition, " is not stated; look by hand")),
        (book & (F.coalesce(edition, F.lit("")) != "") & F.col("wanted").isNull(), said("edition ", edition, " is no ordinal; look by hand")),
        (year.isNotNull() & some_year & close, said("copyright ", nearest["y"], " for an expected ", year)),
        (year.isNotNull() & some_year & ~close & ~before, said("copyright ", listed(F.col("years")), " is later than ", year, ", as of a reprint")),
        (book & year.isNotNull() & ~some_year, said("year ", year, " is not stated; look by hand")),
        (has_isbn & isbn, said("ISBN ", F.col("isbn"), " is stated")),
        (has_isbn & ~isbn, said("ISBN ", F.col("isbn"), " is not stated; an edition may have several")),
    )
    problems = _some(
        (F.col("chars_per_page") < LEAST_CHARS, said("about ", F.col("chars_per_page"), " characters a page: a scan without a text layer")),
        (pinned & (F.col("pin") != F.col("sha256")), "the truth is pinned to other bytes"),
        (F.col("wanted").isNotNull() & some_edition & ~confirmed, said("states edition ", listed(F.transform("stated", T.ordinal_name)), " where ", edition, " is expected")),
        (year.isNotNull() & some_year & ~close & before, said("copyright ", listed(F.col("years")), " is before ", year, ": an earlier edition")),
    )
    broken = F.col("unreadable").isNotNull()
    return rows.withColumns({
        "notes": F.when(broken, F.array().cast("array<string>")).otherwise(notes),
        "problems": F.when(broken, F.array(said("cannot be read: ", F.col("unreadable")))).otherwise(problems),
    }).drop("stated", "wanted", "years")


def claims(identified: DataFrame) -> DataFrame:
    """``(slug, n_files, files, state)``: which books one faultless file answers to, and which several contest.

    ``identified`` has slug, name and problems; a file with a problem claims nothing.
    """
    rows = identified.where("slug IS NOT NULL").where(F.size("problems") == 0)
    grouped = rows.groupBy("slug").agg(F.count("*").alias("n_files"), F.array_sort(F.collect_list("name")).alias("files"))
    return grouped.withColumn("state", F.when(F.col("n_files") == 1, "identified").otherwise("contested"))


def missing(books: DataFrame, claimed: DataFrame) -> DataFrame:
    """Slugs of books that no single file answers to."""
    return books.select("slug").distinct().join(claimed.where("state = 'identified'").select("slug"), "slug", "left_anti")
