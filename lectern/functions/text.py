"""String functions as column expressions, with the reference's exact character semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line separators of Unicode text, as one alternation.
NEWLINE = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
SPACE = r"[\s\x1C-\x1F\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def lines(text: Column) -> Column:
    """Lines of a text as an array; a final separator opens no further line."""
    parts = F.split(text, NEWLINE, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def strip_emphasis(title: Column) -> Column:
    """Unwrap emphasis marks until nothing changes, however deep they are nested."""

    def once(x: Column) -> Column:
        x = F.regexp_replace(x, r"\*\*(.+?)\*\*", "$1")
        x = F.regexp_replace(x, r"__(.+?)__", "$1")
        x = F.regexp_replace(x, rf"(?<!{WORD})\*(.+?)\*(?!{WORD})", "$1")
        return F.regexp_replace(x, rf"(?<!{WORD})_(.+?)_(?!{WORD})", "$1")

    # Every round that changes anything takes at least two marks away.
    marks = F.length(title) - F.length(F.translate(title, "*_", ""))
    rounds = F.filter(F.sequence(F.lit(0), F.floor(marks / 2).cast("int")), lambda i: i > 0)
    return trim(F.aggregate(rounds, title, lambda x, _: once(x)))


def normalise_title(title: Column) -> Column:
    """Comparison form of a title: leading numbering gone, lower case, runs of other characters one blank."""
    bare = F.regexp_replace(title, rf"^{SPACE}*(?U:\d)+(?:[.\-](?U:\d)+)*[.)]?{SPACE}+", "")
    return F.trim(F.regexp_replace(F.lower(bare), r"[^a-z0-9]+", " "))


def normalise_source(text: Column) -> Column:
    """Comparison form of a source's text: invisible characters deleted first."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"[\u00AD\u200B\u200C\u200D\uFEFF]", "")), r"[^a-z0-9]+", " "))


# Suffixes in the order in which they are tried.
SUFFIXES = ("ations", "ation", "ings", "ing", "edly", "ers", "er", "ed", "es", "s")


def stem(word: Column) -> Column:
    """The word without its first matching suffix that leaves four letters."""
    out = word
    for suffix in reversed(SUFFIXES):
        fits = word.endswith(suffix) & (F.length(word) - len(suffix) >= 4)
        out = F.when(fits, F.substring(word, F.lit(1), F.length(word) - len(suffix))).otherwise(out)
    return out


def content_words(text: Column) -> Column:
    """Distinct stems of the words of four letters or more, in order of appearance."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 4)
    return F.array_distinct(F.transform(words, stem))


def word_weight(normalised: Column) -> Column:
    """Number of words of four letters or more."""
    return F.size(F.filter(F.split(normalised, " "), lambda w: F.length(w) >= 4))


def source_location(position: Column, title: Column, section: Column) -> Column:
    base = F.concat(F.lit("chapter "), (position + 1).cast("string"), F.lit(": "), title)
    return F.when(section.isNotNull(), F.concat(base, F.lit(" > "), section)).otherwise(base)


def embedded_text(kind: Column, title: Column, summary: Column, content: Column) -> Column:
    return F.concat(kind, F.lit(": "), title, F.lit("\n"), summary, F.lit("\n"), content)


def strip_fences(text: Column) -> Column:
    """A model's answer without the code fence around it."""
    bare = trim(text)
    inner = F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*\n?", ""), r"\n?[ \t]*```[ \t]*$", "")
    return F.when(bare.startswith("```"), inner).otherwise(bare)


def snippet(text: Column, most: int = 60) -> Column:
    flat = trim(F.regexp_replace(text, f"{SPACE}+", " "))
    return F.when(F.length(flat) > most, F.concat(F.regexp_replace(F.substring(flat, 1, most - 1), f"{SPACE}+$", ""), F.lit("…"))).otherwise(flat)


def redact(secret: Column) -> Column:
    return F.when(F.length(secret) <= 8, F.lit("****")).otherwise(F.concat(F.left(secret, F.lit(4)), F.lit("…"), F.right(secret, F.lit(4))))


def slug(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(bare == "", F.lit("unset")).otherwise(bare)


# Fixed values.
ORDINAL_WORDS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth")


def ordinal(text: Column) -> Column:
    """The edition number that a text names ("3rd", "third", "3", "edition 3"), or null."""
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"\bed(ition|n)?\b\.?|[.,]", " ")), r"\s+", " "))
    number = F.regexp_extract(bare, r"^(\d+)(?:st|nd|rd|th)?$", 1)
    words = F.create_map(*[x for i, w in enumerate(ORDINAL_WORDS, 1) for x in (F.lit(w), F.lit(i))])
    return F.when(number != "", number.cast("int")).otherwise(F.try_element_at(words, bare))


def ordinal_name(n: Column) -> Column:
    tens, ones = n % 100, n % 10
    ending = F.when((tens >= 10) & (tens <= 20), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), ending)


def edition_claims(text: Column, title: Column, window: int = 120) -> Column:
    """Edition numbers that a text claims within ``window`` characters of the title's first two words, ascending.

    All on normalised texts.  A title of one word names too little to anchor a claim.
    """
    head = F.array_join(F.slice(F.split(normalise_source(title), " "), 1, 2), " ")
    pieces = F.split(normalise_source(text), F.coalesce(F.nullif(head, F.lit("")), F.lit("\\z")), -1)  # words and blanks only
    join = lambda parts: F.call_function("array_join", parts, head)
    around = F.transform(F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: i > 0), lambda i: F.concat(
        F.right(join(F.slice(pieces, 1, i)), F.lit(window)), head, F.left(join(F.slice(pieces, i + 1, F.size(pieces))), F.lit(window))))
    words = "|".join(ORDINAL_WORDS)
    claims = F.flatten(F.transform(around, lambda s: F.regexp_extract_all(s, F.lit(rf"\b((?:{words}|\d{{1,3}}(?:st|nd|rd|th)) edition|edition \d{{1,3}})\b"), F.lit(1))))
    numbers = F.array_sort(F.array_distinct(F.transform(claims, lambda c: ordinal(F.trim(F.replace(c, F.lit("edition"), F.lit("")))))))
    return F.when(F.size(F.split(head, " ")) >= 2, numbers).otherwise(F.array().cast("array<int>"))


def copyright_years(text: Column) -> Column:
    """Years that a text claims a copyright of."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\bcopyright\b[^a-z0-9]{0,12}((?:19|20)\d{2})"), F.lit(1)), lambda y: y.cast("int"))


def is_placeholder(text: Column) -> Column:
    return F.upper(text).startswith("TBD")


def has_alphanumeric(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def repin_line(line: Column, sha: Column) -> Column:
    """A ``sha256:`` line with a new value; indentation stays, a comment too unless it speaks of a missing file."""
    indent = F.regexp_extract(line, r"^(\s*)", 1)
    comment = F.regexp_extract(line, r"(\s+#.*)$", 1)
    stale = F.lower(comment).rlike("tbd|handover|when the file lands|blocked")
    return F.concat(indent, F.lit("sha256: "), sha, F.when(stale, "").otherwise(comment))
