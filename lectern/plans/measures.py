"""More registered queries: lookups, histories, claims, tallies, audits and boundaries, each with its oracle.

They follow the rules of ``lectern.plans.catalogue``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions import text as T
from lectern.operators import audit, locations, reads, scoring, search, structure
from lectern.plans.catalogue import _FLAT, _LOCATED, _RECORDS, _SCORED, PROBE, _flat, _located
from lectern.sources import files, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    """Register a query with its oracle."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__], ORACLES[run.__name__] = run, oracle
        return run

    return register


# --- reads ---------------------------------------------------------------------------------------------------------


@query("""
SELECT book_id, chapter_id, position, title, CAST(row_number() OVER (ORDER BY position, chapter_id) AS INTEGER) AS ord
FROM (SELECT DISTINCT book_id, chapter_id, position, title FROM chapters) WHERE book_id = (SELECT min(book_id) FROM chapters)
""")
def chapters_of_book(spark: SparkSession, root: str) -> DataFrame:
    """The book of the smallest id that has chapters, looked up, with its chapters in order."""
    chapters = table(spark, root, "chapters")
    book = chapters.agg(F.min("book_id")).first()[0]
    rows = reads.book_chapters(chapters, book)
    return rows.select("book_id", "chapter_id", "position", "title", F.row_number().over(W.orderBy("position", "chapter_id")).alias("ord"))  # one book's


@query("""
SELECT response_id, stage, CAST(row_number() OVER (ORDER BY created_at, response_id) AS INTEGER) AS ord
FROM (SELECT DISTINCT book_id, response_id, stage, created_at FROM llm_responses) WHERE book_id = (SELECT max(book_id) FROM llm_responses)
""")
def run_history(spark: SparkSession, root: str) -> DataFrame:
    """All calls for one book, failures included, oldest first."""
    rows = table(spark, root, "llm_responses").select("book_id", "response_id", "stage", "created_at")
    book = rows.agg(F.max("book_id")).first()[0]
    return reads.history(rows, "created_at", "response_id", book_id=book).select("response_id", "stage", F.row_number().over(W.orderBy("created_at", "response_id")).alias("ord"))


@query("""
SELECT book_id, EXISTS (SELECT 1 FROM llm_responses r WHERE r.book_id = b.book_id AND trim(coalesce(r.text, '')) NOT IN ('', '[]')) AS answered FROM (SELECT DISTINCT book_id FROM books) b
""")
def books_ever_answered(spark: SparkSession, root: str) -> DataFrame:
    """Whether a book has any usable answer."""
    good = table(spark, root, "llm_responses").where("trim(coalesce(text, '')) NOT IN ('', '[]')").select("book_id").distinct().withColumn("answered", F.lit(True))
    return table(spark, root, "books").select("book_id").distinct().join(good, "book_id", "left").select("book_id", F.coalesce("answered", F.lit(False)).alias("answered"))


_KINDS = ", ".join(f"'{t}'" for t in reads.KNOWLEDGE_TYPES)


@query(f"""
SELECT book_id, string_agg(type, '|' ORDER BY type) AS unknown, count(*) AS n FROM (SELECT DISTINCT book_id, type FROM knowledge_objects WHERE type IS NOT NULL AND type NOT IN ({_KINDS})) GROUP BY 1
""")
def unknown_types(spark: SparkSession, root: str) -> DataFrame:
    """Typed kinds of each book that are none of the nine, sorted."""
    rows = table(spark, root, "knowledge_objects").where("type IS NOT NULL").groupBy("book_id").agg(F.collect_set("type").alias("types"))
    unknown = F.array_sort(F.array_except("types", F.array(*[F.lit(t) for t in reads.KNOWLEDGE_TYPES])))
    return rows.select("book_id", F.array_join(unknown, "|").alias("unknown"), F.size(unknown).cast("bigint").alias("n")).where("n > 0")


@query("""
WITH b AS (SELECT DISTINCT book_id FROM books), p AS (SELECT DISTINCT book_id FROM book_profiles)
SELECT coalesce(b.book_id, p.book_id) AS book_id, CASE WHEN p.book_id IS NULL THEN 'missing' WHEN b.book_id IS NULL THEN 'unknown' ELSE 'in corpus' END AS state FROM b FULL JOIN p ON b.book_id = p.book_id
""")
def corpus_books(spark: SparkSession, root: str) -> DataFrame:
    """Books that the profiles cover, those they miss, and profiles of books nobody knows."""
    b = table(spark, root, "books").select("book_id").distinct().withColumn("known", F.lit(1))
    p = table(spark, root, "book_profiles").select("book_id").distinct().withColumn("held", F.lit(1))
    state = F.when(F.col("held").isNull(), "missing").when(F.col("known").isNull(), "unknown").otherwise("in corpus")
    return b.join(p, "book_id", "full").select("book_id", state.alias("state"))


@query("""
WITH b AS (SELECT DISTINCT book_id, file_hash, uploaded_at FROM books WHERE file_hash IS NOT NULL), cut AS (SELECT quantile_disc(uploaded_at, 0.5) AS t FROM b),
old AS (SELECT file_hash FROM b, cut WHERE uploaded_at <= t)
SELECT min(book_id) AS book_id, file_hash FROM b, cut WHERE uploaded_at > t AND file_hash NOT IN (SELECT file_hash FROM old) GROUP BY file_hash
""")
def register_new(spark: SparkSession, root: str) -> DataFrame:
    """Later registrations whose bytes were not there before, one for each file."""
    b = table(spark, root, "books").where("file_hash IS NOT NULL").select("book_id", "file_hash", "uploaded_at").distinct()
    n = b.count()
    middle = b.orderBy("uploaded_at").offset(max(0, -(-n // 2) - 1)).limit(1).first()
    at = middle[0] if middle is None else middle["uploaded_at"]
    return reads.register(b.where(F.col("uploaded_at") <= F.lit(at)), b.where(F.col("uploaded_at") > F.lit(at))).select("book_id", "file_hash")


@query("""
WITH o AS (SELECT book_id, list(DISTINCT lower(type)) AS v FROM knowledge_objects WHERE type IS NOT NULL GROUP BY 1), p AS (SELECT book_id, list(DISTINCT record_type) AS v FROM points WHERE record_type IS NOT NULL GROUP BY 1)
SELECT coalesce(o.book_id, p.book_id) AS book_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.v, []), coalesce(p.v, [])))), '|') AS kinds FROM o FULL JOIN p ON o.book_id = p.book_id
""")
def kinds_of_either(spark: SparkSession, root: str) -> DataFrame:
    """Sorted kinds that a book's objects or its points have."""
    o = table(spark, root, "knowledge_objects").where("type IS NOT NULL").groupBy("book_id").agg(F.collect_set(F.lower("type")).alias("a"))
    p = table(spark, root, "points").where("record_type IS NOT NULL").groupBy("book_id").agg(F.collect_set("record_type").alias("b"))
    none = F.array().cast("array<string>")
    return o.join(p, "book_id", "full").select("book_id", F.array_join(F.array_sort(F.array_union(F.coalesce("a", none), F.coalesce("b", none))), "|").alias("kinds"))


# --- search --------------------------------------------------------------------------------------------------------

_TURNS = 5


def _turned(i: int) -> list[float]:
    return PROBE[i:] + PROBE[:i]


_MANY = " UNION ALL ".join(
    f"SELECT 'q{i}' AS query_id, point_id, record_type, record_id, book_id, round(list_dot_product(v, {q}) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product({q}, {q}))), 6) AS score FROM usable"
    for i, q in ((i, "[" + ", ".join(map(str, _turned(i))) + "]::DOUBLE[]") for i in range(_TURNS))
)


@query(f"""
WITH {_SCORED}, many AS ({_MANY}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM many QUALIFY rank <= 25), {_RECORDS}
SELECT query_id, CAST(rank AS INTEGER) AS rank, point_id, score, title FROM r JOIN records USING (record_type, record_id)
""")
def search_many(spark: SparkSession, root: str) -> DataFrame:
    """Several queries in one pass, resolved to titles; points without a record leave gaps."""
    hits = search.many_top_k(table(spark, root, "points"), [(f"q{i}", _turned(i), None) for i in range(_TURNS)], 25)
    rows = search.records(table(spark, root, "chapters"), table(spark, root, "sections"), table(spark, root, "knowledge_objects"))
    return search.resolve(hits, rows).select("query_id", "rank", "point_id", "score", "title")


@query(f"""
WITH {_LOCATED}, {_SCORED},
hits AS (SELECT row_number() OVER (ORDER BY score DESC, point_id) AS rank, record_type, record_id, book_id FROM scored QUALIFY rank <= 400),
o AS (SELECT DISTINCT object_id, chapter_id, section_id FROM knowledge_objects),
placed AS (SELECT rank, loc, CASE WHEN hits.book_id IN (SELECT book_id FROM books) THEN hits.book_id END AS slug FROM hits LEFT JOIN o ON o.object_id = hits.record_id
  LEFT JOIN located ON located.record_id = CASE WHEN record_type = 'knowledge_object' THEN coalesce(o.section_id, o.chapter_id) ELSE hits.record_id END)
SELECT slug, count(*) AS n, CASE WHEN slug IS NULL THEN count(*) || ' hits dropped: their book is not in the truth' ELSE slug || ': ' || count(*) || ' hits dropped: their record joins no node' END AS note
FROM placed WHERE slug IS NULL OR loc IS NULL GROUP BY slug
""")
def drop_tallies(spark: SparkSession, root: str) -> DataFrame:
    """Hits that a run can't place, by book."""
    hits = search.top_k(table(spark, root, "points"), PROBE, 400).withColumn("query_id", F.lit("q"))
    links = reads.once(table(spark, root, "knowledge_objects"), "object_id").select(F.col("object_id").alias("record_id"), "section_id", "chapter_id")
    located = locations.locate_hits(hits, links, _located(spark, root)[2]).select("rank", "loc")
    known = table(spark, root, "books").select("book_id").distinct().withColumn("slug", F.col("book_id"))
    return scoring.drops(hits.join(located, "rank", "left").join(known, "book_id", "left"))


# --- scoring -------------------------------------------------------------------------------------------------------


@query("""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id, q.label AS want, p.vec_id AS n, p.label AS got, round(list_dot_product(q.v, p.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(p.v, p.v))), 6) AS score
  FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, n) AS rank FROM s QUALIFY rank <= 10)
SELECT vec_id AS query_id, CAST(min(rank) FILTER (got = want OR got = (want + 1) % 10) AS INTEGER) AS best_book_rank,
  CASE WHEN coalesce(min(rank) FILTER (got = want OR got = (want + 1) % 10), 99) <= 5 THEN 1.0::DOUBLE ELSE 0.0 END AS attributed FROM r GROUP BY 1
""")
def area_attribution(spark: SparkSession, root: str) -> DataFrame:
    """Whether a neighbour of one of two expected labels is among the first five."""
    rows = table(spark, root, "embeddings")
    queries = rows.where("vec_id % 20 = 0")
    hits = search.batch_top_k(queries, rows, "vec_id", "embedding").join(rows.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("book")), "neighbour")
    expected = queries.select(F.col("vec_id").alias("query_id"), F.explode(F.array("label", ((F.col("label") + 1) % 10).cast("int"))).alias("book"))
    return scoring.attribution(expected, hits.select(F.col("vec_id").alias("query_id"), "rank", "book"))


@query("""
WITH b AS (SELECT DISTINCT book_id, primary_topic, language, publication_year FROM books),
res AS (SELECT primary_topic AS q, CASE WHEN publication_year % 3 = 0 THEN NULL ELSE language END AS book, row_number() OVER (ORDER BY book_id) AS nth FROM b),
m AS (SELECT b.book_id, res.nth, CASE WHEN res.book IS NOT DISTINCT FROM b.language THEN 0 WHEN res.book IS NULL THEN 1 END AS o FROM b JOIN res ON res.q = b.primary_topic)
SELECT b.book_id AS query_id, CAST(f.nth AS INTEGER) AS nth FROM b LEFT JOIN (SELECT book_id, arg_min(nth, (o, nth)) AS nth FROM m WHERE o IS NOT NULL GROUP BY 1) f USING (book_id)
""")
def result_precedence(spark: SparkSession, root: str) -> DataFrame:
    """Which result answers a query: its own scope's before one without scope, the earlier first."""
    b = reads.once(table(spark, root, "books"), "book_id").select("book_id", "primary_topic", "language", "publication_year")
    results = b.select(
        F.col("primary_topic").alias("q"), F.when(F.col("publication_year") % 3 == 0, None).otherwise(F.col("language")).alias("book"), F.lit(None).cast("string").alias("area"),
        F.row_number().over(W.orderBy("book_id")).alias("at"),  # the order of a run file
    )
    queries = b.select(F.col("book_id").alias("query_id"), F.col("primary_topic").alias("q"), F.col("language").alias("book"), F.lit(None).cast("string").alias("area"))
    return scoring.chosen_results(queries, results).withColumnRenamed("at", "nth")


@query("""
WITH r AS (SELECT DISTINCT * FROM llm_responses)
SELECT sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens, count(*) AS embedding_tokens, round(sum(length(coalesce(text, '')) / 100.0), 6) AS wall_seconds,
  count(*) FILTER (input_tokens IS NULL) AS unreported FROM r
""")
def cost_totals(spark: SparkSession, root: str) -> DataFrame:
    """One row of what all calls cost; a call counts as an embedding token and its length as time here."""
    rows = reads.once_wide(table(spark, root, "llm_responses"), "response_id")
    total = scoring.cost_totals(rows.select("input_tokens", "output_tokens", F.lit(1).alias("embedding_tokens"), (F.length(F.coalesce("text", F.lit(""))) / 100).alias("seconds")))
    return total.withColumn("wall_seconds", F.round("wall_seconds", 6))


@query("""
WITH c AS (SELECT book_id, count(DISTINCT chapter_id) AS chapters FROM chapters GROUP BY 1), s AS (SELECT book_id, count(DISTINCT section_id) AS sections FROM sections JOIN (SELECT DISTINCT chapter_id, book_id FROM chapters) USING (chapter_id) GROUP BY 1),
f AS (SELECT book_id, count(DISTINCT profile_id) AS profiles FROM book_profiles GROUP BY 1), o AS (SELECT book_id, count(DISTINCT object_id) AS knowledge_objects FROM knowledge_objects GROUP BY 1), p AS (SELECT book_id, count(DISTINCT point_id) AS vectors FROM points GROUP BY 1)
SELECT book_id, coalesce(chapters, 0) AS chapters, coalesce(sections, 0) AS sections, coalesce(profiles, 0) AS profiles, coalesce(knowledge_objects, 0) AS knowledge_objects, coalesce(vectors, 0) AS vectors
FROM (SELECT DISTINCT book_id FROM books) LEFT JOIN c USING (book_id) LEFT JOIN s USING (book_id) LEFT JOIN f USING (book_id) LEFT JOIN o USING (book_id) LEFT JOIN p USING (book_id)
""")
def stage_counts(spark: SparkSession, root: str) -> DataFrame:
    """What each stage made of a book."""
    chapters = table(spark, root, "chapters").select("chapter_id", "book_id").distinct()
    sections = table(spark, root, "sections").select("section_id", "chapter_id").distinct().join(chapters, "chapter_id")
    out = table(spark, root, "books").select("book_id").distinct()
    parts = [(chapters, "chapter_id", "chapters"), (sections, "section_id", "sections")]
    parts += [(table(spark, root, t), k, n) for t, k, n in (("book_profiles", "profile_id", "profiles"), ("knowledge_objects", "object_id", "knowledge_objects"), ("points", "point_id", "vectors"))]
    for df, key, name in parts:
        out = out.join(df.select("book_id", key).distinct().groupBy("book_id").agg(F.count("*").alias(name)), "book_id", "left")
    return out.na.fill(0)


@query("""
WITH r AS (SELECT DISTINCT * FROM llm_responses), g AS (SELECT model, count(*) FILTER (stage = 'profile') AS profile, count(*) FILTER (stage = 'extraction' AND input_tokens IS NULL) AS extraction, count(*) FILTER (stage = 'none') AS none FROM r GROUP BY 1)
SELECT model, dimension, n FROM (UNPIVOT g ON profile, extraction, none INTO NAME dimension VALUE n) WHERE n > 0
""")
def measured_dimensions(spark: SparkSession, root: str) -> DataFrame:
    """Dimensions of which anything was measured, long; one without is absent."""
    rows = reads.once_wide(table(spark, root, "llm_responses"), "response_id").groupBy("model").agg(
        F.count_if(F.col("stage") == "profile").alias("profile"), F.count_if((F.col("stage") == "extraction") & F.col("input_tokens").isNull()).alias("extraction"), F.count_if(F.col("stage") == "none").alias("none")
    )
    return rows.unpivot(["model"], ["profile", "extraction", "none"], "dimension", "n").where("n > 0")


# --- structure -----------------------------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT DISTINCT book_id, chapter_id, source_line AS line FROM chapters WHERE source_line IS NOT NULL),
s AS (SELECT DISTINCT book_id, section_id, source_line AS line FROM sections JOIN (SELECT DISTINCT chapter_id, book_id FROM chapters) USING (chapter_id) WHERE source_line IS NOT NULL),
b AS (SELECT book_id, line FROM c UNION SELECT book_id, line FROM s)
SELECT section_id, s.line, min(b.line) AS stop FROM s LEFT JOIN b ON b.book_id = s.book_id AND b.line > s.line GROUP BY ALL
""")
def next_boundary(spark: SparkSession, root: str) -> DataFrame:
    """The line of the next heading after each section's own."""
    chapters = reads.once(table(spark, root, "chapters"), "chapter_id").select("chapter_id", "book_id", "source_line")
    sections = reads.once(table(spark, root, "sections"), "section_id").select("section_id", "chapter_id", F.col("source_line").alias("line")).where("line IS NOT NULL").join(chapters.drop("source_line"), "chapter_id")
    lines = chapters.where("source_line IS NOT NULL").select("book_id", F.col("source_line").alias("line")).unionByName(sections.select("book_id", "line")).distinct()
    stops = lines.withColumn("stop", F.lead("line").over(W.partitionBy("book_id").orderBy("line")))
    return sections.join(stops, ["book_id", "line"]).select("section_id", "line", "stop")


@query("""
WITH c AS (SELECT DISTINCT book_id, chapter_id, position, title FROM chapters), n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY position, chapter_id) - 1 AS k FROM c)
SELECT book_id, CAST(k AS INTEGER) AS chapter, CASE WHEN k % 3 = 2 THEN 'Part ' || (k + 1) ELSE 'Chapter ' || (k + 1) || ': ' || title END AS title, CAST(1 + 2 * k + (SELECT count(*) FROM n m WHERE m.book_id = n.book_id AND m.k < n.k AND m.k % 3 = 2) * 3 AS INTEGER) AS line FROM n
""")
def numbered_headings(spark: SparkSession, root: str) -> DataFrame:
    """Documents of bare numbers with their titles close below, or too far: the close ones are one heading.

    Every third number stands more than the allowed lines above its title, which is a sub-heading then and not shown.
    """
    c = reads.once(table(spark, root, "chapters"), "chapter_id").select("book_id", "chapter_id", "position", "title")
    k = F.row_number().over(W.partitionBy("book_id").orderBy("position", "chapter_id")) - 1
    number = (F.col("k") + 1).cast("string")
    far = F.concat(F.lit("# Part "), number, F.lit("\n\n\n\n## "), "title")
    near = F.concat(F.lit("# Chapter "), number, F.lit("\n# "), "title")
    parts = c.withColumn("k", k).select("book_id", F.struct("k", F.when(F.col("k") % 3 == 2, far).otherwise(near).alias("t")).alias("part"))
    documents = parts.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["t"]), "\n").alias("markdown"))
    return structure.detect(documents).where("section IS NULL").select("book_id", "chapter", "title", "line")


@query("""
WITH p AS (SELECT DISTINCT parse_id, book_id, markdown FROM parse_results)
SELECT book_id AS artifact_id, CAST(count(*) AS BIGINT) AS pages, CAST(floor(sum(length(markdown)) / count(*)) AS INTEGER) AS chars_per_page FROM p GROUP BY 1
""")
def characters_per_page(spark: SparkSession, root: str) -> DataFrame:
    """Characters a page, each parse of a book standing for a page."""
    rows = reads.once_wide(table(spark, root, "parse_results"), "parse_id")
    pages = rows.select(F.col("book_id").alias("artifact_id"), F.col("parse_id").alias("page_no"), F.col("markdown").alias("text"))
    return files.artifacts(pages).select("artifact_id", "pages", "chars_per_page")


# --- sources -------------------------------------------------------------------------------------------------------


@query("""
WITH b AS (SELECT DISTINCT book_id, file_hash, publication_year FROM books WHERE file_hash IS NOT NULL), ok AS (SELECT file_hash AS slug, book_id FROM b WHERE publication_year BETWEEN 1900 AND 2030)
SELECT slug, count(*) AS n_files, string_agg(book_id, '|' ORDER BY book_id) AS files, CASE WHEN count(*) = 1 THEN 'identified' ELSE 'contested' END AS state FROM ok GROUP BY 1
UNION ALL SELECT DISTINCT file_hash, NULL, NULL, 'missing' FROM b WHERE file_hash NOT IN (SELECT slug FROM ok GROUP BY 1 HAVING count(*) = 1)
""")
def contested_sources(spark: SparkSession, root: str) -> DataFrame:
    """Hashes that one faultless book answers to, that several contest, and that none answers to alone."""
    b = reads.once(table(spark, root, "books"), "book_id").where("file_hash IS NOT NULL")
    fault = F.when(F.col("publication_year").between(1900, 2030), F.array().cast("array<string>")).otherwise(F.array(F.lit("impossible year")))
    found = audit.claims(b.select(F.col("file_hash").alias("slug"), F.col("book_id").alias("name"), fault.alias("problems")))
    lost = audit.missing(b.select(F.col("file_hash").alias("slug")), found)
    return found.select("slug", "n_files", F.array_join("files", "|").alias("files"), "state").unionByName(
        lost.select("slug", F.lit(None).cast("bigint").alias("n_files"), F.lit(None).cast("string").alias("files"), F.lit("missing").alias("state"))
    )


_ORDINAL_SQL = """CAST(coalesce(try_cast(nullif(regexp_extract(bare, '^(\\d+)(?:st|nd|rd|th)?$', 1), '') AS INTEGER),
  list_position(['first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth','eleventh','twelfth'], bare)) AS INTEGER)"""


@query(rf"""
WITH b AS (SELECT DISTINCT book_id, title, edition, publication_year AS year, isbn, file_format, file_hash FROM books),
o AS (SELECT *, {_ORDINAL_SQL} AS wanted, len(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' ')) >= 2 AS anchored
  FROM (SELECT *, trim(regexp_replace(trim(regexp_replace(lower(coalesce(edition, '')), '\bed(ition|n)?\b\.?|[.,]', ' ', 'g')), '\s+', ' ', 'g')) AS bare FROM b)),
f AS (SELECT *, CASE WHEN NOT anchored THEN NULL WHEN year % 3 = 0 THEN 1 WHEN year % 3 = 1 THEN wanted END AS stated, CASE WHEN year - 2 * (year % 2) BETWEEN 1900 AND 2099 THEN year - 2 * (year % 2) END AS told FROM o)
SELECT book_id, CASE WHEN year % 11 = 0 THEN 0 ELSE (file_format = 'epub')::BIGINT + coalesce(year % 7 = 0, false)::BIGINT
    + (wanted IS NOT NULL AND (stated IS NULL OR stated = wanted))::BIGINT + (coalesce(edition, '') <> '' AND wanted IS NULL)::BIGINT
    + coalesce(year IS NOT NULL AND (told IS NULL OR abs(told - year) <= 1), false)::BIGINT + (coalesce(isbn, '') <> '')::BIGINT END AS n_notes,
  CASE WHEN year % 11 = 0 THEN 1 ELSE (length(title) * 10 < 200)::BIGINT + coalesce(year % 7 = 1, false)::BIGINT + (wanted IS NOT NULL AND stated IS NOT NULL AND stated <> wanted)::BIGINT + coalesce(told < year - 1, false)::BIGINT END AS n_problems,
  coalesce(wanted IS NOT NULL AND stated = wanted AND coalesce(year % 11, 1) <> 0, false) AS edition_confirmed, CASE WHEN wanted % 100 BETWEEN 10 AND 20 THEN wanted || 'th' ELSE wanted || CASE wanted % 10 WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END END AS ordinal
FROM f
""")
def source_audit(spark: SparkSession, root: str) -> DataFrame:
    """What front matter made of a book's own data says against what is expected of it.

    By the year's remainders it states another edition, the right one or none, an earlier copyright or the right one.
    """
    b = reads.once(table(spark, root, "books"), "book_id").select("book_id", "title", "edition", F.col("publication_year").alias("year"), "isbn", F.col("file_format").alias("suffix"), F.col("file_hash").alias("sha256"), "checksum")
    year, wanted = F.col("year"), T.ordinal(F.coalesce("edition", F.lit("")))
    said = F.when(year % 3 == 0, "First edition of ").when((year % 3 == 1) & wanted.isNotNull(), F.concat(wanted.cast("string"), F.lit("th Edition of "))).otherwise("")
    told = F.coalesce(F.concat(F.lit(". Copyright "), (year - 2 * (year % 2)).cast("string")), F.lit(""))
    rows = b.withColumns({
        "front": F.concat(said, F.col("title"), told, F.lit(" by its author. ISBN "), F.when(year % 5 == 0, F.coalesce("isbn", F.lit(""))).otherwise("")),
        "chars_per_page": F.length("title") * 10, "unreadable": F.when(year % 11 == 0, "broken"), "pin": F.when(year % 7 == 0, F.col("sha256")).when(year % 7 == 1, F.col("checksum")).otherwise("TBD"),
    })
    found = audit.audited(rows)
    return found.select(
        "book_id", F.size("notes").cast("bigint").alias("n_notes"), F.size("problems").cast("bigint").alias("n_problems"),
        F.exists("notes", lambda n: n.startswith("edition ") & n.endswith(" is stated")).alias("edition_confirmed"), T.ordinal_name(wanted).alias("ordinal"),
    )


@query(r"""
WITH b AS (SELECT DISTINCT book_id, checksum, file_hash, language, primary_topic FROM books)
SELECT book_id, '  sha256: ' || file_hash || CASE WHEN primary_topic IS NULL THEN '' WHEN language IS NULL THEN '' ELSE ' # ' || 'about ' || length(primary_topic) END AS line, upper(coalesce(primary_topic, 'tbd later')) LIKE 'TBD%' AS placeholder FROM b WHERE file_hash IS NOT NULL
""")
def pin_lines(spark: SparkSession, root: str) -> DataFrame:
    """Pin lines with a new hash: a comment stays unless it speaks of a missing file; and which texts are placeholders."""
    b = reads.once(table(spark, root, "books"), "book_id").where("file_hash IS NOT NULL")
    comment = F.when(F.col("primary_topic").isNull(), "").when(F.col("language").isNull(), " # TBD when the file lands").otherwise(F.concat(F.lit(" # about "), F.length("primary_topic").cast("string")))
    line = F.concat(F.lit("  sha256: "), "checksum", comment)
    return b.select("book_id", T.repin_line(line, F.col("file_hash")).alias("line"), T.is_placeholder(F.coalesce("primary_topic", F.lit("tbd later"))).alias("placeholder"))


@query(f"""
WITH {_FLAT}, k AS (SELECT book_id, count(*) FILTER (kind = 'chapter') AS chapters, count(*) FILTER (kind = 'section') AS sections, count(*) FILTER (kind LIKE '%matter') AS matter FROM flat GROUP BY 1)
SELECT book_id, chapters, sections, matter, chapters < 4 AS few_chapters FROM k
""")
def node_kinds(spark: SparkSession, root: str) -> DataFrame:
    """Nodes of each kind in a book, and whether there are too few chapters to ask about."""
    rows = _flat(spark, root)
    n = lambda c: F.count_if(c)
    kind = F.col("kind")
    return rows.groupBy("book_id").agg(n(kind == "chapter").alias("chapters"), n(kind == "section").alias("sections"), n(kind.endswith("matter")).alias("matter")).withColumn("few_chapters", F.col("chapters") < 4)


@query("""
WITH o AS (SELECT DISTINCT object_id, chapter_id, section_id FROM knowledge_objects), c AS (SELECT chapter_id FROM chapters WHERE position % 5 <> 0), s AS (SELECT section_id FROM sections WHERE position % 4 <> 1)
SELECT 'chapter' AS what, chapter_id AS missing, count(*) AS n FROM o WHERE chapter_id IS NOT NULL AND chapter_id NOT IN (SELECT chapter_id FROM c) GROUP BY ALL
UNION ALL SELECT 'section', section_id, count(*) FROM o WHERE section_id IS NOT NULL AND section_id NOT IN (SELECT section_id FROM s) GROUP BY ALL
""")
def lint_dangling(spark: SparkSession, root: str) -> DataFrame:
    """References into a structure that lacks every fifth chapter and every fourth section, by what they name."""
    o = reads.once(table(spark, root, "knowledge_objects"), "object_id")
    kept = {"chapter": table(spark, root, "chapters").where("position % 5 != 0"), "section": table(spark, root, "sections").where("position % 4 != 1")}
    parts = []
    for what, rows in kept.items():
        key = f"{what}_id"
        lost = o.where(F.col(key).isNotNull()).join(rows.select(key).distinct(), key, "left_anti")
        parts.append(lost.groupBy(F.lit(what).alias("what"), F.col(key).alias("missing")).agg(F.count("*").alias("n")))
    return parts[0].unionByName(parts[1])


@query(r"""
WITH b AS (SELECT DISTINCT book_id, original_filename AS name, checksum, file_hash FROM books),
c AS (SELECT book_id, lower(regexp_extract(name, '\.([^./]*)$', 1)) AS suffix, CASE WHEN left(checksum, 1) < '8' THEN 'pdf' WHEN left(checksum, 1) < 'e' THEN 'epub' ELSE 'none' END AS really, file_hash FROM b)
SELECT book_id, CASE WHEN suffix = really THEN really END AS file_format,
  sha256(encode(CASE really WHEN 'pdf' THEN '%PDF-1.7' WHEN 'epub' THEN 'PK' || chr(3) || chr(4) ELSE 'text' END || coalesce(file_hash, ''))) AS digest FROM c
""")
def file_formats(spark: SparkSession, root: str) -> DataFrame:
    """Formats and hashes of contents made for the books' file names, of which some begin like another format."""
    b = reads.once(table(spark, root, "books"), "book_id").select("book_id", "original_filename", "checksum", "file_hash")
    first = F.left("checksum", F.lit(1))
    begin = F.when(first < "8", "%PDF-1.7").when(first < "e", "PK\x03\x04").otherwise("text")
    content = F.concat(begin, F.coalesce("file_hash", F.lit(""))).cast("binary")
    return b.select("book_id", files.file_format(F.col("original_filename"), content).alias("file_format"), F.sha2(content, 256).alias("digest"))
