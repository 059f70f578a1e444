"""Registered queries over the reference's operators, each with the same query in DuckDB's SQL where SQL can say it.

Arrays and structs are joined to strings, scores rounded to 6 decimals and means to 9, so that both engines' values
compare exactly.  Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions import text as T
from lectern.operators import answers, locations, reads, scoring, search, structure
from lectern.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A fixed query vector of 64 numbers.
PROBE = [((i * 37) % 11 - 5) / 10 for i in range(64)]
_PROBE_SQL = "[" + ", ".join(str(x) for x in PROBE) + "]::DOUBLE[]"


def query(oracle: str | None = None):
    """Register a query, with its oracle where there is one."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if oracle:
            ORACLES[run.__name__] = oracle
        return run

    return register


# --- search ------------------------------------------------------------------------------------------------------

_SCORED = f"""
usable AS (SELECT DISTINCT point_id, record_type, record_id, book_id, vector::DOUBLE[] AS v FROM points
  WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
scored AS (SELECT point_id, record_type, record_id, book_id,
  round(list_dot_product(v, {_PROBE_SQL}) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product({_PROBE_SQL}, {_PROBE_SQL}))), 6) AS score FROM usable)
"""
_RECORDS = """
records AS (SELECT 'chapter' AS record_type, chapter_id AS record_id, any_value(title) AS title FROM chapters GROUP BY 2
  UNION ALL SELECT 'section', section_id, any_value(title) FROM sections GROUP BY 2
  UNION ALL SELECT 'knowledge_object', object_id, any_value(title) FROM knowledge_objects GROUP BY 2)
"""


def _records(spark: SparkSession, root: str) -> DataFrame:
    return search.records(table(spark, root, "chapters"), table(spark, root, "sections"), table(spark, root, "knowledge_objects"))


@query(f"""
WITH {_SCORED}, {_RECORDS},
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, point_id) AS rank FROM scored WHERE record_type IN ('chapter', 'section')
  QUALIFY rank <= 20)
SELECT CAST(rank AS INTEGER) AS rank, point_id, top.record_type, top.record_id, book_id, score, title FROM top JOIN records USING (record_type, record_id)
""")
def search_topk_filtered(spark: SparkSession, root: str) -> DataFrame:
    """Best chapters and sections for a fixed query, resolved to their rows; stale points leave gaps."""
    hits = search.top_k(table(spark, root, "points"), PROBE, 20, types=["chapter", "section"])
    return search.resolve(hits, _records(spark, root)).select("rank", "point_id", "record_type", "record_id", "book_id", "score", "title")


@query(f"""
WITH {_SCORED}, ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, point_id) AS rn FROM scored WHERE score >= 0.05)
SELECT CAST(rn - 5 AS INTEGER) AS rank, point_id, score FROM ranked WHERE rn > 5 AND rn <= 30
""")
def search_threshold_offset(spark: SparkSession, root: str) -> DataFrame:
    return search.top_k(table(spark, root, "points"), PROBE, 25, offset=5, threshold=0.05).select("rank", "point_id", "score")


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id, p.vec_id AS neighbour,
  round(list_dot_product(q.v, p.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(p.v, p.v))), 6) AS score
  FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 20 = 0)
SELECT vec_id, neighbour, score, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour) AS INTEGER) AS rank FROM s
QUALIFY rank <= 10
""")
def search_batch_topk(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings")
    return search.batch_top_k(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding")


@query(f"""
WITH {_RECORDS}
SELECT record_type, count(*) AS n_stale FROM (SELECT DISTINCT point_id, record_type, record_id FROM points) p
WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.record_type = p.record_type AND r.record_id = p.record_id) GROUP BY 1
""")
def stale_points(spark: SparkSession, root: str) -> DataFrame:
    return search.stale(table(spark, root, "points"), _records(spark, root)).groupBy("record_type").agg(F.count("*").alias("n_stale"))


@query("""
WITH books2 AS (SELECT DISTINCT book_id FROM knowledge_objects WHERE confidence > 1),
new AS (SELECT object_id AS point_id, book_id FROM (SELECT DISTINCT object_id, book_id, confidence FROM knowledge_objects) WHERE book_id IN (SELECT book_id FROM books2) AND confidence > 0.9),
kept AS (SELECT DISTINCT point_id, book_id FROM points WHERE book_id IS NOT NULL AND book_id NOT IN (SELECT book_id FROM books2) OR book_id IS NULL)
SELECT point_id, book_id FROM kept WHERE point_id NOT IN (SELECT point_id FROM new) UNION ALL SELECT point_id, book_id FROM new
""")
def replace_points_anti_join(spark: SparkSession, root: str) -> DataFrame:
    """The vector table after the books with an impossible confidence were embedded anew."""
    objects = reads.once(table(spark, root, "knowledge_objects"), "object_id").select(F.col("object_id").alias("point_id"), "book_id", "confidence")
    books = objects.where("confidence > 1").select("book_id").distinct()
    new = objects.where("confidence > 0.9").join(books, "book_id", "left_semi").select("point_id", "book_id")
    return search.replace_points(table(spark, root, "points").select("point_id", "book_id").distinct(), new, books)


# --- text and structure ------------------------------------------------------------------------------------------


@query(r"""
WITH t AS (SELECT DISTINCT parse_id, markdown FROM parse_results WHERE markdown IS NOT NULL),
s AS (SELECT parse_id, string_split(CASE WHEN suffix(markdown, chr(10)) THEN markdown[:-2] ELSE markdown END, chr(10)) AS l FROM t)
SELECT parse_id, CAST(i AS INTEGER) AS line_no, l[i] AS line FROM (SELECT parse_id, l, unnest(range(1, len(l) + 1)) AS i FROM s WHERE len(l) > 0)
WHERE NOT (len(l) = 1 AND l[1] = '')
""")
def lines_numbered(spark: SparkSession, root: str) -> DataFrame:
    rows = reads.once_wide(table(spark, root, "parse_results"), "parse_id").where("markdown is not null")
    return rows.select("parse_id", F.posexplode(T.lines(F.col("markdown"))).alias("at", "line")).select("parse_id", (F.col("at") + 1).alias("line_no"), "line")


# Fenced blocks cut out by one pattern: an independent way to the same headings.
# A document is cut at its fences; the line of a heading is the number of line breaks in all before it.
_FENCES = r"'(?s)\n```.*?\n```[^\n]*|\n~~~.*?\n~~~[^\n]*|\n(```|~~~).*'"
_BREAKS = "length({0}) - length(replace({0}, chr(10), ''))"
_HEADINGS = rf"""
doc AS (SELECT DISTINCT parse_id, markdown FROM parse_results WHERE markdown IS NOT NULL),
cut AS (SELECT parse_id, string_split_regex(chr(10) || markdown, {_FENCES}) AS p, regexp_extract_all(chr(10) || markdown, {_FENCES}) AS f FROM doc),
piece AS (SELECT parse_id, p[k] AS t, coalesce(list_sum(list_transform(p[1:k - 1], lambda x: {_BREAKS.format("x")})), 0) + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: {_BREAKS.format("x")})), 0) AS before
  FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM cut)),
raw AS (SELECT parse_id, before + i - 1 AS i, l[i] AS line FROM (SELECT parse_id, before, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT parse_id, before, string_split(t, chr(10)) AS l FROM piece))),
heads AS (SELECT parse_id, i, len(regexp_extract(line, '^(#{{1,6}})\s', 1)) AS level,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(line, '^#{{1,6}}\s+(.*?)\s*#*\s*$', 1), '\*\*(.+?)\*\*', '\1', 'g'), '__(.+?)__', '\1', 'g'), '^[*_](.+)[*_]$', '\1')) AS title
  FROM raw WHERE regexp_matches(line, '^#{{1,6}}\s+\S')),
h AS (SELECT parse_id, i AS line, row_number() OVER (PARTITION BY parse_id ORDER BY i) AS ord, level, title FROM heads WHERE title <> '' AND level > 0)
"""


@query(f"WITH {_HEADINGS} SELECT parse_id, CAST(ord AS INTEGER) AS ord, CAST(level AS INTEGER) AS level, title FROM h")
def structure_headings(spark: SparkSession, root: str) -> DataFrame:
    """Headings outside fenced code, in order."""
    rows = structure.headings(reads.once_wide(table(spark, root, "parse_results"), "parse_id"), "parse_id", "markdown")
    return rows.select("parse_id", F.row_number().over(W.partitionBy("parse_id").orderBy("line")).alias("ord"), "level", "title")


_TREE = _HEADINGS + r""",
t1 AS (SELECT *, min(level) OVER w AS top, max(level) OVER w AS bottom FROM h WINDOW w AS (PARTITION BY parse_id)),
t2 AS (SELECT *, sum((level = top)::INT) OVER (PARTITION BY parse_id) AS n_top FROM t1),
t3 AS (SELECT parse_id, ord, level, title, line FROM t2 WHERE NOT (n_top = 1 AND bottom > top AND level = top)),
t4 AS (SELECT *, min(level) OVER (PARTITION BY parse_id) AS cl FROM t3),
t5 AS (SELECT *, min(CASE WHEN level > cl THEN level END) OVER (PARTITION BY parse_id) AS sl FROM t4 WHERE level >= cl),
t6 AS (SELECT *, sum((level = cl)::INT) OVER (PARTITION BY parse_id ORDER BY ord) - 1 AS chapter FROM t5 WHERE level = cl OR level = sl),
t7 AS (SELECT *, level = cl AS is_chapter, row_number() OVER (PARTITION BY parse_id, chapter ORDER BY ord) - 2 AS s FROM t6 WHERE chapter >= 0),
t8 AS (SELECT *, CASE WHEN NOT is_chapter THEN 'section'
  WHEN regexp_matches(title, '(?i)^(cover|half title|title page|copyright( page)?|contents|table of contents|dedication|epigraph|foreword)$|^(preface|list of (figures|tables|illustrations))\b') THEN 'front_matter'
  WHEN regexp_matches(title, '(?i)^(index|bibliography|references|glossary|notes|epilogue|afterword|further reading|credits|colophon|errata)$|^appendix\b') THEN 'back_matter'
  WHEN regexp_matches(title, '(?i)^(acknowledg|about the )') THEN 'either' ELSE 'chapter' END AS k FROM t7),
t9 AS (SELECT *, coalesce(max((k = 'chapter')::INT) OVER (PARTITION BY parse_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM t8),
t10 AS (SELECT *, CASE WHEN k = 'either' THEN CASE WHEN seen = 1 THEN 'back_matter' ELSE 'front_matter' END ELSE k END AS k2 FROM t9),
tree AS (SELECT parse_id, line, chapter, CASE WHEN is_chapter THEN NULL ELSE s END AS section, title,
  CASE WHEN is_chapter AND chapter = 0 AND k2 = 'chapter' AND max(CASE WHEN is_chapter AND chapter = 1 THEN k2 END) OVER (PARTITION BY parse_id) = 'front_matter' THEN 'front_matter' ELSE k2 END AS kind FROM t10)
"""


@query(f"WITH {_TREE} SELECT parse_id, CAST(chapter AS INTEGER) AS chapter, CAST(section AS INTEGER) AS section, kind, title, CAST(line AS INTEGER) AS line FROM tree")
def structure_tree(spark: SparkSession, root: str) -> DataFrame:
    """Chapters and sections with their kinds (the data has no bare chapter numbers; merging them is tested apart)."""
    return structure.detect(reads.once_wide(table(spark, root, "parse_results"), "parse_id"), "parse_id")


@query("""
WITH s AS (SELECT DISTINCT section_id, chapter_id, position, title FROM sections),
n AS (SELECT chapter_id, string_agg(position || ':' || title, '|' ORDER BY position, title) AS sections FROM s GROUP BY 1)
SELECT book_id, chapter_id, position, title, kind, coalesce(sections, '') AS sections
FROM (SELECT DISTINCT book_id, chapter_id, position, title, kind FROM chapters) LEFT JOIN n USING (chapter_id)
""")
def structure_nested_view(spark: SparkSession, root: str) -> DataFrame:
    view = reads.structure_view(table(spark, root, "chapters"), table(spark, root, "sections"))
    joined = F.array_join(F.transform("sections", lambda s: F.concat(s["position"].cast("string"), F.lit(":"), s["title"])), "|")
    return view.select("book_id", "chapter_id", "position", "title", "kind", joined.alias("sections"))


_FLAT = """
c AS (SELECT DISTINCT chapter_id, book_id, position, title, kind FROM chapters),
s AS (SELECT DISTINCT section_id, chapter_id, position, title FROM sections),
nodes AS (SELECT book_id, position AS cp, -1 AS sp, chapter_id AS record_id, NULL AS parent_id,
    CASE kind WHEN 'front_matter' THEN 'front-matter' WHEN 'back_matter' THEN 'back-matter' ELSE 'chapter' END AS kind, title FROM c
  UNION ALL SELECT book_id, c.position, s.position, section_id, chapter_id, 'section', s.title FROM s JOIN c USING (chapter_id)),
flat AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY cp, sp, record_id) - 1 AS position, record_id, parent_id, kind, title FROM nodes)
"""


def _flat(spark: SparkSession, root: str) -> DataFrame:
    return structure.flatten(reads.once(table(spark, root, "chapters"), "chapter_id"), reads.once(table(spark, root, "sections"), "section_id"))


@query(f"WITH {_FLAT} SELECT book_id, CAST(position AS INTEGER) AS position, record_id, parent_id, kind, title FROM flat")
def document_order_flatten(spark: SparkSession, root: str) -> DataFrame:
    return _flat(spark, root)


_SLICED = """
lines AS (SELECT parse_id, CASE WHEN l[-1] = '' THEN l[:len(l) - 1] ELSE l END AS l FROM (SELECT parse_id, string_split(markdown, chr(10)) AS l FROM doc)),
slices AS (SELECT parse_id, chapter, line, array_to_string(l[line:coalesce(stop, len(l) + 1) - 1], chr(10)) AS body FROM starts JOIN lines USING (parse_id))
"""


@query(f"""
WITH {_TREE}, starts AS (SELECT parse_id, chapter, line, lead(line) OVER (PARTITION BY parse_id ORDER BY chapter) AS stop FROM tree WHERE section IS NULL), {_SLICED}
SELECT parse_id, CAST(chapter AS INTEGER) AS chapter, md5(body) AS digest, length(body)::INTEGER AS n_chars FROM slices
""")
def chapter_bodies(spark: SparkSession, root: str) -> DataFrame:
    """Digest and length of every chapter's own lines."""
    rows = reads.once_wide(table(spark, root, "parse_results"), "parse_id")
    out = structure.bodies(rows, structure.detect(rows, "parse_id"), "parse_id")
    return out.select("parse_id", "chapter", F.md5("body").alias("digest"), F.length("body").alias("n_chars"))


@query(f"""
WITH {_TREE}, starts AS (SELECT parse_id, chapter, line, lead(line) OVER (PARTITION BY parse_id ORDER BY line) AS stop FROM tree), {_SLICED}
SELECT parse_id, CAST(line AS INTEGER) AS line, md5(body) AS digest, length(body)::INTEGER AS n_chars FROM slices
""")
def section_slices(spark: SparkSession, root: str) -> DataFrame:
    """Digest and length of every heading's own lines."""
    rows = reads.once_wide(table(spark, root, "parse_results"), "parse_id")
    out = structure.section_slices(rows, structure.detect(rows, "parse_id"), "parse_id")
    return out.select("parse_id", "line", F.md5("body").alias("digest"), F.length("body").alias("n_chars"))


@query(r"""
WITH p AS (SELECT DISTINCT parse_id, book_id, parser, markdown, CASE parser WHEN 'marker' THEN 1 WHEN 'pymupdf' THEN 2 ELSE 3 END AS o,
  coalesce(regexp_matches(markdown, '[\p{L}\p{N}]'), false) AS ok FROM parse_results)
SELECT book_id, arg_min(parser, (o, parse_id)) FILTER (ok) AS parser, arg_min(parse_id, (o, parse_id)) FILTER (ok) AS parse_id, count(*) AS attempts, count(*) FILTER (NOT ok) AS rejected
FROM p GROUP BY book_id
""")
def parser_chain_first_success(spark: SparkSession, root: str) -> DataFrame:
    """For each book the first parser of the chain whose output holds a letter or digit."""
    rows = reads.once_wide(table(spark, root, "parse_results"), "parse_id")
    rank = F.when(F.col("parser") == "marker", 1).when(F.col("parser") == "pymupdf", 2).otherwise(3)
    ok = F.coalesce(T.has_alphanumeric(F.col("markdown")), F.lit(False))
    rows = rows.select("book_id", "parser", "parse_id", ok.alias("ok"), rank.alias("o"))
    first = F.min(F.when(F.col("ok"), F.struct("o", "parse_id", "parser")))
    return rows.groupBy("book_id").agg(first.alias("f"), F.count("*").alias("attempts"), F.count_if(~F.col("ok")).alias("rejected")).select(
        "book_id", F.col("f.parser").alias("parser"), F.col("f.parse_id").alias("parse_id"), "attempts", "rejected"
    )


@query(r"""
WITH p AS (SELECT DISTINCT parse_id, parser, markdown FROM parse_results WHERE markdown IS NOT NULL),
l AS (SELECT parse_id, unnest(string_split(markdown, chr(10))) AS line FROM p),
m AS (SELECT parse_id, count(*) FILTER (regexp_matches(line, '^\s*#')) AS headings, count(*) FILTER (regexp_matches(line, '^\s*[0-9]+\s*$')) AS bare_numbers,
  count(*) FILTER (regexp_matches(line, '(^|\s)(\pL ){4,}\pL(\s|$)')) AS letter_spaced FROM l GROUP BY 1)
SELECT parse_id, parser, length(markdown) AS n_chars, headings, (len(string_split(markdown, '```')) - 1) // 2 AS fences, letter_spaced, bare_numbers FROM p JOIN m USING (parse_id)
""")
def parser_metrics(spark: SparkSession, root: str) -> DataFrame:
    rows = reads.once_wide(table(spark, root, "parse_results"), "parse_id").where("markdown is not null")
    parts = F.split(F.col("markdown"), "\n", -1)
    count = lambda p: F.size(F.filter(parts, lambda x: x.rlike(p))).cast("bigint")
    return rows.select(
        "parse_id", "parser", F.length("markdown").cast("bigint").alias("n_chars"), count(r"^\s*#").alias("headings"),
        F.floor((F.size(F.split("markdown", "```", -1)) - 1) / 2).alias("fences"), count(r"(^|\s)(\p{L} ){4,}\p{L}(\s|$)").alias("letter_spaced"), count(r"^\s*[0-9]+\s*$").alias("bare_numbers"),
    )


@query(r"""
WITH b AS (SELECT DISTINCT book_id, title, author, checksum FROM books)
SELECT book_id, trim(regexp_replace(lower(regexp_replace(title, '^\s*\d+(?:[.\-]\d+)*[.)]?\s+', '')), '[^a-z0-9]+', ' ', 'g')) AS normalised,
  CASE WHEN length(trim(regexp_replace(title, '\s+', ' ', 'g'))) > 30 THEN rtrim(trim(regexp_replace(title, '\s+', ' ', 'g'))[:29]) || '…' ELSE trim(regexp_replace(title, '\s+', ' ', 'g')) END AS snippet,
  CASE WHEN length(checksum) <= 8 THEN '****' ELSE checksum[:4] || '…' || checksum[-4:] END AS redacted,
  CASE WHEN trim(regexp_replace(lower(author), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'unset' ELSE trim(regexp_replace(lower(author), '[^a-z0-9]+', '-', 'g'), '-') END AS slug FROM b
""")
def title_functions(spark: SparkSession, root: str) -> DataFrame:
    rows = reads.once(table(spark, root, "books"), "book_id")
    return rows.select(
        "book_id", T.normalise_title(F.col("title")).alias("normalised"), T.snippet(F.col("title"), 30).alias("snippet"), T.redact(F.col("checksum")).alias("redacted"), T.slug(F.col("author")).alias("slug")
    )


_STEM = "CASE " + " ".join(f"WHEN suffix(w, '{s}') AND length(w) - {len(s)} >= 4 THEN w[:length(w) - {len(s)}]" for s in T.SUFFIXES) + " ELSE w END"


@query(f"""
WITH b AS (SELECT DISTINCT chapter_id, title, summary FROM chapters WHERE summary IS NOT NULL),
stems AS (SELECT chapter_id, 't' AS side, {_STEM} AS stem FROM (SELECT chapter_id, unnest(regexp_extract_all(lower(title), '[a-z]+')) AS w FROM b) WHERE length(w) >= 4
  UNION SELECT chapter_id, 's', {_STEM} FROM (SELECT chapter_id, unnest(regexp_extract_all(lower(summary), '[a-z]+')) AS w FROM b) WHERE length(w) >= 4)
SELECT chapter_id, count(*) AS shared FROM (SELECT chapter_id, stem FROM stems GROUP BY 1, 2 HAVING count(*) = 2) GROUP BY 1
""")
def lint_content_word_overlap(spark: SparkSession, root: str) -> DataFrame:
    """Chapters whose summary shares stems with their title."""
    rows = reads.once(table(spark, root, "chapters"), "chapter_id").where("summary is not null")
    shared = F.size(F.array_intersect(T.content_words(F.col("title")), T.content_words(F.col("summary")))).cast("bigint")
    return rows.select("chapter_id", shared.alias("shared")).where("shared > 0")


@query(r"""
WITH b AS (SELECT DISTINCT book_id, edition FROM books WHERE edition IS NOT NULL),
c AS (SELECT book_id, trim(regexp_replace(trim(regexp_replace(lower(edition), '\bed(ition|n)?\b\.?|[.,]', ' ', 'g')), '\s+', ' ', 'g')) AS bare FROM b)
SELECT book_id, CAST(coalesce(try_cast(nullif(regexp_extract(bare, '^(\d+)(?:st|nd|rd|th)?$', 1), '') AS INTEGER),
  list_position(['first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth','eleventh','twelfth'], bare)) AS INTEGER) AS edition_no FROM c
""")
def edition_ordinals(spark: SparkSession, root: str) -> DataFrame:
    rows = reads.once(table(spark, root, "books"), "book_id").where("edition is not null")
    return rows.select("book_id", T.ordinal(F.col("edition")).alias("edition_no"))


# --- tables ------------------------------------------------------------------------------------------------------


@query("""
WITH b AS (SELECT DISTINCT book_id, file_hash, uploaded_at FROM books WHERE file_hash IS NOT NULL),
r AS (SELECT *, row_number() OVER w AS rn, first_value(book_id) OVER w AS kept_id FROM b WINDOW w AS (PARTITION BY file_hash ORDER BY uploaded_at, book_id))
SELECT book_id, file_hash, kept_id FROM r WHERE rn > 1
""")
def register_duplicates(spark: SparkSession, root: str) -> DataFrame:
    """Books whose file another registration already has."""
    return reads.duplicates(table(spark, root, "books"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def register_dedup_sha256(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").where("text is not null")
    return rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(r"""
SELECT book_id, lower(regexp_extract(original_filename, '(\.[^.]*)$', 1)) AS suffix,
  lower(regexp_extract(original_filename, '(\.[^.]*)$', 1)) IN ('.pdf', '.epub') AND '.' || file_format = lower(regexp_extract(original_filename, '(\.[^.]*)$', 1)) AS accepted
FROM (SELECT DISTINCT book_id, original_filename, file_format FROM books)
""")
def format_check(spark: SparkSession, root: str) -> DataFrame:
    suffix = F.lower(F.regexp_extract("original_filename", r"(\.[^.]*)$", 1))
    rows = reads.once(table(spark, root, "books"), "book_id")
    return rows.select("book_id", suffix.alias("suffix"), (suffix.isin(".pdf", ".epub") & (F.concat(F.lit("."), "file_format") == suffix)).alias("accepted"))


@query("SELECT book_id, title, author, CAST(row_number() OVER (ORDER BY uploaded_at, book_id) AS INTEGER) AS ord FROM (SELECT DISTINCT book_id, title, author, uploaded_at FROM books) QUALIFY ord <= 50")
def list_books_first_page(spark: SparkSession, root: str) -> DataFrame:
    """The first page of the list of books, in the order of the list."""
    page = reads.list_books(table(spark, root, "books")).limit(50)
    return page.select("book_id", "title", "author", F.row_number().over(W.orderBy("uploaded_at", "book_id")).alias("ord"))


@query("""
SELECT book_id, profile_id, model, prompt_version FROM (SELECT DISTINCT book_id, profile_id, model, prompt_version, created_at FROM book_profiles)
QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY created_at DESC, profile_id DESC) = 1
""")
def latest_profile(spark: SparkSession, root: str) -> DataFrame:
    return reads.latest(table(spark, root, "book_profiles"), "book_id", "created_at", "profile_id").select("book_id", "profile_id", "model", "prompt_version")


@query("SELECT DISTINCT object_id, book_id, title FROM knowledge_objects WHERE type = 'Smell'")
def knowledge_filter_by_type(spark: SparkSession, root: str) -> DataFrame:
    return reads.knowledge(table(spark, root, "knowledge_objects"), kind="Smell").select("object_id", "book_id", "title")


@query("""
SELECT book_id, sum(CASE WHEN stage IN ('profile','extraction','summaries') THEN coalesce(input_tokens, 0) END)::BIGINT AS input_tokens,
  sum(CASE WHEN stage IN ('profile','extraction','summaries') THEN coalesce(output_tokens, 0) END)::BIGINT AS output_tokens, count(*) FILTER (input_tokens IS NULL) AS unreported
FROM (SELECT DISTINCT * FROM llm_responses) GROUP BY 1
""")
def run_token_totals(spark: SparkSession, root: str) -> DataFrame:
    return reads.token_totals(reads.once_wide(table(spark, root, "llm_responses"), "response_id"), "book_id")


@query("""
SELECT book_id, nullif(concat_ws(',', max(CASE WHEN stage = 'profile' THEN 'profile=1' END), max(CASE WHEN stage = 'extraction' THEN 'extraction=2' END),
  max(CASE WHEN stage = 'summaries' THEN 'summary=1' END)), '') AS prompt_version FROM llm_responses GROUP BY 1
""")
def version_stamps(spark: SparkSession, root: str) -> DataFrame:
    return reads.version_stamps(table(spark, root, "llm_responses"), "book_id")


@query("""
WITH one AS (SELECT min(book_id) AS id FROM books)
SELECT book_id, CASE WHEN book_id = one.id THEN 'Renamed' ELSE title END AS title, CASE WHEN book_id = one.id THEN NULL ELSE isbn END AS isbn,
  CASE WHEN book_id = one.id THEN 2001 ELSE publication_year END AS publication_year FROM (SELECT DISTINCT book_id, title, isbn, publication_year FROM books), one
""")
def metadata_update(spark: SparkSession, root: str) -> DataFrame:
    books = reads.once(table(spark, root, "books"), "book_id")
    first = books.agg(F.min("book_id")).first()[0]
    return reads.update_metadata(books, first, title="Renamed", isbn="", publication_year=2001).select("book_id", "title", "isbn", "publication_year")


@query("""
SELECT object_id, CASE WHEN chapter_id IN (SELECT chapter_id FROM chapters) THEN chapter_id END AS chapter_id, CASE WHEN section_id IN (SELECT section_id FROM sections) THEN section_id END AS section_id
FROM (SELECT DISTINCT object_id, chapter_id, section_id FROM knowledge_objects)
""")
def dangling_links_nulled(spark: SparkSession, root: str) -> DataFrame:
    return reads.detached(table(spark, root, "knowledge_objects"), table(spark, root, "chapters"), table(spark, root, "sections")).select("object_id", "chapter_id", "section_id")


@query("""
WITH c AS (SELECT DISTINCT chapter_id, position, title FROM chapters), s AS (SELECT DISTINCT section_id, chapter_id, title FROM sections)
SELECT object_id, 'chapter ' || (c.position + 1) || ': ' || c.title || coalesce(' > ' || s.title, '') AS location
FROM (SELECT DISTINCT object_id, chapter_id, section_id FROM knowledge_objects) o JOIN c USING (chapter_id) LEFT JOIN s ON s.section_id = o.section_id AND s.chapter_id = o.chapter_id
""")
def section_pointer_resolve(spark: SparkSession, root: str) -> DataFrame:
    """Location text of objects; a section of another chapter leaves the chapter's link alone."""
    o = reads.once(table(spark, root, "knowledge_objects"), "object_id").select("object_id", "chapter_id", "section_id")
    c = reads.once(table(spark, root, "chapters"), "chapter_id").select("chapter_id", "position", F.col("title").alias("ct"))
    s = reads.once(table(spark, root, "sections"), "section_id").select("section_id", "chapter_id", F.col("title").alias("st"))
    return o.join(c, "chapter_id").join(s, ["section_id", "chapter_id"], "left").select("object_id", T.source_location(F.col("position"), F.col("ct"), F.col("st")).alias("location"))


_EMBED = """
c AS (SELECT DISTINCT chapter_id, book_id, position, summary FROM chapters), s AS (SELECT DISTINCT section_id, chapter_id, position, summary FROM sections),
o AS (SELECT DISTINCT object_id, book_id, type, title, summary, content FROM knowledge_objects),
e AS (SELECT book_id, 0 AS o1, position AS o2, -1 AS o3, 'chapter' AS record_type, chapter_id AS record_id, summary AS text FROM c WHERE summary <> ''
  UNION ALL SELECT book_id, 0, c.position, s.position, 'section', section_id, s.summary FROM s JOIN c USING (chapter_id) WHERE s.summary <> ''
  UNION ALL SELECT book_id, 1, 0, 0, 'knowledge_object', object_id, type || ': ' || title || chr(10) || summary || chr(10) || content FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY o1, o2, o3, record_id) - 1 AS ord FROM e)
"""


def _embeddable(spark: SparkSession, root: str) -> DataFrame:
    return reads.embeddable(table(spark, root, "chapters"), table(spark, root, "sections"), table(spark, root, "knowledge_objects"))


@query(f"WITH {_EMBED} SELECT record_id, list_aggregate([((length(text) + i) % 7 + 1)::INTEGER::VARCHAR for i in range(8)], 'string_agg', ',') AS vector FROM r")
def embed_fake_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Vectors of the deterministic offline embedder for everything that is embedded."""
    from lectern.plans.providers import fake_vector

    rows = _embeddable(spark, root)
    return rows.select("record_id", F.array_join(F.transform(fake_vector(F.col("text")), lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@query(f"WITH {_EMBED} SELECT book_id, CAST(ord // 100 AS BIGINT) AS batch, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM r GROUP BY 1, 2")
def embed_batches(spark: SparkSession, root: str) -> DataFrame:
    rows = _embeddable(spark, root).withColumn("batch", F.floor(F.col("ord") / 100))
    return rows.groupBy("book_id", "batch").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


# --- model answers -----------------------------------------------------------------------------------------------

_BARE = r"regexp_replace(regexp_replace(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '^```[^\n]*\n?', ''), '\n?[ \t]*```$', '')"


@query(f"""
WITH t AS (SELECT DISTINCT response_id, {_BARE} AS j FROM llm_responses WHERE stage = 'extraction' AND text IS NOT NULL),
a AS (SELECT response_id, unnest(CAST(json_extract(j, '$[*]') AS JSON[])) AS e FROM t WHERE json_valid(j) AND json_type(j) = 'ARRAY')
SELECT response_id, count(*) AS n_objects, round(sum((e->>'$.confidence')::DOUBLE), 6) AS confidence FROM a
WHERE json_type(e) = 'OBJECT' AND len(list_intersect(json_keys(e), ['type','title','content','summary','confidence'])) = 5
  AND (e->>'$.type') IN ('Practice','Principle','Tradeoff','Anti-pattern','Smell','Decision Rule','Definition','Glossary','Checklist')
  AND json_type(e, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT')
  AND coalesce(json_type(e, '$.section_index'), 'NULL') IN ('NULL', 'UBIGINT', 'BIGINT') AND coalesce(json_type(e, '$.page'), 'NULL') IN ('NULL', 'UBIGINT', 'BIGINT')
  AND coalesce(json_type(e, '$.paragraph'), 'NULL') IN ('NULL', 'UBIGINT', 'BIGINT') GROUP BY 1
""")
def extract_json_strict(spark: SparkSession, root: str) -> DataFrame:
    """Valid objects of each extraction answer."""
    rows = reads.once_wide(table(spark, root, "llm_responses"), "response_id").where("stage = 'extraction' and text is not null")
    good = answers.extracted(rows, "response_id", "text").where("reason is null")
    return good.groupBy("response_id").agg(F.count("*").alias("n_objects"), F.round(F.sum("confidence"), 6).alias("confidence"))


@query(f"""
WITH t AS (SELECT DISTINCT response_id, {_BARE} AS j FROM llm_responses WHERE stage = 'summaries' AND text IS NOT NULL),
v AS (SELECT response_id, j FROM t WHERE json_valid(j) AND json_type(j) = 'OBJECT' AND json_type(j, '$.chapter_summary') = 'VARCHAR' AND trim(j->>'$.chapter_summary') <> ''
  AND coalesce(json_type(j, '$.section_summaries'), 'NULL') IN ('NULL', 'ARRAY'))
SELECT response_id, j->>'$.chapter_summary' AS chapter_summary, nullif(trim(j->>'$.section_summaries[0]'), '') IS NOT NULL AS has_0, nullif(trim(j->>'$.section_summaries[1]'), '') IS NOT NULL AS has_1,
  nullif(trim(j->>'$.section_summaries[2]'), '') IS NOT NULL AS has_2 FROM v
""")
def summary_align_pad_truncate(spark: SparkSession, root: str) -> DataFrame:
    """Chapter summaries with exactly three aligned section summaries."""
    rows = reads.once_wide(table(spark, root, "llm_responses"), "response_id").where("stage = 'summaries' and text is not null")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for key, text in zip(pdf["response_id"], pdf["text"], strict=True):
                try:
                    chapter, sections = answers.summaries(text, 3)
                except answers.AnswerError:
                    continue
                out.append((key, chapter, *[s is not None for s in sections]))
            yield pd.DataFrame(out, columns=["response_id", "chapter_summary", "has_0", "has_1", "has_2"]).astype({"has_0": bool, "has_1": bool, "has_2": bool})

    return rows.select("response_id", "text").mapInPandas(run, "response_id string, chapter_summary string, has_0 boolean, has_1 boolean, has_2 boolean")


# --- evaluation --------------------------------------------------------------------------------------------------

_NORM = r"trim(regexp_replace(lower(regexp_replace({0}, '^\s*\d+(?:[.\-]\d+)*[.)]?\s+', '')), '[^a-z0-9]+', ' ', 'g'))"
_AUTHORED = f"""
{_FLAT},
authored AS (SELECT book_id, record_id AS loc, parent_id AS parent_loc, kind, position, (position + 1) || '. ' || upper(title) AS title FROM flat WHERE position % 4 <> 3)
"""
_LOCATED = f"""
{_AUTHORED},
d AS (SELECT *, {_NORM.format("title")} AS norm FROM flat), a AS (SELECT *, {_NORM.format("title")} AS norm FROM authored),
dc AS (SELECT *, row_number() OVER (PARTITION BY book_id, norm ORDER BY position) AS nth FROM d WHERE kind <> 'section'),
ac AS (SELECT *, row_number() OVER (PARTITION BY book_id, norm ORDER BY position) AS nth FROM a WHERE kind <> 'section'),
top AS (SELECT dc.book_id, dc.record_id, ac.loc FROM dc JOIN ac USING (book_id, norm, nth)),
ds AS (SELECT d.*, top.loc AS parent_loc FROM d LEFT JOIN top ON top.book_id = d.book_id AND top.record_id = d.parent_id WHERE d.kind = 'section'),
dw AS (SELECT *, row_number() OVER (PARTITION BY book_id, parent_loc, norm ORDER BY position) AS nth FROM ds WHERE parent_loc IS NOT NULL),
aw AS (SELECT *, row_number() OVER (PARTITION BY book_id, parent_loc, norm ORDER BY position) AS nth FROM a WHERE kind = 'section'),
within AS (SELECT dw.book_id, dw.record_id, aw.loc FROM dw JOIN aw USING (book_id, parent_loc, norm, nth)),
rest AS (SELECT * FROM a WHERE kind = 'section' AND loc NOT IN (SELECT loc FROM within)),
single AS (SELECT book_id, norm, min(loc) AS loc FROM rest GROUP BY 1, 2 HAVING count(*) = 1),
orphan AS (SELECT * FROM ds WHERE parent_loc IS NULL QUALIFY row_number() OVER (PARTITION BY book_id, norm ORDER BY position) = 1),
located AS (SELECT * FROM top UNION ALL SELECT * FROM within UNION ALL SELECT orphan.book_id, orphan.record_id, single.loc FROM orphan JOIN single USING (book_id, norm))
"""


def _located(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    detected = _flat(spark, root)
    authored = detected.where("position % 4 != 3").select(
        "book_id", F.col("record_id").alias("loc"), F.col("parent_id").alias("parent_loc"), "kind", "position", F.concat((F.col("position") + 1).cast("string"), F.lit(". "), F.upper("title")).alias("title")
    )
    return detected, authored, locations.join_locations(detected, authored)


@query(f"WITH {_LOCATED} SELECT book_id, record_id, loc FROM located")
def location_join(spark: SparkSession, root: str) -> DataFrame:
    """Detected nodes mapped to an authored table of contents that lacks every fourth node."""
    return _located(spark, root)[2]


@query(f"""
WITH {_LOCATED}, {_SCORED},
hits AS (SELECT 'q' AS query_id, row_number() OVER (ORDER BY score DESC, point_id) AS rank, record_type, record_id FROM scored QUALIFY rank <= 200),
o AS (SELECT DISTINCT object_id, chapter_id, section_id FROM knowledge_objects)
SELECT query_id, CAST(rank AS INTEGER) AS rank, hits.record_id, loc FROM hits LEFT JOIN o ON o.object_id = hits.record_id
JOIN located ON located.record_id = CASE WHEN record_type = 'knowledge_object' THEN coalesce(o.section_id, o.chapter_id) ELSE hits.record_id END
""")
def locate_hits_rank_gaps(spark: SparkSession, root: str) -> DataFrame:
    hits = search.top_k(table(spark, root, "points"), PROBE, 200).select(F.lit("q").alias("query_id"), "rank", "record_type", "record_id")
    links = reads.once(table(spark, root, "knowledge_objects"), "object_id").select(F.col("object_id").alias("record_id"), "section_id", "chapter_id")
    return locations.locate_hits(hits, links, _located(spark, root)[2])


@query("""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id, q.label AS want, p.vec_id AS n, p.label AS got, round(list_dot_product(q.v, p.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(p.v, p.v))), 6) AS score
  FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, n) AS rank FROM s QUALIFY rank <= 10),
b AS (SELECT vec_id, any_value(want) AS label, min(rank) FILTER (got = want) AS best FROM r GROUP BY 1)
SELECT CASE WHEN grouping(label) = 1 THEN 'all' ELSE 'label' END AS grp, coalesce(label::VARCHAR, '') AS value, round(avg(coalesce(1.0 / best, 0)), 9) AS mrr,
  round(avg(CASE WHEN best <= 5 THEN 1.0 ELSE 0.0 END), 9) AS hit_at_5, count(*) AS n FROM b GROUP BY GROUPING SETS ((), (label))
""")
def recall_mrr_hit5(spark: SparkSession, root: str) -> DataFrame:
    """Retrieval quality of vectors: a neighbour of the same label is a hit."""
    rows = table(spark, root, "embeddings")
    queries = rows.where("vec_id % 20 = 0")
    labels = rows.select(F.col("vec_id").alias("neighbour"), F.col("label").cast("string").alias("loc"))
    hits = search.batch_top_k(queries, rows, "vec_id", "embedding").join(labels, "neighbour").select(F.col("vec_id").alias("query_id"), "rank", "loc")
    expected = queries.select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("loc"))
    judged = scoring.judge(expected, hits).join(expected.select("query_id", F.col("loc").alias("label")), "query_id")
    return scoring.recall(judged, "label")


@query(f"""
WITH {_TREE}, {_FLAT},
e AS (SELECT book_id, kind, {_NORM.format("title")} AS norm, count(*) AS e FROM flat WHERE kind IN ('chapter', 'section') GROUP BY ALL),
pr AS (SELECT DISTINCT parse_id, book_id FROM parse_results),
first AS (SELECT book_id, min(parse_id) AS parse_id FROM pr GROUP BY 1),
d AS (SELECT book_id, kind, {_NORM.format("title")} AS norm, count(*) AS d FROM tree JOIN first USING (parse_id) WHERE kind IN ('chapter', 'section') GROUP BY ALL),
j AS (SELECT coalesce(e.book_id, d.book_id) AS book_id, coalesce(e.e, 0) AS e, coalesce(d.d, 0) AS d FROM e FULL JOIN d ON e.book_id = d.book_id AND e.kind = d.kind AND e.norm = d.norm),
g AS (SELECT book_id, sum(least(e, d))::BIGINT AS matched, sum(d)::BIGINT AS detected, sum(e)::BIGINT AS expected FROM j GROUP BY ROLLUP (book_id)),
rates AS (SELECT *, CASE WHEN detected = 0 THEN 0.0 ELSE matched / detected END AS p, CASE WHEN expected = 0 THEN 0.0 ELSE matched / expected END AS r FROM g)
SELECT book_id, matched, detected, expected, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM rates
""")
def structure_prf(spark: SparkSession, root: str) -> DataFrame:
    """Detected structure of each book's first parse against its stored chapters and sections."""
    rows = reads.once_wide(table(spark, root, "parse_results"), "parse_id")
    first = rows.groupBy("book_id").agg(F.min("parse_id").alias("parse_id"))
    detected = structure.detect(rows, "parse_id").join(first, "parse_id").select("book_id", "kind", T.normalise_title(F.col("title")).alias("norm"))
    return scoring.structure_scores(_flat(spark, root).select("book_id", "kind", T.normalise_title(F.col("title")).alias("norm")), detected)


@query(f"""
WITH c AS (SELECT field, canon_id AS concept_id, {_NORM.format("unnest(list_prepend(name, aliases))")} AS norm FROM ref_values),
s AS (SELECT DISTINCT 'type' AS field, {_NORM.format("type")} AS norm FROM knowledge_objects UNION SELECT 'primary_topic', {_NORM.format("primary_topic")} FROM books UNION SELECT 'language', {_NORM.format("language")} FROM books),
m AS (SELECT DISTINCT field, concept_id, max((c.norm <> '' AND EXISTS (SELECT 1 FROM s WHERE s.field = c.field AND s.norm = c.norm))::INT) OVER (PARTITION BY field, concept_id) AS hit FROM c)
SELECT field, count(*) FILTER (hit = 1) AS found, count(*) AS total, round(count(*) FILTER (hit = 1) / count(*), 9) AS recall FROM m GROUP BY ROLLUP (field)
""")
def coverage_recall(spark: SparkSession, root: str) -> DataFrame:
    """Reference entries that typed values surface under their name or an alias."""
    ref = table(spark, root, "ref_values")
    names = F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), T.normalise_title)
    concepts = ref.select("field", F.col("canon_id").alias("concept_id"), names.alias("names"))
    surfaced = table(spark, root, "knowledge_objects").select(F.lit("type").alias("field"), F.col("type").alias("v"))
    for column in ("primary_topic", "language"):
        surfaced = surfaced.unionByName(table(spark, root, "books").select(F.lit(column).alias("field"), F.col(column).alias("v")))
    return scoring.coverage(concepts, surfaced.select("field", T.normalise_title(F.col("v")).alias("norm")), "field")


_JUDGED = """
o AS (SELECT DISTINCT object_id, book_id, confidence, extraction_model FROM knowledge_objects),
b AS (SELECT book_id, count(*) FILTER (confidence >= 0.2) AS supported, count(*) AS claims FROM o GROUP BY 1)
"""


@query(f"""
WITH {_JUDGED} SELECT round(coalesce(avg(supported / claims), 0), 9) AS mean_support, count(*) AS judged, count(*) FILTER (supported / claims < 0.9) AS below_bar FROM b WHERE claims > 0
""")
def faithfulness_mean(spark: SparkSession, root: str) -> DataFrame:
    o = reads.once(table(spark, root, "knowledge_objects"), "object_id")
    return scoring.faithfulness(o.groupBy("book_id").agg(F.count_if(F.col("confidence") >= 0.2).alias("supported"), F.count("*").alias("claims")))


@query("""
WITH o AS (SELECT DISTINCT object_id, extraction_model, confidence, chapter_id, section_id, page FROM knowledge_objects),
m AS (SELECT extraction_model, count(*) AS n, avg((chapter_id IS NOT NULL)::INT) AS recall, avg((section_id IS NOT NULL)::INT) AS structure, avg((page IS NOT NULL)::INT) AS coverage FROM o GROUP BY 1),
two AS (SELECT *, row_number() OVER (ORDER BY n DESC, extraction_model) AS rn FROM m WHERE extraction_model IS NOT NULL),
u AS (UNPIVOT (SELECT rn, recall, structure, coverage FROM two WHERE rn <= 2) ON recall, structure, coverage INTO NAME dimension VALUE score),
j AS (SELECT dimension, round(max(score) FILTER (rn = 1), 9) AS base, round(max(score) FILTER (rn = 2), 9) AS candidate FROM u GROUP BY 1)
SELECT dimension, base, candidate, round(candidate - base, 9) AS delta, CASE WHEN candidate IS NULL OR base IS NULL THEN 'incomparable'
  WHEN -round(candidate - base, 9) > CASE dimension WHEN 'structure' THEN 0.02 ELSE 0.05 END THEN 'regression' ELSE 'ok' END AS verdict FROM j
""")
def compare_regression(spark: SparkSession, root: str) -> DataFrame:
    """The two most used extraction models as runs, compared by how well their objects are linked."""
    o = reads.once(table(spark, root, "knowledge_objects"), "object_id").where("extraction_model is not null")
    share = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("int")), 9)
    m = o.groupBy("extraction_model").agg(F.count("*").alias("n"), share("chapter_id").alias("recall"), share("section_id").alias("structure"), share("page").alias("coverage"))
    two = m.withColumn("rn", F.row_number().over(W.orderBy(F.desc("n"), "extraction_model"))).where("rn <= 2")  # a row for each model
    long = two.unpivot(["rn"], ["recall", "structure", "coverage"], "dimension", "score")
    return scoring.compare(long.where("rn = 1"), long.where("rn = 2"))


@query("""
SELECT stage, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens, count(*) AS calls, count(*) FILTER (input_tokens IS NULL) AS unreported
FROM (SELECT DISTINCT * FROM llm_responses) WHERE stage <> '' GROUP BY 1
""")
def cost_by_stage(spark: SparkSession, root: str) -> DataFrame:
    return scoring.stage_costs(reads.once_wide(table(spark, root, "llm_responses"), "response_id"))


@query("""
SELECT model, sum(coalesce(input_tokens, 0)) FILTER (stage = 'profile')::BIGINT AS profile, sum(coalesce(input_tokens, 0)) FILTER (stage = 'extraction')::BIGINT AS extraction,
  sum(coalesce(input_tokens, 0)) FILTER (stage = 'summaries')::BIGINT AS summaries FROM (SELECT DISTINCT * FROM llm_responses) GROUP BY 1
""")
def cost_pivot(spark: SparkSession, root: str) -> DataFrame:
    rows = reads.once_wide(table(spark, root, "llm_responses"), "response_id")
    return rows.groupBy("model").pivot("stage", ["profile", "extraction", "summaries"]).agg(F.sum(F.coalesce("input_tokens", F.lit(0))))


@query("""
WITH k AS (SELECT unnest(['chapter', 'section', 'knowledge_object', 'book_profile']) AS kind)
SELECT kind, count(point_id) AS n, count(point_id) < 4 AS too_few FROM k LEFT JOIN (SELECT DISTINCT point_id, record_type FROM points) p ON record_type = kind GROUP BY 1
""")
def lint_kind_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Points of each kind; a kind with fewer than four is too thin to judge."""
    kinds = spark.createDataFrame([("chapter",), ("section",), ("knowledge_object",), ("book_profile",)], "kind string")
    rows = table(spark, root, "points").select("point_id", F.col("record_type").alias("kind")).distinct()
    return rows.join(F.broadcast(kinds), "kind", "right").groupBy("kind").agg(F.count("point_id").alias("n"), (F.count("point_id") < 4).alias("too_few"))


@query("""
SELECT 'chapter' AS what, chapter_id AS missing, count(*) AS n FROM (SELECT DISTINCT object_id, chapter_id FROM knowledge_objects) WHERE chapter_id IS NOT NULL AND chapter_id NOT IN (SELECT chapter_id FROM chapters) GROUP BY ALL
UNION ALL SELECT 'section', section_id, count(*) FROM (SELECT DISTINCT object_id, section_id FROM knowledge_objects) WHERE section_id IS NOT NULL AND section_id NOT IN (SELECT section_id FROM sections) GROUP BY ALL
UNION ALL SELECT 'book', book_id, count(*) FROM (SELECT DISTINCT object_id, book_id FROM knowledge_objects) WHERE book_id IS NOT NULL AND book_id NOT IN (SELECT book_id FROM books) GROUP BY ALL
""")
def lint_referential(spark: SparkSession, root: str) -> DataFrame:
    o = reads.once(table(spark, root, "knowledge_objects"), "object_id")
    out = None
    for what, name in (("chapter", "chapters"), ("section", "sections"), ("book", "books")):
        key = f"{what}_id"
        part = o.where(F.col(key).isNotNull()).join(table(spark, root, name).select(key).distinct(), key, "left_anti").groupBy(F.lit(what).alias("what"), F.col(key).alias("missing")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query(rf"""
WITH a AS (SELECT DISTINCT parse_id AS artifact_id, trim(regexp_replace(lower(markdown), '[^a-z0-9]+', ' ', 'g')) AS norm FROM parse_results WHERE markdown IS NOT NULL),
c AS (SELECT DISTINCT chapter_id, book_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS norm FROM chapters),
t AS (SELECT *, len(list_filter(string_split(norm, ' '), lambda w: length(w) >= 4)) AS weight FROM c),
w AS (SELECT * FROM t WHERE weight > 0 AND norm <> ''), whole AS (SELECT book_id, sum(weight) AS whole FROM w GROUP BY 1),
h AS (SELECT artifact_id, book_id, sum(weight) AS hit FROM a JOIN w ON contains(a.norm, w.norm) GROUP BY 1, 2),
s AS (SELECT artifact_id, book_id, round(hit / whole, 9) AS score FROM h JOIN whole USING (book_id)),
r AS (SELECT *, row_number() OVER o AS rn, lead(score) OVER o AS runner_up FROM s WINDOW o AS (PARTITION BY artifact_id ORDER BY score DESC, book_id))
SELECT artifact_id, book_id, score, coalesce(runner_up, 0.0) AS runner_up, score >= 0.4 AND (runner_up IS NULL OR score - runner_up >= 0.15) AS decided FROM r WHERE rn = 1
""")
def identify_sources(spark: SparkSession, root: str) -> DataFrame:
    """The book whose weighted chapter titles each parsed text holds best."""
    parsed = reads.once_wide(table(spark, root, "parse_results"), "parse_id").where("markdown is not null")
    artifacts = parsed.select(F.col("parse_id").alias("artifact_id"), T.normalise_source(F.col("markdown")).alias("norm"))
    norm = T.normalise_source(F.col("title"))
    titles = reads.once(table(spark, root, "chapters"), "chapter_id").select(F.col("chapter_id").alias("title_id"), "book_id", norm.alias("norm"), T.word_weight(norm).alias("weight"))
    return scoring.identify(artifacts, titles)


@query("""
WITH b AS (SELECT DISTINCT book_id, title, author FROM books), c AS (SELECT DISTINCT chapter_id, book_id, position, title FROM chapters), s AS (SELECT DISTINCT section_id, chapter_id, position, title FROM sections),
n AS (SELECT chapter_id, string_agg(k || '. ' || title, chr(10) ORDER BY k) AS secs FROM (SELECT chapter_id, title, row_number() OVER (PARTITION BY chapter_id ORDER BY position, section_id) - 1 AS k FROM s) GROUP BY 1)
SELECT chapter_id, md5('Book: ' || b.title || ' by ' || author || chr(10) || 'Chapter ' || (position + 1) || ': ' || c.title || chr(10) || chr(10) || 'Numbered sections in this chapter:' || chr(10) || coalesce(secs, '(none detected)')) AS digest
FROM c JOIN b USING (book_id) LEFT JOIN n USING (chapter_id)
""")
def prompt_chapter_scaffold(spark: SparkSession, root: str) -> DataFrame:
    from lectern.plans.prompts import chapter_scaffold

    head = chapter_scaffold(reads.once(table(spark, root, "books"), "book_id"), reads.once(table(spark, root, "chapters"), "chapter_id"), reads.once(table(spark, root, "sections"), "section_id"))
    return head.select("chapter_id", F.md5("scaffold").alias("digest"))


@query("""
WITH n AS (SELECT DISTINCT book_id, methodology, framework FROM books)
SELECT book_id, array_to_string(list_filter(CASE WHEN methodology = framework THEN [methodology] ELSE [methodology, framework] END, lambda x: x IS NOT NULL), '|') AS notes FROM n
""")
def notes_ordered_distinct(spark: SparkSession, root: str) -> DataFrame:
    """First-seen union of two lists."""
    rows = reads.once(table(spark, root, "books"), "book_id")
    both = F.array_distinct(F.concat(F.array("methodology"), F.array("framework")))
    return rows.select("book_id", F.array_join(F.filter(both, lambda x: x.isNotNull()), "|").alias("notes"))
