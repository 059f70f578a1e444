"""Detecting texts that were cut at a field limit or in transfer, in SQL alone.

A JSON answer is whole if it parses, fenced or not.  Ends of prose are judged by trigrams: every word trigram of every
text is counted where it stands inside and where it stands at an end, and the final trigram of a text is joined to
both counts.  One that is frequent inside but almost never final marks a cut.  Rates have a prior: after a full stop a
trigram nobody has seen says nothing (as many ends as not), while one without a full stop is an ending only if it ends
a fixed share of all texts.  List items, headings and notes, which carry no full stop, are judged in the same way by
their last word: how often it ends items and sentences, against its other uses.  A trailing mark of omission is taken
off first; it leaves a text whole only if the trigram before it ends such a share of the texts with a mark.

The closing of tables, tags, formulas and code, which no trigram can tell, is seen by its form; such ends are whole.
Every count runs over all texts that are no JSON.  Numbers in trigrams are folded to one digit, and trigrams are
counted by their 64-bit hashes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import durable
from lectern.sources import table

#: Least share of a trigram's places that must be ends of texts; for the last word of an item the same among its uses.
FINAL_SHARE = 0.02
ITEM_SHARE = 0.002
#: Share of all ends that a trigram without a full stop must make up to be an ending.
ENDING_SHARE = 0.0002

#: Where the texts are: table, key, text, model.
SOURCES = (
    ("llm_responses", "response_id", "text", "model"),
    ("chapters", "chapter_id", "summary", "summary_model"),
    ("sections", "section_id", "summary", "summary_model"),
    ("book_profiles", "profile_id", "content", "model"),
)

_CLOSERS = "[\"\\'”’»)\\\\]*_]*"
_ITEM = r"(?m)^[ \\t]*(?:[-*+•]|\\(?\\d+[.)]|#+|\\\\item)[ \\t]+[^\\n]*?(\\S+)[ \\t]*\\n"

_BLANK = "' \\t\\n\\r\\f\\u000b\\u0085\\u00a0\\u1680\\u2000\\u2001\\u2002\\u2003\\u2004\\u2005\\u2006\\u2007\\u2008\\u2009\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000'"
# Marks of omission that a limit or a transfer leaves behind.
_MARKS = ("[...]", "(...)", "[…]", "(…)", "...", "…", "(cut)", "[cut]", "(truncated)", "[truncated]", "(continued)", "[continued]")
_MARK_LENGTH = "CASE " + " ".join(f"WHEN endswith(whole, '{m}') THEN {len(m)}" for m in _MARKS) + " ELSE 0 END"

_JSON = r'^\\s*(```[a-zA-Z]*\\s*)?(\\[\\s*[{"\\]]|\\{\\s*["}]|\\[\\s*$|\\{\\s*$|null$)'

# What one text says about its own end.  Ends are cut off by plain string functions: a pattern tied to the end of a
# text would be tried from each of its characters.
_SHAPE = rf"""
SELECT tbl, rec_id, model, line,
  CASE
    WHEN json_like THEN IF(try_parse_json(regexp_replace(IF(endswith(whole, '```'), trim(TRAILING {_BLANK} FROM left(whole, length(whole) - 3)), whole), '^\\s*```[a-zA-Z]*\\s*', '')) IS NOT NULL, 'whole', 'cut')
    WHEN endswith(whole, '\ufffd') THEN 'cut'
    WHEN (contains(body, '```') OR contains(body, '~~~')) AND size(regexp_extract_all(body, '(?m)^[ ]{{0,3}}(```|~~~)', 1)) % 2 = 1 THEN 'cut'
    WHEN mark > 0 THEN 'mark'
    WHEN word RLIKE '[.!?。！？।॥…]{_CLOSERS}(`|\\}}|</[a-zA-Z]+>|\\[\\^[^\\]]*\\]|\\\\[a-z]+\\{{[^}}]*\\}})*$' THEN 'stop'
    WHEN line RLIKE '^[ ]{{0,3}}(```|~~~)[ \\t]*$' THEN 'whole'
    WHEN endswith(body, '|') AND line RLIKE '^[ \\t]*\\|' OR line = '|}}' THEN 'whole'
    WHEN endswith(body, '=') AND line RLIKE '^[ \\t]*(=+)[^=].*[^=]\\1$' THEN 'whole'
    WHEN line RLIKE '^[ \\t]*\\[\\^[^\\]]+\\]:[ \\t]*\\S' THEN 'item'
    WHEN endswith(body, '>') AND line RLIKE '(?i)</(p|div|section|article|li|ul|ol|blockquote|table|tr|td|th|h[1-6]|pre|main|body|html)\\s*>$|<(br|hr|img)\\b[^>]*>$|-->$' THEN 'whole'
    WHEN endswith(body, '}}') AND line RLIKE '\\\\end\\{{[^}}]*\\}}$|\\\\(sub)*(section|paragraph|chapter)\\*?\\{{[^}}]*\\}}$|^[ \\t]*\\{{\\{{.*\\}}\\}}$' THEN 'whole'
    WHEN endswith(body, '\\]') OR endswith(body, '\\)') THEN 'whole'
    WHEN endswith(body, ']]') AND line RLIKE '\\[\\[(Category|File|Image):[^\\]]*\\]\\]$' THEN 'whole'
    WHEN endswith(body, '$$') AND size(split(body, '\\$\\$', -1)) % 2 = 1 THEN 'whole'
    WHEN line RLIKE '^[ \\t]*(\\*\\*|__)[^*_]+(\\*\\*|__)$' THEN 'whole'
    WHEN line RLIKE '^[ \\t]*([-*+•]|\\(?\\d+[.)]|#+|\\\\item)[ \\t]+\\S' THEN 'item'
    ELSE 'bare'
  END AS shape,
  regexp_replace(substring_index(translate(body, '\n\t', '  '), ' ', -3), '\\d+', '9') AS trigram, word
FROM (
  SELECT *, substring_index(translate(line, '\t', ' '), ' ', -1) AS word FROM (
    SELECT *, substring_index(body, '\n', -1) AS line FROM (
      SELECT *, IF(mark = 0, whole, trim(TRAILING {_BLANK} FROM left(whole, length(whole) - mark))) AS body FROM (
        SELECT *, {_MARK_LENGTH} AS mark,
          whole RLIKE '{_JSON}' AS json_like
        FROM (SELECT tbl, rec_id, model, trim(TRAILING {_BLANK} FROM text) AS whole FROM :texts WHERE text RLIKE '[^\\s\\p{{Z}}]')
      )
    )
  )
)
"""

# Hashes of what stands inside texts: trigrams (t), words as they are (u), and words that end sentences or items (f).
_INSIDE = rf"""
SELECT key, count(*) AS inside FROM (
  SELECT explode(concat(
    IF(n > 3, transform(slice(w, 3, n - 3), (x, i) -> xxhash64('t', w[i], w[i + 1], x)), array()),
    IF(n > 1, transform(slice(w, 1, n - 1), x -> xxhash64('u', x)), array()),
    IF(n > 1, transform(filter(slice(w, 1, n - 1), x -> right(x, 1) IN ('.', '!', '?', '…', ':')), x -> xxhash64('f', trim(TRAILING '.!?…:' FROM x))), array()),
    transform(regexp_extract_all(text, '{_ITEM}', 1), x -> xxhash64('f', regexp_replace(x, '\\d+', '9')))
  )) AS key
  FROM (SELECT text, w, size(w) AS n FROM (
    SELECT text, split(trim({_BLANK} FROM regexp_replace(text, '\\d+', '9')), '\\s+') AS w FROM :texts
    WHERE text RLIKE '[^\\s\\p{{Z}}]' AND NOT (text RLIKE '{_JSON}')
  ))
) GROUP BY key
"""

_KEYS = r"""
SELECT tbl, rec_id, model, shape, ends, marks, ask.kind, ask.key FROM (
  SELECT *, CASE WHEN shape = 'item' THEN array(struct('f' AS kind, xxhash64('f', folded) AS key), struct('u' AS kind, xxhash64('u', folded) AS key))
    ELSE array(struct('t' AS kind, xxhash64('t', get(t, 0), get(t, 1), get(t, 2)) AS key)) END AS asks
  FROM (SELECT s.*, split(trigram, ' +') AS t, regexp_replace(word, '\\d+', '9') AS folded, ends, marks FROM :shapes s JOIN :ends e USING (trigram))
) LATERAL VIEW explode(asks) AS ask
"""

_JUDGED = """
SELECT tbl, rec_id, model, CASE first(shape)
    WHEN 'stop' THEN (first(ends) - 0.5) / (max(t) + first(ends)) < {share}
    WHEN 'item' THEN (max(f) + 0.001) / (max(f) + max(u) + 1) < {item}
    WHEN 'mark' THEN (first(marks) - 1) / (max(t) + first(marks) - 1 + {weak}) < {share}
    ELSE (first(ends) - 1) / (max(t) + first(ends) - 1 + {strong}) < {share}
  END AS cut
FROM (
  SELECT tbl, rec_id, model, shape, ends, marks, IF(kind = 't', coalesce(inside, 0), 0) AS t, IF(kind = 'f', coalesce(inside, 0), 0) AS f, IF(kind = 'u', coalesce(inside, 0), 0) AS u
  FROM :asked LEFT JOIN :insides USING (key)
) GROUP BY tbl, rec_id, model
"""


def _sql(query: str, **frames: DataFrame) -> DataFrame:
    """Run a query over DataFrames, named ``:name`` in it."""
    spark = next(iter(frames.values())).sparkSession
    for name, frame in frames.items():
        view = f"{name}_{uuid.uuid4().hex}"
        frame.createOrReplaceTempView(view)
        query = query.replace(f":{name} ", f"{view} ").replace(f":{name}\n", f"{view}\n")
    return spark.sql(query)


def gather(spark: SparkSession, root: str) -> DataFrame:
    """``(tbl, rec_id, model, text)`` of every place where a text may be cut."""
    out = None
    for name, key, text, model in SOURCES:
        part = table(spark, root, name).select(
            F.lit(name).alias("tbl"), F.col(key).alias("rec_id"), F.col(model).alias("model"), F.col(text).alias("text")
        )
        out = part if out is None else out.unionByName(part)
    return out


def judge(texts: DataFrame, share: float = FINAL_SHARE, item: float = ITEM_SHARE, ending: float = ENDING_SHARE) -> DataFrame:
    """``(tbl, rec_id, model, cut)`` once for every record with a text; null and blank texts are left out.

    The texts themselves are read twice and never shuffled: what moves are the last trigrams and the counts, which
    are summed up before they are exchanged.  A record delivered twice counts once.
    """
    shapes = _sql(_SHAPE, texts=texts).selectExpr("tbl", "rec_id", "model", "shape", "regexp_replace(trigram, '\\\\s+', ' ') AS trigram", "word")
    shapes = durable(shapes.distinct(), "shapes")
    settled = shapes.where("shape IN ('whole', 'cut')").selectExpr("tbl", "rec_id", "model", "shape = 'cut' AS cut")
    open_ = shapes.where("shape NOT IN ('whole', 'cut')")
    ends = open_.groupBy("trigram").agg(F.count("*").alias("ends"), F.count_if(F.col("shape") == "mark").alias("marks"))
    # The prior of a trigram without a full stop: one that ends this share of all texts, and another one, outweighs it.
    n = open_.count()
    strong, weak = (1 + ending * n) / share, (0.5 + ending * n) / share
    asked = _sql(_KEYS, shapes=open_, ends=ends)
    judged = _sql(_JUDGED.format(share=float(share), item=float(item), strong=float(strong), weak=float(weak)), asked=asked, insides=_sql(_INSIDE, texts=texts))
    return settled.unionByName(judged)


def rates(judged: DataFrame) -> DataFrame:
    """Texts, cut texts and their share for each table and model; a missing model is one group."""
    return judged.groupBy("tbl", "model").agg(
        F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), F.round(F.count_if("cut") / F.count("*"), 6).alias("cut_rate")
    )


# --- the same in DuckDB's SQL --------------------------------------------------------------------------------------

_DUCK_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(133) || chr(160) || chr(5760) || " + " || ".join(f"chr({c})" for c in (*range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
_DUCK_CLOSERS = "[\"''”’»)\\]*_]*"
_DUCK_JSON = r'^\s*(```[a-zA-Z]*\s*)?(\[\s*[{"\]]|\{\s*["}]|\[\s*$|\{\s*$|null$)'
_DUCK_ITEM = r"(?m)^[ \t]*(?:[-*+•]|\(?\d+[.)]|#+|\\item)[ \t]+[^\n]*?(\S+)[ \t]*\n"
_DUCK_HEADS = "|".join(f"{'=' * n}[^=].*[^=]{'=' * n}" for n in range(1, 7))
_DUCK_MARK = "CASE " + " ".join(f"WHEN suffix(whole, '{m}') THEN {len(m)}" for m in _MARKS) + " ELSE 0 END"

DUCKDB_JUDGED = rf"""
texts AS ({" UNION ".join(f"SELECT '{name}' AS tbl, {key} AS rec_id, {model} AS model, {text} AS text FROM {name}" for name, key, text, model in SOURCES)}),
texty AS (SELECT * FROM texts WHERE regexp_matches(text, '[^\s\p{{Z}}]')),
a AS (SELECT tbl, rec_id, model, rtrim(text, {_DUCK_BLANK}) AS whole FROM texty),
b AS (SELECT *, {_DUCK_MARK} AS mark, regexp_matches(whole, '{_DUCK_JSON}') AS json_like FROM a),
c AS (SELECT *, CASE WHEN mark = 0 THEN whole ELSE rtrim(left(whole, length(whole) - mark), {_DUCK_BLANK}) END AS body FROM b),
d AS (SELECT *, string_split(body, chr(10))[-1] AS line FROM c),
e AS (SELECT *, string_split(replace(line, chr(9), ' '), ' ')[-1] AS word FROM d),
shapes AS (SELECT tbl, rec_id, model, word,
  CASE WHEN json_like THEN CASE WHEN json_valid(regexp_replace(CASE WHEN suffix(whole, '```') THEN rtrim(left(whole, length(whole) - 3), {_DUCK_BLANK}) ELSE whole END, '^\s*```[a-zA-Z]*\s*', '')) THEN 'whole' ELSE 'cut' END
    WHEN suffix(whole, chr(65533)) THEN 'cut'
    WHEN len(regexp_extract_all(body, '(?m)^[ ]{{0,3}}(```|~~~)')) % 2 = 1 THEN 'cut'
    WHEN mark > 0 THEN 'mark'
    WHEN regexp_matches(word, '[.!?。！？।॥…]{_DUCK_CLOSERS}(`|\}}|</[a-zA-Z]+>|\[\^[^\]]*\]|\\[a-z]+\{{[^}}]*\}})*$') THEN 'stop'
    WHEN regexp_matches(line, '^[ ]{{0,3}}(```|~~~)[ \t]*$') THEN 'whole'
    WHEN suffix(body, '|') AND regexp_matches(line, '^[ \t]*\|') OR line = '|}}' THEN 'whole'
    WHEN regexp_matches(line, '^[ \t]*({_DUCK_HEADS})$') THEN 'whole'
    WHEN regexp_matches(line, '^[ \t]*\[\^[^\]]+\]:[ \t]*\S') THEN 'item'
    WHEN regexp_matches(line, '(?i)</(p|div|section|article|li|ul|ol|blockquote|table|tr|td|th|h[1-6]|pre|main|body|html)\s*>$|<(br|hr|img)\b[^>]*>$|-->$') THEN 'whole'
    WHEN regexp_matches(line, '\\end\{{[^}}]*\}}$|\\(sub)*(section|paragraph|chapter)\*?\{{[^}}]*\}}$|^[ \t]*\{{\{{.*\}}\}}$') THEN 'whole'
    WHEN suffix(body, '\]') OR suffix(body, '\)') THEN 'whole'
    WHEN regexp_matches(line, '\[\[(Category|File|Image):[^\]]*\]\]$') THEN 'whole'
    WHEN suffix(body, '$$') AND len(string_split(body, '$$')) % 2 = 1 THEN 'whole'
    WHEN regexp_matches(line, '^[ \t]*(\*\*|__)[^*_]+(\*\*|__)$') THEN 'whole'
    WHEN regexp_matches(line, '^[ \t]*([-*+•]|\(?\d+[.)]|#+|\\item)[ \t]+\S') THEN 'item' ELSE 'bare' END AS shape,
  regexp_replace(regexp_replace(array_to_string(string_split(replace(replace(body, chr(10), ' '), chr(9), ' '), ' ')[-3:], ' '), '\d+', '9', 'g'), '\s+', ' ', 'g') AS trigram FROM e),
open AS (SELECT *, regexp_replace(word, '\d+', '9', 'g') AS folded FROM shapes WHERE shape NOT IN ('whole', 'cut')),
counted AS (SELECT trigram, count(*) AS ends, count(*) FILTER (shape = 'mark') AS marks FROM open GROUP BY 1),
prose AS (SELECT text, w, len(w) AS n FROM (SELECT text, string_split_regex(trim(regexp_replace(text, '\d+', '9', 'g'), {_DUCK_BLANK}), '\s+') AS w FROM texty WHERE NOT regexp_matches(text, '{_DUCK_JSON}'))),
t AS (SELECT k, count(*) AS inside FROM (SELECT unnest(list_transform(range(1, n - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS k FROM prose WHERE n > 3) GROUP BY 1),
u AS (SELECT k, count(*) AS inside FROM (SELECT unnest(w[:n - 1]) AS k FROM prose WHERE n > 1) GROUP BY 1),
f AS (SELECT k, sum(inside) AS inside FROM (SELECT rtrim(k, '.!?…:') AS k, inside FROM u WHERE right(k, 1) IN ('.', '!', '?', '…', ':') UNION ALL
  SELECT regexp_replace(x, '\d+', '9', 'g'), 1 FROM (SELECT unnest(regexp_extract_all(text, '{_DUCK_ITEM}', 1)) AS x FROM prose)) GROUP BY 1),
seen AS (SELECT open.tbl, open.rec_id, open.model, shape, ends, marks, coalesce(t.inside, 0) AS t, coalesce(f.inside, 0) AS f, coalesce(u.inside, 0) AS u, count(*) OVER () AS n
  FROM open JOIN counted USING (trigram) LEFT JOIN t ON t.k = trim(trigram, ' ') LEFT JOIN f ON f.k = folded LEFT JOIN u ON u.k = folded),
judged AS (SELECT tbl, rec_id, model, shape = 'cut' AS cut FROM shapes WHERE shape IN ('whole', 'cut') UNION ALL
  SELECT tbl, rec_id, model, CASE shape WHEN 'stop' THEN (ends - 0.5) / (t + ends) < {FINAL_SHARE} WHEN 'item' THEN (f + 0.001) / (f + u + 1) < {ITEM_SHARE}
    WHEN 'mark' THEN (marks - 1) / (t + marks - 1 + (0.5 + {ENDING_SHARE} * n) / {FINAL_SHARE}) < {FINAL_SHARE} ELSE (ends - 1) / (t + ends - 1 + (1 + {ENDING_SHARE} * n) / {FINAL_SHARE}) < {FINAL_SHARE} END FROM seen)
"""
