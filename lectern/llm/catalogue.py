"""Queries of the language-model operators, for the driver's contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import components as graph
from lectern.llm import canonical, markup, mixture, names, neardup, neighbours, scans, sentences, tokens, truncation
from lectern.session import durable
from lectern.sources import table


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of books whose author strings differ and mean the same person or organisation."""
    return names.pairs(names.linked(table(spark, root, "books"), "book_id", "author"), "book_id")


def p7_entities(spark: SparkSession, root: str) -> DataFrame:
    """Each book that names an author, with the entity its author string stands for."""
    return names.linked(table(spark, root, "books"), "book_id", "author")


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """Ids of every document."""
    return tokens.encode_texts(table(spark, root, "documents"), "doc_id")


def _mixed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    counted = tokens.count_tokens(table(spark, root, "documents").where("source is not null"), ["doc_id", "source"])
    return mixture.mix(counted, table(spark, root, "source_targets"))


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    """Each drawn document with its number of uses, beside its source's target and actual share."""
    used, shares = _mixed(spark, root)
    return used.join(F.broadcast(shares.select("source", "target_share", "actual_share")), "source").select(
        "doc_id", "source", "n_tokens", "uses", "target_share", "actual_share"
    )


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and actual share of every source that has a target."""
    return _mixed(spark, root)[1]


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Sentence units of every document."""
    return sentences.split(table(spark, root, "documents"))


_TYPED = (("knowledge_objects", "object_id", "type"), ("books", "book_id", "primary_topic"), ("books", "book_id", "language"))


def _canonical(spark: SparkSession, root: str) -> DataFrame:
    columns = [(table(spark, root, name), key, column, column) for name, key, column in _TYPED]
    return canonical.mapped_fields(columns, table(spark, root, "ref_values"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """The entry meant by each typed value that isn't blank nor exactly a reference name."""
    names = table(spark, root, "ref_values").select("field", F.col("name").alias("value")).distinct()
    return (
        _canonical(spark, root)
        .where(F.trim(F.regexp_replace("value", r"\p{Z}|\s", "")) != "")
        .join(names, ["field", "value"], "left_anti")
        .select("field", "rec_id", F.col("canon_id").cast("bigint").alias("canon_id"))
    )


def p6_values(spark: SparkSession, root: str) -> DataFrame:
    """Each distinct typed value with its entry (0: none fits) and the number of records that hold it."""
    return _canonical(spark, root).groupBy("field", "value", "canon_id").agg(F.count("*").alias("n_records"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines of parsed markdown that are page furniture or hold a broken or misread word."""
    return scans.noise(table(spark, root, "parse_results"))


def p1_text(spark: SparkSession, root: str) -> DataFrame:
    """Every parse result as continuous repaired paragraphs."""
    return scans.repaired(table(spark, root, "parse_results"))


_MARKED = (("chapters", "chapter_id", "summary", True), ("parse_results", "parse_id", "markdown", False))


def _cleaned(spark: SparkSession, root: str, only_marked: bool) -> DataFrame:
    parts = [
        markup.cleaned(table(spark, root, name), key, column, markdown, only_marked).withColumn("tbl", F.lit(name))
        for name, key, column, markdown in _MARKED
    ]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Records that hold foreign markup."""
    return _cleaned(spark, root, True).select("tbl", "rec_id")


def p2_text(spark: SparkSession, root: str) -> DataFrame:
    """Clean text of every chapter summary and parse result, with the kinds of markup that were resolved."""
    return _cleaned(spark, root, False).select("tbl", "rec_id", F.array_join("kinds", " ").alias("kinds"), "text")


_CONTENT = ["title", "content", "summary"]


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of objects whose words are alike to 0.75 or more."""
    return neardup.pairs(table(spark, root, "knowledge_objects"), "object_id", _CONTENT, 0.75).select("object_id_a", "object_id_b")


def p3_groups(spark: SparkSession, root: str) -> DataFrame:
    """Each object with its group of alike objects, its class of equal words and the number of its class's links.

    Groups and classes go by their smallest object_id.
    """
    members, texts = neardup.classes(table(spark, root, "knowledge_objects"), "object_id", _CONTENT)
    links = durable(neardup.similar(texts, 0.75).select("a", "b"), "similar")
    ends = links.select(F.col("a").alias("cid")).unionByName(links.select(F.col("b").alias("cid"))).groupBy("cid").agg(F.count("*").alias("n_links"))
    heads = members.groupBy("class").agg(F.min("object_id").alias("class_id"))
    heads = durable(heads.join(texts.select("cid", "class").hint("merge"), "class"), "heads")
    groups = durable(graph.components(links).withColumnRenamed("node", "cid"), "groups")
    named = groups.join(heads.hint("merge"), "cid").groupBy("component").agg(F.min("class_id").alias("group_id"))
    groups = groups.join(named, "component").select("cid", "group_id")
    return (
        members.join(heads.hint("merge"), "class")
        .join(ends, "cid", "left")
        .join(groups, "cid", "left")
        .select("object_id", F.coalesce("group_id", "class_id").alias("group_id"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def p4_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The 10 most similar other points of every usable point, with cosine and rank."""
    return neighbours.nearest(table(spark, root, "points"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of points of which one is among the 10 most similar of the other."""
    return neighbours.pairs(p4_neighbours(spark, root))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Records whose text was cut."""
    return truncation.judge(truncation.gather(spark, root)).where("cut").select("tbl", "rec_id")


def p5_rates(spark: SparkSession, root: str) -> DataFrame:
    """How often each model's texts are cut, for each table."""
    return truncation.rates(truncation.judge(truncation.gather(spark, root)))


QUERIES = {
    "p1_found": p1_found,
    "p1_text": p1_text,
    "p2_found": p2_found,
    "p2_text": p2_text,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p6_found": p6_found,
    "p6_values": p6_values,
    "p7_found": p7_found,
    "p7_entities": p7_entities,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
}

# Brute force for the searches, on the small tables where the oracle runs.
_WORDS = """
o AS (SELECT DISTINCT object_id, lower(coalesce(title, '') || ' ' || coalesce(content, '') || ' ' || coalesce(summary, '')) AS t FROM knowledge_objects),
w AS (SELECT object_id, word, count(*) AS n FROM (SELECT object_id, unnest(regexp_extract_all(t, '[\\p{L}\\p{N}]+')) AS word FROM o) GROUP BY 1, 2),
sizes AS (SELECT object_id, sum(n) AS total FROM w GROUP BY 1)
"""
_COSINES = """
u AS (SELECT DISTINCT point_id, vector::DOUBLE[] AS v FROM points WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
s AS (SELECT a.point_id, b.point_id AS neighbour_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS sim FROM u a JOIN u b ON a.point_id <> b.point_id),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY point_id ORDER BY sim DESC, neighbour_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10)
"""
ORACLES: dict[str, str] = {
    "p3_found": f"""
WITH {_WORDS}, c AS (SELECT a.object_id AS object_id_a, b.object_id AS object_id_b, sum(least(a.n, b.n)) AS common FROM w a JOIN w b ON a.word = b.word AND a.object_id < b.object_id GROUP BY 1, 2)
SELECT object_id_a, object_id_b FROM c JOIN sizes a ON a.object_id = object_id_a JOIN sizes b ON b.object_id = object_id_b WHERE common >= 0.75 * (a.total + b.total - common)
""",
    "p5_found": f"WITH {truncation.DUCKDB_JUDGED} SELECT tbl, rec_id FROM judged WHERE cut",
    "p5_rates": f"WITH {truncation.DUCKDB_JUDGED} SELECT tbl, model, count(*) AS n_texts, count(*) FILTER (cut) AS n_cut, round(count(*) FILTER (cut) / count(*), 6) AS cut_rate FROM judged GROUP BY 1, 2",
    "p3_groups": f"""
WITH RECURSIVE {_WORDS}, bag AS (SELECT object_id, string_agg(word || ' ' || n, ',' ORDER BY word) AS words FROM w GROUP BY 1),
k AS (SELECT object_id, min(object_id) OVER (PARTITION BY words) AS class_id FROM bag), first AS (SELECT w.* FROM w JOIN k USING (object_id) WHERE object_id = class_id),
c AS (SELECT a.object_id AS a, b.object_id AS b, sum(least(a.n, b.n)) AS common FROM first a JOIN first b ON a.word = b.word AND a.object_id <> b.object_id GROUP BY 1, 2),
link AS (SELECT a, b FROM c JOIN sizes x ON x.object_id = a JOIN sizes y ON y.object_id = b WHERE common >= 0.75 * (x.total + y.total - common)),
reach AS (SELECT a AS node, a AS root FROM link UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node),
g AS (SELECT node, min(root) AS group_id FROM reach GROUP BY 1), d AS (SELECT a, count(*) AS n_links FROM link GROUP BY 1)
SELECT k.object_id, coalesce(g.group_id, k.class_id) AS group_id, k.class_id, coalesce(d.n_links, 0) AS n_links FROM k LEFT JOIN g ON g.node = k.class_id LEFT JOIN d ON d.a = k.class_id
""",
    "p4_neighbours": f"WITH {_COSINES} SELECT point_id, neighbour_id, sim, rank FROM n",
    "p4_found": f"WITH {_COSINES} SELECT DISTINCT least(point_id, neighbour_id) AS point_id_a, greatest(point_id, neighbour_id) AS point_id_b FROM n",
}
