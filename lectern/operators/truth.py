"""Hand-authored truth as small tables, and the rules it must keep."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions import text as T

KINDS = ("exact-term", "conceptual", "cross-book")
MIN_OF_KIND = 4

SCHEMAS = {
    "books": "slug string, title string, area string, sha256 string, source string, edition string, year string, isbn string",
    "nodes": "book string, loc string, parent_loc string, kind string, title string, position int",
    "queries": "query_id string, book string, area string, q string, kind string, why string, gated boolean",
    "expects": "query_id string, book string, loc string",
    "concepts": "book string, concept_id string, names array<string>, loc string",
    "index_pairs": "book string, term string, loc string, gated boolean",
}


@dataclass(frozen=True)
class Truth:
    books: DataFrame
    nodes: DataFrame
    queries: DataFrame
    expects: DataFrame
    concepts: DataFrame
    index_pairs: DataFrame


def _document(folder: Path, name: str) -> object:
    """A YAML document, or JSON of the same shape where no YAML reader is installed."""
    for suffix in (".yaml", ".yml"):
        path = folder / f"{name}{suffix}"
        if path.exists():
            import yaml  # noqa: PLC0415 - optional

            return yaml.safe_load(path.read_text())
    path = folder / f"{name}.json"
    return json.loads(path.read_text()) if path.exists() else None


def _list(value: object) -> list:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def load(spark: SparkSession, assets: Path) -> Truth:
    """All books and areas under ``assets/truth``; documents are small and written by people, so the driver reads them."""
    rows: dict[str, list[tuple]] = {name: [] for name in SCHEMAS}

    def ask(owner: str, area: str | None, items: list) -> None:
        for i, q in enumerate(items):
            query_id = f"{owner}#{i}"
            rows["queries"].append((query_id, None if area else owner, area, str(q.get("q", "")), q.get("kind"), q.get("why"), bool(q.get("gated", False))))
            rows["expects"] += [(query_id, e.get("book") or (None if area else owner), str(e.get("loc", ""))) for e in _list(q.get("expects"))]

    root = assets / "truth"
    for folder in sorted(p for p in (root / "books").glob("*") if p.is_dir()):
        slug = folder.name
        book = _document(folder, "book") or {}
        source = book.get("source") or {}
        rows["books"].append((slug, book.get("title"), book.get("area"), source.get("sha256"), source.get("file") or f"sources/{slug}.pdf", *[None if book.get(k) is None else str(book[k]) for k in ("edition", "year", "isbn")]))
        toc, at = _document(folder, "toc") or {}, 0
        for part, kind in (("front_matter", "front-matter"), ("chapters", "chapter"), ("back_matter", "back-matter")):
            for node in _list(toc.get(part)):
                rows["nodes"].append((slug, node.get("id"), None, kind, node.get("title"), at))
                at += 1
                for section in _list(node.get("sections")):
                    rows["nodes"].append((slug, section.get("id"), node.get("id"), "section", section.get("title"), at))
                    at += 1
        ask(slug, None, _list((_document(folder, "queries") or {}).get("queries")))
        for i, c in enumerate(_list((_document(folder, "concepts") or {}).get("concepts"))):
            rows["concepts"].append((slug, f"{slug}#{i}", [str(c.get("concept", "")), *[str(a) for a in c.get("accept") or []]], c.get("loc")))
        for p in _list((_document(folder, "index-pairs") or {}).get("index_pairs")):
            rows["index_pairs"].append((slug, p.get("term"), p.get("loc"), bool(p.get("gated", False))))
    for folder in sorted(p for p in (root / "areas").glob("*") if p.is_dir()):
        ask(folder.name, folder.name, _list((_document(folder, "queries") or {}).get("queries")))
    return Truth(**{name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()})


def lint(truth: Truth) -> DataFrame:
    """``(severity, place, message)``: each rule is one filter, aggregate or anti join."""
    found: list[DataFrame] = []

    def rule(df: DataFrame, severity: str, place: str, message) -> None:
        found.append(df.select(F.lit(severity).alias("severity"), F.col(place).cast("string").alias("place"), (F.lit(message) if isinstance(message, str) else message).alias("message")))

    nodes, queries, expects = truth.nodes, truth.queries, truth.expects
    known = nodes.select("book", "loc").distinct()
    named = F.concat_ws(" ", F.lit("unknown location"), "loc")
    rule(nodes.groupBy("book", "loc").agg(F.count("*").alias("n")).where("n > 1"), "error", "book", F.concat(F.lit("duplicate id "), "loc"))
    rule(truth.books.where(F.col("sha256").isNull() | T.is_placeholder(F.col("sha256"))), "warning", "slug", "the source is not pinned")
    for table_, what in ((truth.concepts, "concept"), (truth.index_pairs, "index pair")):
        rule(table_.join(known, ["book", "loc"], "left_anti"), "error", "book", F.concat(F.lit(f"{what}: "), named))
    rule(queries.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))), "error", "query_id", "unknown kind")
    rule(queries.where(F.trim(F.coalesce("why", F.lit(""))) == ""), "error", "query_id", "why is blank")
    rule(queries.join(expects.select("query_id").distinct(), "query_id", "left_anti"), "error", "query_id", "no expectation")
    rule(queries.where((F.col("kind") == "exact-term") & (F.size(F.split(F.trim("q"), r"\s+")) > 6)), "warning", "query_id", "an exact term of more than six words")
    rule(expects.where("book is null"), "error", "query_id", "an area's expectation names no book")
    rule(expects.where(T.is_placeholder(F.col("loc"))), "warning", "query_id", "a placeholder location")
    rule(expects.where("book is not null").where(~T.is_placeholder(F.col("loc"))).join(known, ["book", "loc"], "left_anti"), "error", "query_id", named)
    told = queries.where("kind = 'conceptual'").select("query_id", T.content_words(F.col("q")).alias("qw")).join(expects, "query_id").join(nodes.select("book", "loc", "title"), ["book", "loc"])
    shared = F.array_intersect("qw", T.content_words(F.col("title")))
    rule(told.where(F.size(shared) > 0), "error", "query_id", F.concat(F.lit("shares words with the expected title: "), F.array_join(shared, ", ")))
    per = queries.where("book is not null").groupBy("book", "kind").agg(F.count("*").alias("n"))
    kinds = queries.sparkSession.createDataFrame([(k,) for k in KINDS[:2]], "kind string")
    slugs = truth.books.select(F.col("slug").alias("book"))
    asked = slugs.join(queries.select("book").distinct(), "book", "left_semi")
    rule(slugs.join(queries.select("book").distinct(), "book", "left_anti"), "warning", "book", "no queries")
    thin = asked.crossJoin(F.broadcast(kinds)).join(per, ["book", "kind"], "left").where(F.coalesce("n", F.lit(0)) < MIN_OF_KIND)  # two kinds a book
    rule(thin, "warning", "book", F.concat(F.lit("few queries of kind "), "kind"))
    rule(queries.where("gated").groupBy("book").agg(F.count("*").alias("n")), "warning", "book", F.concat(F.col("n").cast("string"), F.lit(" gated queries")))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def errors(findings: DataFrame) -> DataFrame:
    return findings.where("severity = 'error'")


def askable(truth: Truth, scope: str) -> DataFrame:
    """Queries of a book or an area: gated ones are never asked, an area's own only where the scope is no book."""
    books = truth.books.where((F.col("slug") == scope) | (F.col("area") == scope)).select(F.col("slug").alias("book"))
    own = truth.queries.join(books, "book", "left_semi")
    areas = truth.queries.where(F.col("area") == scope).join(truth.books.where(F.col("slug") == scope).select(F.lit(scope).alias("area")).distinct(), "area", "left_anti")
    order = W.orderBy("query_id")
    return own.unionByName(areas.select(*own.columns)).where("not gated").withColumn("ord", F.row_number().over(order))
