"""Evaluation of a run against the truth: recall, structure, coverage, faithfulness, comparison, cost."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import durable

# How much a dimension may fall, and the bars.
THRESHOLDS = {"recall": 0.05, "structure": 0.02, "coverage": 0.05, "faithfulness": 0.05}
PASS_BAR = 0.9
HIT_AT = 5


def ratio(a: Column, b: Column) -> Column:
    """Quotient that is 0 where the denominator is."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def judge(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """``(query_id, best_rank)`` of every query with an expectation: the least rank from 1 of an expected location.

    ``expected`` has query_id, loc (placeholders already gone), ``hits`` has query_id, rank, loc.  A miss is null.
    """
    found = hits.where("rank >= 1").join(expected.select("query_id", "loc").distinct(), ["query_id", "loc"], "left_semi")
    best = found.groupBy("query_id").agg(F.min("rank").alias("best_rank"))
    return expected.select("query_id").distinct().join(best, "query_id", "left")


def recall(judged: DataFrame, *groups: str) -> DataFrame:
    """Reciprocal rank, hit rate and number of queries: pooled and by each group, as (grp, value, mrr, hit_at_5, n)."""
    rr = ratio(F.lit(1), F.col("best_rank"))
    hit = F.when(F.col("best_rank") <= HIT_AT, 1.0).otherwise(0.0)
    sets = F.array(F.struct(F.lit("all").alias("grp"), F.lit("").alias("value")), *[F.struct(F.lit(g).alias("grp"), F.col(g).cast("string").alias("value")) for g in groups])
    rows = judged.select(F.explode(sets).alias("s"), rr.alias("rr"), hit.alias("hit")).where("s.value is not null")
    return rows.groupBy("s.grp", "s.value").agg(F.round(F.avg("rr"), 9).alias("mrr"), F.round(F.avg("hit"), 9).alias("hit_at_5"), F.count("*").alias("n"))


def structure_scores(expected: DataFrame, detected: DataFrame, book: str = "book_id") -> DataFrame:
    """Precision, recall and F1 of (kind, normalised title) bags by book, and pooled over the sums (book null)."""
    keys = [book, "kind", "norm"]
    e = expected.where("kind in ('chapter', 'section')").groupBy(*keys).agg(F.count("*").alias("e"))
    d = detected.where("kind in ('chapter', 'section')").groupBy(*keys).agg(F.count("*").alias("d"))
    both = e.join(d, keys, "full").na.fill(0, ["e", "d"])
    sums = both.rollup(book).agg(F.sum(F.least("e", "d")).alias("matched"), F.sum("d").alias("detected"), F.sum("e").alias("expected"))
    p, r = ratio(F.col("matched"), F.col("detected")), ratio(F.col("matched"), F.col("expected"))
    return sums.select(book, "matched", "detected", "expected", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(ratio(2 * p * r, p + r), 9).alias("f1"))


def coverage(concepts: DataFrame, surfaced: DataFrame, group: str) -> DataFrame:
    """Share of concepts of which a name was surfaced, by group and pooled; ``concepts`` has concept_id and names."""
    names = concepts.select(group, "concept_id", F.explode("names").alias("norm")).where("norm != ''")
    found = names.join(surfaced.select(group, "norm").distinct(), [group, "norm"], "left_semi").select(group, "concept_id").distinct()
    marked = concepts.select(group, "concept_id").distinct().join(found.withColumn("hit", F.lit(1)), [group, "concept_id"], "left")
    return marked.rollup(group).agg(F.count("hit").alias("found"), F.count("*").alias("total")).withColumn("recall", F.round(ratio(F.col("found"), F.col("total")), 9))


def faithfulness(judged: DataFrame) -> DataFrame:
    """Mean share of supported claims over what has claims, and how many fall below the bar; ``supported``, ``claims``."""
    share = F.when(F.col("claims") > 0, F.col("supported") / F.col("claims"))
    return judged.agg(F.round(F.coalesce(F.avg(share), F.lit(0.0)), 9).alias("mean_support"), F.count(share).alias("judged"), F.count_if(share < PASS_BAR).alias("below_bar"))


def compare(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """``(dimension, base, candidate, delta, verdict)``: only a fall by more than the threshold is a regression."""
    limits = F.create_map(*[x for k, v in THRESHOLDS.items() for x in (F.lit(k), F.lit(v))])
    rows = base.select("dimension", F.col("score").alias("base")).join(candidate.select("dimension", F.col("score").alias("candidate")), "dimension", "full")
    delta = F.round(F.col("candidate") - F.col("base"), 9)
    verdict = F.when(delta.isNull(), "incomparable").when(-delta > F.try_element_at(limits, "dimension"), "regression").otherwise("ok")
    return rows.withColumn("delta", delta).withColumn("verdict", verdict)


def stage_costs(stages: DataFrame) -> DataFrame:
    """Tokens, seconds and unreported calls by stage; a stage without name is left out."""
    return stages.where("stage is not null and stage != ''").groupBy("stage").agg(
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.count("*").alias("calls"), F.count_if(F.col("input_tokens").isNull()).alias("unreported"),
    )


def attribution(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """``(query_id, best_book_rank, attributed)`` of area queries: whether an expected book is among the first hits.

    ``expected`` has query_id, book; ``hits`` query_id, rank, book.  Ranks below 1 are malformed and count for nothing.
    """
    books = expected.select("query_id", "book").distinct()
    best = hits.where("rank >= 1").join(books, ["query_id", "book"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("best_book_rank"))
    return books.select("query_id").distinct().join(best, "query_id", "left").withColumn("attributed", F.when(F.col("best_book_rank") <= HIT_AT, 1.0).otherwise(0.0))


def chosen_results(queries: DataFrame, results: DataFrame) -> DataFrame:
    """``(query_id, at)``: the result that answers each query, by its place in the run file; null where none does.

    ``queries`` has query_id, q, book, area; ``results`` q, book, area, at.  A result of the query's own book and area
    wins over one without any, the earlier over the later.
    """
    # One row for each question and scope, so a question asked by many meets few.
    named = results.groupBy("q", F.col("book").alias("__book"), F.col("area").alias("__area")).agg(F.min("at").alias("at"))
    both = queries.select("query_id", "q", "book", "area").join(named, "q", "left")
    exact = F.col("__book").eqNullSafe(F.col("book")) & F.col("__area").eqNullSafe(F.col("area"))
    loose = F.col("__book").isNull() & F.col("__area").isNull()
    rank = F.when(F.col("at").isNotNull() & (exact | loose), F.struct((~exact).cast("int").alias("o"), F.col("at").alias("at")))
    return both.groupBy("query_id").agg(F.min(rank).alias("r")).select("query_id", F.col("r.at").alias("at"))


def drops(placed: DataFrame) -> DataFrame:
    """``(slug, n, note)``: hits without a location by book, and those of books nobody knows (slug null).

    ``placed`` has slug (null: unknown book) and loc (null: joined no node).
    """
    lost = placed.where("slug IS NULL OR loc IS NULL").groupBy("slug").agg(F.count("*").alias("n"))
    why = F.when(F.col("slug").isNull(), F.concat(F.col("n").cast("string"), F.lit(" hits dropped: their book is not in the truth"))).otherwise(
        F.concat("slug", F.lit(": "), F.col("n").cast("string"), F.lit(" hits dropped: their record joins no node"))
    )
    return lost.withColumn("note", why)


def cost_totals(stages: DataFrame) -> DataFrame:
    """One row of sums over stages: tokens, seconds, and how many calls told no usage."""
    add = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return stages.agg(add("input_tokens"), add("output_tokens"), add("embedding_tokens"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("wall_seconds"), F.count_if(F.col("input_tokens").isNull()).alias("unreported"))


#: Distinct titles, about, that are sent to every worker at a time.
TITLES = 50_000


def contained(artifacts: DataFrame, titles: DataFrame) -> DataFrame:
    """``(artifact_id, title_id)`` where the artifact's text contains the title, both normalised."""
    return held(artifacts, titles).join(titles.select("title_id", F.col("norm").alias("title_norm")), "title_norm").select("artifact_id", "title_id")


def held(artifacts: DataFrame, titles: DataFrame) -> DataFrame:
    """``(artifact_id, title_norm)``: which of the distinct titles each artifact's text contains, inside words as well.

    Both are normalised; blank titles are in nothing.  The titles become a multi-pattern automaton, of which each
    block of ``TITLES`` reads every text once where it lies: no text is exchanged, nor any pair that doesn't hold.
    """
    spark = artifacts.sparkSession
    kind = artifacts.schema["artifact_id"].dataType.simpleString()
    distinct = durable(titles.where("norm != ''").select("norm").distinct(), "titles")
    blocks = 1 + distinct.count() // TITLES
    out = None
    for b in range(blocks):
        shared = spark.sparkContext.broadcast([r["norm"] for r in distinct.where(F.pmod(F.xxhash64("norm"), F.lit(blocks)) == b).collect()])

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            found = _finder(shared.value)
            for pdf in batches:
                rows = [(key, title) for key, text in zip(pdf["artifact_id"], pdf["norm"], strict=True) if text for title in found(text)]
                yield pd.DataFrame(rows, columns=["artifact_id", "title_norm"]).astype({"title_norm": "str"})

        part = artifacts.select("artifact_id", "norm").mapInPandas(run, f"artifact_id {kind}, title_norm string")
        out = part if out is None else out.unionByName(part)
    return out


def _finder(titles: list[str]) -> Callable[[str], Iterable[str]]:
    """A function that gives the titles within a text, each once; without the automaton's library, title by title."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [t for t in titles if t in text]
    automaton = ahocorasick.Automaton()
    for title in titles:
        automaton.add_word(title, title)
    if not titles:
        return lambda text: []
    automaton.make_automaton()
    return lambda text: {title for _, title in automaton.iter(text)}


def identify(artifacts: DataFrame, titles: DataFrame, least: float = 0.4, margin: float = 0.15) -> DataFrame:
    """``(artifact_id, book_id, score, runner_up, decided)``: the book whose weighted chapter titles an artifact holds best.

    A title weighs its words of four letters or more; titles without such words do not count.  ``titles`` has
    title_id, book_id, norm, weight.
    """
    from pyspark.sql.window import Window as W

    weighed = titles.where("weight > 0")
    # Equal titles of a book are one row with their weights summed.
    named = weighed.groupBy(F.col("norm").alias("title_norm"), "book_id").agg(F.sum("weight").alias("weight"))
    hits = held(artifacts, weighed).join(named, "title_norm")
    got = hits.groupBy("artifact_id", "book_id").agg(F.sum("weight").alias("hit"))
    whole = weighed.groupBy("book_id").agg(F.sum("weight").alias("whole"))
    scored = got.join(whole, "book_id").withColumn("score", F.round(F.col("hit") / F.col("whole"), 9))
    order = W.partitionBy("artifact_id").orderBy(F.desc("score"), "book_id")
    ranked = scored.withColumns({"rn": F.row_number().over(order), "runner_up": F.lead("score").over(order)}).where("rn = 1")
    decided = (F.col("score") >= least) & (F.col("runner_up").isNull() | (F.col("score") - F.col("runner_up") >= margin))
    return ranked.select("artifact_id", "book_id", "score", F.coalesce("runner_up", F.lit(0.0)).alias("runner_up"), decided.alias("decided"))
