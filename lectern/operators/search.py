"""Exact cosine search over a model-locked vector table, and resolution of hits to their rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RECORD_TYPES = ("chapter", "section", "knowledge_object")
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


class EmbeddingModelMismatch(ValueError):
    """The vector table was written with another embedding model."""


def checked_types(types: Sequence[str] | None) -> list[str]:
    """The record types asked for; unknown ones are named in one error."""
    unknown = sorted(set(types or ()) - set(RECORD_TYPES))
    if unknown:
        raise ValueError(f"unknown record types: {', '.join(unknown)}")
    return list(types or ())


def verified_model(meta: DataFrame | None, asked: str) -> bool:
    """Whether there is anything to search; raises where the recorded model is missing or another."""
    if meta is None:
        return False
    rows = meta.select("embedding_model").distinct().limit(2).collect()
    if not rows:
        return False
    if len(rows) > 1 or rows[0][0] is None:
        raise EmbeddingModelMismatch("the vector table names no single embedding model")
    if rows[0][0] != asked:
        raise EmbeddingModelMismatch(f"vectors were made by {rows[0][0]}, not by {asked}")
    return True


def usable(vector: Column, size: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return F.coalesce((F.size(vector) == size) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine with a fixed query, accumulated in double precision."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = float(np.sqrt(sum(float(x) ** 2 for x in query)))
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return dot / (own * norm)


def top_k(
    points: DataFrame, query: Sequence[float], k: int = 10, offset: int = 0, threshold: float | None = None, book_id: str | None = None, types: Sequence[str] | None = None
) -> DataFrame:
    """``(rank, point_id, record_type, record_id, book_id, score)`` of the best points.

    Filters apply before the score, threshold and offset after it; ties go to the smaller id; a point delivered again
    counts once.  The best rows of every task meet in one merge: no sort and no exchange of all points.  The search runs
    when it is asked for, as only its rows tell whether repeats left enough of them.
    """
    if k < 1 or offset < 0 or not len(query):
        raise ValueError("a query needs numbers, a positive limit and no negative offset")
    wanted = checked_types(types)
    rows = points.where(usable(F.col("vector"), len(query)))
    if book_id is not None:
        rows = rows.where(F.col("book_id") == book_id)
    if wanted:
        rows = rows.where(F.col("record_type").isin(wanted))
    rows = rows.select("point_id", "record_type", "record_id", "book_id", F.round(cosine(F.col("vector"), query), 6).alias("score"))
    if threshold is not None:
        rows = rows.where(F.col("score") >= threshold)
    ordered, most = rows.orderBy(F.desc("score"), "point_id"), 2 * (offset + k)
    while True:
        found = ordered.limit(most).collect()
        best = list(dict.fromkeys(map(tuple, found)))
        if len(best) >= offset + k or len(found) < most:
            break
        most *= 4
    ranked = [(rank, *row) for rank, row in enumerate(best[offset : offset + k], 1)]
    return points.sparkSession.createDataFrame(ranked, "rank int, point_id string, record_type string, record_id string, book_id string, score double")


def search(store, embedder, query: str, limit: int = 10, offset: int = 0, threshold: float | None = None, book_id: str | None = None, types: Sequence[str] | None = None) -> tuple[DataFrame | None, int | None]:
    """Hits with their titles in rank order, and the embedding tokens that the query cost (None: not told).

    What is asked is checked first, then the model lock, so a query against vectors of another model costs nothing.
    Without any vectors there are no hits: (None, 0).  Points whose records are gone leave gaps in the ranking.
    """
    from lectern.plans import runner

    if not query.strip():
        raise ValueError("the query is empty")
    if limit < 1 or offset < 0:
        raise ValueError("the limit must be positive, the offset not negative")
    checked_types(types)
    if not verified_model(store.vector_model(), embedder.model):
        return None, 0
    vectors, tokens = embedder.embed([query])
    hits = top_k(store.stage("points", runner.POINTS), vectors[0], limit, offset, threshold, book_id, types)
    rows = records(store.stage("chapters", runner.CHAPTERS), store.stage("sections", runner.SECTIONS), store.stage("objects", runner.OBJECTS))
    return resolve(hits, rows).orderBy("rank"), tokens


#: Queries that are sent to every worker at a time.
QUERIES = 1_000


def many_top_k(points: DataFrame, queries: Sequence[tuple[str, Sequence[float], str | None]], k: int = 10, queries_a_pass: int = QUERIES) -> DataFrame:
    """``(query_id, rank, point_id, record_type, record_id, book_id, score)``: the ``k`` best points of every query.

    A query is (id, numbers, book or None); one with a book sees that book's points alone.  Each pass reads the points
    once for up to ``queries_a_pass`` queries and keeps ``k`` points a query and batch.  Scores and ties are those of
    ``top_k``; a repeated point counts once.
    """
    size = {len(v) for _, v, _ in queries}
    if len(size) != 1 or 0 in size or k < 1:
        raise ValueError("queries need vectors of one size and a positive limit")
    rows = points.where(usable(F.col("vector"), size.pop()) & F.col("point_id").isNotNull())
    spark, out = points.sparkSession, None
    for at in range(0, len(queries), queries_a_pass):
        part = queries[at : at + queries_a_pass]
        shared = spark.sparkContext.broadcast(([q for q, _, _ in part], np.array([v for _, v, _ in part], dtype="f8"), [b for _, _, b in part]))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q, books = shared.value
            q = q / np.linalg.norm(q, axis=1, keepdims=True)
            for pdf in batches:
                pdf = pdf.drop_duplicates("point_id", ignore_index=True)
                if not len(pdf):
                    continue
                p = np.array(pdf["vector"].tolist(), dtype="f8")
                sims = np.round(q @ (p / np.linalg.norm(p, axis=1, keepdims=True)).T, 6)
                for i, book in enumerate(books):
                    seen = np.arange(len(pdf)) if book is None else np.flatnonzero(pdf["book_id"].to_numpy() == book)
                    best = seen[np.lexsort((pdf["point_id"].to_numpy()[seen], -sims[i, seen]))[:k]]
                    if len(best):
                        yield pdf.iloc[best].drop(columns="vector").assign(query_id=ids[i], score=sims[i, best])

        found = rows.select("point_id", "record_type", "record_id", "book_id", "vector").mapInPandas(run, "query_id string, point_id string, record_type string, record_id string, book_id string, score double")
        out = found if out is None else out.unionByName(found)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    return out.dropDuplicates(["query_id", "point_id"]).withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "point_id", "record_type", "record_id", "book_id", "score")


def records(chapters: DataFrame, sections: DataFrame, objects: DataFrame) -> DataFrame:
    """``(record_type, record_id, title)`` of everything a hit may name."""
    parts = [(chapters, "chapter_id", "chapter"), (sections, "section_id", "section"), (objects, "object_id", "knowledge_object")]
    out = None
    for df, key, kind in parts:
        part = df.select(F.lit(kind).alias("record_type"), F.col(key).alias("record_id"), "title").dropDuplicates(["record_id"])
        out = part if out is None else out.unionByName(part)
    return out


def resolve(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """Hits with their rows, in rank order with the gaps that stale points leave; never more hits than before."""
    valid = hits.where(F.col("record_type").isin(*RECORD_TYPES) & F.col("record_id").rlike(UUID))
    return valid.join(rows, ["record_type", "record_id"])


def batch_top_k(queries: DataFrame, points: DataFrame, key: str, vector: str, k: int = 10, block: int = 1024, chunk: int = 4096) -> DataFrame:
    """``(key, neighbour, score, rank)``: exact top-k of every query row against all rows, in blocks.

    Both sides are cut into bounded chunks of rows; each pair of chunks is one matrix product that keeps ``k`` rows a
    query, so what is exchanged is ``k`` rows for each query and chunk.  A row is not its own neighbour.
    """

    def chunked(df: DataFrame, rows: int, name: str) -> DataFrame:
        n = -(-df.count() // rows) or 1
        return (
            df.select(F.col(key), F.col(vector)).withColumn("c", F.pmod(F.xxhash64(key), F.lit(2 * n)))
            .groupBy("c").agg(F.collect_list(F.struct(key, vector)).alias(name)).drop("c")
        )

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qs, ps in zip(pdf["q"], pdf["p"], strict=True):
                qid, pid = np.array([r[key] for r in qs]), np.array([r[key] for r in ps])
                a, b = np.array([r[vector] for r in qs], dtype="f8"), np.array([r[vector] for r in ps], dtype="f8")
                sims = np.round((a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T, 6)
                order = np.lexsort((np.broadcast_to(pid, sims.shape), -sims), axis=1)[:, : k + 1]
                rows = np.repeat(np.arange(len(qid)), order.shape[1])
                frame = pd.DataFrame({key: qid[rows], "neighbour": pid[order.ravel()], "score": sims[rows, order.ravel()]})
                yield frame[frame[key] != frame["neighbour"]]

    kind = points.schema[key].dataType.simpleString()
    pairs = chunked(queries, block, "q").crossJoin(chunked(points, chunk, "p"))  # chunks, not rows
    order = W.partitionBy(key).orderBy(F.desc("score"), "neighbour")
    found = pairs.mapInPandas(best, f"{key} {kind}, neighbour {kind}, score double")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


def stale(points: DataFrame, rows: DataFrame) -> DataFrame:
    """Points that name no existing record."""
    return points.select("point_id", "record_type", "record_id", "book_id").distinct().join(rows.select("record_type", "record_id"), ["record_type", "record_id"], "left_anti")


def replace_points(points: DataFrame, new: DataFrame, books: DataFrame) -> DataFrame:
    """The table after each book of ``books`` has got its new points: upserts first, the book's other points gone."""
    kept = points.join(books.select("book_id").distinct(), "book_id", "left_anti").join(new.select("point_id"), "point_id", "left_anti")
    return kept.unionByName(new.select(*kept.columns))
