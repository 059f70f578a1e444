"""Stages over all pending books at once, and the loop that runs a scope of them.

A stage works on every book of the run in one plan.  What fails, fails for its book alone: the failure is recorded with
the stage's name, the book keeps what earlier stages and earlier runs published, and later stages leave it out.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import answers, reads, structure
from lectern.plans import prompts
from lectern.plans.providers import FakeEmbedder, FakeLanguageModel, completed, embedded
from lectern.session import durable
from lectern.sources.files import CHAIN, Originals, parsed
from lectern.sources.store import Store

# Which stages each scope runs.
SCOPES = {
    "full": ("parse", "structure", "profile", "extraction", "summaries", "embeddings"),
    "profile": ("profile",),
    "extraction": ("extraction", "embeddings"),
    "embeddings": ("embeddings",),
}
CHAPTERS = "chapter_id string, book_id string, position int, title string, kind string, source_line int"
SECTIONS = "section_id string, chapter_id string, book_id string, position int, title string, source_line int"
OBJECTS = (
    "object_id string, book_id string, chapter_id string, section_id string, type string, title string, content string, summary string, source_location string, "
    "confidence double, page bigint, paragraph bigint, extraction_model string"
)
SUMMARIES = "record_type string, record_id string, book_id string, summary string, summary_model string"
POINTS = "point_id string, vector array<float>, record_type string, record_id string, book_id string, text string"
PROFILES = "profile_id string, book_id string, content string, model string, created_at timestamp"
PARSED = "book_id string, markdown string, parser string"
REPORTS = (
    "run_id string, stage string, book_id string, input_tokens bigint, output_tokens bigint, embedding_tokens bigint, seconds double, counts map<string,bigint>, notes array<string>"
)
FAILURES = "run_id string, stage string, book_id string, error string"


def _id(*parts) -> F.Column:
    """A deterministic id in the form of a UUID: a recomputed plan gives it again."""
    h = F.md5(F.concat_ws("\x1f", *[p.cast("string") for p in parts]))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


class Pipeline:
    """Books and their parsed text in, published stage tables out."""

    def __init__(
        self, store: Store, books: DataFrame, parsed: DataFrame | None = None, llm=FakeLanguageModel, embedder=FakeEmbedder, on_stage: Callable[[str], None] | None = None, chain: tuple[str, ...] = CHAIN
    ):
        """``parsed`` (book_id, markdown) takes the place of the parsers; without it, registered files are parsed."""
        self.store, self.books, self.given, self.llm, self.embedder, self.on_stage, self.chain = store, books, parsed, llm, embedder, on_stage, chain
        self.all, self.run_id, self.seq, self.began = books, "", 0, time.monotonic()

    @property
    def parsed(self) -> DataFrame:
        return self.given if self.given is not None else self.store.stage("parsed", PARSED)

    def run(self, scope: str = "full") -> str:
        """Run a scope for all books; each book's run is recorded when it opens and when it ends."""
        self.run_id, stamp = uuid.uuid4().hex, dt.datetime.now(dt.UTC).replace(tzinfo=None)
        self.seq = int(stamp.timestamp() * 1000)
        everything = self.books
        opened = everything.select("book_id").distinct().select(F.lit(self.run_id).alias("run_id"), "book_id", F.lit(scope).alias("scope"), F.lit(stamp).alias("at"))
        self.store.record(opened.select("*", F.lit(0).alias("seq"), F.lit("running").alias("status")))
        stages = SCOPES.get(scope, ())
        if not stages:
            self._fail(scope, everything, F.lit(f"unknown scope {scope}"))
        for stage in stages:
            self.began = time.monotonic()
            if self.on_stage is not None:
                self.on_stage(stage)
            try:
                getattr(self, stage)()
            except Exception as error:  # noqa: BLE001 - recorded, whatever it is
                self._fail(stage, self.books, F.lit(f"{stage}: {type(error).__name__}: {str(error)[:500]}"))
            self.books = self._left()
        self.books = everything
        self._close(opened, stages)
        return self.run_id

    def _close(self, opened: DataFrame, stages: tuple[str, ...]) -> None:
        """The last record of each book's run; tokens are null where no stage calls a model."""
        mine = F.col("run_id") == self.run_id
        reports = self.store.history("reports", REPORTS).where(mine)
        has_llm = any(s in reads.LLM_STAGES for s in stages)
        models = [f"llm={self.llm.model}"] * has_llm + [f"embedding={self.embedder.model}"] * ("embeddings" in stages)
        stamps = [v for s, v in reads.PROMPT_VERSIONS if s in stages]
        tokens = reports.groupBy("book_id").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens")])
        errors = self.store.history("failures", FAILURES).where(mine).groupBy("book_id").agg(F.min("error").alias("error"))
        closed = opened.join(tokens, "book_id", "left").join(errors, "book_id", "left")
        billed = lambda c: F.coalesce(c, F.lit(0)) if has_llm else F.lit(None)
        text = lambda parts: F.lit(",".join(parts) or None)
        self.store.record(closed.select(
            "run_id", "book_id", "scope", "at", "error", F.lit(1).alias("seq"), F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("status"),
            billed("input_tokens").alias("input_tokens"), billed("output_tokens").alias("output_tokens"), text(models).alias("model_version"), text(stamps).alias("prompt_version"),
        ))
        lines = reports.select("book_id", F.col("stage").alias("s"), F.explode(F.concat(F.array(F.concat_ws(" ", "stage", F.to_json("counts"))), F.coalesce("notes", F.array().cast("array<string>")))).alias("line"))
        order = F.create_map(*[x for i, name in enumerate(("parse", "structure", "profile", "extraction", "summaries", "embeddings")) for x in (F.lit(name), F.lit(i))])
        failed = errors.select("book_id", F.lit(9).alias("ord"), F.concat(F.lit("failed: "), "error").alias("line"))
        self.store.write_log(lines.select("book_id", F.try_element_at(order, "s").alias("ord"), "line").unionByName(failed), self.run_id)

    def _fail(self, stage: str, books: DataFrame, error: F.Column) -> None:
        """Record why books fail in a stage."""
        rows = books.select(F.lit(self.run_id).alias("run_id"), F.lit(stage).alias("stage"), "book_id", error.alias("error")).dropDuplicates(["book_id"])
        self.store.append("failures", rows)

    def _left(self) -> DataFrame:
        """The books of the run that have not failed.

        Always out of all books: two reads of one folder at different times pass for the same in one plan.
        """
        failed = self.store.history("failures", FAILURES).where(F.col("run_id") == self.run_id).select("book_id").distinct()
        return self.all.join(failed, "book_id", "left_anti")

    def _publish(self, stage: str, rows: DataFrame) -> None:
        """Replace a stage's rows of the books that have not failed."""
        left = self._left()
        self.store.publish(stage, self.run_id, self.seq, left, rows.join(left.select("book_id").distinct(), "book_id", "left_semi").select(*rows.columns))

    def _report(self, stage: str, rows: DataFrame, **counts: F.Column) -> None:
        """One report a book: what was billed, what was made and what there is to say (``notes``, an array, if given).

        ``rows`` has book_id and perhaps input_tokens, output_tokens, embedding_tokens and notes.
        """
        has = rows.columns
        told = lambda c: (F.sum(c) if c in has else F.lit(None).cast("bigint")).alias(c)
        notes = F.flatten(F.collect_list("notes")) if "notes" in has else F.array().cast("array<string>")
        made = F.create_map(*[x for name, count in counts.items() for x in (F.lit(name), count.cast("bigint"))]) if counts else F.create_map().cast("map<string,bigint>")
        out = rows.groupBy("book_id").agg(told("input_tokens"), told("output_tokens"), told("embedding_tokens"), made.alias("counts"), notes.alias("notes"))
        self.store.append("reports", out.select(
            F.lit(self.run_id).alias("run_id"), F.lit(stage).alias("stage"), "book_id", "input_tokens", "output_tokens", "embedding_tokens", F.lit(time.monotonic() - self.began).alias("seconds"), "counts", "notes",
        ))

    def parse(self) -> None:
        """The registered files as markdown, by the first parser that gives text; every attempt is noted."""
        if self.given is not None:
            rows = self.given.select("book_id", "markdown", F.lit(None).cast("string").alias("parser"), F.array().cast("array<string>").alias("attempts"))
        else:
            rows = parsed(Originals(self.store.root).content(self.store.spark, self.books), "book_id", self.chain)
        rows = durable(rows, "parsed")
        self._fail("parse", rows.where("markdown IS NULL"), F.concat(F.lit("parse: no parser succeeded; attempts: "), F.array_join("attempts", "; ")))
        self._publish("parsed", rows.select("book_id", "markdown", "parser"))
        self._report("parse", rows.withColumnRenamed("attempts", "notes"), characters=F.coalesce(F.sum(F.length("markdown")), F.lit(0)))

    def structure(self) -> None:
        missing = self.books.join(self.parsed.where("markdown IS NOT NULL").select("book_id"), "book_id", "left_anti")
        self._fail("structure", missing, F.lit("structure: no parsed text; run a full ingest first"))
        tree = durable(structure.detect(self.parsed, "book_id"), "tree")
        top = tree.where("section is null")
        chapter_id = _id(F.lit(self.run_id), F.col("book_id"), F.lit("chapter"), F.col("chapter"))
        self._publish("chapters", top.select(chapter_id.alias("chapter_id"), "book_id", F.col("chapter").alias("position"), "title", "kind", F.col("line").alias("source_line")))
        low = tree.where("section is not null")
        section_id = _id(F.lit(self.run_id), F.col("book_id"), F.lit("section"), F.col("chapter"), F.col("section"))
        self._publish("sections", low.select(section_id.alias("section_id"), chapter_id.alias("chapter_id"), "book_id", F.col("section").alias("position"), "title", F.col("line").alias("source_line")))
        every = self.books.select("book_id").distinct().join(tree, "book_id", "left")
        self._report("structure", every, chapters=F.count_if(F.col("chapter").isNotNull() & F.col("section").isNull()), sections=F.count("section"))

    def _tables(self) -> tuple[DataFrame, DataFrame]:
        return self.store.stage("chapters", CHAPTERS), self.store.stage("sections", SECTIONS)

    def profile(self) -> None:
        chapters, sections = self._tables()
        lines = structure.flatten(chapters, sections).withColumn("line", F.concat(F.when(F.col("kind") == "section", "  - ").otherwise("- "), "title"))
        outline = lines.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("outline"))
        asked = durable(completed(prompts.profile_prompt(self.books, outline), "book_id", "profile", self.llm), "profiles")
        self._fail("profile", asked.where("text IS NULL"), F.concat(F.lit("profile: "), "error"))
        self._report("profile", asked, profiles=F.count("text"))
        stamp = F.lit(dt.datetime.fromtimestamp(self.seq / 1000, dt.UTC).replace(tzinfo=None))
        self.store.append("profiles", asked.where("text IS NOT NULL").select(_id(F.lit(self.run_id), F.col("book_id")).alias("profile_id"), "book_id", F.col("text").alias("content"), "model", stamp.alias("created_at")))

    def _asked(self, stage: str, instruction: str, parse: Callable[[str], object]) -> DataFrame:
        """Answers by chapter, written before they are read: a recomputed task must not bill twice.

        An answer that can't be read is asked for once more.  A book of which one answer stays unusable fails.
        """
        chapters, sections = self._tables()
        tree = chapters.select("book_id", F.col("position").alias("chapter"), F.lit(None).cast("int").alias("section"), F.col("source_line").alias("line"))
        bodies = structure.bodies(self.parsed, tree).withColumnRenamed("chapter", "position")
        heads = prompts.chapter_scaffold(self.books, chapters, sections).join(chapters.select("chapter_id", "position"), "chapter_id").join(bodies, ["book_id", "position"])
        prompt = heads.select("chapter_id", prompts.chapter_prompt(F.col("scaffold"), F.col("body"), instruction).alias("prompt"))
        asked = durable(completed(prompt, "chapter_id", stage, self.llm, parse), stage)
        asked = asked.join(chapters.select("chapter_id", "book_id", "position", F.col("title").alias("chapter_title")), "chapter_id")
        self._fail(stage, asked.where("text IS NULL").orderBy("position"), F.concat(F.lit(f"{stage}: chapter "), (F.col("position") + 1).cast("string"), F.lit(": "), "error"))
        return asked

    def extraction(self) -> None:
        asked = self._asked("extraction", "Extract the knowledge objects as JSON.", answers.extraction)
        sections = self._tables()[1].select("chapter_id", F.col("position").cast("bigint").alias("section_index"), "section_id", F.col("title").alias("section_title"))
        found = durable(answers.extracted(asked.where("text IS NOT NULL"), "chapter_id", "text"), "extracted")
        good = found.where("reason is null").join(asked.drop("text", "input_tokens", "output_tokens"), "chapter_id").join(sections, ["chapter_id", "section_index"], "left")
        object_id = _id(F.lit(self.run_id), F.col("chapter_id"), F.lit("object"), F.col("at"))
        place = T.source_location(F.col("position"), F.col("chapter_title"), F.col("section_title"))
        self._publish("objects", good.select(
            object_id.alias("object_id"), "book_id", "chapter_id", "section_id", "type", "title", "content", "summary", place.alias("source_location"), "confidence", "page", "paragraph",
            F.col("model").alias("extraction_model"),
        ))
        # What was dropped and why, and pointers to sections that aren't there, stand in the report.
        where = F.concat(F.lit("chapter "), (F.col("position") + 1).cast("string"), F.lit(", object "))
        dropped = found.where("reason is not null").join(asked.select("chapter_id", "book_id", "position"), "chapter_id").select("book_id", F.concat(where, "reason").alias("note"))
        astray = good.where("section_index is not null and section_id is null").select("book_id", F.concat(where, F.col("at").cast("string"), F.lit(": no section "), F.col("section_index").cast("string")).alias("note"))
        again = asked.where("attempts > 1").select("book_id", F.concat(F.lit("chapter "), (F.col("position") + 1).cast("string"), F.lit(": asked twice")).alias("note"))
        notes = dropped.unionByName(astray).unionByName(again).groupBy("book_id").agg(F.array_sort(F.collect_list("note")).alias("notes"))
        made = good.groupBy("book_id").agg(F.count("*").alias("made"))
        billed = asked.groupBy("book_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
        rows = billed.join(made, "book_id", "left").join(notes, "book_id", "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))
        self._report("extraction", rows, knowledge_objects=F.coalesce(F.sum("made"), F.lit(0)))

    def summaries(self) -> None:
        asked = self._asked("summaries", "Summarize the chapter and its sections as JSON.", lambda text: answers.summaries(text, 0))
        sections = self._tables()[1]
        n = sections.groupBy("chapter_id").agg(F.count("*").alias("n"))

        def run(batches):
            import pandas as pd

            for pdf in batches:
                rows = []
                for chapter_id, text, k in zip(pdf["chapter_id"], pdf["text"], pdf["n"], strict=True):
                    summary, parts = answers.summaries(text, int(k))
                    rows.append((chapter_id, -1, summary))
                    rows += [(chapter_id, i, p) for i, p in enumerate(parts)]
                yield pd.DataFrame(rows, columns=["chapter_id", "position", "summary"]).astype({"position": "int32"})

        given = asked.where("text IS NOT NULL").join(n, "chapter_id", "left").select("chapter_id", "text", F.coalesce("n", F.lit(0)).alias("n"))
        parts = given.mapInPandas(run, "chapter_id string, position int, summary string").join(asked.select("chapter_id", "book_id", "model"), "chapter_id")
        top = parts.where("position = -1").select(F.lit("chapter").alias("record_type"), F.col("chapter_id").alias("record_id"), "book_id", "summary", F.col("model").alias("summary_model"))
        low = parts.join(sections.select("chapter_id", "position", "section_id"), ["chapter_id", "position"]).select(
            F.lit("section").alias("record_type"), F.col("section_id").alias("record_id"), "book_id", "summary", F.when(F.col("summary").isNotNull(), F.col("model")).alias("summary_model")
        )
        self._publish("summaries", top.unionByName(low))
        self._report("summaries", asked, chapters=F.count("text"))

    def embeddings(self) -> None:
        chapters, sections = self._tables()
        summaries = self.store.stage("summaries", SUMMARIES)
        with_summary = lambda df, key: df.join(summaries.select(F.col("record_id").alias(key), "summary"), key, "left")
        rows = durable(reads.embeddable(with_summary(chapters, "chapter_id"), with_summary(sections, "section_id"), self.store.stage("objects", OBJECTS)), "embeddable")
        self.store.lock_vectors(self.embedder.model)
        # Written once: a recomputed task must not bill twice.
        vectors = durable(embedded(rows, "record_id", self.embedder), "vectors")
        point = _id(F.lit("point"), F.col("record_type"), F.col("record_id"))
        self._publish("points", rows.join(vectors, "record_id").select(point.alias("point_id"), "vector", "record_type", "record_id", "book_id", "text"))
        every = self.books.select("book_id").distinct().join(rows.join(vectors, "record_id").select("book_id", "record_id", F.col("batch_tokens").alias("embedding_tokens")), "book_id", "left")
        self._report("embeddings", every, vectors=F.count("record_id"))
