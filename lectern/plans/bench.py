"""Benchmarks over hand-authored truth: corpora, ingest with provenance, runs, and the catalogue of source files."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import re
import time
import uuid
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import audit, locations, reads, scoring, search, structure
from lectern.operators.truth import Truth, askable
from lectern.plans import evaluate, providers, registration, runner
from lectern.session import durable
from lectern.sources import files
from lectern.sources.store import Store

FAMILIES = {"recall": ("recall",), "ingestion": ("ingestion",), "all": ("recall", "ingestion")}
DEFINING = ("llm_provider", "llm_model", "llm_effort", "embedding_provider", "embedding_model")
EXTRACTION_VERSION = "1"
PREFIX = "LECTERN_"


class BenchError(RuntimeError):
    """A benchmark that can't be run as asked."""


# --- settings and corpora ------------------------------------------------------------------------------------------


def settings_of(env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """The pipeline's settings from the environment alone, so that the command shows what a run was made with."""
    from lectern.config import FIELDS

    return {name: env.get(PREFIX + name.upper(), default) for name, (default, _) in FIELDS.items()}


def snapshot_inputs(settings: Mapping[str, str]) -> dict[str, str | None]:
    """What makes two corpora different: the models and the versions stamped on what they write."""
    versions = {f"{v.split('=')[0]}_prompt_version": v.split("=")[1] for _, v in reads.PROMPT_VERSIONS}
    return {name: settings.get(name) or None for name in DEFINING} | {"extraction_version": EXTRACTION_VERSION} | versions


def snapshot(settings: Mapping[str, str]) -> str:
    """A folder name for one configuration: readable in front, unique behind."""
    digest = hashlib.blake2b(json.dumps(snapshot_inputs(settings), sort_keys=True).encode(), digest_size=4).hexdigest()
    part = lambda name: re.sub("[^a-z0-9]+", "-", (settings.get(name) or "").lower()).strip("-") or "unset"
    return f"{part('llm_provider')}-{part('embedding_provider')}-{digest}"


def assets_folder(given: Path | None, env: Mapping[str, str] = os.environ) -> Path:
    """The checked folder of truth and sources."""
    named = given or (Path(env[PREFIX + "BENCH_ASSETS"]) if env.get(PREFIX + "BENCH_ASSETS") else None)
    if named is None:
        raise BenchError(f"name the assets with --assets or {PREFIX}BENCH_ASSETS")
    folder = named.expanduser().resolve()
    if not (folder / "truth").is_dir():
        raise BenchError(f"{folder} is no assets folder: it has no truth")
    return folder


def corpus_home(settings: Mapping[str, str], env: Mapping[str, str] = os.environ) -> Path:
    """Where the corpus of a configuration lives; nothing is made."""
    return Path(env.get(PREFIX + "BENCH_HOME") or Path.home() / ".lectern-bench") / snapshot(settings)


class Corpus:
    """One configuration's store with its provenance."""

    def __init__(self, spark: SparkSession, settings: Mapping[str, str], home: Path | None = None):
        self.settings, self.home = dict(settings), home or corpus_home(settings)
        self.home.mkdir(parents=True, exist_ok=True)
        self.store = Store(spark, str(self.home / "storage"))
        keys = {v: settings.get(f"{v}_api_key") for v in ("anthropic", "openai", "gemini")}
        self.keys = keys
        self.llm = providers.language_model(settings["llm_provider"], keys, settings.get("llm_model", ""), settings.get("llm_effort", ""))
        self.embedder = providers.embedding_model(settings["embedding_provider"], keys, settings.get("embedding_model", ""))

    def provenance(self) -> dict[str, dict]:
        """What was ingested from which bytes at what cost, by book; a file that is no such object stops the read."""
        path = self.home / "provenance.json"
        if not path.exists():
            return {}
        try:
            books = json.loads(path.read_text())["books"]
        except (ValueError, KeyError, TypeError) as error:
            raise BenchError(f"{path} is no provenance: {error}") from error
        if not isinstance(books, dict):
            raise BenchError(f"{path}: books is no object")
        return books

    def keep_provenance(self, books: dict[str, dict]) -> None:
        (self.home / "provenance.json").write_text(json.dumps({"snapshot": self.home.name, "books": books}, indent=2) + "\n")


# --- sources and ingest --------------------------------------------------------------------------------------------


def scope_books(truth: Truth, scope: str) -> list[dict]:
    """The books of a slug or an area, by slug; a scope that is neither names what there is."""
    every = [r.asDict() for r in truth.books.orderBy("slug").collect()]  # written by people
    found = [b for b in every if b["slug"] == scope] or [b for b in every if b["area"] == scope]
    if not found:
        areas = sorted({b["area"] for b in every if b["area"]})
        raise BenchError(f"no scope {scope}; books: {', '.join(b['slug'] for b in every) or 'none'}; areas: {', '.join(areas) or 'none'}")
    return found


def locate_source(assets: Path, book: Mapping[str, str | None]) -> tuple[Path, str]:
    """A book's source file and its SHA-256, which must be the pinned one where there is a pin."""
    path = (assets / (book["source"] or "")).resolve()
    if not path.is_relative_to(assets.resolve()):
        raise BenchError(f"{book['slug']}: the source {book['source']} lies outside of the assets")
    if not path.is_file():
        raise BenchError(f"{book['slug']}: no source at {path}")
    with path.open("rb") as stream:
        digest = files.hash_stream(stream)
    if pinned(book["sha256"]) and book["sha256"] != digest:
        raise BenchError(f"{book['slug']}: the truth is pinned to {book['sha256']}, the source is {digest}")
    return path, digest


def pinned(sha256: str | None) -> bool:
    return bool(sha256) and not sha256.upper().startswith("TBD")


def ingest(corpus: Corpus, assets: Path, truth: Truth, scope: str, force: bool = False, on_stage: Callable[[str], None] | None = None, chain: tuple[str, ...] = files.CHAIN) -> dict:
    """Ingest a scope's books; all their sources are checked before any work.

    A book whose recorded bytes are the same is skipped unless forced.  Those left run as one batch, in which each fails
    alone; what succeeded is recorded with the cost of every stage.
    """
    located = [(b["slug"], b, *locate_source(assets, b)) for b in scope_books(truth, scope)]
    notes = [f"{slug}: the source is not pinned; its sha256 is {digest}" for slug, book, _, digest in located if not pinned(book["sha256"])]
    known, outcomes, pending = corpus.provenance(), [], {}
    for slug, book, path, digest in located:
        before = known.get(slug)
        if before and before.get("sha256") == digest and not force:
            outcomes.append({"slug": slug, "status": "skipped", "sha256": digest, "book_id": before.get("book_id")})
            continue
        try:
            book_id = registration.register_book(corpus.store, path, book["title"] or slug, "unknown")
        except registration.DuplicateBook as same:
            book_id = same.book_id
        pending[book_id] = (slug, digest)
    if pending:
        books = registration.books(corpus.store).where(F.col("book_id").isin(list(pending)))  # a scope of people's truth
        began = time.monotonic()
        run = runner.Pipeline(corpus.store, books, None, corpus.llm, corpus.embedder, on_stage, chain).run()
        wall = time.monotonic() - began
        ended = {r["book_id"]: r for r in corpus.store.runs().where(F.col("run_id") == run).collect()}
        stages = [r.asDict() for r in corpus.store.history("reports", runner.REPORTS).where(F.col("run_id") == run).collect()]
        for book_id, (slug, digest) in sorted(pending.items(), key=lambda e: e[1]):
            own = [{k: s[k] if s[k] is not None else 0 for k in ("stage", "seconds", "input_tokens", "output_tokens", "embedding_tokens", "counts")} for s in stages if s["book_id"] == book_id]
            own.sort(key=lambda s: runner.SCOPES["full"].index(s["stage"]))
            record = {"slug": slug, "status": ended[book_id]["status"], "sha256": digest, "book_id": book_id, "run_id": run, "stages": own, "error": ended[book_id]["error"]}
            outcomes.append(record)
            if record["status"] == "succeeded":
                known[slug] = {"book_id": book_id, "run_id": run, "sha256": digest, "ingested_at": dt.datetime.now(dt.UTC).isoformat(), "wall_seconds": wall, "stages": own}
                corpus.keep_provenance(known)
    return {"snapshot": corpus.home.name, "books": sorted(outcomes, key=lambda o: o["slug"]), "notes": notes}


def ingest_totals(outcome: dict) -> dict[str, float]:
    """Sums over the stages of what was ingested."""
    stages = [s for b in outcome["books"] for s in b.get("stages", [])]
    return {k: sum(s[k] or 0 for s in stages) for k in ("seconds", "input_tokens", "output_tokens", "embedding_tokens")}


# --- runs ----------------------------------------------------------------------------------------------------------


def in_corpus(truth: Truth, known: Mapping[str, dict], notes: list[str]) -> dict[str, str]:
    """The truth's books that the corpus holds; an id that is none is noted."""
    slugs = {r["slug"] for r in truth.books.select("slug").collect()}
    found = {}
    for slug, record in known.items():
        if slug in slugs and record.get("book_id"):
            try:
                found[slug] = str(uuid.UUID(str(record["book_id"])))
            except ValueError:
                notes.append(f"{slug}: the provenance has no readable book_id ({record['book_id']!r})")
    return found


def execute(
    corpus: Corpus, assets: Path, truth: Truth, family: str, scope: str, limit: int = 10, out: Path | None = None, judge: Callable[[], providers.LanguageModel] | None = None, judged_by: dict | None = None,
) -> dict:
    """Run a family of benchmarks over a scope and write the run file; returns its document with its path."""
    if family not in FAMILIES:
        raise BenchError(f"no family {family}; there are {', '.join(sorted(FAMILIES))}")
    if limit < 1:
        raise BenchError("the limit must be positive")
    spark, store, notes = truth.books.sparkSession, corpus.store, []
    books = scope_books(truth, scope)
    known = in_corpus(truth, corpus.provenance(), notes)
    scoped = [b["slug"] for b in books if b["slug"] in known]
    notes += [f"{b['slug']}: not in this corpus; ingest it first" for b in books if b["slug"] not in known]
    if not scoped:
        raise BenchError(f"no book of {scope} is in {corpus.home}; ingest it first")
    slugs = F.broadcast(spark.createDataFrame([(v, k) for k, v in known.items()], "book_id string, slug string"))
    chapters, sections = store.stage("chapters", runner.CHAPTERS), store.stage("sections", runner.SECTIONS)
    detected = structure.flatten(chapters, sections).join(slugs, "book_id")
    authored = truth.nodes.select(F.col("book").alias("slug"), "loc", "parent_loc", "kind", "title", "position").join(slugs, "slug").drop("slug")
    located = durable(locations.join_locations(detected.drop("slug"), authored), "located")
    lost = detected.join(located.select("record_id", "loc"), "record_id", "left").where("loc IS NULL").groupBy("slug", "kind").agg(F.count("*").alias("n"))
    notes += [f"{r['slug']}: {r['n']} detected nodes of kind {r['kind']} join no authored one" for r in lost.orderBy("slug", "kind").collect()]
    document = {"run_id": "", "generated_at": dt.datetime.now(dt.UTC).isoformat(), "family": family, "scope": scope, "results": [], "structure": [], "coverage": [], "faithfulness": [], "judge": None}
    document["corpus"] = {"snapshot": corpus.home.name, "books": scoped, "config": snapshot_inputs(corpus.settings)}
    document["search"] = {"mode": "vector", "limit": limit, "record_types": list(search.RECORD_TYPES)}
    costs: list[dict] = []
    if "ingestion" in FAMILIES[family]:
        costs += ingest_costs(corpus.provenance(), scoped, notes)
        document["structure"], document["coverage"] = _ingested(detected, store.stage("objects", runner.OBJECTS).join(slugs, "book_id"), scoped)
        if judge is None:
            notes.append("faithfulness is not measured: no judge is named")
        else:
            began = time.monotonic()
            tested = under_test(store, located, slugs, scoped, notes)
            verdicts = [r.asDict() for r in durable(evaluate.judged(tested, judge), "judged").join(tested.select("record_id", "book", "loc"), "record_id").orderBy("book", "loc").collect()]
            document["judge"] = judged_by
            if not verdicts:
                notes.append("faithfulness is not measured: the corpus has no summaries")
            document["faithfulness"] = [{k: v[k] for k in ("book", "loc", "supported", "claims", "note")} for v in verdicts]
            notes += [f"judge: {v['book']}/{v['loc']} {v['note']}" for v in verdicts if v["failed"]]
            costs.append({"stage": "judge", "seconds": time.monotonic() - began, "input_tokens": sum(v["input_tokens"] or 0 for v in verdicts), "output_tokens": sum(v["output_tokens"] or 0 for v in verdicts), "embedding_tokens": 0})
    if "recall" in FAMILIES[family]:
        document["results"], spent = _asked(corpus, truth, scope, scoped, known, located, slugs, limit, notes)
        costs.append(spent)
    document["cost"] = {k: sum(c[k] for c in costs) for k in ("input_tokens", "output_tokens", "embedding_tokens")} | {"wall_seconds": float(sum(c["seconds"] for c in costs)), "per_stage": costs}
    document["notes"] = notes
    path = evaluate.save_run(document, assets / "runs", family, scope, out)
    return document | {"path": str(path)}


def _ingested(detected: DataFrame, objects: DataFrame, scoped: list[str]) -> tuple[list[dict], list[dict]]:
    """Detected nodes and surfaced titles of each book, for the run file, which people keep and compare."""
    nodes = {s: [] for s in scoped}
    for r in detected.where(F.col("slug").isin(scoped)).orderBy("slug", "position").collect():
        nodes[r["slug"]].append({"title": r["title"], "kind": r["kind"], "position": r["position"]})
    names = {s: [] for s in scoped}
    for r in objects.where(F.col("slug").isin(scoped)).select("slug", "title").orderBy("slug", "title").collect():
        names[r["slug"]].append(r["title"])
    return [{"book": s, "detected": v} for s, v in nodes.items()], [{"book": s, "surfaced": v} for s, v in names.items()]


def under_test(store: Store, located: DataFrame, slugs: DataFrame, scoped: list[str], notes: list[str]) -> DataFrame:
    """``(record_id, book, loc, summary, source)``: every stored summary beside the lines it must be faithful to.

    A chapter's are its whole body, a section's its own lines up to the next heading.  Summaries without a location and
    sections without a line are counted in the notes, as a mean over the others would hide them.
    """
    chapters, sections = store.stage("chapters", runner.CHAPTERS), store.stage("sections", runner.SECTIONS)
    texts = store.stage("parsed", runner.PARSED)
    top = chapters.select("book_id", F.col("chapter_id").alias("record_id"), "title", F.col("source_line").alias("line"), F.col("position").alias("chapter"), F.lit(None).cast("int").alias("section"))
    low = sections.select("book_id", F.col("section_id").alias("record_id"), "title", F.col("source_line").alias("line"), F.lit(None).cast("int").alias("chapter"), F.col("position").alias("section"))
    told = store.stage("summaries", runner.SUMMARIES).where("summary IS NOT NULL AND summary != ''").select("record_id", "summary")
    rows = top.unionByName(low).join(told, "record_id").join(slugs, "book_id").where(F.col("slug").isin(scoped)).join(located.select("record_id", "loc"), "record_id", "left")
    rows = durable(rows, "summaries")
    bodies = structure.bodies(texts, top.select("book_id", "chapter", "section", "line"))
    slices = structure.section_slices(texts, top.select("book_id", "line").unionByName(low.select("book_id", "line")))
    for r in rows.groupBy("slug").agg(F.count_if(F.col("loc").isNull()).alias("lost"), F.count_if(F.col("loc").isNotNull() & F.col("chapter").isNull() & F.col("line").isNull()).alias("bare")).orderBy("slug").collect():
        notes += [f"{r['slug']}: {r['lost']} summaries are not judged, as they join no node"] * (r["lost"] > 0)
        notes += [f"{r['slug']}: {r['bare']} section summaries are not judged, as no line is recorded"] * (r["bare"] > 0)
    good = rows.where("loc IS NOT NULL")
    whole = good.where("chapter IS NOT NULL").join(bodies, ["book_id", "chapter"])
    part = good.where("chapter IS NULL AND line IS NOT NULL").join(slices, ["book_id", "line"])
    pick = lambda df: df.select("record_id", F.col("slug").alias("book"), "loc", "summary", F.col("body").alias("source"))
    return pick(whole).unionByName(pick(part))


def _asked(corpus: Corpus, truth: Truth, scope: str, scoped: list[str], known: dict, located: DataFrame, slugs: DataFrame, limit: int, notes: list[str]) -> tuple[list[dict], dict]:
    """Every query of a scope asked in one pass over the points, and what that cost.

    A book's own queries see its points alone; an area's see all.  Gated queries are noted and not asked.
    """
    embedder, store = corpus.embedder(), corpus.store
    if not search.verified_model(store.vector_model(), embedder.model):
        raise BenchError(f"nothing is embedded in {corpus.home}; every query would fail")
    every = truth.queries.where(F.col("book").isin(scoped) | (F.col("area") == scope)).orderBy("query_id").collect()
    notes += [f"{q['q']!r} is gated; not asked" for q in every if q["gated"]]
    notes += [f"{s}: no queries are authored" for s in scoped if all(q["book"] != s for q in every)]
    live = {r["query_id"] for r in askable(truth, scope).select("query_id").collect()}
    asked = [q for q in every if not q["gated"] and (q["query_id"] in live or q["book"] in scoped)]
    began, tokens, unreported, vectors = time.monotonic(), 0, 0, []
    for at in range(0, len(asked), embedder.max_batch):
        part, told = embedder.embed([q["q"] for q in asked[at : at + embedder.max_batch]])
        vectors += part
        tokens, unreported = tokens + (told or 0), unreported + (told is None)
    results = {q["query_id"]: {"q": q["q"], "hits": [], **({"book": q["book"]} if q["book"] else {"area": q["area"]})} for q in asked}
    if asked:
        queries = [(q["query_id"], v, known.get(q["book"]) if q["book"] else None) for q, v in zip(asked, vectors, strict=True)]
        hits = durable(search.many_top_k(store.stage("points", runner.POINTS), queries, limit), "hits")
        rows = search.records(store.stage("chapters", runner.CHAPTERS), store.stage("sections", runner.SECTIONS), store.stage("objects", runner.OBJECTS))
        there = search.resolve(hits, rows).drop("title")
        objects = store.stage("objects", runner.OBJECTS).select(F.col("object_id").alias("record_id"), "section_id", "chapter_id")
        placed = durable(there.join(slugs, "book_id", "left").join(locations.locate_hits(there, objects, located).select("query_id", "rank", "record_id", "loc"), ["query_id", "rank", "record_id"], "left"), "placed")
        for r in placed.where("loc IS NOT NULL AND slug IS NOT NULL").orderBy("query_id", "rank").collect():
            results[r["query_id"]]["hits"].append({"rank": r["rank"], "book": r["slug"], "loc": r["loc"], "record_type": r["record_type"]})
        notes += [r["note"] for r in scoring.drops(placed).orderBy("note").collect()]
    if unreported:
        notes.append(f"{unreported} embedding calls told no usage; the cost of the search is a lower bound")
    spent = {"stage": "search", "seconds": time.monotonic() - began, "input_tokens": 0, "output_tokens": 0, "embedding_tokens": tokens}
    return list(results.values()), spent


def ingest_costs(known: Mapping[str, dict], scoped: list[str], notes: list[str]) -> list[dict]:
    """One row a stage, summed over books in the order first seen; what is no number counts as zero and is noted."""
    totals: dict[str, dict] = {}
    for slug in scoped:
        for entry in known.get(slug, {}).get("stages") or []:
            stage = str(entry.get("stage") or "").strip() if isinstance(entry, dict) else ""
            if not stage:
                notes.append(f"{slug}: a stage without a name is not counted")
                continue
            row = totals.setdefault(stage, {"stage": stage, "seconds": 0.0, "input_tokens": 0, "output_tokens": 0, "embedding_tokens": 0})
            for name, cast in (("seconds", float), ("input_tokens", int), ("output_tokens", int), ("embedding_tokens", int)):
                value = entry.get(name)
                try:
                    row[name] += cast(value) if value not in (None, "") else 0
                except (TypeError, ValueError):
                    notes.append(f"{slug}/{stage} {name} is no number ({value!r}); counted as zero")
    return list(totals.values())


# --- the catalogue of source files ---------------------------------------------------------------------------------


def read_sources(spark: SparkSession, folder: Path) -> DataFrame:
    """``(name, path, suffix, sha256, pages, chars_per_page, norm, front, unreadable)`` of every book file of a folder.

    Files are read on the workers, each as a whole; what can't be read says why.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                pages, outline, broken = _pages(bytes(content))
                body = " ".join(pages)
                rows.append((len(pages), sum(map(len, pages)) // len(pages) if pages else 0, f"{outline} {body}", body[:25_000], broken))
            yield pd.concat([pdf[["path", "sha256", "changed"]].reset_index(drop=True), pd.DataFrame(rows, columns=["pages", "chars_per_page", "text", "head", "unreadable"])], axis=1)

    rows = files.binary(spark, str(folder)).select("path", F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("changed"), "content")
    read = rows.mapInPandas(run, "path string, sha256 string, changed timestamp, pages int, chars_per_page int, text string, head string, unreadable string")
    name = F.url_decode(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\+", "%2B"))
    return read.select(
        name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("suffix"), "sha256", "changed", "pages", "chars_per_page", T.normalise_source(F.col("text")).alias("norm"), F.col("head").alias("front"), "unreadable"
    ).where("suffix IN ('pdf', 'epub')")


def _pages(content: bytes) -> tuple[list[str], str, str | None]:
    """Texts of the pages, the outline's titles, and why there are none."""
    try:
        import pymupdf
    except ImportError:
        return [], "", "no library to read it is installed"
    try:
        pymupdf.TOOLS.mupdf_display_errors(False)
        with pymupdf.open(stream=content) as document:
            if document.needs_pass:
                return [], "", "it is protected by a password"
            if not document.page_count:
                return [], "", "it has no pages"
            return [str(page.get_text()) for page in document], " ".join(entry[1] for entry in document.get_toc()), None
    except Exception as error:  # noqa: BLE001 - whatever keeps it from opening
        return [], "", f"{type(error).__name__}: {error}"


def catalogue(spark: SparkSession, assets: Path, truth: Truth, read: Callable[[SparkSession, Path], DataFrame] = read_sources) -> dict:
    """Which book each source file is, what is wrong with it, and what it should be called.

    Files are identified by the authored chapter titles they hold; a file that can't be told apart, contradicts what is
    expected or has another format has a problem, and only faultless files are given the expected name.
    """
    folder = assets / "sources"
    slugs = sorted(r["slug"] for r in truth.books.select("slug").collect())
    if not folder.is_dir():
        return {"files": [], "identified": {}, "contested": {}, "missing": slugs, "ignored": []}
    found = durable(read(spark, folder), "sources")
    norm = T.normalise_source(F.col("title"))
    titles = truth.nodes.where("kind = 'chapter'").select(F.concat_ws("#", "book", "loc").alias("title_id"), F.col("book").alias("book_id"), norm.alias("norm"), T.word_weight(norm).alias("weight"))
    matched = scoring.identify(found.select(F.col("name").alias("artifact_id"), "norm"), titles)
    taken = matched.select(F.col("artifact_id").alias("name"), F.col("book_id").alias("best"), "score", "runner_up", "decided")
    facts = F.broadcast(truth.books.select(F.col("slug").alias("best"), "title", "edition", F.col("year").cast("int").alias("year"), "isbn", F.col("sha256").alias("pin"), "source"))
    rows = found.join(taken, "name", "left").withColumn("best", F.when(F.col("decided"), F.col("best"))).join(facts, "best", "left").withColumnRenamed("best", "slug")
    rows = audit.audited(rows)
    expected = F.regexp_extract("source", r"([^/]*)$", 1)
    other = F.lower(F.regexp_extract(expected, r"\.([^.]*)$", 1)) != F.col("suffix")
    undecided = F.when(F.coalesce("score", F.lit(0.0)) == 0, "holds no book's chapter titles").otherwise(F.concat(
        F.lit("cannot be told apart: "), F.format_number("score", 2), F.lit(" against "), F.format_number("runner_up", 2)))
    more = F.when(F.col("slug").isNull() & (F.size("problems") == 0), F.array(undecided)).when(F.col("slug").isNotNull() & other, F.array(F.concat(F.lit("another format than "), expected))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("problems", F.concat("problems", more)).withColumn("rename_to", F.when((F.size("problems") == 0) & (F.col("name") != expected), expected))
    rows = durable(rows.drop("norm", "front"), "catalogue")
    claimed = audit.claims(rows)
    listed = {r["slug"]: r for r in claimed.collect()}  # at most the truth's books
    by_name = {r["name"]: r.asDict() for r in rows.drop("changed").orderBy("name").collect()}  # a folder that people fill
    return {
        "files": list(by_name.values()),
        "identified": {s: by_name[r["files"][0]] for s, r in sorted(listed.items()) if r["state"] == "identified"},
        "contested": {s: r["files"] for s, r in sorted(listed.items()) if r["state"] == "contested"},
        "missing": sorted(r["slug"] for r in audit.missing(truth.books, claimed).collect()),
        "ignored": sorted(p.name for p in folder.iterdir() if p.is_file() and p.suffix.lower().lstrip(".") not in files.MAGIC),
    }


def pin(assets: Path, found: Mapping) -> list[str]:
    """Give each identified file its expected name and write its hash into the truth; contested ones stay as they are."""
    done = []
    for slug, entry in sorted(found["identified"].items()):
        path = assets / "sources" / entry["name"]
        if entry["rename_to"]:
            path = path.rename(path.with_name(entry["rename_to"]))
            done.append(f"{slug}: {entry['name']} is now {path.name}")
        for name in ("book.yaml", "book.yml"):
            document = assets / "truth" / "books" / slug / name
            if document.exists():
                before = document.read_text()
                after = re.sub(r"(?m)^[^\S\n]*sha256:[^\n]*", lambda m: repinned(m.group(), entry["sha256"]), before, count=1)
                if after != before:
                    document.write_text(after)
                    done.append(f"{slug}: pinned to {entry['sha256'][:16]}…")
    return done


def repinned(line: str, sha256: str) -> str:
    """A ``sha256:`` line with another value, as ``text.repin_line`` gives it."""
    comment = re.search(r"\s+#.*$", line)
    stale = comment is None or re.search("(?i)tbd|handover|when the file lands|blocked", comment.group())
    return re.match(r"\s*", line).group() + f"sha256: {sha256}" + ("" if stale else comment.group())
