"""Command line: ``python -m lectern.cli <command>``."""

from __future__ import annotations

import argparse
import getpass
import json
import os
import re
import sys
from pathlib import Path

from lectern import config


def _rows(df) -> None:
    """Every row as a line of JSON, fetched piece by piece."""
    for r in df.toLocalIterator():
        print(json.dumps({k: v for k, v in r.asDict(recursive=True).items() if v is not None}, default=str, ensure_ascii=False))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern")
    p.add_argument("--home", type=Path, default=Path(os.environ.get("LECTERN_HOME", "~/.lectern")).expanduser())
    p.add_argument("--data", help="folder of tables; the storage root by default")
    sub = p.add_subparsers(dest="command", required=True)
    add = sub.add_parser("add")
    add.add_argument("path", type=Path)
    add.add_argument("--title", required=True)
    add.add_argument("--author", required=True)
    add.add_argument("--hint", action="append", default=[], help="name=value, such as isbn=...")
    ingest = sub.add_parser("ingest")
    ingest.add_argument("book", nargs="?", help="a book's id; all books without it")
    ingest.add_argument("--scope", default="full", choices=["full", "profile", "extraction", "embeddings"])
    books = sub.add_parser("books").add_subparsers(dest="verb", required=True)
    books.add_parser("list")
    books.add_parser("show").add_argument("book")
    update = books.add_parser("update")
    update.add_argument("book")
    update.add_argument("fields", nargs="+", help="name=value; an empty value clears")
    runs = sub.add_parser("runs").add_subparsers(dest="verb", required=True)
    runs.add_parser("list")
    runs.add_parser("show").add_argument("run")
    sub.add_parser("export", help="write the tables to the database that jdbc_url names")
    for name in ("structure", "profile"):
        sub.add_parser(name).add_argument("book")
    knowledge = sub.add_parser("knowledge").add_subparsers(dest="verb", required=True)
    listed = knowledge.add_parser("list")
    listed.add_argument("book")
    listed.add_argument("--type")
    knowledge.add_parser("show").add_argument("object")
    find = sub.add_parser("search")
    find.add_argument("book", help="a book's id, or all")
    find.add_argument("query")
    find.add_argument("--type", action="append")
    find.add_argument("--limit", type=int, default=10)
    find.add_argument("--offset", type=int, default=0)
    find.add_argument("--score-threshold", type=float)
    bench = sub.add_parser("bench")
    bench.add_argument("--assets", type=Path)
    verbs = bench.add_subparsers(dest="verb", required=True)
    verbs.add_parser("lint")
    verbs.add_parser("sources").add_argument("--pin", action="store_true")
    fill = verbs.add_parser("ingest")
    fill.add_argument("scope")
    fill.add_argument("--force", action="store_true")
    run = verbs.add_parser("run")
    run.add_argument("family", choices=["recall", "ingestion", "all"])
    run.add_argument("scope")
    run.add_argument("--limit", type=int, default=10)
    run.add_argument("--out", type=Path)
    verbs.add_parser("score").add_argument("run", type=Path)
    for name in ("compare", "report"):
        two = verbs.add_parser(name)
        two.add_argument("base", type=Path)
        two.add_argument("candidate", type=Path)
    conf = sub.add_parser("config").add_subparsers(dest="verb", required=True)
    conf.add_parser("list")
    for verb in ("get", "unset"):
        conf.add_parser(verb).add_argument("name")
    put = conf.add_parser("set")
    put.add_argument("name")
    put.add_argument("value", nargs="?", help="read from the terminal or the input where it is left out")
    return p


def _config(args) -> None:
    if args.verb == "list":
        for name, value, source in config.shown(config.resolve(args.home)):
            print(f"{name}\t{value}\t{source}")
    elif args.verb == "get":
        values = config.resolve(args.home)
        if args.name not in values:
            raise config.ConfigError(f"unknown setting {args.name}")
        print(values[args.name].value)
    else:
        value = None if args.verb == "unset" else args.value
        if args.verb == "set" and value is None:
            value = getpass.getpass(f"{args.name}: ") if sys.stdin.isatty() else sys.stdin.readline().rstrip("\n")
        config.write(args.home, args.name, value)


def _run(args) -> int:
    from pyspark.sql import functions as F

    from lectern.operators import reads, search
    from lectern.plans import providers, registration, runner
    from lectern.session import local_session
    from lectern.sources import relational
    from lectern.sources.store import Store

    settings = {name: v.value for name, v in config.resolve(args.home).items()}
    for name in ("book", "object"):
        named = getattr(args, name, None)
        if named not in (None, "all") and not re.fullmatch(search.UUID, named):
            raise ValueError(f"{named} is no id")
    spark = local_session("*")
    store = Store(spark, args.data or settings["storage_root"])
    keys = {v: settings[f"{v}_api_key"] for v in ("anthropic", "openai", "gemini")}
    books = registration.books(store)
    if args.command == "add":
        book = registration.register_book(store, args.path, args.title, args.author, **dict(h.split("=", 1) for h in args.hint))
        _rows(registration.books(store).where(F.col("book_id") == book))
    elif args.command == "ingest":
        wanted = reads.by_id(books, "book_id", args.book) if args.book else books
        if args.scope != "full":
            done = store.runs().where("status = 'succeeded'").select("book_id").distinct()
            if not wanted.join(done, "book_id", "left_anti").isEmpty():
                raise reads.NotFound("an incremental scope needs an earlier successful run of every book")
        llm = providers.language_model(settings["llm_provider"], keys, settings["llm_model"], settings["llm_effort"])
        embedder = providers.embedding_model(settings["embedding_provider"], keys, settings["embedding_model"])
        run = runner.Pipeline(store, wanted, None, llm, embedder, on_stage=lambda stage: print(stage, file=sys.stderr)).run(args.scope)
        ended = store.runs().where(F.col("run_id") == run)
        _rows(ended)
        return int(not ended.where("status = 'failed'").isEmpty())
    elif args.command == "books":
        if args.verb == "list":
            _rows(reads.list_books(books))
        elif args.verb == "show":
            _rows(reads.by_id(books, "book_id", args.book))
        else:
            registration.update_book(store, args.book, **dict(f.split("=", 1) for f in args.fields))
            _rows(registration.books(store).where(F.col("book_id") == args.book))
    elif args.command == "export":
        if not settings["jdbc_url"]:
            raise config.ConfigError("jdbc_url names no database")
        for name in relational.export(store, settings["jdbc_url"]):
            print(name)
    elif args.command == "runs":
        runs = store.runs()
        _rows(runs.orderBy("at", "run_id") if args.verb == "list" else reads.by_id(runs, "run_id", args.run))
    elif args.command == "structure":
        view = reads.structure_view(store.stage("chapters", runner.CHAPTERS), store.stage("sections", runner.SECTIONS))
        _rows(view.where(F.col("book_id") == args.book).orderBy("position"))
    elif args.command == "profile":
        latest = reads.latest(store.history("profiles", runner.PROFILES), "book_id", "created_at", "profile_id")
        _rows(reads.by_id(latest, "book_id", args.book))
    elif args.command == "knowledge":
        objects = store.stage("objects", runner.OBJECTS)
        if args.verb == "list":
            _rows(reads.knowledge(objects.withColumn("created_at", F.lit(0)), args.book, args.type).drop("created_at"))
        else:
            _rows(reads.by_id(objects, "object_id", args.object))
    elif args.command == "search":
        embedder = providers.embedding_model(settings["embedding_provider"], keys, settings["embedding_model"])()
        hits, _ = search.search(store, embedder, args.query, args.limit, args.offset, args.score_threshold, None if args.book == "all" else args.book, args.type)
        if hits is not None:
            _rows(hits)
    return 0


def _bench(args) -> int:
    """The benchmark's verbs; a regression or an error of the truth ends with 1."""
    from lectern.operators import scoring, truth
    from lectern.plans import bench, evaluate, providers
    from lectern.session import local_session

    assets, spark, settings = bench.assets_folder(args.assets), local_session("*"), bench.settings_of()
    facts = truth.load(spark, assets)
    show = lambda value: print(json.dumps(value, indent=2, default=str, ensure_ascii=False))
    if args.verb == "lint":
        findings = truth.lint(facts)
        _rows(findings.orderBy("severity", "place", "message"))
        return int(not truth.errors(findings).isEmpty())
    if args.verb == "sources":
        found = bench.catalogue(spark, assets, facts)
        show(found | ({"done": bench.pin(assets, found)} if args.pin else {}))
        return int(any(f["problems"] for f in found["files"]))
    if args.verb in ("ingest", "run"):
        faults = truth.errors(truth.lint(facts))
        if not faults.isEmpty():
            raise bench.BenchError("the truth has errors; lint names them")
        corpus = bench.Corpus(spark, settings)
        if args.verb == "ingest":
            outcome = bench.ingest(corpus, assets, facts, args.scope, args.force, on_stage=lambda stage: print(stage, file=sys.stderr))
            show(outcome | {"totals": bench.ingest_totals(outcome)})
            return int(any(b["status"] == "failed" for b in outcome["books"]))
        choice = providers.judge_choice(os.environ, settings["llm_provider"])
        judge = choice.recipe(corpus.keys, settings["llm_provider"]) if choice else None
        show(bench.execute(corpus, assets, facts, args.family, args.scope, args.limit, args.out, judge, vars(choice) if choice else None))
        return 0
    if args.verb == "score":
        made = evaluate.summary(evaluate.load_run(spark, str(args.run)), facts)
        show(made | {"slices": list(made["slices"].values())})
        return 0
    base, candidate = (evaluate.load_run(spark, str(p)) for p in (args.base, args.candidate))
    verdicts = scoring.compare(evaluate.score(base, facts), evaluate.score(candidate, facts))
    if args.verb == "report":
        print(evaluate.page(evaluate.summary(base, facts), evaluate.summary(candidate, facts)), end="")
    else:
        _rows(verdicts.orderBy("dimension"))
    return int(not verdicts.where("verdict = 'regression'").isEmpty())


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        if args.command == "config":
            _config(args)
        else:
            return (_bench if args.command == "bench" else _run)(args)
    except (ValueError, LookupError, RuntimeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
