"""Benchmarks from truth and sources to a comparison."""

import json

import pytest
from pyspark.sql import functions as F

from lectern import cli
from lectern.operators import audit, scoring, search, truth
from lectern.plans import bench, evaluate, providers
from lectern.sources import files

HEADS = {"one": ("Parsing input", "Tokens and lexers"), "two": ("Garbage collection", "Mark and sweep")}


@pytest.fixture
def assets(tmp_path):
    for slug, (chapter, section) in HEADS.items():
        folder = tmp_path / "assets" / "truth" / "books" / slug
        folder.mkdir(parents=True)
        put = lambda name, value, folder=folder: (folder / f"{name}.json").write_text(json.dumps(value))
        put("book", {"title": f"Book {slug} of engines", "area": "engines", "edition": "2nd", "year": "2020", "isbn": "123", "source": {"sha256": "TBD", "file": f"sources/{slug}.pdf"}})
        put("toc", {"chapters": [{"id": "c1", "title": chapter, "sections": [{"id": "s1", "title": section}]}, {"id": "c2", "title": f"More of {slug} matters"}]})
        put("queries", {"queries": [{"q": f"what is {slug}", "kind": "conceptual", "why": "w", "expects": [{"loc": "c1"}]}, {"q": f"gated {slug}", "kind": "exact-term", "why": "w", "gated": True, "expects": [{"loc": "c1"}]}, {"q": f"open {slug}", "kind": "exact-term", "why": "w", "expects": [{"loc": "TBD"}]}]})
        put("concepts", {"concepts": [{"concept": "Offline stand-in", "loc": "c1"}, {"concept": "Gone", "loc": "s1"}]})
        put("index-pairs", {"index_pairs": [{"term": "t", "loc": "c1"}]})
    area = tmp_path / "assets" / "truth" / "areas" / "engines"
    area.mkdir(parents=True)
    (area / "queries.json").write_text(json.dumps({"queries": [{"q": "which book", "kind": "cross-book", "why": "w", "expects": [{"book": "two", "loc": "c1"}]}]}))
    sources = tmp_path / "assets" / "sources"
    sources.mkdir()
    for slug, (chapter, section) in HEADS.items():
        (sources / f"{slug}.pdf").write_bytes(f"%PDF-1.7 # {chapter}\nwords here\n## {section}\nmore words\n# More of {slug} matters\nend".encode())
    return tmp_path / "assets"


def _settings(**more):
    return bench.settings_of({}) | more


def test_settings_make_the_corpus(tmp_path, assets):
    env = {"LECTERN_LLM_MODEL": "m", "LECTERN_BENCH_HOME": str(tmp_path)}
    assert bench.settings_of(env)["llm_model"] == "m" and bench.snapshot(_settings()) == bench.snapshot(_settings(jdbc_url="x"))
    assert bench.snapshot(_settings(llm_model="m")) != bench.snapshot(_settings()) and bench.snapshot(_settings()).startswith("fake-fake-")
    assert bench.corpus_home(_settings(), env).parent == tmp_path and bench.snapshot_inputs(_settings())["extraction_prompt_version"] == "2"
    assert bench.assets_folder(None, {"LECTERN_BENCH_ASSETS": str(assets)}) == assets
    for given in (None, tmp_path / "nowhere", tmp_path):
        with pytest.raises(bench.BenchError):
            bench.assets_folder(given, {})


def test_sources_are_checked_before_any_work(assets):
    book = {"slug": "one", "source": "sources/one.pdf", "sha256": "TBD"}
    path, digest = bench.locate_source(assets, book)
    assert bench.locate_source(assets, book | {"sha256": digest}) == (path, digest)
    for wrong in ({"source": "../one.pdf"}, {"source": "sources/none.pdf"}, {"sha256": "ff" * 32}):
        with pytest.raises(bench.BenchError):
            bench.locate_source(assets, book | wrong)


def test_from_ingest_to_report(spark, assets, tmp_path, capsys, monkeypatch):
    files.register_parser("bare", {"pdf"}, lambda: lambda content: content[9:].decode())
    facts = truth.load(spark, assets)
    corpus = bench.Corpus(spark, _settings(), tmp_path / "corpus")
    with pytest.raises(bench.BenchError, match="ingest it first"):
        bench.execute(corpus, assets, facts, "all", "engines")
    seen = []
    outcome = bench.ingest(corpus, assets, facts, "engines", on_stage=seen.append, chain=("bare",))
    assert [b["status"] for b in outcome["books"]] == ["succeeded", "succeeded"] and len(outcome["notes"]) == 2 and seen[0] == "parse"
    assert [s["stage"] for s in outcome["books"][0]["stages"]] == ["parse", "structure", "profile", "extraction", "summaries", "embeddings"]
    assert outcome["books"][0]["stages"][1]["counts"] == {"chapters": 2, "sections": 1} and bench.ingest_totals(outcome)["input_tokens"] == 0
    assert [b["status"] for b in bench.ingest(corpus, assets, facts, "one", chain=("bare",))["books"]] == ["skipped"]
    forced = bench.ingest(corpus, assets, facts, "one", force=True, chain=("bare",))["books"][0]
    assert forced["status"] == "succeeded" and forced["book_id"] == outcome["books"][0]["book_id"]
    with pytest.raises(bench.BenchError, match="areas: engines"):
        bench.ingest(corpus, assets, facts, "nothing")

    class Judge(providers.FakeLanguageModel):
        def complete(self, prompt, *, system=None):
            return providers.Answer(super().complete(prompt, system=system).text, "judge-1", 5, 1)

    run = bench.execute(corpus, assets, facts, "all", "engines", judge=Judge, judged_by={"provider": "x", "model": "judge-1"})
    assert len(run["results"]) == 5 and all("hits" in r for r in run["results"]) and {r.get("area") for r in run["results"]} == {None, "engines"}
    own = next(r for r in run["results"] if r["q"] == "what is one")
    assert own["hits"] and {h["book"] for h in own["hits"]} == {"one"}
    assert {h["book"] for r in run["results"] if r.get("area") for h in r["hits"]} == {"one", "two"}
    assert [d["title"] for d in run["structure"][0]["detected"]] == ["Parsing input", "Tokens and lexers", "More of one matters"]
    assert len(run["faithfulness"]) == 4 and all(f["supported"] == f["claims"] == 1 for f in run["faithfulness"])
    assert [s["stage"] for s in run["cost"]["per_stage"]][-2:] == ["judge", "search"] and run["cost"]["input_tokens"] == 4 * 2 * 5
    assert any("gated" in n for n in run["notes"])
    loaded = evaluate.load_run(spark, run["path"])
    scores = {r["dimension"]: r["score"] for r in evaluate.score(loaded, facts).collect()}
    assert scores["structure"] == 1.0 and scores["coverage"] == 0.5 and scores["faithfulness"] == 1.0 and 0 < scores["recall"] <= 1
    made = evaluate.summary(loaded, facts)
    assert made["slices"]["attribution", ""]["mrr"] == 1.0 and ("area", "engines") in made["slices"] and ("kind", "conceptual") in made["slices"]
    assert sum("gated" in n for n in made["skipped"]) == 2 and sum("placeholders" in n for n in made["skipped"]) == 2 and sum("index terms" in n for n in made["unasked"]) == 2
    worse = json.loads(open(run["path"]).read()) | {"run_id": "worse", "structure": [{"book": "one", "detected": []}, {"book": "zzz", "detected": []}], "results": [], "cost": None}
    other = evaluate.save_run(worse, tmp_path, "all", "engines", tmp_path / "worse.json")
    page = evaluate.page(made, evaluate.summary(evaluate.load_run(spark, str(other)), facts))
    for want in ("**Regression** in structure", "| recall |", "not comparable", "Right book", "| search |", "never asked", "zzz is not in the truth"):
        assert want in page, want
    monkeypatch.setattr("lectern.session.local_session", lambda *a, **k: spark)
    assert cli.main(["bench", "--assets", str(assets), "compare", run["path"], str(other)]) == 1 and "regression" in capsys.readouterr().out
    assert cli.main(["bench", "--assets", str(assets), "report", run["path"], run["path"]]) == 0 and "No regression" in capsys.readouterr().out
    assert cli.main(["bench", "--assets", str(assets), "lint"]) == 0
    assert cli.main(["bench", "--assets", str(tmp_path), "lint"]) == 1


def test_run_files_are_read_strictly(spark, tmp_path):
    path = tmp_path / "r.json"
    put = lambda value: path.write_text(json.dumps(value))
    put({"run_id": "r", "results": [5, {"q": "a", "hits": [{"rank": "2", "loc": "x"}, {"rank": None}, "odd"]}], "faithfulness": [{"supported": "", "claims": 3}]})
    row = evaluate.load_run(spark, str(path)).first()
    assert [h["rank"] for h in row["results"][0]["hits"]] == [2, 0] and row["faithfulness"][0]["supported"] == 0 and row["cost"] is None
    for bad in ({"results": [{"q": "a", "hits": [{"rank": True}]}]}, {"faithfulness": [{"claims": [1]}]}):
        put(bad)
        with pytest.raises(TypeError, match="r.json"):
            evaluate.load_run(spark, str(path))
    for bad in ("{", "[]"):
        path.write_text(bad)
        with pytest.raises(ValueError, match="r.json"):
            evaluate.load_run(spark, str(path))


def test_provenance_is_read_with_care(spark, assets, tmp_path):
    corpus, notes = bench.Corpus(spark, _settings(), tmp_path / "c"), []
    assert corpus.provenance() == {}
    corpus.keep_provenance({"one": {"book_id": "no id"}, "zzz": {"book_id": "x"}})
    assert bench.in_corpus(truth.load(spark, assets), corpus.provenance(), notes) == {} and len(notes) == 1
    (tmp_path / "c" / "provenance.json").write_text("[]")
    with pytest.raises(bench.BenchError):
        corpus.provenance()
    notes.clear()
    stages = [{"stage": "parse", "seconds": "1.5", "input_tokens": "x"}, {"stage": " "}, "odd", {"stage": "parse", "seconds": 1, "output_tokens": 4}]
    costs = bench.ingest_costs({"one": {"stages": stages}}, ["one", "two"], notes)
    assert costs == [{"stage": "parse", "seconds": 2.5, "input_tokens": 0, "output_tokens": 4, "embedding_tokens": 0}] and len(notes) == 3


def test_results_answer_queries_by_scope_and_attribution(spark):
    queries = spark.createDataFrame([("1", "a", "one", None), ("2", "a", None, "x"), ("3", "b", "one", None), ("4", "c", "one", None)], "query_id string, q string, book string, area string")
    results = spark.createDataFrame([("a", None, None, 0), ("a", "one", None, 1), ("a", "one", None, 2), ("b", "two", None, 3)], "q string, book string, area string, at int")
    assert {r["query_id"]: r["at"] for r in scoring.chosen_results(queries, results).collect()} == {"1": 1, "2": 0, "3": None, "4": None}
    expected = spark.createDataFrame([("1", "one"), ("1", "two"), ("2", "one")], "query_id string, book string")
    hits = spark.createDataFrame([("1", 5, "two"), ("1", 6, "one"), ("1", 0, "one"), ("2", 6, "one")], "query_id string, rank int, book string")
    assert {r["query_id"]: (r["best_book_rank"], r["attributed"]) for r in scoring.attribution(expected, hits).collect()} == {"1": (5, 1.0), "2": (6, 0.0)}


def test_many_queries_equal_single_ones(spark):
    import random

    rng = random.Random(5)
    rows = [(f"p{i:03d}", [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)], "chapter", f"r{i}", rng.choice("xy")) for i in range(80)] + [("bad", None, "chapter", "r", "x")]
    points = spark.createDataFrame(rows + rows[:5], "point_id string, vector array<float>, record_type string, record_id string, book_id string").repartition(5)
    queries = [(f"q{i}", [rng.choice([-1.0, 1.0]) for _ in range(3)], rng.choice([None, "x", "z"])) for i in range(9)]
    got = {}
    for r in search.many_top_k(points, queries, 4, queries_a_pass=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["point_id"], r["score"]))
    for q, v, book in queries:
        want = [(r["rank"], r["point_id"], r["score"]) for r in search.top_k(points, v, 4, book_id=book).collect()]
        assert sorted(got.get(q, [])) == sorted(want), q


def test_source_files_are_identified_audited_and_pinned(spark, assets):
    facts = truth.load(spark, assets)
    text = lambda slug: " ".join(HEADS[slug]).lower() + f" more of {slug} matters"
    front = lambda slug, edition, year: f"Book {slug} of engines, {edition} edition. Copyright {year} by X. ISBN 1-2-3"
    rows = [
        ("a.pdf", "pdf", "h1", 10, 900, text("one"), front("one", "second", 2020), None),
        ("b.pdf", "pdf", "h2", 10, 900, text("two"), front("two", "first", 2012), None),
        ("c.epub", "epub", "h3", 10, 900, text("two"), front("two", "2nd", 2024), None),
        ("d.pdf", "pdf", "h4", 10, 20, "", "", None),
        ("e.pdf", "pdf", "h5", 0, 0, "", "", "it has no pages"),
    ]
    schema = "name string, suffix string, sha256 string, pages int, chars_per_page int, norm string, front string, unreadable string"
    read = lambda spark, folder: spark.createDataFrame(rows, schema).withColumn("changed", F.lit(None).cast("timestamp"))
    (assets / "sources" / "notes.txt").write_text("x")
    found = bench.catalogue(spark, assets, facts, read)
    by = {f["name"]: f for f in found["files"]}
    assert by["a.pdf"]["problems"] == [] and by["a.pdf"]["rename_to"] == "one.pdf" and any("2nd is stated" in n for n in by["a.pdf"]["notes"]) and any("ISBN 123 is stated" in n for n in by["a.pdf"]["notes"])
    assert len(by["b.pdf"]["problems"]) == 2 and "states edition 1st" in by["b.pdf"]["problems"][0] and "earlier edition" in by["b.pdf"]["problems"][1]
    assert by["c.epub"]["problems"] == ["another format than two.pdf"] and any("reprint" in n for n in by["c.epub"]["notes"])
    assert "scan" in by["d.pdf"]["problems"][0] and by["e.pdf"]["problems"] == ["cannot be read: it has no pages"]
    assert list(found["identified"]) == ["one"] and found["missing"] == ["two"] and found["ignored"] == ["notes.txt"]
    yaml = assets / "truth" / "books" / "one" / "book.yaml"
    yaml.write_text("title: One\nsource:\n  sha256: TBD  # when the file lands\n  file: x\n")
    (assets / "sources" / "one.pdf").rename(assets / "sources" / "a.pdf")
    assert len(bench.pin(assets, found)) == 2 and (assets / "sources" / "one.pdf").exists()
    assert yaml.read_text() == "title: One\nsource:\n  sha256: h1\n  file: x\n" and bench.repinned("sha256: a # kept", "b") == "sha256: b # kept"
    twice = spark.createDataFrame([("one", "a", []), ("one", "b", []), ("two", "c", []), ("two", "d", ["bad"]), (None, "e", [])], "slug string, name string, problems array<string>")
    assert {r["slug"]: (r["state"], r["files"]) for r in audit.claims(twice).collect()} == {"one": ("contested", ["a", "b"]), "two": ("identified", ["c"])}


def test_files_that_cannot_be_read_say_why(spark, assets):
    rows = bench.read_sources(spark, assets / "sources").collect()
    assert {r["name"] for r in rows} == {"one.pdf", "two.pdf"} and all(r["unreadable"] and len(r["sha256"]) == 64 for r in rows)
