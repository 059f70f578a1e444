"""Benchmark runs: ask, judge, score, compare and report."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import answers, scoring
from lectern.operators.truth import Truth
from lectern.plans import prompts
from lectern.plans.providers import Answer, LanguageModel
from lectern.session import durable

RUN = (
    "run_id string, corpus struct<snapshot:string,books:array<string>>, results array<struct<q:string,book:string,area:string,hits:array<struct<rank:int,book:string,loc:string,record_type:string>>>>, "
    "structure array<struct<book:string,detected:array<struct<title:string,kind:string,position:int>>>>, coverage array<struct<book:string,surfaced:array<string>>>, "
    "faithfulness array<struct<book:string,loc:string,supported:int,claims:int,note:string>>, "
    "cost struct<input_tokens:bigint,output_tokens:bigint,embedding_tokens:bigint,wall_seconds:double,"
    "per_stage:array<struct<stage:string,seconds:double,input_tokens:bigint,output_tokens:bigint,embedding_tokens:bigint>>>"
)
TOKENS = ("input_tokens", "output_tokens", "embedding_tokens")
ORDER = ("recall", "structure", "coverage", "faithfulness")


def judge_summary(llm: LanguageModel, summary: str, source: str) -> tuple[int, int, list[Answer]]:
    """Supported claims and all claims of a summary, and every answer that was billed; each may be asked for twice."""
    billed: list[Answer] = []

    def asked(prompt: str, stage: str, parse):
        for last in (False, True):
            billed.append(llm.complete(prompt, system=prompts.SYSTEM[stage]))
            try:
                return parse(billed[-1].text)
            except answers.AnswerError:
                if last:
                    raise
        raise AssertionError

    try:
        listed = asked(prompts.claim_prompt(summary), "claims", answers.claims)
        verdicts = [asked(prompts.verdict_prompt(c, source), "verdict", answers.verdict) for c in listed]
    except Exception as error:
        error.billed = billed
        raise
    return sum(verdicts), len(listed), billed


def judged(summaries: DataFrame, llm: Callable[[], LanguageModel]) -> DataFrame:
    """``(record_id, supported, claims, note, failed, input_tokens, output_tokens)``.

    A summary that can't be judged counts no claims and says why; what was asked for it is billed all the same.
    """

    def run(batches):
        import pandas as pd

        model = llm()
        for pdf in batches:
            rows = []
            for key, summary, source in zip(pdf["record_id"], pdf["summary"], pdf["source"], strict=True):
                supported = claims = 0
                note, failed = "", False
                try:
                    supported, claims, billed = judge_summary(model, summary, source)
                    note = "" if claims else "the judge found no claims to check"
                except Exception as error:  # noqa: BLE001 - named in the notes
                    note, failed, billed = f"the judge could not verify this summary ({type(error).__name__}: {error})", True, getattr(error, "billed", [])
                rows.append((key, supported, claims, note, failed, sum(a.input_tokens or 0 for a in billed), sum(a.output_tokens or 0 for a in billed)))
            yield pd.DataFrame(rows, columns=["record_id", "supported", "claims", "note", "failed", "input_tokens", "output_tokens"])

    schema = "record_id string, supported bigint, claims bigint, note string, failed boolean, input_tokens bigint, output_tokens bigint"
    return summaries.select("record_id", "summary", "source").mapInPandas(run, schema)


def number(value: object, where: str, cast=int):
    """A number of a run file: missing or blank is zero, a number in quotes one; anything else stops the read."""
    if value is None or value == "":
        return cast(0)
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise TypeError(f"{where} must be a number, not {type(value).__name__}")
    return cast(value)


def _items(value: object) -> list[dict]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def load_run(spark: SparkSession, path: str) -> DataFrame:
    """A run file as one typed row; items that are no objects are left out, a number that is none stops the read."""
    try:
        raw = json.loads(Path(path).read_text())
    except ValueError as error:
        raise ValueError(f"{path} is no JSON: {error}") from error
    if not isinstance(raw, dict):
        raise ValueError(f"{path} holds no object")
    n = lambda value, what, cast=int: number(value, f"{path}: {what}", cast)
    corpus, cost = raw.get("corpus") or {}, raw.get("cost")
    row = {
        "run_id": str(raw.get("run_id", "")),
        "corpus": {"snapshot": str(corpus.get("snapshot", "")), "books": [str(b) for b in corpus.get("books") or []]},
        "results": [{"q": r.get("q"), "book": r.get("book"), "area": r.get("area"), "hits": [{"rank": n(h.get("rank"), "rank"), "book": h.get("book"), "loc": h.get("loc"), "record_type": h.get("record_type")} for h in _items(r.get("hits"))]} for r in _items(raw.get("results"))],
        "structure": [{"book": b.get("book"), "detected": [{"title": d.get("title") or "", "kind": d.get("kind"), "position": n(d.get("position"), "position")} for d in _items(b.get("detected"))]} for b in _items(raw.get("structure"))],
        "coverage": [{"book": b.get("book"), "surfaced": [str(t) for t in b.get("surfaced") or []]} for b in _items(raw.get("coverage"))],
        "faithfulness": [{"book": f.get("book"), "loc": f.get("loc"), "supported": n(f.get("supported"), "supported"), "claims": n(f.get("claims"), "claims"), "note": f.get("note")} for f in _items(raw.get("faithfulness"))],
        "cost": None if not isinstance(cost, dict) else {
            **{k: n(cost.get(k), k) for k in TOKENS}, "wall_seconds": n(cost.get("wall_seconds"), "wall_seconds", float),
            "per_stage": [{"stage": str(s.get("stage", "")), "seconds": n(s.get("seconds"), "seconds", float), **{k: n(s.get(k), k) for k in TOKENS}} for s in _items(cost.get("per_stage"))],
        },
    }
    return spark.createDataFrame([row], RUN)


def save_run(run: dict, folder: Path, family: str, scope: str, out: Path | None = None) -> Path:
    """Write a run file under its time, family and scope; another file of that name is never overwritten."""
    base = f"{dt.datetime.now(dt.UTC):%Y-%m-%dT%H-%M-%SZ}-{family}-{scope}"
    path = out or folder / f"{base}.json"
    n = 2
    while out is None and path.exists():
        path, n = folder / f"{base}-{n}.json", n + 1
    path.parent.mkdir(parents=True, exist_ok=True)
    run["run_id"] = run.get("run_id") or (base if out else path.stem)
    path.write_text(json.dumps(run, indent=2, ensure_ascii=False))
    return path


def _recall(run: DataFrame, truth: Truth) -> tuple[DataFrame, DataFrame]:
    """Judged queries (query_id, kind, area, book, best_rank, attributed) and what was not judged, as (state, note)."""
    res = run.select(F.posexplode("results").alias("at", "r")).select("at", "r.*")
    live = truth.queries.where("not gated")
    wanted = truth.expects.where(~T.is_placeholder(F.col("loc"))).join(live.select("query_id", F.col("book").alias("owner")), "query_id").select("query_id", F.coalesce("book", "owner").alias("book"), "loc")
    some = wanted.select("query_id").distinct()
    place = scoring.chosen_results(live.join(some, "query_id", "left_semi"), res)
    hits = place.where("at IS NOT NULL").join(res, "at").select("query_id", F.explode("hits").alias("h")).select("query_id", "h.rank", "h.book", "h.loc")
    asked = wanted.join(place.where("at IS NOT NULL").select("query_id"), "query_id", "left_semi")
    key = F.concat_ws("\x1f", "book", "loc").alias("loc")
    verdicts = scoring.judge(asked.select("query_id", key), hits.select("query_id", "rank", key))
    facts = live.select("query_id", "kind", "area", "book")
    areas = asked.join(facts.where("book IS NULL").select("query_id"), "query_id", "left_semi")
    rows = verdicts.join(facts, "query_id").join(scoring.attribution(areas, hits).select("query_id", "attributed"), "query_id", "left")
    where = F.concat(F.when(F.col("book").isNotNull(), F.col("book")).otherwise(F.concat(F.lit("area "), "area")), F.lit(": "), "q")
    note = lambda df, state, why: df.select(F.lit(state).alias("state"), F.concat(where, F.lit(why)).alias("note"))
    notes = note(truth.queries.where("gated"), "skipped", " is gated; not scored")
    notes = notes.unionByName(note(live.join(some, "query_id", "left_anti"), "skipped", " expects placeholders alone"))
    return rows, notes.unionByName(note(live.join(place.where("at IS NULL"), "query_id", "left_semi"), "unasked", " was never asked"))


def notes(run: DataFrame, truth: Truth) -> DataFrame:
    """``(state, note)`` of everything that is not measured: skipped on purpose, or never asked by the run."""
    out = _recall(run, truth)[1]
    pairs = truth.index_pairs.where("not gated").groupBy("book").agg(F.count("*").alias("n"))
    out = out.unionByName(pairs.select(F.lit("unasked").alias("state"), F.concat("book", F.lit(": "), F.col("n").cast("string"), F.lit(" index terms are not asked")).alias("note")))
    known = truth.books.select(F.col("slug").alias("book"))
    for name in ("structure", "coverage"):
        strange = run.select(F.explode(f"{name}.book").alias("book")).join(known, "book", "left_anti")
        out = out.unionByName(strange.select(F.lit("skipped").alias("state"), F.concat(F.lit(f"{name}: "), "book", F.lit(" is not in the truth")).alias("note")))
    empty = run.select(F.explode("faithfulness").alias("f")).select("f.*").where("claims = 0")
    why = F.coalesce(F.nullif("note", F.lit("")), F.lit("had no claims to verify"))
    return out.unionByName(empty.select(F.lit("skipped").alias("state"), F.concat(F.lit("faithfulness: "), "book", F.lit("/"), "loc", F.lit(" "), why).alias("note")))


def slices(run: DataFrame, truth: Truth) -> DataFrame:
    """``(grp, value, mrr, hit_at_5, n)`` of recall by kind and area, and attribution as grp ``attribution``."""
    rows = durable(_recall(run, truth)[0], "judged")
    told = rows.where("attributed IS NOT NULL").agg(F.avg("attributed").alias("mrr"), F.count("*").alias("n")).where("n > 0")
    return scoring.recall(rows, "kind", "area").unionByName(told.select(F.lit("attribution").alias("grp"), F.lit("").alias("value"), F.round("mrr", 9).alias("mrr"), F.lit(None).cast("double").alias("hit_at_5"), "n"))


def score(run: DataFrame, truth: Truth) -> DataFrame:
    """``(dimension, score, n)`` of a run, by which variants are compared: a dimension without anything to judge is
    absent, not 0."""
    verdicts = _recall(run, truth)[0]
    recall = verdicts.agg(F.lit("recall").alias("dimension"), F.avg(F.coalesce(1 / F.col("best_rank"), F.lit(0.0))).alias("score"), F.count("*").alias("n"))
    known = truth.books.select(F.col("slug").alias("book"))
    found = run.select(F.explode("structure").alias("s")).select("s.book", F.explode_outer("s.detected").alias("d")).join(known, "book", "left_semi")
    told = found.where("d IS NOT NULL").select("book", "d.kind", T.normalise_title(F.col("d.title")).alias("norm"))
    wanted = truth.nodes.join(found.select("book").distinct(), "book", "left_semi").select("book", "kind", T.normalise_title(F.col("title")).alias("norm"))
    prf = scoring.structure_scores(wanted, told, "book").where("book is null")
    struct = prf.select(F.lit("structure").alias("dimension"), F.col("f1").alias("score"), F.col("expected").alias("n"))
    shown = run.select(F.explode("coverage").alias("c")).select("c.book", F.explode("c.surfaced").alias("t")).select("book", T.normalise_title(F.col("t")).alias("norm"))
    concepts = truth.concepts.join(run.select(F.explode("coverage.book").alias("book")), "book", "left_semi").select("book", "concept_id", F.transform("names", T.normalise_title).alias("names"))
    cover = scoring.coverage(concepts, shown, "book").where("book is null").select(F.lit("coverage").alias("dimension"), F.col("recall").alias("score"), F.col("total").alias("n"))
    faith = scoring.faithfulness(run.select(F.explode("faithfulness").alias("f")).select("f.*"))
    faith = faith.select(F.lit("faithfulness").alias("dimension"), F.col("mean_support").alias("score"), F.col("judged").alias("n"))
    return recall.unionByName(struct).unionByName(cover).unionByName(faith).where("n > 0").withColumn("score", F.round("score", 9))


def summary(run: DataFrame, truth: Truth) -> dict:
    """All that a report says of a run, as plain values."""
    head = run.select("run_id", "corpus", "cost", F.filter("faithfulness", lambda f: (f["claims"] > 0) & (f["supported"] < scoring.PASS_BAR * f["claims"])).alias("below")).first().asDict(recursive=True)
    listed = [r.asDict() for r in notes(run, truth).orderBy("state", "note").collect()]
    return head | {
        "pooled": {r["dimension"]: r["score"] for r in score(run, truth).collect()},
        "slices": {(r["grp"], r["value"]): r.asDict() for r in slices(run, truth).collect()},
        "skipped": [x["note"] for x in listed if x["state"] == "skipped"], "unasked": [x["note"] for x in listed if x["state"] == "unasked"],
    }


def page(base: dict, candidate: dict) -> str:
    """The comparison of two runs' summaries as Markdown: answer, pooled figures, where they moved, cost, what is missing."""
    cell = lambda v: "—" if v is None else f"{v:.3f}"
    known = set(base["pooled"]) & set(candidate["pooled"])
    order = [*ORDER, *sorted(set(scoring.THRESHOLDS) - set(ORDER))]
    delta = {d: candidate["pooled"][d] - base["pooled"][d] for d in known}
    fell = [d for d in order if d in known and -round(delta[d], 9) > scoring.THRESHOLDS[d]]
    out = ["# Two runs compared", "", *[f"- {side}: `{r['run_id']}` on `{r['corpus']['snapshot']}`" for side, r in (("base", base), ("candidate", candidate))], ""]
    out += [f"**Regression** in {', '.join(fell)}." if fell else "**No regression.**", ""]
    apart = [d for d in order if (d in base["pooled"]) != (d in candidate["pooled"])]
    out += [f"Not comparable, as only one run has it: {', '.join(apart)}.", ""] if apart else []
    out += ["| dimension | base | candidate | change | may fall | verdict |", "|---|---|---|---|---|---|"]
    for d in order:
        if d in base["pooled"] or d in candidate["pooled"]:
            verdict = "not comparable" if d not in known else "**regression**" if d in fell else "ok"
            change = f"{delta[d]:+.3f}" if d in known else "—"
            out.append(f"| {d} | {cell(base['pooled'].get(d))} | {cell(candidate['pooled'].get(d))} | {change} | {scoring.THRESHOLDS[d]:.2f} | {verdict} |")
    for grp in ("kind", "area", "attribution"):
        values = sorted({v for r in (base, candidate) for g, v in r["slices"] if g == grp})
        if values:
            out += ["", f"## Recall by {grp}" if grp != "attribution" else "## Right book among the first hits", "", "| slice | base | candidate | base hit@5 | candidate hit@5 | n |", "|---|---|---|---|---|---|"]
        for v in values:
            a, b = base["slices"].get((grp, v)) or {}, candidate["slices"].get((grp, v)) or {}
            out.append(f"| {v or 'all'} | {cell(a.get('mrr'))} | {cell(b.get('mrr'))} | {cell(a.get('hit_at_5'))} | {cell(b.get('hit_at_5'))} | {(b or a)['n']} |")
    if candidate["below"]:
        out += ["", "## Summaries below the bar", "", *[f"- {f['book']} {f['loc']}: {f['supported'] / f['claims']:.2f}" for f in candidate["below"]]]
    if base["cost"] or candidate["cost"]:
        raw = lambda cost, k: "—" if not cost else f"{cost[k]:,.1f}" if isinstance(cost[k], float) else f"{cost[k]:,}"
        out += ["", "## Cost, never scored", "", "| measure | base | candidate |", "|---|---|---|"]
        out += [f"| {k} | {raw(base['cost'], k)} | {raw(candidate['cost'], k)} |" for k in (*TOKENS, "wall_seconds")]
        sides = [{s["stage"]: s for s in (r["cost"] or {}).get("per_stage") or []} for r in (base, candidate)]  # the last of a name counts
        names = list(dict.fromkeys([*sides[0], *sides[1]]))
        if names:
            out += ["", "| stage | base s | candidate s | base tokens | candidate tokens |", "|---|---|---|---|---|"]
        for n in names:
            own = [side.get(n) for side in sides]
            seconds = ["—" if s is None else f"{s['seconds']:.2f}" for s in own]
            tokens = ["—" if s is None else f"{sum(s[k] for k in TOKENS):,}" for s in own]
            out.append(f"| {n} | {' | '.join(seconds)} | {' | '.join(tokens)} |")
    for state, title in (("skipped", "Skipped"), ("unasked", "In the truth, never asked")):
        both = list(dict.fromkeys([*base[state], *candidate[state]]))
        out += ["", f"## {title}", "", *[f"- {x}" for x in both]] if both else []
    return "\n".join(out) + "\n"


def report(changes: list[dict], title: str = "Comparison") -> str:
    """A Markdown page of compared dimensions in their fixed order."""
    cell = lambda v: "—" if v is None else f"{v:.3f}"
    rank = {d: i for i, d in enumerate(ORDER)}
    lines = [f"# {title}", "", "| dimension | base | candidate | change | verdict |", "|---|---|---|---|---|"]
    for c in sorted(changes, key=lambda c: (rank.get(c["dimension"], len(rank)), c["dimension"])):
        delta = "—" if c["delta"] is None else f"{c['delta']:+.3f}"
        lines.append(f"| {c['dimension']} | {cell(c['base'])} | {cell(c['candidate'])} | {delta} | {c['verdict']} |")
    return "\n".join(lines) + "\n"
