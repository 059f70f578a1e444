"""Matching operators against brute force on small tables."""

import random
import re
from collections import Counter

import numpy as np

from lectern.llm import canonical, components, names, neardup, neighbours

# --- p3 ---


def _near_copies(seed=5):
    rng = random.Random(seed)
    words = [a + b for a in "ka lo mi nu pe ra si to".split() for b in "ban den fil gor hus".split()]
    rows = []
    for i in range(150):
        base = [rng.choice(words) for _ in range(60)]
        rows.append((f"o{i:04d}a", "t", " ".join(base), "s"))
        edited = base[:]
        for _ in range(rng.randint(0, 8)):
            edited[rng.randrange(60)] = rng.choice(words)
        if i % 3 == 0:
            edited = edited[30:] + edited[:30]
        rows.append((f"o{i:04d}b", "t", " ".join(edited), None if i % 5 == 0 else "s"))
    rows += [rows[0], ("x1", "t", rows[0][2], "s"), ("n1", None, None, None), ("n2", "", "", ""), ("short1", "t", "one two", None), ("short2", "t", "two one", None)]
    return rows


def test_pairs_equal_brute_force(spark):
    rows = _near_copies()
    df = spark.createDataFrame([(*r, 1) for r in rows], "object_id string, title string, content string, summary string, cid int")
    got = [tuple(r)[:2] for r in neardup.pairs(df, "object_id", ["title", "content", "summary"], 0.75).collect()]
    bags = {r[0]: Counter(re.findall(r"[^\W_]+", " ".join(x or "" for x in r[1:]).lower())) for r in rows}
    ids = sorted(bags)
    true = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if bags[a] and sum((bags[a] & bags[b]).values()) >= 0.75 * sum((bags[a] | bags[b]).values())}
    assert len(got) == len(set(got)) and set(got) <= true
    assert len(set(got)) >= 0.97 * len(true) and ("short1", "short2") in got
    assert neardup.pairs(df.limit(0), "object_id", ["title"], 0.75).count() == 0


def test_a_large_group_of_near_copies_keeps_its_links(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(60):
        words = base[:]
        for at in (rng.randrange(3, 27), rng.randrange(33, 57), rng.randrange(63, 87)):
            words[at] = f"own{i}x{at}"
        rows.append((f"g{i:03d}", " ".join(words)))
    rows += [(f"o{i:03d}", " ".join(f"z{rng.randrange(4000)}" for _ in range(90))) for i in range(200)]
    df = spark.createDataFrame(rows, "object_id string, content string")
    got = {tuple(r)[:2] for r in neardup.pairs(df, "object_id", ["content"], 0.75).collect()}
    assert got == {(f"g{i:03d}", f"g{j:03d}") for i in range(60) for j in range(i + 1, 60)}


def test_banded_alignment_and_its_leftovers_make_up_the_common_words():
    rng = random.Random(1)
    a = [np.array([rng.randrange(12) for _ in range(rng.randint(1, 30))]) for _ in range(80)]
    b = [np.array([rng.randrange(12) for _ in range(rng.randint(1, 30))]) for _ in range(80)]

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for u in x:
            last, row = row, [0]
            for j, v in enumerate(y, 1):
                row.append(max(row[-1], last[j], last[j - 1] + (u == v)))
        return row[-1]

    wide, _, _ = neardup.aligned(a, b, band=40)
    assert wide.tolist() == [lcs(x, y) for x, y in zip(a, b)]
    common = neardup.common_words(a, b)
    assert common.tolist() == [sum((Counter(x.tolist()) & Counter(y.tolist())).values()) for x, y in zip(a, b)]
    for band in (0, 2, 8, 40):
        matches, over_a, over_b = neardup.aligned(a, b, band)
        assert [len(x) - len(o) for x, o in zip(a, over_a)] == matches.tolist() == [len(x) - len(o) for x, o in zip(b, over_b)]
        moved = neardup.common_words(over_a, over_b)
        assert (matches + moved).tolist() == common.tolist()
        # Without the alignment the leftovers alone are too few.
        assert (moved < common).any()


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 201 + i) for i in range(50)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}


# --- p4 ---


def _brute(points, k):
    ok = {i: np.array(v, dtype="f8") for i, v in points if i and v and len(v) == 8 and not any(x != x for x in v) and any(v)}
    out = {}
    for i, v in ok.items():
        sims = sorted((-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 6), j) for j, w in ok.items() if j != i)
        out[i] = [j for _, j in sims[:k]]
    return out


def test_neighbours_reach_the_recall_and_handle_bad_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    points = [(f"p{i:04d}", [float(x) for x in (centres[i % 12] + 0.3 * rng.normal(size=8)) * rng.uniform(0.5, 3)]) for i in range(600)]
    points += [("dup%02d" % i, points[0][1]) for i in range(14)] + [points[1]]
    points += [("null", None), ("empty", []), ("short", [1.0]), ("zero", [0.0] * 8), ("nan", [float("nan")] * 8)]
    df = spark.createDataFrame([(i, v, 3) for i, v in points], "point_id string, vector array<float>, node int")
    f32 = [(i, None if v is None else [float(np.float32(x)) for x in v]) for i, v in dict(points).items()]
    true = _brute(f32, 10)
    got = {}
    for r in neighbours.nearest(df, 10, size=8, shard=150).collect():
        got.setdefault(r["point_id"], []).append((r["rank"], r["neighbour_id"]))
    assert set(got) == set(true)
    assert all(len(v) == 10 and [n for n, _ in sorted(v)] == list(range(1, 11)) for v in got.values())
    recall = np.mean([len({j for _, j in got[i]} & set(true[i])) / 10 for i in true])
    assert recall >= 0.9, recall
    assert [j for _, j in sorted(got["dup00"])] == true["dup00"]
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_rescaled_copies_and_close_directions_go_by_id(spark):
    rng = np.random.default_rng(9)
    points = [(f"p{i:04d}", [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(200)]
    base = np.array(points[0][1])
    # Copies of other lengths, and directions so close that all cosines are 1 at six decimals.
    points += [(f"r{i:03d}", [float(np.float32(x)) for x in base * s]) for i, s in enumerate(rng.uniform(0.3, 3, 120))]
    other = np.array(points[1][1])
    points += [(f"s{i:03d}", [float(np.float32(x)) for x in other + 2e-4 * rng.normal(size=8)]) for i in range(120)]
    rng.shuffle(points)
    points = [(str(i), [float(x) for x in v]) for i, v in points]
    df = spark.createDataFrame(points, "point_id string, vector array<float>")
    true = _brute(points, 10)
    got = {}
    for r in neighbours.nearest(df, 10, size=8).collect():
        got.setdefault(r["point_id"], []).append((r["rank"], r["neighbour_id"]))
    close = [i for i in true if i[0] in "rs"]
    assert {i: [j for _, j in sorted(got[i])] for i in close} == {i: true[i] for i in close}
    assert np.mean([len({j for _, j in got[i]} & set(true[i])) / 10 for i in true]) >= 0.99


def test_pruning_keeps_nearest_and_drops_covered():
    data = neighbours.unit(np.array([[1, 0.0], [1, 0.1], [1, 0.11], [0.1, 1]], dtype="f4"))
    graph = neighbours.Graph(data, degree=3, beam=4)
    edges = graph.prune(np.array([0]), np.array([[1, 2, 3, -1]]))[0]
    assert edges[0] == 1 and 2 not in edges


# --- p6 ---


def test_typed_values_map_to_entries(spark, monkeypatch):
    reference = spark.createDataFrame(
        [(1, "type", "Decision Rule", ["Heuristic"]), (2, "type", "Practice", None), (3, "type", "Anti-pattern", ["Bad Practice"]), (4, "lang", "Italian", ["it", "Italiano"])],
        "canon_id int, field string, name string, aliases array<string>",
    )
    typed = ["decision rule", "DecisionRule", "Deci. Rule", "Rule, Decision", "heuristic!", "a Practice", "Pracitce", "bad practice", "anti_pattern", "Photograph", "see notes", "???", "", None, "Practice (draft)", "Practice"]
    df = spark.createDataFrame([(str(i), v, "z") for i, v in enumerate(typed)] * 2, "object_id string, type string, canon_id string")
    got = {r["value"]: r["canon_id"] for r in canonical.mapped(df, "object_id", "type", reference, "type").collect()}
    want = {"decision rule": 1, "DecisionRule": 1, "Deci. Rule": 1, "Rule, Decision": 1, "heuristic!": 1, "a Practice": 2, "Pracitce": 2, "bad practice": 3, "anti_pattern": 3, "Photograph": 0, "see notes": 0, "???": 0, "Practice (draft)": 2, "Practice": 2}
    assert got == want
    assert canonical.mapped(df.limit(0), "object_id", "type", reference, "type").count() == 0
    assert {r["canon_id"] for r in canonical.mapped(df, "object_id", "type", reference.limit(0), "type").collect()} == {0}
    # The same from a list in blocks, and from candidates that share a word as from all entries.
    monkeypatch.setattr(canonical, "BLOCK", 1)
    assert {r["value"]: r["canon_id"] for r in canonical.mapped(df, "object_id", "type", reference, "type").collect()} == want
    long = canonical.Matcher([(1, "Decision Rule", ["Heuristic"]), (2, "Practice", None)])
    assert long.match("rule " * 50_000) == 0 and long.match("x" * 100_000) == 0
    rng = random.Random(6)
    entries = [(i, " ".join("".join(rng.choices("abcde", k=rng.randint(2, 8))) for _ in range(rng.randint(1, 3))), None) for i in range(1, 60)]
    matcher, every = canonical.Matcher(entries), canonical.Matcher(entries)
    every._candidates = lambda words, bare: set(range(len(every.forms)))
    for _ in range(300):
        value = " ".join("".join(rng.choices("abcde", k=rng.randint(1, 8))) for _ in range(rng.randint(1, 3)))
        assert matcher.scores(value.split(), frozenset()) == every.scores(value.split(), frozenset())
    m = canonical.Matcher([(4, "Italian", ["it", "Italiano"])])
    assert m.match("it") == 4 and m.match("it depends on") == 0


def test_edit_distance_with_swaps():
    assert [canonical.edits(a, b, 2) for a, b in (("abcd", "abdc"), ("abc", "abc"), ("abc", "xyz"), ("abcd", "ac"))] == [1, 0, 3, 2]


# --- p7 ---


def test_spellings_of_one_author_are_linked(spark):
    one = ["Cosmo Droovovwick", "COSMO DROOVOVWICK", "Droovovwick, Cosmo R.", "Dr. Cosmo Droovovwick", "C.R. Droovovwick", "Droovovwick CR", "Csomo Droovovwick", "Cosmo Droovowick", "by Cosmo Droovóvwick"]
    two = ["Priya Droovovwick", "P. Droovovwick", "Priya “Pip” Droovovwick", "Pip Droovovwick"]
    org = ["Zanar Software Consortium", "Consortium of Software, Zanar", "The Zanar Software Consortium, Inc.", "Zanar Software Cons."]
    none = ["Anonymous", "n/a", "-", "", "various authors", None]
    groups = [one * 3, two * 3, org * 3, none * 2]
    rows = [(f"b{i:03d}", a, "e") for i, a in enumerate(x for g in groups for x in g)]
    df = spark.createDataFrame(rows + rows[:3], "book_id string, author string, entity string")
    links = names.linked(df, "book_id", "author")
    by = {}
    for r in links.collect():
        by.setdefault(r["entity"], set()).add(r["author"])
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, (set(one), set(two), set(org))))
    pairs = names.pairs(links, "book_id").collect()
    author = {b: a for b, a, _ in rows}
    assert all(r[0] < r[1] and author[r[0]] != author[r[1]] for r in pairs) and len(pairs) == len(set(map(tuple, pairs)))
    assert names.pairs(names.linked(df.limit(0), "book_id", "author"), "book_id").count() == 0


def test_initials_are_no_titles():
    assert names.read("Lanozelette JR")[1:3] == ("lanozelette", ["j", "r"]) and names.read("Dunuredino MS")[1:3] == ("dunuredino", ["m", "s"])
    assert names.read("Cosmo Droovovwick, PhD")[1:3] == ("droovovwick", ["cosmo"]) and names.read("Dr. Ann Lee (ed.)")[1:3] == ("lee", ["ann"])
    assert names.read("COSMO DROOVOVWICK")[1:3] == ("droovovwick", ["cosmo"]) and names.read("Bo LI")[1:3] == ("bo", ["l", "i"])


def test_alignment_permits_initials_and_refuses_clashes():
    assert names.align(["c", "r"], ["cosmo", "r"]) > 0 == names.align(["c", "x"], ["cosmo", "r"])
    assert names.one_edit("abcd", "abdc") and names.one_edit("abc", "abxc") and not names.one_edit("abc", "abc") and not names.one_edit("abcd", "badc")


def _brute_neighbours(points, k):
    ids = np.array([p for p, _ in points])
    rows = np.array([v for _, v in points], dtype="float64")
    rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    sims = np.round(rows @ rows.T, 6)
    np.fill_diagonal(sims, -9)
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in np.lexsort((ids, -sims[i]))[:k]}


def test_crowded_shards_get_pivots_of_their_own_or_are_cut_into_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    # One dense region of 26 close groups, beside scattered vectors.
    dense = rng.normal(size=64) * 3 + np.repeat(rng.normal(size=(26, 64)) * 0.3, 10, axis=0) + rng.normal(size=(260, 64)) * 0.03
    points = [(f"p{i:03d}", [float(np.float32(x)) for x in v]) for i, v in enumerate(np.concatenate([dense, rng.normal(size=(60, 64))]))]
    df = spark.createDataFrame(points, "point_id string, vector array<float>")
    truth = _brute_neighbours(points, 5)
    nodes = df.select("vector")
    pivots, parts = neighbours.fitted_shards(nodes, 20, 2)
    assert len(pivots) > 320 // 20 and (parts == 1).all()
    found = {tuple(r)[:2] for r in neighbours.nearest(df, 5, shard=20).collect()}
    assert len(found & truth) >= 0.8 * len(truth)
    # Pivots that cannot part a region: the shard is cut at random, and its parts answer every query.
    monkeypatch.setattr(neighbours, "fit_pivots", lambda sample, n, **_: sample[:1])
    pivots, parts = neighbours.fitted_shards(nodes, 20, 2)
    assert len(pivots) == 1 and parts.tolist() == [8]
    found = {tuple(r)[:2] for r in neighbours.nearest(df, 5, shard=20).collect()}
    assert len(found & truth) >= 0.99 * len(truth)


def test_assignment_equals_the_best_permutation():
    from itertools import permutations

    rng = random.Random(3)
    for _ in range(60):
        n, m = rng.randint(1, 4), rng.randint(4, 6)
        scores = [[rng.choice([-8.0, 0.8, 1.0]) - rng.random() / 10 for _ in range(m)] for _ in range(n)]
        chosen = names.assigned(scores)
        best = max(sum(scores[i][j] for i, j in enumerate(p)) for p in permutations(range(m), n))
        assert len(set(chosen)) == n and abs(sum(scores[i][j] for i, j in enumerate(chosen)) - best) < 1e-9
    assert names.align([f"w{i}" for i in range(9)], [f"w{i}" for i in range(9)]) == 1.0  # any number of words
    assert names.align(["r", "christoph."], ["christopher", "r"]) > 0 == names.align(["christoph"], ["christopher"])


def test_middle_names_reverse_order_and_abbreviations(spark):
    rows = ["John A. Smith", "Smith, John A.", "John B. Smith", "J. B. Smith", "Mary Smith", "M. Smith", "Smith Mary", "Ann Smith", "Mary Jones", "Ann Jones", "Mary Brown", "Ann Brown", "Ann Green"]
    rows += ["Christopher Jones", "Christoph. Jones", "Jones, Christoph.", "Christina Jones"]
    df = spark.createDataFrame([(f"b{i:02d}", a) for i, a in enumerate(rows)], "book_id string, author string")
    by = {}
    for r in names.linked(df, "book_id", "author").collect():
        by.setdefault(r["entity"], set()).add(r["author"])
    groups = sorted(sorted(g) for g in by.values() if len(g) > 1)
    assert groups == sorted(map(sorted, [
        {"John A. Smith", "Smith, John A."}, {"John B. Smith", "J. B. Smith"}, {"Mary Smith", "M. Smith", "Smith Mary"}, {"Christopher Jones", "Christoph. Jones", "Jones, Christoph."},
    ]))
