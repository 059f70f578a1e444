"""Text operators: exact round trips, hand-made cases, and the edge cases every operator must bear."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import markup, mixture, scans, sentences, tokens, truncation

VOCABULARY = tokens.vocabulary_path()


# --- p8 ---


def test_automaton_equals_the_public_encoder_and_decodes_back():
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(VOCABULARY)
    theirs.encode_special_tokens = True
    encode = tokens.encoder(VOCABULARY)
    automaton = tokens.load(VOCABULARY)
    random.seed(7)
    letters = "aaabeinrst  \n\t'\"0129éßжи中あ😀\u00a0\u3000\x1c½²Ⅷ_"
    texts = ["", " ", "<|endoftext|> is text", "don't  stop\n\n", "x" * 5000, " " * 3000] + [
        "".join(random.choice(letters) for _ in range(random.randint(1, 60))) for _ in range(1500)
    ]
    for text in texts:
        ids = encode(text)
        assert ids == theirs.encode(text, add_special_tokens=False).ids, repr(text)
        assert automaton.decode(ids).decode() == text


def test_merge_gadgets_on_a_tiny_vocabulary():
    base = {bytes([b]): b for b in b"ab"}
    merges = [(b"a", b"a"), (b"aa", b"a"), (b"a", b"b")]
    vocabulary = base | {u + v: 200 + i for i, (u, v) in enumerate(merges)}
    automaton = tokens.MergeAutomaton(vocabulary, merges)

    def plain(word):
        parts = [bytes([b]) for b in word]
        for u, v in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i : i + 2] = [u + v]
                i += 1
        return [vocabulary[p] for p in parts]

    for n in range(1, 9):
        for k in range(2**n):
            word = bytes(b"ab"[k >> i & 1] for i in range(n))
            assert automaton.encode(word) == plain(word), word


def test_ids_of_null_empty_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a b", None), (3, "a b", None), (None, "c", "z")], "doc_id bigint, text string, ids string")
    out = {(r["doc_id"], tuple(r["ids"])) for r in tokens.encode_texts(rows, "doc_id").collect()}
    assert (1, ()) in out and (2, ()) in out and len(out) == 4
    assert tokens.encode_texts(rows, "doc_id").count() == 5
    assert tokens.encode_texts(rows.limit(0), "doc_id").count() == 0


# --- p9 ---


@pytest.mark.parametrize("seed", range(20))
def test_sainte_lague_equals_serving_the_highest_quotient(seed):
    rng = random.Random(seed)
    w = [rng.choice([0, 0.1, 0.2, 0.2, 0.37, 1.5]) for _ in range(6)]
    caps = [rng.randint(0, 40) for _ in w]
    seats = rng.randint(0, 120)
    quota = [0] * len(w)
    for _ in range(seats):
        q = [(w[i] / (2 * quota[i] + 1) if quota[i] < caps[i] and w[i] > 0 else -1) for i in range(len(w))]
        if max(q, default=-1) < 0:
            break
        quota[q.index(max(q))] += 1
    got = mixture.sainte_lague(w, caps, seats)
    assert sum(got) == sum(quota)
    assert all(g <= c for g, c in zip(got, caps))
    # Ties between equal quotients may fall to either.
    assert sorted(zip(w, got)) == sorted(zip(w, quota)) or max(abs(a - b) for a, b in zip(got, quota)) <= 1


def test_mix_respects_caps_and_reports_shares(spark):
    docs = [(i, "big", 50) for i in range(400)] + [(1000 + i, "small", 50) for i in range(10)] + [(5000, None, 9), (5001, "untargeted", 9), (5002, "big", 0)]
    counted = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 4), ("small", 0.3, 3), ("absent", 0.2, 5), ("absent", 0.2, 5)], "source string, target_share double, max_repeats int")
    used, shares = mixture.mix(counted, targets, block=100)
    rows = used.collect()
    assert max(r["uses"] for r in rows if r["source"] == "small") == 3
    assert all(r["source"] in ("big", "small") for r in rows)
    by = {r["source"]: r for r in shares.collect()}
    assert set(by) == {"big", "small", "absent"} and by["absent"]["actual_share"] == 0.0
    assert abs(sum(r["actual_share"] for r in by.values()) - 1) < 1e-9
    again = mixture.mix(counted, targets, block=100)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    none, empty = mixture.mix(counted.limit(0), targets)
    assert none.count() == 0 and empty.count() == 3


# --- p5 ---


def test_cut_texts(spark):
    inside = [f"We start at Ch. {i} of the plan. It ends here. Then more follows in load." for i in range(60)]
    texts = [("a", "chapters", t) for t in inside] + [
        ("word", "chapters", "The plan ends in the midd"),
        ("mark", "chapters", "The plan ends in the midd…"),
        ("json", "llm_responses", '```json\n[{"type": "Smell", "title": "x"'),
        ("goodjson", "llm_responses", '```json\n[{"type": "Smell"}]\n```'),
        ("null", "llm_responses", "null"),
        ("abbrev", "chapters", "We start at Ch."),
        ("whole", "chapters", "We start here. It ends in load."),
        ("table", "chapters", "Text.\n\n| a | b |\n|---|---|\n| 1 | x |"),
        ("blank", "chapters", "  \n "),
        ("nil", "chapters", None),
        ("long", "chapters", "It goes on and on. " * 20000 + "and stops in the mi"),
    ]
    df = spark.createDataFrame([(t, k, "m", x) for k, t, x in texts], "tbl string, rec_id string, model string, text string")
    got = {r["rec_id"]: r["cut"] for r in truncation.judge(df.unionByName(df)).collect()}
    assert {k for k, v in got.items() if v} == {"word", "mark", "json", "abbrev", "long"}
    assert "blank" not in got and "nil" not in got
    assert truncation.judge(df.limit(0)).count() == 0
    rate = truncation.rates(truncation.judge(df)).collect()
    assert {r["tbl"] for r in rate} == {"chapters", "llm_responses"}


def test_ends_without_a_stop_are_judged_by_trigrams_and_items_by_their_words(spark):
    texts = [(f"a{i}", f"We look at the plan of the day {i} first. Then we look at the load. It all ends well.") for i in range(60)]
    texts += [(f"s{i}", f"A note on point {i} says little. Kindly yours the editors") for i in range(40)]
    texts += [
        ("item", "Two points:\n\n- we look at the load"),
        ("cutitem", "Two points:\n\n- we look at the"),
        ("fragment", "Two points:\n\n- we look at the loa"),
        ("note", "It ends well.\n\n[^1]: See what the load"),
        ("cutnote", "It ends well.\n\n[^1]: See what the"),
        ("bare", "Then we look at the"),
    ]
    df = spark.createDataFrame([(k, "chapters", "m", x) for k, x in texts], "rec_id string, tbl string, model string, text string")
    judged = lambda **kw: {r["rec_id"] for r in truncation.judge(df, **kw).where("cut").collect()}
    assert judged() == {"cutitem", "fragment", "cutnote", "bare"}
    # Without the evidence of the closing's trigram every text that ends in it would count as cut.
    assert judged(ending=1.0) == {"cutitem", "fragment", "cutnote", "bare"} | {f"s{i}" for i in range(40)}


# --- p2 ---


@pytest.mark.parametrize(
    "text, kind",
    [("a <b>bold</b> word", "tag"), ("R&amp;D", "entity"), ("see [[Page|it]]", "wikilink"), ("a {{term|stale}} word", "template"), ("== Head ==\ntext", "wikihead"),
     ("an '''old''' word", "quotes"), ("\\section{One} text", "texhead"), ("so $x_{i} \\le 2$ holds", "inline"), ("\\begin{quote}\nx\n\\end{quote}", "env"), ("5\\% of it", "texescape")],
)
def test_foreign_markup_is_found(text, kind):
    assert kind in markup.kinds(text, False)


@pytest.mark.parametrize(
    "text",
    ["A Map<String, Long> holds.", "Here a < b and b > c hold.", "Prices range from $40 to $60 per seat.", "Paths such as C:\\data\\new are rewritten.", "The set {x, y} is closed.",
     "a/b = 3 == c is checked", "Rate 2^10 (see [12]).", "It's the team's 'final' answer.", "R&D prefers C# and F#.", "```\n<div>\\textbf{x}</div>\n```", "", None],
)
def test_plain_signs_are_no_markup(text):
    assert markup.kinds(text, False) == []


def test_clean_text_keeps_structure():
    html = "<h2>Head</h2><p>One &amp; two</p><ul><li>first</li><li>second</li></ul><pre>x = 1</pre>"
    assert markup.clean(html, False)[1] == "## Head\n\nOne & two\n\n- first\n- second\n\n```\nx = 1\n```"
    assert markup.clean("a [link](#link-1) and **bold** `code`, $x^2$.", True)[1] == "a link and bold code, $x^2$."
    assert markup.clean("{|\n|-\n! a !! b\n|-\n| 1 || 2\n|}\nend", False)[1] == "| a | b |\n| 1 | 2 |\n\nend"
    assert markup.clean("\\emph{so \\textbf{deep}}\\footnote{note} ends", False)[1] == "so deep (note) ends"
    assert markup.clean(None, True) == ([], None)


def test_region_drops_furniture_of_tags_and_learns_weights():
    page = "<nav><a>x</a><a>y</a><a>z</a></nav>\n" + "plain words make up the text of this page and go on\n" + "<div><span></span><a></a></div>"
    a, b = markup.region(page, False)
    assert page[a:b].strip().startswith("plain") and page[a:b].strip().endswith("go on")
    spans = [(page.index("plain"), page.index("go on") + 5)]
    weights = markup.learn_weights([(page, spans)], False)
    assert weights["word"] > 0 > weights["tag"]


def test_labelled_pages_decide_what_is_markup():
    text = "a <b>bold</b> word and a \\emph{stressed} one"
    assert set(markup.kinds(text, False)) == {"tag", "command"}
    # Where the pages show tags as content, they are none.
    shown = [("see <b>it</b> and <i>this</i>", [(0, 28)])] * 9 + [("a \\emph{b} c", [(0, 2), (8, 11)])] * 9
    assert markup.kinds(text, False, markup.learn_weights(shown, False)) .count("tag") == 0
    marked = [(t, []) for t in ("if a < b", "x <y> z", "p > q")]
    plain = [("plain words go here and on and on", [(0, 33)])]
    assert markup.kinds("so a < b holds", False, markup.learn_weights(marked + plain, False)) == ["angle"]
    page, spans = markup.read_labels("see ⟦<b>⟧it⟦</b>⟧ now")
    assert page == "see <b>it</b> now" and [page[a:b] for a, b in spans] == ["see ", "it", " now"]
    long = "{{infobox\n" + "| field = some value\n" * 200 + "}}\nText."
    assert "template" in markup.kinds(long, False)


def test_cleaned_handles_edges(spark):
    df = spark.createDataFrame([(1, "a <b>c</b>", 9), (1, "a <b>c</b>", 9), (2, None, 8), (3, "", 7), (4, "<p>" + "word " * 200000 + "</p>", 6)], "id bigint, body string, kinds bigint")
    rows = {r["rec_id"]: r for r in markup.cleaned(df, "id", "body", True).collect()}
    assert len(rows) == 4 and rows["2"]["text"] is None and rows["3"]["text"] == "" and rows["1"]["text"] == "a c"
    assert {r["rec_id"] for r in markup.cleaned(df, "id", "body", True, True).collect()} == {"1", "4"}


# --- p10 ---


def _split(text, model=None):
    return [text[a:b] for a, b in sentences.units(text, model or sentences.Model())]


def test_sentence_units():
    assert _split("Dr. Smith saw it. See Fig. 3 for 2.5 more. Fine?! Yes… Then e.g. this one waits ... then ends.") == [
        "Dr. Smith saw it.", "See Fig. 3 for 2.5 more.", "Fine?!", "Yes…", "Then e.g. this one waits ... then ends.",
    ]
    assert _split('"Is it safe?" asks he. (It was not before!) and so on. “Keep it short.” Next one.') == [
        '"Is it safe?" asks he.', "(It was not before!) and so on.", "“Keep it short.”", "Next one.",
    ]
    assert _split("『まず測れ。次に直せ。』という掟は守る。「安全か。」と問う。終わる。") == ["『まず測れ。次に直せ。』という掟は守る。", "「安全か。」と問う。", "終わる。"]
    assert _split("यह पहला है। डॉ. राम आए। क्या यह ठीक है? हाँ।") == ["यह पहला है।", "डॉ. राम आए।", "क्या यह ठीक है?", "हाँ।"]
    assert _split("## A head. With stop\nOne line\nwraps here. Two.\n\n(1) An item. Whole.\n(2) Next item\n\nChapter 9. Schedule it") == [
        "## A head. With stop", "One line\nwraps here.", "Two.", "(1) An item. Whole.", "(2) Next item", "Chapter 9. Schedule it",
    ]


def test_units_cover_all_but_white_space():
    random.seed(3)
    alphabet = "ab C. !?\n\n  “”()«»。、」「ก ข\u00a0;:-1."
    for _ in range(400):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 120)))
        spans = sentences.units(text, sentences.Model())
        covered = set()
        for a, b in spans:
            assert a < b and not text[a].isspace() and not text[b - 1].isspace()
            assert covered.isdisjoint(range(a, b))
            covered |= set(range(a, b))
        assert all(c.isspace() or i in covered for i, c in enumerate(text))


def test_abbreviations_are_learned():
    texts = [f"We met Xyz. {i} at the end. All is well.\n\nIt was good." for i in range(300)]
    model = sentences.fit(texts)
    assert model.stop_word("Xyz.") < 0 < model.stop_word("well.")


def test_marks_and_what_follows_them_are_learned_from_all_texts():
    # A sign that stands before lower-case words and ends no block ends no sentence before a capital either.
    texts = [f"We ask Kelo! about plan {i} first. Then the plan grows." for i in range(300)]
    model = sentences.fit(texts)
    assert model.mark("!") < -2 < model.mark(".") and model.follow["l"] < -5 < 0 < model.follow["u"]
    text = "We ask Kelo! Later it grows. It ends."
    assert _split(text, model) == ["We ask Kelo! Later it grows.", "It ends."] and _split(text) == ["We ask Kelo!", "Later it grows.", "It ends."]
    # Where blocks begin with lower-case letters, such a letter begins a sentence.
    small = sentences.fit([f"so it goes in plan {i} here. then it ends!" for i in range(300)])
    assert small.follow["l"] > model.follow["l"] + 5


def test_a_boundary_depends_on_where_the_last_one_was():
    # Alone, each stop would end a unit; the number's does not right after a boundary, but does after an abbreviation.
    assert _split("It goes. 2. Then it ends here.") == ["It goes.", "2. Then it ends here."]
    assert _split("See Fig. 2. Then it ends here.") == ["See Fig. 2.", "Then it ends here."]
    assert _split("\xa0 1. No lock is safe.\n2. No cache is safe.") == ["1. No lock is safe.", "2. No cache is safe."]
    assert _split("Quoi ? ! Rien ne va.") == ["Quoi ? !", "Rien ne va."] and _split("好。不。走吧。") == ["好。", "不。", "走吧。"]
    # Without the sizes nothing depends on anything.
    flat = sentences.Model(sizes={str(n): 0.0 for n in range(sentences.FAR)})
    assert _split("It goes. 2. Then it ends here.", flat) == ["It goes.", "2.", "Then it ends here."]


def test_sizes_of_units_are_learned():
    items = [f"1. Plan {i} goes on\n2. It holds" for i in range(400)]
    model = sentences.fit([*items, *(f"The plan number {i} holds." for i in range(400))])
    assert model.sizes[0] < -5 and len(model.sizes) == 2
    short = sentences.fit(["Go!"] * 300 + [f"We ask the yard! about plan {i} first." for i in range(300)])
    assert len(short.sizes) == 2
    rare = sentences.fit(["We ask the yard!"] * 300 + [f"Yo! about plan {i} first." for i in range(300)])
    assert rare.sizes[2] < -5


def test_viterbi_against_all_tags():
    def best(emissions, gaps, sizes):
        def share(tags):
            total, n = 0.0, 0
            for e, gap, tag in zip(emissions, gaps, tags, strict=True):
                n += gap
                odds = e + (sizes[n] if n < len(sizes) else 0.0)
                total -= math.log1p(math.exp(-odds if tag else odds))
                n = 0 if tag else n
            return total

        return max(itertools.product([False, True], repeat=len(emissions)), key=share)

    random.seed(5)
    differ = 0
    for _ in range(300):
        n = random.randint(1, 8)
        emissions, gaps = [random.uniform(-4, 6) for _ in range(n)], [random.randint(0, 5) for _ in range(n)]
        tags = sentences.viterbi(emissions, gaps, (-6.0, -3.0, -1.0, -0.5))
        assert tuple(tags) == best(emissions, gaps, (-6.0, -3.0, -1.0, -0.5))
        differ += tags != [e > 0 for e in emissions]
    assert differ > 100
    assert sentences.viterbi([900.0, -900.0, 5.0], [9, 9, 9], (-6.0,)) == [True, False, True] and sentences.viterbi([], [], (-6.0,)) == []


def test_split_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "  ", 2), (3, "One. Two.", 3), (3, "One. Two.", 3)], "doc_id bigint, text string, start_pos int")
    assert sentences.split(df).count() == 4
    assert sentences.split(df.limit(0)).count() == 0


# --- p1 ---

_WORDS = "the buffered framework splits another handshake and a good debugger widens an explicit review while bad modules invalidate the approximate hotspot under load fault tolerant fault-tolerant".split()


def _lexicon():
    return scans.Lexicon({w: 400 for w in _WORDS})


def test_page_noise_is_found_and_repaired():
    page = scans.Page("# The good review\n\nThe buffered frame-\nwork splits an0ther hand-\n\nPage 3 of 9\n\nThe good review\n\nshake and a good debug ger\nwidens the fault-\ntolerant review under load.\n\n- 1 item\n\n```\n12\n```", _lexicon())
    assert page.found() == [(3, "hyphen"), (4, "hyphen"), (4, "misread"), (6, "furniture"), (8, "furniture"), (10, "misread")]
    assert page.text().split("\n\n")[1] == "The buffered framework splits another handshake and a good debugger widens the fault-tolerant review under load."
    assert "```\n12\n```" in page.text() and "Page 3" not in page.text()


def test_misread_words_of_any_alphabet_and_of_any_length():
    lexicon = scans.Lexicon({"система": 900, "работает": 800, "σύστημα": 700, "another": 900, "module": 500})
    assert lexicon.meant("систена")[0] == "система" and lexicon.meant("рабтает")[0] == "работает" and lexicon.meant("σύστμηα")[0] == "σύστημα"
    assert lexicon.meant("@n0thcr")[0] == "another"  # signs beside a confusion
    assert lexicon.meant("rnodule")[0] == "module" and lexicon.meant("x" * 50_000) is None and list(lexicon.cuts("y" * 50_000)) == []


def test_clean_documents_have_no_noise():
    page = scans.Page("# Head\n\nThe good debugger widens an explicit review.\n\n* the load\n", _lexicon())
    assert page.found() == []


def test_noise_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "Some text\n\n12\n\nmore text", "c"), (3, "Some text\n\n12\n\nmore text", "c")], "parse_id bigint, markdown string, kind string")
    assert [tuple(r) for r in scans.noise(df).collect()] == [(3, 3, "furniture")]
    assert {r["parse_id"]: r["text"] for r in scans.repaired(df).collect()}[1] is None
    assert scans.noise(df.limit(0)).count() == 0
    assert scans.noise(df).where(F.col("line_no") < 1).count() == 0


@pytest.mark.parametrize("scale", [1, 100])
def test_misreadings_are_found_at_any_size_of_the_corpus(scale):
    counts = {"the": 60_000, "cat": 900, "sat": 900, "another": 14_000, "anofher": 13, "scheduled": 900, "sched": 4, "uled": 4}
    lexicon = scans.Lexicon({w: n * scale for w, n in counts.items()})
    page = scans.Page("12\nthe cat sat anofher cat\nthe cat sat sched uled the cat", lexicon)
    assert page.found() == [(1, "furniture"), (2, "misread"), (3, "misread")]
    assert page.text().startswith("the cat sat another cat the cat sat scheduled the cat")


def test_evidence_is_counted_over_all_texts(spark):
    rows = [(i, "Nothing of note here.\n\nThe next one ends.") for i in range(7000)]
    # Rare among all texts, though each of them has it once.
    rows += [(7000 + i, "They met Xyz. Smith there.\n\nIt went well.") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = sentences.fitted(df)
    assert model.ends == sentences.fit([t for _, t in rows]).ends and "Xyz." in model.ends
    assert sentences.fitted(df.limit(0)).ends == {}


def test_a_word_that_also_stands_bare_is_no_abbreviation():
    texts = ["We like metrics more.\n\nThey read metrics. Then they go on.\n\nIt ends here."] * 40 + ["They met Xyz. Smith.\n\nIt ends here."] * 40
    model = sentences.fit(texts)
    assert model.ends["metrics."] >= 2.0 and model.ends["Xyz."] < 0


def test_every_line_is_decoded_over_line_ends_and_without_other_traces():
    page = scans.Page("The good debug\nger widens the explicit rcview\nunder load.\n\nThe reviev's load.", _lexicon())
    assert page.found() == [(1, "misread"), (2, "misread"), (5, "misread")]
    assert page.text() == "The good debugger widens the explicit review under load.\n\nThe review's load."
