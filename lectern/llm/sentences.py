"""Sentence units of texts in any of the corpus's languages and scripts.

Layout comes first: blank lines end units, heading lines and list items are units of their own.  In what remains every
place where a sentence may end (after a terminator and the marks that close with it; in scripts without terminators at
every space) is an observation of a linear-chain model with the tags boundary and inside.  Its emission scores are log
odds of features, counted over all texts: the words that end and begin blocks are known to end and begin sentences.  So
a mark is worth how much more often it ends a block than it stands before a lower-case word, and what follows it how
much more often it begins a block than it follows a word; a word that often stands before a full stop and almost never
ends a block is an abbreviation; for unpunctuated scripts the letters around spaces are compared with those around the
ends of blocks, on text stripped of punctuation.  Whether a unit ends also depends on where the last one did: so few letters
since then speak against it, as much as first places of blocks with as few letters end a block more rarely than others.
Viterbi decoding gives the best sequence of tags.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import durable

#: Uses from which a word before a stop, or letters beside a space, are evidence, and their least share of all such
#: places: at most 1 / SHARE of each are sent to the workers.
LEAST, SHARE = {"word": 8, "end": 5, "start": 5, "quote": 0, "mark": 0, "follow": 0, "size": 0}, 1e-6
#: Log odds of a mark and of the kind of letter that follows it (u: upper case, l: lower case, d: digit, o: other) where
#: nothing is counted; they weigh as much as so many counts.
MARK, FOLLOW, PRIOR = {"…": 2.0, ".": 0.0}, {"u": 2.5, "l": -12.0, "d": 1.5, "o": 1.5}, 20
#: Log odds of the letters since the last boundary where nothing is counted, and from how many on they tell nothing.
SIZE, FAR = {"0": -6.0, "1": -3.0}, 4
#: Entries that a task holds before it hands them on.
HELD = 200_000

# Abbreviations that stand before a name, a number or a continuation in several languages; prior
# knowledge that the fitted counts correct.
ABBREVIATIONS = frozenset(
    "dr prof mr mrs ms st no nos fig figs sec ch chap pp p vs cf e.g i.e approx al vol ed eds eq ref jr sr gen col lt capt rev hon "
    "nr bzw z u vgl abb kap hr fr bd ggf ca d.h z.b u.a s sog evtl mme mlle m c.-à-d sect art chap éd env fig pág págs sra srta sr dra ej ee "
    "т г гл рис см стр им ул д проф акад π.χ βλ σελ κ κα αρ δηλ डॉ श्री पृ क्र د أ م ص".split()
)
_END = "?!。！？．…؟।॥។៕"
_CLOSE = "\"”’»›)\\]）」』】》〉'“"
_PUNCTUATED = (
    rf"(?=[.!?…؟।॥。！？｡;;])(?:(?P<cjk>[。！？｡]+[\"'”’»)\]）」』】》〉…]*)|(?P<dots>…+|\.\.\.+)[{_CLOSE}]*(?=\s|$)"
    rf"|(?P<mark>(?:[.!?؟।॥]|(?<=[Ͱ-Ͽἀ-῿][;;]))+)(?P<close>(?:[{_CLOSE}]|\s(?=[»›]))*)(?=\s|$|[぀-ヿ一-鿿])"
    rf"|(?P<greek>(?<=[Ͱ-Ͽἀ-῿])[;;])(?P<gclose>[{_CLOSE}]*)(?=\s|$)|(?P<thai>(?!)))"
)
_CANDIDATE = re.compile(_PUNCTUATED)
#: With the spaces of a script that has no terminators.
_CANDIDATE_THAI = re.compile(_PUNCTUATED.replace("|(?P<thai>(?!)))", r")|(?P<thai>(?<=[฀-๿])[ \n\u00a0]+(?=[฀-๿]))"))
_THAI = re.compile("[฀-๿]")
_OPENERS = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "«": "»", "„": "“", "“": "”", "《": "》", "【": "】"}
_QUOTE = re.compile(r"[()\[\]（）「」『』«»„“”《》【】\"]")
_HEAD = re.compile(r"[ \t]*#{1,6}[ \t]+\S")
_ITEM = re.compile(r"[ \t]*(?:[-*•·–+][ \t]+|\(\d{1,3}\)[ \t]*|\(?[a-z]\)[ \t]+)(?=\S)")
_NUMBERED = re.compile(r"[ \t]*(\d{1,3})[.)、．][ \t]*(?=\S)")
_CHAPTER = re.compile(r"\s*(?:บทที่|第\s*[\d一二三四五六七八九十百]+\s*[章节節回部]|अध्याय|الفصل|Κεφάλαιο|Глава|Chapter|Kapitel|Capítulo|Chapitre|Section|Part)\s*[\d一二三四五六七八九十]*")
_STOPPED = re.compile(rf"[.!?。！？…؟।॥;;][{_CLOSE}\s]*$")
_LEAD, _TRAIL, _MARKS = "\"“„«‘'([¿¡「『（-*#", "\"”’»›)]）」』】》〉'“", frozenset(".!?؟।॥;;…")
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
#: Letters and the vowel signs of scripts that write them as marks.
_LETTER = re.compile(r"[^\W\d_]|[ऀ-ॣॱ-෿ะ-ฺเ-๎]")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_ORDINAL_BEFORE = frozenset("am vom zum im beim der dem den des die das bis ab seit jeden jeder jedem 1 of".split()) - {"1", "of"}
_REPORT_NEXT = re.compile(r"[\s]*(?:[,，、;:—–-]|[と则則]|って|という)")


class Model:
    """Log odds of the features of a place where a sentence may end."""

    def __init__(
        self, ends: dict[str, float] | None = None, thai: tuple[dict[str, float], dict[str, float]] | None = None, zh_report: float = -4.0, marks: dict[str, float] | None = None,
        follow: dict[str, float] | None = None, sizes: dict[str, float] | None = None,
    ):
        self.marks, self.follow = marks or {}, FOLLOW | (follow or {})
        self.ends = ends or {}
        self.thai = thai or ({}, {})
        self.zh_report = zh_report
        #: What so many letters since the last boundary add to a place's log odds; more add nothing.
        sizes = SIZE | (sizes or {})
        self.sizes = tuple(sizes.get(str(n), 0.0) for n in range(1 + max((n for n in range(FAR) if sizes.get(str(n))), default=-1)))

    def mark(self, sign: str) -> float:
        return self.marks.get(sign, MARK.get(sign, 4.5))

    def stop_word(self, word: str) -> float:
        """How well a word with a full stop ends a sentence, before its successor is seen."""
        learned = self.ends.get(word)
        if learned is not None:
            return learned
        bare = word.rstrip(".").lower()
        if bare in ABBREVIATIONS:
            return -4.0
        if len(bare) == 1 and bare.isalpha() and bare.upper() != bare.lower():
            return -3.0
        return 2.0


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans between blank lines."""
    at = 0
    for m in _BLANK.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def pieces(text: str, start: int, end: int) -> Iterator[tuple[int, int, bool]]:
    """Spans of a block as (start, end, whole): heading lines and list items are whole, the rest is running text."""
    if start >= end:
        return
    if text.find("\n", start, end) < 0:
        line = text[start:end]
        bare = line.strip()
        whole = bool(_HEAD.match(line) or _ITEM.match(line))
        if not whole and bare and len(bare) < 100 and not _STOPPED.search(bare):
            whole = bool(_CHAPTER.match(bare)) or not re.search(r"[฀-๿぀-ヿ一-鿿]", bare)
        yield start, end, whole or bool(_NUMBERED.match(line))
        return
    at, since, item = start, start, False
    first = True
    while at < end:
        stop = text.find("\n", at, end)
        stop = end if stop < 0 else stop
        line = text[at:stop]
        numbered = _NUMBERED.match(line)
        whole = bool(_HEAD.match(line) or _ITEM.match(line)) or bool(numbered and (first or item))
        if whole:
            if since < at:
                yield since, at, False
            yield at, stop, True
            since = stop + 1
        item = whole and not _HEAD.match(line)
        first = False
        at = stop + 1
    if since < end:
        yield since, end, False


def _nested(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans between matching brackets or quotation marks, outermost only, in order."""
    found: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in _QUOTE.finditer(text, start, end):
        c = m.group()
        if stack and c == stack[-1][0]:
            _, at = stack.pop()
            if not stack:
                found.append((at, m.start()))
        elif c == '"':
            stack.append(('"', m.start()))
        elif c in _OPENERS:
            stack.append((_OPENERS[c], m.start()))
        elif any(c == closer for closer, _ in stack):
            while stack and stack[-1][0] != c:
                stack.pop()
            _, at = stack.pop()
            if not stack:
                found.append((at, m.start()))
    return found


def _kind(c: str) -> str:
    return "u" if c.isupper() or c.istitle() else "l" if c.islower() else "d" if c.isdigit() else "o"


def _word_before(text: str, at: int) -> str:
    """The characters from the last blank or opening mark up to ``at``."""
    words = text[max(0, at - 40) : at].split()
    if not words or text[at - 1].isspace():
        return ""
    return words[-1].lstrip("(«“„[「『（\"")


def score(model: Model, text: str, m: re.Match, start: int, end: int, nested: list[tuple[int, int]], opens: list[int]) -> float:
    """Log odds that a sentence ends at a candidate."""
    at, stop = m.start(), m.end()
    if stop >= end:
        return 9.0
    i = bisect_right(opens, at) - 1
    inside = i >= 0 and nested[i][0] < at <= nested[i][1]
    if inside and stop <= nested[i][1]:
        return -9.0
    kind = m.lastgroup
    if m["thai"] is not None:
        finals, initials = model.thai
        before = text[max(start, at - 4) : at]
        after = text[stop : stop + 4]
        return 2.0 + finals.get(before, 0.0) + initials.get(after, 0.0)
    nxt = stop
    while nxt < end and text[nxt].isspace():
        nxt += 1
    follow = text[nxt] if nxt < end else ""
    if not follow:
        return 9.0
    if m["cjk"] is not None:
        if inside:
            if _REPORT_NEXT.match(text, stop):
                return -9.0
            # A quotation or remark that closes here and goes on is part of a longer sentence, unless it opened one.
            opened = nested[i][0]
            if text[nested[i][1]] in "）)】":
                previous = text[opened - 1 : opened] if opened > start else ""
                return 6.0 if previous in _END and previous else -9.0
            return model.zh_report if follow not in "“「『‘" else 4.0
        return -9.0 if _REPORT_NEXT.match(text, stop) and text[stop - 1] in "」』”" else 6.0
    here = text[at]
    if follow in ",;:—–-，、" or follow == "—":
        return -9.0
    shown = follow
    j = nxt
    while shown in "\"“„«‘'([¿¡「『（" and j + 1 < end:
        j += 1
        if not text[j].isspace():
            shown = text[j]
    kind_after = _kind(shown)
    next_ = model.follow[kind_after]
    if m["dots"] is not None:
        return model.mark("…") + next_
    if here in "!?؟।॥;;" or m["greek"] is not None:
        return model.mark(here) + next_
    if m["close"]:
        return model.mark(here) + 1.5 + next_
    word = _word_before(text, at) + "."
    bare = word[:-1]
    if bare.isdigit() or (bare and bare[-1].isdigit()):
        if bare.isdigit() and len(bare) <= 4 and kind_after == "u":
            before = _word_before(text, at - len(bare) - 1).lower() if at - len(bare) - 1 > start else ""
            if before in _ORDINAL_BEFORE:
                return -4.0
        return model.mark(".") + 1.5 + next_
    s = model.stop_word(word)
    if kind_after == "o" and shown.isalpha() and word not in model.ends and len(bare) == 1:
        s = -4.0
    # A word's score is that before a letter without case.
    return model.mark(".") + s - FOLLOW["o"] + next_


def letters(text: str, start: int, end: int, far: int = FAR) -> int:
    """Letters of a span, up to ``far``; one that writes a syllable or a word counts twice."""
    n = 0
    for m in _LETTER.finditer(text, start, end):
        c = m.group()
        n += 2 if "⺀" <= c <= "\ud7ff" or c >= "\U00020000" else 1
        if n >= far:
            return far
    return n


def viterbi(emissions: list[float], gaps: list[int], sizes: tuple[float, ...]) -> list[bool]:
    """Best tags (boundary or not) of a chain of places, each with its own log odds and the letters since the one before.

    The state is the number of letters since the last boundary: ``sizes`` says what it adds to the log odds of the next,
    and from ``len(sizes)`` on it adds nothing.  The beginning is a boundary.
    """
    far = len(sizes)
    best = {0: 0.0}
    back: list[dict[int, tuple[int, bool]]] = []
    for e, gap in zip(emissions, gaps, strict=True):
        now: dict[int, float] = {}
        came: dict[int, tuple[int, bool]] = {}
        for state, total in best.items():
            n = min(state + gap, far)
            odds = e + sizes[n] if n < far else e
            # Logarithms of the shares of both tags, given the state.
            no = -math.log1p(math.exp(odds)) if odds < 0 else -odds - math.log1p(math.exp(-odds))
            for to, value, tag in ((n, total + no, False), (0, total + no + odds, True)):
                if to not in now or value > now[to]:
                    now[to], came[to] = value, (state, tag)
        best = now
        back.append(came)
    state = max(best, key=best.__getitem__)
    tags = []
    for came in reversed(back):
        state, tag = came[state]
        tags.append(tag)
    return tags[::-1]


def units(text: str | None, model: Model) -> list[tuple[int, int]]:
    """Spans of the sentence units of a text, in code points, without outer white space."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    candidates = (_CANDIDATE_THAI if _THAI.search(text) else _CANDIDATE).finditer

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    for begin, finish in blocks(text):
        for a, b, whole in pieces(text, begin, finish):
            if whole:
                add(a, b)
                continue
            found = list(candidates(text, a, b))
            # Marks that follow each other, as in French spacing, are one place.
            found = [m for k, m in enumerate(found) if k + 1 == len(found) or found[k + 1]["dots"] is not None or text[m.end() : found[k + 1].start()].strip()]
            if not found:
                add(a, b)
                continue
            nested = _nested(text, a, b)
            opens = [o for o, _ in nested]
            scores, gaps, last, far = [], [], a, len(model.sizes)
            for m in found:
                scores.append(score(model, text, m, a, b, nested, opens))
                gaps.append(letters(text, last, m.start(), far))
                last = m.end()
            if min(gaps) >= far:
                tags = [s > 0 for s in scores]  # each place stands alone
            else:
                tags = viterbi(scores, gaps, model.sizes)
            since = a
            for m, tag in zip(found, tags, strict=True):
                if tag:
                    add(since, m.end())
                    since = m.end()
            add(since, b)
    return out


def count(text: str, counts: dict[tuple[str, str], list[int]]) -> None:
    """Add a text's evidence to ``counts``: by family and key, all places, those at a block's edge, those before a
    lower-case word, and how often the word stands without its stop.

    ``word``: words with a full stop; ``end`` and ``start``: Thai letters before and after a space; ``quote``: Chinese
    quotations that close after a stop, within blocks and at their ends; ``mark``: marks within blocks and at their
    ends; ``follow``: kinds of letters that follow a word, and that begin blocks; ``size``: letters before the first place
    of a block, where it ends the block and where it surely ends nothing (the stop of an item's number, and marks before
    lower-case words but for stops of words, which are judged by the word).
    """

    def add(family: str, key: str, *more: int) -> None:
        row = counts.setdefault((family, key), [0, 0, 0, 0])
        for i, x in enumerate(more):
            row[i] += x

    inside: Counter = Counter()
    for begin, finish in blocks(text):
        block = text[begin:finish].strip()
        if not block:
            continue
        m = _CANDIDATE.search(block)
        if m:
            n, rest = letters(block, 0, m.start()), m.end()
            while rest < len(block) and block[rest].isspace():
                rest += 1
            if rest == len(block):
                add("size", str(n), 1, 1)
            elif (not n and _NUMBERED.match(block)) or (block[rest].islower() and not (m["mark"] == "." and block[m.start() - 1 : m.start()].isalpha())):
                add("size", str(n), 1, 0, 1)
        tokens = block.split()
        before = ""
        for token in tokens:
            first = token[0] if token[0].isalnum() else token.lstrip(_LEAD)[:1]
            if not before:
                add("follow", _kind(first), 0, 1)
            elif before[-1].isalnum():
                inside[_kind(first)] += 1
            else:
                sign = before.rstrip(_TRAIL)[-1:]
                if sign in _MARKS and sign:
                    lower = first.islower()
                    if sign not in ";;" or _GREEK.search(before):
                        add("mark", sign, 1, 0, lower)
            before = token
        sign = before.rstrip(_TRAIL)[-1:]
        if sign and sign in _MARKS and (sign not in ";;" or _GREEK.search(before)):
            add("mark", sign, 1, 1)
        for k, token in enumerate(tokens):
            if token[-1] == "." and 1 < len(token) <= 40 and token[-2] != "." and not token[:-1].isdigit():
                final = k + 1 == len(tokens) or not tokens[k + 1].strip("»”")
                add("word", token.lstrip("(«“„[「『（\""), 1, final, not final and tokens[k + 1][0].islower())
        for token, n in Counter(tokens).items():
            if token[-1].isalpha():
                add("word", token.lstrip("(«“„[「『（\"") + ".", 0, 0, 0, n)
        on = len(re.findall(r"[。！？]”(?=[一-鿿])", block))
        end = bool(re.search(r"[。！？]”$", block))
        if on or end:
            add("quote", "", on, end)
        if "฀" <= max(block[:1], block[-1:]) <= "๿" and "#" not in block:
            plain = re.sub(r"[^฀-๿\s\dA-Za-z]", "", block)
            if _ITEM.match(block) or _CHAPTER.match(block):
                continue
            add("end", plain[-4:], 0, 1)
            add("start", plain[:4], 0, 1)
            for m in re.finditer(r"(?<=[฀-๿]) (?=[฀-๿])", plain):
                add("end", plain[max(0, m.start() - 4) : m.start()], 1)
                add("start", plain[m.end() : m.end() + 4], 1)
    for kind, n in inside.items():
        add("follow", kind, n)


def model_of(counts: dict[tuple[str, str], list[int]], stops: int, final_stops: int) -> Model:
    """A model from evidence and the number of all stops and of those that end blocks."""
    share = (final_stops + 1) / (stops + 5)
    ends: dict[str, float] = {}
    thai: dict[str, dict[str, float]] = {"end": {}, "start": {}}
    quoted_on = quoted_end = 0
    marks, follow = _fitted_odds(counts, "mark", 2, MARK, 4.5), _fitted_odds(counts, "follow", 0, FOLLOW, 0.0)
    sizes = _fitted_odds(counts, "size", 2, SIZE, 0.0)
    # Against many letters, for which a place's own score stands; few of them never speak for a boundary.
    sizes = {n: min(0.0, odds - sizes.get(str(FAR), 0.0)) for n, odds in sizes.items()}
    for (family, key), (n, at_edge, lower, bare) in counts.items():
        if n < LEAST[family] or family in ("mark", "follow", "size"):
            continue
        if family == "word":
            # Smoothed share of block ends against the share of all stops.
            odds = math.log((at_edge + 0.5) / (n * share + 0.5))
            weight = min(1.0, n * share / 3)
            ends[key] = max(-4.0, min(3.0, 2.0 + odds * 1.6 * weight - 1.5 * (lower > 0.3 * n) * (at_edge == 0)))
            known = key.rstrip(".").lower() in ABBREVIATIONS
            if known and n * share < 4:
                ends[key] = -4.0
            elif not known and len(key) > 2 and bare >= n:
                # A word (an initial is none) that stands without a stop as often is no abbreviation, though it may end no
                # block.
                ends[key] = max(2.0, ends[key])
        elif family == "quote":
            quoted_on, quoted_end = n, at_edge
        else:
            thai[family][key] = max(-2.0, min(3.0, math.log((at_edge + 0.3) / (n * 0.2 + 0.3))))
    return Model(ends, (thai["end"], thai["start"]), 4.0 if quoted_end > quoted_on else -4.0, marks, follow, sizes)


def _fitted_odds(counts: dict[tuple[str, str], list[int]], family: str, against: int, prior: dict[str, float], other: float) -> dict[str, float]:
    """Log odds of standing at a block's edge against standing where no sentence ends, drawn towards the prior."""
    rows = {key: (row[1], row[against]) for (f, key), row in counts.items() if f == family}
    edges, insides = (sum(r[i] for r in rows.values()) for i in (0, 1))
    out = {}
    for key, (edge, inside) in rows.items():
        odds = math.log((edge + 0.5) / (edges + 1)) - math.log((inside + 0.5) / (insides + 1))
        n = edge + inside
        out[key] = (n * max(-12.0, min(6.0, odds)) + PRIOR * prior.get(key, other)) / (n + PRIOR)
    return out


def fit(texts: list[str]) -> Model:
    """A model from texts without labels: ends and beginnings of blocks stand for those of sentences."""
    counts: dict[tuple[str, str], list[int]] = {}
    for text in texts:
        count(text, counts)
    stops = [row for (family, _), row in counts.items() if family == "word"]
    return model_of(counts, sum(row[0] for row in stops), sum(row[1] for row in stops))


def fitted(documents: DataFrame, text: str = "text") -> Model:
    """The model of all texts; their evidence is summed up in each task before it is exchanged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[str, str], list[int]] = {}

        def rows() -> pd.DataFrame:
            table = pd.DataFrame([(*k, *map(int, v)) for k, v in counts.items()], columns=["family", "key", "n", "at_edge", "lower", "bare"])
            counts.clear()
            return table.astype({"family": "str", "key": "str", "n": "int64", "at_edge": "int64", "lower": "int64", "bare": "int64"})

        for pdf in batches:
            for t in pdf["t"]:
                count(t, counts)
            if len(counts) > HELD:
                yield rows()
        yield rows()

    texts = documents.where(F.col(text).isNotNull()).select(F.col(text).alias("t"))
    evidence = texts.mapInPandas(run, "family string, key string, n bigint, at_edge bigint, lower bigint, bare bigint").groupBy("family", "key")
    evidence = durable(evidence.agg(*[F.sum(c).alias(c) for c in ("n", "at_edge", "lower", "bare")]), "evidence")
    sums = {r["family"]: (r["n"], r["at_edge"]) for r in evidence.groupBy("family").agg(F.sum("n").alias("n"), F.sum("at_edge").alias("at_edge")).collect()}
    enough = F.lit(False)
    for family, least in LEAST.items():
        enough = enough | ((F.col("family") == family) & (F.col("n") >= max(least, SHARE * sums.get(family, (0, 0))[0])))
    kept = {(r["family"], r["key"]): [r["n"], r["at_edge"], r["lower"], r["bare"]] for r in evidence.where(enough).collect()}
    return model_of(kept, *sums.get("word", (0, 0)))


def split(documents: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """``(key, start_pos, end_pos)`` for every sentence unit of every text; null and blank texts have none.

    A pass that counts evidence, then one narrow pass over whole texts of any length; repeated rows give their units again.
    """
    model = model or fitted(documents, text)
    kind = documents.schema[key].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows, starts, ends = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for a, b in units(t, model):
                    rows.append(i)
                    starts.append(a)
                    ends.append(b)
            taken = batch.column(0).take(pa.array(np.array(rows, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([taken, pa.array(starts, type=pa.int64()), pa.array(ends, type=pa.int64())], names=[key, "start_pos", "end_pos"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, start_pos bigint, end_pos bigint")
