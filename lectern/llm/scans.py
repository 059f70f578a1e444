"""Repair of text from scanned pages.

Per document: running headers, footers and page numbers are found by their form and by likeness to the document's own
headings and to each other; the remaining lines of running text become one stream of characters in which words are
segmented jointly: a lattice offers each token as it stands, its one-edit and confusion neighbours in the lexicon, the
word that it forms with its neighbour (a split, at a blank or a line end, or a hyphen of a line break) and the two words that it may hold
(a merge); the path with the least cost under the corpus's word frequencies wins.  Dynamic programming over the line
gaps then chooses the paragraph boundaries.  Headings, lists, tables and code stay as they are.

The lexicon is counted over all documents; a word must make up a fixed share of all words, which bounds its size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A lexicon word's least share of all words (so at most 1 / SHARE words are sent to workers); LEAST is its floor in
#: small corpora, where a share is less than a few uses.
LEAST, SHARE = 4, 3e-6
#: Share of all words from which a word may be a part of a merged token.
OFTEN = 1.5e-5
#: Further cost of an error in a document that shows no other trace of a scanned page.
UNTOUCHED = 4.0
#: A form this much rarer than a word one edit away may be a misreading of it.
RARER = 0.02

# Signs that recognition takes for letters, and letters that it takes for each other.
SIGNS = {"1": "li", "0": "o", "@": "a", "!": "il", "|": "li", "$": "s", "5": "s", "3": "e", "8": "b", "6": "b", "9": "g", "4": "a", "7": "t", "€": "e", "(": "c", "+": "t"}
CONFUSED = (
    ("rn", "m"), ("m", "rn"), ("ii", "u"), ("u", "ii"), ("ri", "n"), ("n", "ri"), ("vv", "w"), ("w", "vv"), ("cl", "d"), ("d", "cl"), ("nn", "m"), ("m", "nn"), ("in", "m"), ("m", "in"),
    ("li", "h"), ("h", "li"), ("lh", "h"), ("fi", "h"), ("tl", "d"), ("il", "u"), ("u", "il"), ("iu", "m"), ("ll", "u"), ("rr", "n"), ("tn", "m"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"),
)
_HYPHENS = "-¬‐­‑"
_WORD = re.compile(r"(?<![\\{^_\w])(?:[^\W_]+(?:[@!|$€'’­-]+[^\W_]+)*|[@!$][^\W\d_]{2,})")
_ROMAN = r"(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,4})(?:xc|xl|l?x{0,4})(?:ix|iv|v?i{0,4})"
_NUMBER = rf"(?:\d{{1,4}}|{_ROMAN})"
_PAGE = re.compile(
    rf"(?i)^\W{{0,4}}(?:(?:page|pg|p|s|seite|pagina|página|стр)\.?\s*)?{_NUMBER}(?:\s*(?:of|/|von|de|sur|из)\s*{_NUMBER})?\W{{0,4}}$"
)
_EDGE = re.compile(rf"(?i)^\s*(?:(?:page|p)\.?\s*)?{_NUMBER}(?:\s*of\s*\d+)?\s*(?:[|–—·•:-]|\s{{2,}}|\t)\s*(?P<a>\S.*)$|^\s*(?P<b>.*\S)\s*(?:[|–—·•-]|\s{{2,}}|\t)\s*(?:(?:page|p)\.?\s*)?{_NUMBER}(?:\s*of\s*\d+)?\s*$")
_FENCE = re.compile(r"^[ ]{0,3}(```+|~~~+)")
_STRUCTURE = re.compile(r"^\s*(?:#{1,6}\s|[-*+•]\s+\S|\(?\d{1,3}[.)]\s+\S|\||>|\{\||!\s|:{3}|\[\^)")
_STOP = re.compile(r"[.!?:…][\"'”’»)\]*_]*\s*$")


_AS_LETTERS = str.maketrans({c: SIGNS[c][0] for c in "10@!|$"})
_SENTENCE = re.compile(r"[.!?:;\"“(]\W*$")
_PIECE = re.compile(r"[^-'’]+")


def _letters(line: str) -> str:
    """Letters of a line, lower-cased, with letter-spacing and marks gone and signs read as letters."""
    line = re.sub(r"^[\s_*#|]+|[\s_*#|]+$", "", line)
    return "".join(filter(str.isalpha, line.lower().translate(_AS_LETTERS)))


def _alike(a: str, b: str) -> bool:
    """Whether two headings agree up to a few misread letters."""
    if a == b:
        return True
    n = max(len(a), len(b))
    most = max(1, n // 8)
    if abs(len(a) - len(b)) > most or not n:
        return False
    ca, cb = Counter(a), Counter(b)
    if sum((ca - cb).values()) > most or sum((cb - ca).values()) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        if min(row) > most + 1:
            return False
    return row[-1] <= most + 1


def code_lines(lines: list[str]) -> list[bool]:
    """Which lines are fenced code, fences included."""
    out, fence = [], ""
    for line in lines:
        m = _FENCE.match(line)
        if fence:
            out.append(True)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip(" `~"):
                fence = ""
        else:
            fence = m[1] if m else ""
            out.append(bool(m))
    return out


def furniture(lines: list[str], code: list[bool]) -> list[bool]:
    """Which lines are running headers or footers or page numbers."""
    n = len(lines)
    headings = [_letters(x) for x, c in zip(lines, code, strict=True) if not c and re.match(r"\s*#{1,6}\s", x)]
    headings = [h for h in dict.fromkeys(headings) if len(h) > 5]
    joined = set(headings)
    out = [False] * n
    titles: list[tuple[int, str, bool]] = []
    for i, line in enumerate(lines):
        text = line.strip()
        if code[i] or not text or re.match(r"#{1,6}\s", text):
            continue
        if _PAGE.match(text) and not re.match(r"[-*+]\s*[a-z]{4,}$", text):
            out[i] = True
            continue
        if len(text) > 200 or (_STRUCTURE.match(line) and not re.match(r"\s*[|]", line)) and not _EDGE.match(text):
            continue
        edge = _EDGE.match(text)
        core = (edge["a"] or edge["b"]) if edge else text
        key = _letters(core)
        if len(key) < 6:
            continue
        titles.append((i, key, bool(edge)))
    counts = Counter(k for _, k, _ in titles)

    def heading(key: str) -> bool:
        if key in joined or any(_alike(key, h) for h in headings):
            return True
        # A title and a section together.
        for h in headings:
            if len(key) > len(h) + 5:
                if _alike(key[: len(h)], h) and any(_alike(key[len(h) :], g) for g in headings):
                    return True
        return False

    def spaced(line: str) -> bool:
        return bool(re.search(r"(?:\b\w\s+){5,}\w\b", line))

    known: dict[str, bool] = {}
    for i, key, edge in titles:
        text = lines[i].strip()
        prose = _STOP.search(text) and not edge
        if prose:
            continue
        near = any(0 <= j < n and out[j] for j in (i - 1, i + 1, i - 2, i + 2)) or edge or spaced(text) or text.isupper() or text[:1] in "_*" and text[-1:] in "_*"
        alone = (i == 0 or not lines[i - 1].strip()) and (i + 1 == n or not lines[i + 1].strip())
        if not (near or alone or counts[key] > 1):
            continue
        if key not in known:
            known[key] = heading(key)
        if known[key] or (counts[key] > 1 and near) or (near and edge and any(_alike(key, k) for k in counts if k != key and abs(len(k) - len(key)) < 4)):
            out[i] = True
    # A short line that follows a page number and neither goes on with the sentence nor ends one is a running header,
    # also where the heading itself is nowhere in the document.
    running = sorted(len(x.rstrip()) for i, x in enumerate(lines) if x.strip() and not code[i] and not out[i] and not _STRUCTURE.match(x))
    width = running[len(running) * 9 // 10] if running else 0
    for i in range(n):
        if not out[i] or not (_PAGE.match(lines[i].strip()) or _EDGE.match(lines[i].strip())):
            continue
        j = i + 1
        while j < n and (not lines[j].strip() or out[j]) and j <= i + 3:
            j += 1
        if j >= n or j > i + 3 or code[j] or out[j] or _STRUCTURE.match(lines[j]):
            continue
        text = lines[j].strip()
        if text[:1].islower() or _STOP.search(text) or text[-1:] in _HYPHENS or len(text.split()) < 2:
            continue
        k = j + 1
        while k < n and not lines[k].strip():
            k += 1
        if k < n and code[k]:
            continue
        # Two titles in one header may be as long as a line of prose.
        two = text.isupper() or " – " in text or (": " in text and not re.search("[,;]", text))
        h = i - 1
        while h >= 0 and (not lines[h].strip() or out[h]):
            h -= 1
        amid = k < n and h >= 0 and not code[h] and not _STOP.search(lines[h]) and k > j + 1 and lines[k].lstrip()[:1].islower()
        if (k < n and len(text) < 0.8 * width) or two or amid:
            out[j] = True
    return out


def _one_edit(a: str, b: str) -> bool:
    """Whether two different strings are one lost, added, replaced or swapped letter apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


class Lexicon:
    """Word frequencies of the corpus."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.total = max(1, sum(counts.values()))
        #: No form much longer than the longest word is a misreading of any.
        self.longest = 4 + max(map(len, counts), default=0)
        self.often = max(LEAST, OFTEN * self.total)
        self._shorter: dict[str, list[str]] | None = None
        self._neighbours: dict[str, tuple[str, float] | None] = {}
        self._doubtful: dict[str, bool] = {}

    def cost(self, word: str) -> float:
        return -math.log(self.counts[word] / self.total)

    def fits(self, form: str, word: str) -> bool:
        """Whether ``word`` is frequent enough beside ``form`` to be what was meant."""
        return self.counts.get(form, 0) <= RARER * self.counts.get(word, 0)

    def _variants(self, form: str) -> Iterator[tuple[str, float]]:
        """Forms that recognition may have had before it, with the cost of the error."""
        signs = [i for i, c in enumerate(form) if c in SIGNS]
        if signs and len(signs) <= 4:
            made = [form]
            for i in signs:
                made = [m[:i] + r + m[i + 1 :] for m in made for r in (*SIGNS[form[i]], form[i])]
            for m in made:
                if m != form:
                    yield m, 2.0
        yield from ((word, 3.0) for word in self._confused(form))
        yield from ((word, 5.0) for word in self._one_edit(form))

    @staticmethod
    def _confused(form: str) -> Iterator[str]:
        """The form with one group of letters replaced by one that recognition takes it for."""
        for a, b in CONFUSED:
            at = form.find(a)
            while at >= 0:
                yield form[:at] + b + form[at + len(a) :]
                at = form.find(a, at + 1)

    def _one_edit(self, form: str) -> Iterator[str]:
        """Lexicon words one lost, added, replaced or swapped letter away, in any alphabet.

        Both sides meet in their forms with one letter less; of those that share one, all are within two edits.
        """
        if self._shorter is None:
            self._shorter = {}
            for word in self.counts:
                if len(word) > 2:
                    for key in {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}:
                        self._shorter.setdefault(key, []).append(word)
        met = {word for key in {form, *(form[:i] + form[i + 1 :] for i in range(len(form)))} for word in self._shorter.get(key, ())}
        for word in sorted(met):
            if word != form and _one_edit(form, word):
                yield word

    def meant(self, form: str) -> tuple[str, float] | None:
        """The lexicon word that a misread form most likely was, and its cost; kept for later."""
        if form not in self._neighbours:
            if len(self._neighbours) > 200_000:
                self._neighbours.clear()
            best: tuple[str, float] | None = None
            tried = [(form, 0.0), *(self._variants(form) if len(form) <= self.longest else ())]
            if any(c in SIGNS for c in form):  # a sign beside another error
                tried += [(v, c + 3.0) for u, c in tried[1:] if c == 2.0 for v in self._confused(u)]
            for variant, price in tried[1:]:
                if variant in self.counts and len(variant) > 2 and self.fits(form, variant):
                    cost = self.cost(variant) + price
                    if best is None or cost < best[1]:
                        best = (variant, cost)
            self._neighbours[form] = best
        return self._neighbours[form]


    def cuts(self, form: str) -> Iterator[tuple[str, str, float]]:
        """The pairs of words that a form may have been merged from, with their cost."""
        for cut in range(1, len(form)) if 5 < len(form) <= 2 * self.longest else ():
            a, b = form[:cut], form[cut:]
            if min(len(a), len(b)) > (1 if a not in ("a",) else 0) and self.counts.get(a, 0) > self.often and self.counts.get(b, 0) > self.often:
                yield a, b, self.cost(a) + self.cost(b) + 3.0

    def union(self, a: str, b: str) -> str | None:
        """The word that two neighbours form, if it is far more frequent than the rarer of them."""
        both = a + b
        n = self.counts.get(both, 0)
        return both if n > LEAST and min(self.counts.get(a, 0), self.counts.get(b, 0)) <= max(1, RARER * 5 * n) else None

    def doubtful(self, form: str) -> bool:
        """Whether a form is no word of the lexicon or another reading of it costs less than the form itself."""
        if form not in self.counts:
            return True
        if form not in self._doubtful:
            own = self.cost(form)
            meant = self.meant(form) if len(form) > 2 else None
            self._doubtful[form] = bool(meant and meant[1] < own) or any(cost < own for _, _, cost in self.cuts(form))
        return self._doubtful[form]


def decode(tokens: list[str], lexicon: Lexicon, names: list[bool], joins: list[bool], prior: float = 0.0) -> list[tuple[int, int, str]]:
    """Least-cost segmentation of a run of tokens: (first, last + 1, words) of every repaired stretch.

    ``names`` marks tokens that may be names: capitalised ones, which are only repaired where they hold a sign or stand
    one confusion from a word.  ``joins`` marks tokens after which only white space comes before the next one;
    ``prior`` is added to the cost of every error.
    """
    n = len(tokens)
    low = [t.lower() for t in tokens]
    unknown = 16.0
    best = [0.0] + [math.inf] * n
    how: list[tuple[int, str]] = [(0, "")] * (n + 1)

    def offer(i: int, j: int, cost: float, words: str) -> None:
        if best[i] + cost < best[j]:
            best[j], how[j] = best[i] + cost, (i, words)

    for i in range(n):
        w = low[i]
        known = w in lexicon.counts
        offer(i, i + 1, min(lexicon.cost(w), unknown) if known else unknown + (0 if names[i] else 4), tokens[i])
        if lexicon.doubtful(w):
            meant = lexicon.meant(w) if len(w) > 2 and not w.isdigit() else None
            if meant and (not names[i] or any(c in SIGNS for c in w) or meant[1] < 14):
                offer(i, i + 1, meant[1] + prior, meant[0])
            if not names[i]:
                for a, b, cost in lexicon.cuts(w):
                    offer(i, i + 1, cost + prior, f"{a} {b}")
        both = lexicon.union(w, low[i + 1]) if i + 1 < n and joins[i] else None
        if both:
            offer(i, i + 2, lexicon.cost(both) + 4.0 + prior, both)
    out, j = [], n
    while j:
        i, words = how[j]
        if j - i > 1 or words != tokens[i]:
            out.append((i, j, words))
        j = i
    out.reverse()
    return out


def _is_break(lexicon: Lexicon, left: str, right: str, sign: str) -> bool:
    """Whether a hyphen at a line's end was put in by the break."""
    whole, kept = (left + right).lower(), f"{left}-{right}".lower()
    a, b = lexicon.counts.get(whole, 0), lexicon.counts.get(kept, 0)
    if a or b:
        return a > b
    if sign != "-":
        return True
    parts = [p for p in re.split("-", kept) if p]
    if all(p in lexicon.counts for p in parts):
        return False
    if lexicon.meant(whole):
        return True
    return not (lexicon.counts.get(left.split("-")[-1].lower(), 0) > lexicon.often and lexicon.counts.get(right.lower(), 0) > lexicon.often)


class Page:
    """One document, read line by line."""

    def __init__(self, text: str, lexicon: Lexicon):
        self.lines = text.split("\n")
        self.lexicon = lexicon
        self.code = code_lines(self.lines)
        self.furniture = furniture(self.lines, self.code)
        self.prose = [
            bool(x.strip()) and not c and not f for x, c, f in zip(self.lines, self.code, self.furniture, strict=True)
        ]
        self.hyphen: dict[int, tuple[str, str, int]] = {}
        self.repairs: dict[int, list[tuple[int, int, str]]] = {}
        self._hyphens()
        #: Lines whose first word belongs to the line before it.
        self.taken: dict[int, tuple[int, int]] = {}
        self._words()

    def _next(self, i: int) -> int | None:
        for j in range(i + 1, len(self.lines)):
            if self.prose[j]:
                return None if re.match(r"\s*#{1,6}\s", self.lines[j]) else j
            if self.code[j]:
                return None
        return None

    def _hyphens(self) -> None:
        for i, line in enumerate(self.lines):
            if not self.prose[i] or not line.rstrip().endswith(tuple(_HYPHENS)) or re.match(r"\s*#{1,6}\s", line):
                continue
            m = re.search(rf"([^\W_]+(?:[-'’@!|$][^\W_]+)*)([{_HYPHENS}])\s*$", line)
            j = self._next(i)
            if not m or j is None:
                continue
            right = re.match(r"\s*([^\W_]+(?:[-'’@!|$][^\W_]+)*)", self.lines[j])
            if right and (right[1][0].islower() or not right[1][0].isalpha() or m[1].isupper()) and _is_break(self.lexicon, m[1], right[1], m[2]):
                self.hyphen[i] = (m[1], right[1], j)

    def _words(self) -> None:
        skip_first = {j: right for _, (_, right, j) in self.hyphen.items()}
        lexicon = self.lexicon
        start = True
        # One stream over all lines; a line break may be a split as well as a blank may.
        flat: list[str] = []
        spans: list[tuple[int, int, int]] = []
        names: list[bool] = []
        for i, line in enumerate(self.lines):
            if not self.prose[i]:
                continue
            words = list(_WORD.finditer(line))
            if "[[" in line or "{{" in line:
                words = [m for m in words if "|" not in m.group()]
            # The two halves of a broken word are judged as one, at the line where it begins.
            if i in skip_first and words:
                words = words[1:]
            if i in self.hyphen and words:
                left, right, _ = self.hyphen[i]
                whole = (left + right).lower()
                if whole not in lexicon.counts and lexicon.meant(whole) and (left + right)[:1].islower():
                    self.repairs.setdefault(i, []).append((words[-1].start(), len(line), lexicon.meant(whole)[0]))
                words = words[:-1]
            for m in words:
                token, begin = m.group(), m.start()
                parts = [(0, token)] if token.lower() in lexicon.counts else [(p.start(), p.group()) for p in _PIECE.finditer(token)]
                first: bool | None = None
                for at, part in parts:
                    upper = part[:1].isupper()
                    if upper and first is None:  # only of a capitalised word it is asked whether a sentence begins there
                        first = start or (begin > 0 and bool(_SENTENCE.search(line, 0, begin)))
                    flat.append(part.replace("­", "") if "­" in part else part)
                    spans.append((i, begin + at, begin + at + len(part)))
                    names.append(upper and not first)
                start = False
            start = bool(_STOP.search(line))
        prior = 0.0 if self.hyphen or any(self.furniture) else UNTOUCHED
        # Only stretches around doubtful tokens, or around neighbours that form a word, have a choice.
        low = [f.lower() for f in flat]
        open_ = [lexicon.doubtful(w) for w in low]
        for k in range(1, len(low)):
            if lexicon.union(low[k - 1], low[k]) and self._joined(spans[k - 1], spans[k]):
                open_[k - 1] = open_[k] = True
        at = 0
        while at < len(flat):
            if not open_[at]:
                at += 1
                continue
            a, b = max(0, at - 1), min(len(flat), at + 2)
            while b < len(flat) and open_[b - 1]:
                b += 1
            joins = [k + 1 < len(spans) and self._joined(spans[k], spans[k + 1]) for k in range(a, b)]
            for x, y, fixed in decode(flat[a:b], lexicon, names[a:b], joins, prior):
                (i, begin, _), (j, _, end) = spans[a + x], spans[a + y - 1]
                if i == j:
                    self.repairs.setdefault(i, []).append((begin, end, fixed))
                else:
                    self.repairs.setdefault(i, []).append((begin, len(self.lines[i]), fixed))
                    self.taken[j] = spans[a + y - 1][1:]
            at = b

    def _joined(self, x: tuple[int, int, int], y: tuple[int, int, int]) -> bool:
        """Whether only white space, or a line break within a paragraph, is between two tokens."""
        (i, _, end), (j, begin, _) = x, y
        if i == j:
            return not self.lines[i][end:begin].strip()
        if self.lines[i][end:].strip() or self.lines[j][:begin].strip() or re.match(r"\s*#{1,6}\s", self.lines[i]) or self._next(i) != j:
            return False
        between = range(i + 1, j)
        return not between or any(self.furniture[k] for k in between)

    def found(self) -> list[tuple[int, str]]:
        """``(line number from 1, kind)`` of everything found."""
        out = [(i + 1, "furniture") for i, f in enumerate(self.furniture) if f]
        out += [(i + 1, "hyphen") for i in self.hyphen]
        out += [(i + 1, "misread") for i in self.repairs]
        return sorted(out)

    def text(self) -> str:
        """The repaired document: continuous paragraphs, with headings, lists, tables and code as they are."""
        fixed: list[str] = []
        for i, line in enumerate(self.lines):
            done: set[int] = set()
            for a, b, words in sorted(self.repairs.get(i, []), reverse=True):
                if a in done:
                    continue
                done.add(a)
                if i in self.taken and a == self.taken[i][0]:
                    continue
                line = line[:a] + (words[:1].upper() + words[1:] if line[a : a + 1].isupper() else words) + line[b:]
            if i in self.taken:
                line = line[self.taken[i][1] :].lstrip()
            fixed.append(line)
        for i, (_, right, j) in sorted(self.hyphen.items(), reverse=True):
            head = fixed[i].rstrip()
            if head.endswith(tuple(_HYPHENS)):
                head = head[:-1] + right
            fixed[i] = head
            fixed[j] = re.sub(rf"^\s*{re.escape(right)}", "", fixed[j], count=1).lstrip()
        return _paragraphs(fixed, self.code, self.furniture)


def _paragraphs(lines: list[str], code: list[bool], drop: list[bool]) -> str:
    """Join running lines into paragraphs; boundaries minimise the cost of all gaps together."""
    rows: list[tuple[str, bool, bool]] = []  # text, fixed as it is, blank line before
    blank = cut = False
    for line, c, f in zip(lines, code, drop, strict=True):
        if f:
            cut = True
            continue
        if not line.strip() and not c:
            blank = True
            continue
        rows.append((line, c or bool(_STRUCTURE.match(line)), blank and not cut or (blank and cut and bool(rows) and bool(_STOP.search(rows[-1][0])))))
        blank = cut = False
    width = max([len(t) for t, fixed, _ in rows if not fixed], default=0)
    # State: whether a paragraph begins at the row; a one-line paragraph in the middle costs.
    costs = []
    for k, (text, fixed, apart) in enumerate(rows):
        if k == 0 or fixed or rows[k - 1][1]:
            costs.append((0.0, 99.0))  # begins, continues
            continue
        before = rows[k - 1][0]
        stopped = bool(_STOP.search(before))
        begins = (0.0 if apart else 3.0) + (0.0 if stopped else 2.5) + (2.0 if text.lstrip()[:1].islower() else 0.0)
        goes_on = (5.0 if apart else 0.0) + (0.5 if stopped and len(before) < 0.7 * width else 0.0)
        costs.append((begins, goes_on))
    best_begin, best_on = 0.0, math.inf
    back: list[tuple[bool, bool]] = []
    for k, (b, o) in enumerate(costs):
        if k == 0:
            best_begin, best_on = b, math.inf
            back.append((True, True))
            continue
        lone = 0.3 if not rows[k - 1][1] else 0.0
        from_begin = best_begin + lone <= best_on
        back.append((from_begin, best_begin <= best_on))
        best_begin, best_on = min(best_begin + lone, best_on) + b, min(best_begin, best_on) + o
    begins = [True] * len(rows)
    state = best_begin <= best_on
    for k in range(len(rows) - 1, -1, -1):
        begins[k] = state
        state = back[k][0] if state else back[k][1]
    out: list[list[str]] = []
    for k, (text, fixed, apart) in enumerate(rows):
        if fixed and k and rows[k - 1][1] and not apart:
            out[-1] += ["\n", text]
        elif begins[k] or not out:
            out.append([text if fixed else text.strip()])
        else:
            # A hyphen that belongs to its word stays, without a blank after it.
            last = out[-1][-1]
            joined = last[-1:] in _HYPHENS and last[-2:-1].isalnum()
            out[-1] += ["" if joined and last else " ", text.strip()]
    return "\n\n".join("".join(parts) for parts in out)


def word_counts(documents: DataFrame, text: str) -> DataFrame:
    """``(word, n)``: lower-cased words of all documents, hyphenated ones also as a whole, outside fenced code.

    Words are counted within each batch before anything is exchanged.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*(?![-¬‐­‑]\s*$|[@!|$\d])", re.M).findall
        fenced = re.compile(r"(?ms)^[ ]{0,3}(```+|~~~+).*?^\1[ \t]*$")
        for pdf in batches:
            counts: Counter = Counter()
            for t in pdf["t"]:
                counts.update(word(fenced.sub("", t).lower()))
            for w, n in [(w, n) for w, n in counts.items() if "-" in w]:
                for part in w.split("-"):
                    counts[part] += n
            yield pd.DataFrame(list(counts.items()), columns=["word", "n"]).astype({"word": "str", "n": "int64"})

    texts = documents.where(F.col(text).isNotNull()).select(F.col(text).alias("t"))
    return texts.mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_of(documents: DataFrame, text: str = "markdown") -> dict[str, int]:
    """The corpus's frequent words; at most ``1 / SHARE`` of them by construction, the same at any size of the corpus."""
    from lectern.session import durable

    counts = durable(word_counts(documents, text), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = counts.where(F.col("n") >= max(LEAST, SHARE * total)).toPandas()
    return dict(zip(kept["word"], kept["n"].astype(int), strict=True))


def _pages(documents: DataFrame, key: str, text: str):
    shared = documents.sparkSession.sparkContext.broadcast(lexicon_of(documents, text))
    kept: dict[str, Lexicon] = {}

    def page(value: str) -> Page:
        if "x" not in kept:
            kept["x"] = Lexicon(shared.value)
        return Page(value, kept["x"])

    return page


def noise(documents: DataFrame, key: str = "parse_id", text: str = "markdown") -> DataFrame:
    """``(key, line_no, kind)``: lines with furniture, break hyphens or misread words; null texts have none.

    A record delivered twice counts once.
    """
    page = _pages(documents, key, text)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, what) for k, t in zip(pdf["k"], pdf["t"], strict=True) for n, what in page(t).found()]
            yield pd.DataFrame(rows, columns=[key, "line_no", "kind"]).astype({"line_no": "int64", "kind": "str"})

    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"`{key}` {kind}, line_no bigint, kind string").distinct()


def repaired(documents: DataFrame, key: str = "parse_id", text: str = "markdown") -> DataFrame:
    """``(key, text)`` once for every record: the repaired text; null stays null."""
    page = _pages(documents, key, text)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf["k"], "text": [page(t).text() if isinstance(t, str) else None for t in pdf["t"]]})

    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"`{key}` {kind}, text string").dropDuplicates([key])
