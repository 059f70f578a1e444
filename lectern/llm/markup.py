"""Foreign markup in documents: finding it, and turning documents into clean text.

A scanner cuts a document into words, breaks, elements of HTML, wiki, LaTeX and (where it is foreign) Markdown, and signs
that only look like them.  Every element scores: a word positive, a tag negative, by log odds learned from labelled
pages (``LABELLED``), in which the markup is set between brackets.  One linear scan finds the contiguous span with the
highest sum (Ruzzo and Tompa's maximum-scoring subsequence), twice:

* over the negated scores, in which markup is positive and words are negative: a document holds markup if and only if
  its best span has a positive sum; what the labelled pages show as content (comparisons, prices, generic types, paths,
  a mark of emphasis without partner) never makes one;
* over the scores of a document with markup: what lies before and behind its best span is page furniture and goes.

The span is written out as clean text that keeps headings, lists, code and formulas.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The element names of HTML that count as markup, so that a generic type or a comparison does not.
HTML_NAMES = (
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt "
    "em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark "
    "math meta nav noscript ol option p param picture pre q s samp script section select small source span strike strong style sub "
    "summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video wbr"
).split()
BLOCK = frozenset(
    "address article aside blockquote body center dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav "
    "ol p pre section table tbody td tfoot th thead title tr ul".split()
)
DROPPED = ("script", "style", "noscript", "head", "svg", "template")
# LaTeX commands that take no braces and still are commands; other backslash words are plain paths.
BARE_COMMANDS = (
    "item noindent newline newpage clearpage pagebreak hline centering maketitle tableofcontents par bigskip medskip smallskip "
    "ldots dots LaTeX TeX quad qquad it bf em tt sl sc rm sf small large Large tiny"
).split()

_NAME = "|".join(sorted(HTML_NAMES, key=len, reverse=True))
_FENCE = r"(?m:^[ ]{0,3}(?P<fence>```+|~~~+)[^\n]*\n(?s:.*?)(?:^[ ]{0,3}(?P=fence)[ \t]*$|\Z))"
_SHARED = [
    ("code", _FENCE),
    ("comment", r"(?s:<!--.*?-->)|<!DOCTYPE[^>]*>"),
    ("dropped", rf"(?is:<(?P<drop>{'|'.join(DROPPED)})\b[^>]*>.*?</(?P=drop)\s*>)"),
    ("pre", r"(?is:<pre\b[^>]*>.*?</pre\s*>)"),
    ("tag", rf"(?i:</?(?:{_NAME})(?:\s+[a-z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=]+))?)*\s*/?>)"),
    ("entity", r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});"),
    ("math", r"(?s:\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\))"),
    ("mathenv", r"(?s:\\begin\{(?P<env>equation|align|gather|displaymath|math|eqnarray|multline)(?P<star>\*?)\}.+?\\end\{(?P=env)\*?\})"),
    ("verbatim", r"(?s:\\begin\{(?P<verb>verbatim|lstlisting|minted)\}.*?\\end\{(?P=verb)\})"),
    ("inline", r"(?<![\\$\w])\$(?=[^\s$])(?:[^$\n]*?[\\^_{=+<>][^$\n]*?|[A-Za-z])(?<![\s\\])\$(?![\w$])"),
    ("texhead", r"\\(?:sub)*(?:section|paragraph|chapter|part)\*?\{[^{}\n]*\}"),
    ("env", r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?"),
    ("texgroup", r"\{\\(?:it|bf|em|tt|sl|sc|rm|sf|small|large|Large|tiny|itshape|bfseries)\b[ ]?"),
    ("command", rf"\\(?:[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?=\{{)|(?:{'|'.join(BARE_COMMANDS)})(?![A-Za-z\\]))|\\verb(?P<bar>[|!+]).*?(?P=bar)"),
    ("texescape", r"\\[%&#_{}$](?![A-Za-z]:)|~(?=\\(?:cite|ref)\b)"),
    ("wikihead", r"(?m:^(?P<eq>={2,6})[ \t]*(?=[^=\s])[^\n]*?[^=\s][ \t]*(?P=eq)[ \t]*$)"),
    ("wikitable", r"(?sm:^\{\|.*?^\|\})"),
    ("template", r"(?s:\{\{(?!\{)[^{}]+\}\})"),
    ("wikilink", r"\[\[[^\[\]\n]+\]\]"),
    ("extlink", r"\[(?:https?|ftp)://[^\s\]]+(?:[ ][^\]\n]*)?\]"),
    ("quotes", r"'{2,5}(?=[^'\s])|(?<=[^'\s])'{2,5}"),
    ("wikiword", r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION|INDEX|NOINDEX)__"),
]
_MARKDOWN = [
    ("mdhead", r"(?m:^[ ]{0,3}#{1,6}[ \t]+(?=\S))"),
    ("mdtable", r"(?m:^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$)"),
    ("mdrule", r"(?m:^[ ]{0,3}(?:-{3,}|\*{3,}|_{3,}|={3,})[ \t]*$)"),
    ("mdlist", r"(?m:^[ \t]*(?:[-+*][ \t]+(?:\[[ xX]\][ \t]+)?|\d{1,3}[.)][ \t]+|[*#:;]{1,4}[ \t]+)(?=\S))"),
    ("mdquote", r"(?m:^[ ]{0,3}>[ \t]?)"),
    ("footnote", r"\[\^[^\]\s]+\]:?"),
    ("image", r"!\[[^\]\n]*\]\([^()\s]*(?:[ ]\"[^\"\n]*\")?\)"),
    ("link", r"\[[^\[\]\n]+\]\((?:#|/|\.|https?:|mailto:|[\w-]+[./#])?[^()\s]*(?:[ ]\"[^\"\n]*\")?\)|\[[^\[\]\n]+\]\[[^\[\]\n]*\]|<https?://[^>\s]+>"),
    ("strong", r"(?<![\w*])\*{1,3}(?=[^\s*])(?=[^*\n]*[^\s*]\*{1,3}(?![\w*]))|(?<=[^\s*])\*{1,3}(?![\w*])"),
    ("under", r"(?<![\w_])_{1,3}(?=[^\s_])(?=[^\n]*?[^\s_]_{1,3}(?!\w))|(?<=[^\s_])_{1,3}(?![\w])"),
    ("strike", r"~~(?=\S)|(?<=\S)~~"),
    ("codespan", r"(?P<tick>`{1,2})(?!`)[^\n]+?(?<!`)(?P=tick)(?!`)"),
]
# Signs that only look like markup; the labelled pages tell that they are content.
_ALIKE = [
    ("angle", r"</?[A-Za-z][^<>\s]*>|[<>]=?"),
    ("amp", r"&"),
    ("dollar", r"\$\d*"),
    ("backslash", r"\\[A-Za-z]*"),
    ("bracket", r"[\[{]{1,2}|[\]}]{1,2}"),
    ("sign", r"[*_~`#|=]+"),
]
_TEXT = [("break", r"\n[ \t]*\n\s*|\n"), ("word", r"[^\W_]+(?:['’_-][^\W_]+)*"), ("other", r"[ \t]+|(?s:.)")]


_FIRST = r"(?:(?=[<&\\${\[='_~`*#>|!])|(?m:^)(?=[ \t\-+:;\d`~]))"


def _scanner(kinds: list[tuple[str, str]], words: bool = False) -> re.Pattern:
    """One pattern over all kinds; without words it skips characters that begin no markup."""
    body = "|".join(f"(?P<k_{k}>{p})" for k, p in kinds + _ALIKE + (_TEXT if words else []))
    return re.compile(body if words else f"{_FIRST}(?:{body})")


FOREIGN, ANY = _scanner(_SHARED), _scanner(_SHARED + _MARKDOWN)
_FOREIGN_WORDS, _ANY_WORDS = _scanner(_SHARED, True), _scanner(_SHARED + _MARKDOWN, True)
#: A text that matches none of these holds no markup; the JVM leaves it out before any text goes to Python.
MAYBE_FOREIGN = r"[<&\\$]|\[\[|\{[{|]|''|\[(?:https?|ftp)://|__[A-Z]|(?m:^={2})"
MAYBE_ANY = MAYBE_FOREIGN + r"|[*_~`#>|]|\[\^|\]\(|\]\[|(?m:^[ \t]*(?:[-+*:;=]|\d{1,3}[.)]))"
_PAIRED = {"k_quotes", "k_strong", "k_under", "k_strike"}


def _elements(text: str, markdown: bool, words: bool) -> list[tuple[str, int, int]]:
    """Elements of a text as (kind, start, end); a mark of emphasis that meets no partner is just a ``sign``."""
    scanner = (_ANY_WORDS if markdown else _FOREIGN_WORDS) if words else (ANY if markdown else FOREIGN)
    found = [(m.lastgroup, m.start(), m.end()) for m in scanner.finditer(text) if m.lastgroup != "k_other"]
    names = [k for k, _, _ in found]
    alone = {k for k in _PAIRED if names.count(k) == 1}
    return [("sign" if k in alone else k[2:], a, b) for k, a, b in found]


def elements(text: str, markdown: bool) -> list[tuple[str, int, int]]:
    """Every element of a text as (kind, start, end), words and breaks included."""
    return _elements(text, markdown, True)


# --- weights from labelled pages ---------------------------------------------------------------------------------

# Labelled pages: what stands between the brackets is markup, all else is content.
LABELLED = (
    "The ⟦<b>⟧scheduler⟦</b>⟧ picks the next ⟦<i>⟧runnable⟦</i>⟧ task.⟦<br/>⟧ Others wait their turn.",
    "⟦<p>⟧A lock is held⟦</p>⟧ ⟦<ul>⟧⟦<li>⟧by one owner⟦</li>⟧⟦<li>⟧for a short time⟦</li>⟧⟦</ul>⟧",
    "Tea ⟦&amp;⟧ coffee cost less than 3⟦&nbsp;⟧euros⟦&hellip;⟧ ⟦<!-- check the price -->⟧",
    "⟦<style>p { margin: 0 }</style>⟧ Readers see only this. ⟦<pre>x = 1</pre>⟧ ⟦<script>run()</script>⟧",
    "⟦<!-- nav -->⟧ ⟦<div>⟧The index is rebuilt every night⟦&#8212;⟧or so we hope.⟦</div>⟧ ⟦<pre>make all</pre>⟧",
    "⟦\\section{Caches}⟧ A cache ⟦\\emph⟧{evicts} old entries, see ⟦\\ref⟧{fig}. ⟦\\item⟧ The cost is ⟦$n^2$⟧.",
    "⟦\\begin{itemize}⟧ ⟦\\item⟧ small pages ⟦\\item⟧ large pages ⟦\\end{itemize}⟧ and {⟦\\bf⟧ bold} words, 5⟦\\%⟧ of all.",
    "The sum ⟦$$a + b = c$$⟧ holds, and so does ⟦\\(x^2\\)⟧ or ⟦\\begin{equation}y = 2x\\end{equation}⟧ at once.",
    "⟦\\begin{verbatim}ls -l\\end{verbatim}⟧ lists files; 3⟦\\&⟧4 are ⟦{\\it ⟧odd}. ⟦\\subsection{Limits}⟧ None. ⟦$x_1$⟧",
    "⟦== History ==⟧\nThe ⟦'''⟧kernel⟦'''⟧ began as a ⟦[[hobby]]⟧ project.⟦{{citation needed}}⟧ ⟦[[Category:Systems]]⟧",
    "⟦__TOC__⟧ See ⟦[https://example.org the manual]⟧ for ⟦''⟧details⟦''⟧.\n⟦{|\n! a !! b\n|-\n| 1 || 2\n|}⟧\n⟦=== Use ===⟧\nIt is used ⟦{{as of|2020}}⟧ daily.",
    # Content that looks like markup.
    "If a < b and c > d then a <= d, but x >= y does not follow from x < y.",
    "A List<String> or Map<K> holds T&lt values; f<T> and <unset> are no tags, AT&T & Co. is a firm.",
    "It costs $5 or $7, rarely $12; R&D took $3 of each $9 and Q&A took $2.",
    "The file C:\\temp\\new lies beside D:\\data\\old and \\srv\\share, as arr[0] and {x} and [a] do.",
    "Set snake_case_name and MAX_SIZE, then 2 * 3 * 4 = 24, C# or F#, a | b, x != y, ~5 pages, and don't stop!",
    "It's rock 'n' roll: {a, b} is a set, [1, 2] is a list; item #1 of 10 is *the best, they say. 3 * 4.",
    "The readers' notes say so! Really! A path like a/b or a\\b, a flag |x|, a rate of ~3, an id #7 and a [sic].",
)
LABELLED_MARKDOWN = (
    "⟦# ⟧Caches\n\nA cache is ⟦**⟧fast⟦**⟧ and ⟦*⟧small⟦*⟧.\n\n⟦- ⟧hits\n⟦- ⟧misses\n\n⟦> ⟧Measure first.",
    "⟦## ⟧Limits\n\n⟦1. ⟧time\n⟦2. ⟧space\n\n⟦---⟧\n\nSee ⟦[the manual](https://example.org/m)⟧ and ⟦![plan](plan.png)⟧.⟦[^1]⟧",
    "Use ⟦`ls -l`⟧ or ⟦~~⟧nothing⟦~~⟧, with ⟦_⟧care⟦_⟧ and ⟦__⟧love⟦__⟧.\n\n⟦```sh\nls\n```⟧\n\n⟦[^1]:⟧ A note.",
    "⟦| ⟧a | b |\n⟦|---|---|⟧\n| 1 | 2 |\n\n⟦```\nmake\n```⟧\n\n⟦* ⟧one\n⟦* ⟧two\n⟦> ⟧quoted\n\n⟦***⟧\n",
)
#: Where Markdown is the document's own form, fenced code is its content.
LABELLED_OWN = ("Run this:\n```sh\nmake all\n```\nThen that:\n~~~\nls\n~~~\nand then\n```\nend\n```\nor\n```\nx\n```\nor\n```\ny\n```\n",)


def read_labels(page: str) -> tuple[str, list[tuple[int, int]]]:
    """A labelled page as its text and the spans of its content."""
    text, spans, since, at = [], [], 0, 0
    for part in re.split("([⟦⟧])", page):
        if part == "⟦":
            spans.append((since, at))
        elif part == "⟧":
            since = at
        else:
            text.append(part)
            at += len(part)
    return "".join(text), [*spans, (since, at)]


def learn_weights(pages: list[tuple[str, list[tuple[int, int]]]], markdown: bool = True) -> dict[str, float]:
    """Log odds of being content of each kind of element, from labelled pages: (text, spans that are content).

    A kind that no page shows stands under ``""``: it leans to where fewer elements are.
    """
    inside: dict[str, int] = {}
    outside: dict[str, int] = {}
    for text, spans in pages:
        for kind, start, end in elements(text, markdown):
            where = inside if any(a <= start and end <= b for a, b in spans) else outside
            where[kind] = where.get(kind, 0) + 1
    n, m = sum(inside.values()), sum(outside.values())
    every = set(inside) | set(outside) | {""}
    return {k: math.log((inside.get(k, 0) + 1) / (n + len(every))) - math.log((outside.get(k, 0) + 1) / (m + len(every))) for k in every}


@functools.cache
def fitted(markdown: bool) -> dict[str, float]:
    """The weights of the labelled pages."""
    pages = [*LABELLED, *(LABELLED_MARKDOWN if markdown else LABELLED_OWN)]
    return learn_weights([read_labels(p) for p in pages], markdown)


def best_span(scores: Iterator[tuple[float, int, int]]) -> tuple[float, int, int]:
    """The contiguous run of scored elements (score, start, end) with the highest sum: (sum, start, end), in one scan."""
    best = (0.0, 0, 0)
    total, since = 0.0, 0
    for score, start, end in scores:
        if total <= 0:
            total, since = 0.0, start
        total += score
        if total > best[0]:
            best = (total, since, end)
    return best


def kinds(text: str | None, markdown: bool, weights: dict[str, float] | None = None) -> list[str]:
    """The kinds of markup of a text, in order; none unless some span of it scores as markup.

    ``markdown`` tells whether Markdown counts.  Words, of which nothing is asked but their number, are counted as the
    blanks between elements.
    """
    if not text:
        return []
    weights = weights or fitted(markdown)
    found = _elements(text, markdown, False)
    word, unseen = weights.get("word", 0.0), weights[""]

    def scored() -> Iterator[tuple[float, int, int]]:
        last = 0
        for kind, start, end in found:
            yield -word * text.count(" ", last, start), last, start
            yield -weights.get(kind, unseen), start, end
            last = end

    if best_span(scored())[0] <= 0:
        return []
    return [k for k, _, _ in found if weights.get(k, unseen) < 0]


# --- the content region -----------------------------------------------------------------------------------------

#: Structure that neither helps nor hurts a region; what is dropped from the text anyway is none of its content.
_NEUTRAL = {"mdhead", "mdlist", "break", "dropped", "comment"}
#: Structure that stays in the text and counts as the words it holds.
_HOLDING = {"code", "pre", "verbatim", "math", "mathenv", "inline", "wikihead", "texhead", "wikitable", "wikilink", "link", "extlink", "codespan"}


def region(text: str, markdown: bool, weights: dict[str, float] | None = None) -> tuple[int, int]:
    """The contiguous span with the highest sum of scores, widened to whole lines; the whole text if it has no word."""
    weights = weights or fitted(markdown)
    word, unseen = weights.get("word", 0.0), weights[""]

    def scored() -> Iterator[tuple[float, int, int]]:
        for kind, start, end in elements(text, markdown):
            if kind in _HOLDING:
                yield word * max(1, len(re.findall(r"[^\W_]+", text[start:end]))), start, end
            elif kind not in _NEUTRAL:
                yield weights.get(kind, unseen), start, end

    total, a, b = best_span(scored())
    if total <= 0:
        return 0, len(text)
    return text.rfind("\n", 0, a) + 1, (text.find("\n", b) + len(text) + 1) % (len(text) + 1) or len(text)


# --- writing clean text -----------------------------------------------------------------------------------------


def _sub_all(pattern: str, to, text: str) -> str:
    """Substitute until nothing changes: arguments may be nested."""
    compiled = re.compile(pattern, re.S)
    while True:
        text, n = compiled.subn(to, text)
        if not n:
            return text


def _fenced(body: str) -> str:
    return "\n\n```\n" + body.strip("\n") + "\n```\n\n"


def _table(m: re.Match) -> str:
    rows, row = [], []
    for line in m.group().splitlines()[1:]:
        line = line.strip()
        if line.startswith(("|-", "|}")):
            rows.append(row)
            row = []
        elif line[:1] in "|!":
            row += [c.rpartition("|")[2].strip() for c in re.split(r"\|\||!!", line[1:])]
    return "\n\n" + "\n".join("| " + " | ".join(r) + " |" for r in [*rows, row] if r) + "\n\n"


def to_text(text: str, markdown: bool) -> str:
    """Clean text of a document: markup resolved, headings, lists, code, tables and formulas kept."""
    kept: list[str] = []

    def keep(value: str) -> str:
        kept.append(value)
        return f"\x00{len(kept) - 1}\x00"

    def first(m: re.Match) -> str:
        kind = m.lastgroup[2:]
        s = m.group()
        if kind == "code":
            return keep(s)
        if kind == "pre":
            return keep(_fenced(html.unescape(re.sub(r"(?s)<[^>]*>", "", s))))
        if kind == "verbatim":
            return keep(_fenced(re.sub(r"\\(?:begin|end)\{\w+\}(?:\[[^\]]*\])?", "", s)))
        if kind in ("math", "inline"):
            block = s.startswith(("$$", "\\["))
            inner = s.strip("$").strip() if s[0] == "$" else s[2:-2].strip()
            return keep(f"$${inner}$$" if block else f"${inner}$")
        if kind == "mathenv":
            return keep("$$" + re.sub(r"\\(?:begin|end)\{\w+\*?\}", "", s).strip() + "$$")
        if kind == "codespan":
            return keep(s.strip("`").strip())
        if kind in ("comment", "dropped", "wikiword", "mdrule"):
            return ""
        return s

    text = (ANY if markdown else FOREIGN).sub(first, text)
    # LaTeX
    text = re.sub(r"\\(?P<s>(?:sub)*)(?:section|paragraph|chapter|part)\*?\{(?P<t>[^{}\n]*)\}", lambda m: f"\n\n{'#' * (2 + len(m['s']) // 3)} {m['t']}\n\n", text)
    text = re.sub(r"\\verb([|!+])(.*?)\1", lambda m: keep(m[2]), text)
    text = re.sub(r"~?\\(?:cite|ref|label|eqref|pageref|index|bibliography\w*|vspace|hspace)\w*\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", text)
    text = _sub_all(r"\\footnote\{([^{}]*)\}", r" (\1)", text)
    text = _sub_all(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?", "\n", text)
    text = re.sub(r"\\item\b[ \t]*(?:\[([^\]\n]*)\])?", lambda m: "\n- " + (m[1] + " " if m[1] else ""), text)
    text = _sub_all(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\{\\(?:it|bf|em|tt|sl|sc|rm|sf|small|large|Large|tiny|itshape|bfseries)\b[ ]?([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\([%&#_{}$])(?![A-Za-z]:)", r"\1", text)
    # wiki
    text = re.sub(r"(?sm)^\{\|.*?^\|\}", _table, text)
    text = re.sub(r"(?m)^(={2,6})[ \t]*([^=\s][^\n]*?)[ \t]*\1[ \t]*$", lambda m: f"\n{'#' * len(m[1])} {m[2]}\n", text)
    text = re.sub(r"\[\[(?:Category|File|Image):[^\[\]]*\]\]", "", text)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", r"\1", text)
    text = re.sub(r"\{\{([^{}]*)\}\}", lambda m: m[1].split("|")[-1].strip() if m[1].count("|") == 1 and "=" not in m[1] else "", text)
    text = re.sub(r"\[(?:https?|ftp)://[^\s\]]+(?:[ ]([^\]\n]*))?\]", lambda m: m[1] or "", text)
    text = re.sub(r"('{2,5})(?=[^'\s])([^\n]*?[^'\s])\1", r"\2", text)
    # HTML
    text = re.sub(r"(?i)<br\s*/?>", "\n", text)
    text = re.sub(r"(?i)<h([1-6])\b[^>]*>", lambda m: "\n\n" + "#" * int(m[1]) + " ", text)
    text = re.sub(r"(?i)<li\b[^>]*>", "\n- ", text)
    text = re.sub(r"(?i)</t[dh]\s*>\s*<t[dh]\b[^>]*>", " | ", text)
    text = re.sub(r"(?i)<img\b[^>]*?alt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')[^>]*>", lambda m: m[1] or m[2] or "", text)
    tag = next(p for k, p in _SHARED if k == "tag")
    text = re.sub(r"(?i)</li\s*>", "", text)
    text = re.sub(tag, lambda m: "\n\n" if re.match(r"</?(\w+)", m.group())[1].lower() in BLOCK - {"li", "ul", "ol"} else ("\n" if re.match(r"</?(\w+)", m.group())[1].lower() in BLOCK else ""), text)
    text = re.sub(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});", lambda m: html.unescape(m.group()).replace("\xa0", " "), text)
    if markdown:
        text = re.sub(r"!\[([^\]\n]*)\]\([^()\s]*(?:[ ]\"[^\"\n]*\")?\)", r"\1", text)
        text = re.sub(r"\[([^\[\]\n]+)\]\((?:#|/|\.|https?:|mailto:|[\w-]+[./#])?[^()\s]*(?:[ ]\"[^\"\n]*\")?\)", r"\1", text)
        text = re.sub(r"(?m)^\[\^[^\]\s]+\]:[ \t]*[^\n]*$|\[\^[^\]\s]+\]", "", text)
        text = re.sub(r"(?m)^[ ]{0,3}>[ \t]?", "", text)
        text = re.sub(r"(?m)^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*\n?", "", text)
        text = re.sub(r"(?<![\w*])(\*{1,3})(?=[^\s*])([^*\n]*[^\s*])\1(?![\w*])", r"\2", text)
        text = re.sub(r"(?<![\w_])(_{1,3})(?=[^\s_])([^\n]*?[^\s_])\1(?!\w)", r"\2", text)
        text = re.sub(r"~~(?=\S)([^\n]*?\S)~~", r"\1", text)
    text = re.sub(r"[ \t]+\n", "\n", text)
    # What was kept comes back before blank lines are counted, except that code keeps its own.
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    text = re.sub(r"\s*\x00(\d+)\x00\s*", lambda m: f"\n\n{kept[int(m[1])].strip()}\n\n" if kept[int(m[1])].lstrip().startswith(("```", "~~~")) else m.group(), text)
    return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], text).strip()


def clean(text: str | None, markdown: bool, weights: dict[str, float] | None = None) -> tuple[list[str], str | None]:
    """The kinds of markup of a text and its clean form; a text without markup stays as it is."""
    found = kinds(text, markdown, weights)
    if not found:
        return [], text
    a, b = region(text, markdown, weights)
    return sorted(set(found)), to_text(text[a:b].replace("\x00", ""), markdown)


def cleaned(df: DataFrame, key: str, column: str, markdown: bool, only_marked: bool = False, weights: dict[str, float] | None = None) -> DataFrame:
    """``(rec_id, kinds, text)`` once for every record; null texts stay null.

    With ``only_marked`` just the records with markup, of which the JVM first drops those that cannot have any.  One
    narrow pass; then a repeated record, equal in all columns, is dropped by its key.
    """
    df = df.select(F.col(key).cast("string").alias("rec_id"), F.col(column).alias("text"))
    if only_marked:
        df = df.where(F.col("text").rlike(MAYBE_ANY if markdown else MAYBE_FOREIGN))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [clean(t, markdown, weights) for t in pdf["text"]]
            frame = pd.DataFrame({"rec_id": pdf["rec_id"].to_numpy(), "kinds": [k for k, _ in out], "text": [t for _, t in out]})
            yield frame[frame["kinds"].map(len) > 0] if only_marked else frame

    return df.mapInPandas(run, "rec_id string, kinds array<string>, text string").dropDuplicates(["rec_id"])
