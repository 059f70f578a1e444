"""Mapping freely typed values to the entries of a reference list.

All work is done on the distinct values of a field, spread over the cluster; the records only meet the finished map.
The reference list is held in blocks of ``BLOCK`` entries, one pass over the values for each, so a list of any length
does: mentions and scores of all blocks meet by value before anything is decided.  A value is folded
(width, case, accents, joined words, punctuation), then

1. a multi-pattern automaton over the folded names and aliases finds embedded mentions on word boundaries, of which
   the longest non-overlapping ones win; one entry mentioned decides.  A mention shorter than ``SHORT`` letters counts
   only where every other word of the value is decoration: a word seen around long mentions of several entries;
2. what remains is compared by token-set similarity with the entries that share a word up to the edits allowed (found
   through the words' forms with letters deleted, which loses none): words are aligned one to one, equal words score 1, an
   abbreviation and a word within a small edit distance a little less; the best entry decides if it reaches ``LEAST``
   and no other entry comes within ``GAP``.

Anything else is reported with ``canon_id`` 0.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import durable

SHORT = 4
LEAST = 0.72
GAP = 0.02
#: Entries, about, that are sent to every worker at a time.
BLOCK = 5_000


def fold(value: str) -> list[str]:
    """Words of a value: joined words split, then width, case, accents and punctuation folded away."""
    value = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", unicodedata.normalize("NFKC", value))
    plain = "".join(c for c in unicodedata.normalize("NFD", value.casefold()) if not 0x300 <= ord(c) < 0x370)
    plain = unicodedata.normalize("NFC", plain)
    # Marks belong to the words of many scripts.
    return re.findall(r"[^\W_]+(?:[^\s\x00-\x40\x5b-\x60\x7b-\xbf]|[^\W_])*", plain)


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or ``most + 1`` where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before_last = row, before
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before_last[j - 2] + 1)
            row.append(d)
        before = last
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _likeness(word: str, entry: str) -> float:
    if word == entry:
        return 1.0
    n = min(len(word), len(entry))
    if n >= 3 and len(word) < len(entry) and entry.startswith(word):
        return 0.9
    most = 0 if n < 3 else 1 if n < 6 else 2
    d = edits(word, entry, most) if most else 1
    return 1 - d / max(len(word), len(entry)) if d <= most else 0.0


def token_set(words: list[str], entry: list[str]) -> float:
    """Similarity of two word sets under the best greedy one-to-one alignment, weighted by length."""
    pairs = sorted(((_likeness(a, b), i, j) for i, a in enumerate(words) for j, b in enumerate(entry)), reverse=True)
    left, right, gain = set(), set(), 0.0
    for s, i, j in pairs:
        if s > 0 and i not in left and j not in right:
            left.add(i)
            right.add(j)
            gain += s * (len(words[i]) + len(entry[j]))
    whole = sum(map(len, words)) + sum(map(len, entry))
    return gain / whole if whole else 0.0


def _deleted(word: str, most: int) -> set[str]:
    """The word, and what is left of it without up to ``most`` of its letters."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


class Matcher:
    """A reference list of one field, or a block of it, ready to map values."""

    def __init__(self, entries: Iterable[tuple[int, str, Iterable[str] | None]]):
        import ahocorasick

        self.names: dict[str, int] = {}
        self.forms: list[tuple[int, list[str]]] = []
        self.joined: dict[str, int] = {}
        self._near: dict[str, list[int]] | None = None
        for canon, name, aliases in sorted(entries, key=lambda e: e[0]):
            for form in [name, *(aliases or [])]:
                words = fold(form or "")
                if words:
                    self.names.setdefault(" ".join(words), canon)
                    self.joined.setdefault("".join(words), canon)
                    self.forms.append((canon, words))
        self._automaton = ahocorasick.Automaton()
        for form, canon in self.names.items():
            self._automaton.add_word(f" {form} ", (canon, len(form)))
        if self.names:
            self._automaton.make_automaton()

    def mentions(self, words: list[str]) -> list[tuple[int, int, int]]:
        """All mentions as (entry, start, length) in the joined words."""
        if not self.names:
            return []
        return [(canon, end - n - 1, n) for end, (canon, n) in self._automaton.iter(f" {' '.join(words)} ")]

    def scores(self, words: list[str], decoration: frozenset[str]) -> list[tuple[float, int]]:
        """The two best entries by token-set similarity, each with its score, best first."""
        bare = [w for w in words if w not in decoration] or words
        best: dict[int, float] = {}
        for at in sorted(self._candidates(words, bare)):
            canon, form = self.forms[at]
            if sum(map(len, form)) < SHORT:
                continue
            score = max(token_set(words, form), token_set(bare, form))
            if len(words) > 1 or len(form) > 1:
                a, b = "".join(bare), "".join(form)
                most = _joined_edits(a, b)
                d = edits(a, b, most)
                if d <= most:
                    score = max(score, 1 - d / max(len(a), len(b)))
            best[canon] = max(best.get(canon, 0.0), score)
        return sorted(((score, canon) for canon, score in best.items() if score > 0), key=lambda e: (-e[0], e[1]))[:2]

    def match(self, value: str, decoration: frozenset[str] = frozenset()) -> int:
        """The entry meant by a value, where this matcher holds the whole list, or 0."""
        words = fold(value)
        whole = self.names.get(" ".join(words)) or self.joined.get("".join(words))
        if whole or not words:
            return whole or 0
        canon = mentioned(value, self.mentions(words), decoration)
        return closest(self.scores(words, decoration)) if canon is None else canon

    def _candidates(self, words: list[str], bare: list[str]) -> set[int]:
        """Forms with a word that is like one of the value's, or that are like it as a whole; no other scores above 0."""
        if self._near is None:
            self._near = {}
            self._longest = max((sum(map(len, f)) for _, f in self.forms), default=0), max((len(w) for _, f in self.forms for w in f), default=0)
            for at, (_, form) in enumerate(self.forms):
                keys = {f"j{k}" for k in _deleted("".join(form), 2 if sum(map(len, form)) >= 8 else 1)}
                for word in form:
                    keys |= {f"w{k}" for k in _deleted(word, 2 if len(word) >= 6 else 1)}
                    keys |= {f"p{word[:n]}" for n in range(3, len(word))}
                for key in keys:
                    self._near.setdefault(key, []).append(at)
        asked: set[str] = set()
        if sum(map(len, bare)) <= self._longest[0] + 2:
            asked = {f"j{k}" for k in _deleted("".join(bare), 2 if sum(map(len, bare)) >= 8 else 1)}
        for word in words:
            if len(word) > self._longest[1] + 2:
                continue  # two edits away from none
            asked |= {f"w{k}" for k in _deleted(word, 2 if len(word) >= 6 else 1)} | {f"p{word}"}
        return {at for key in asked for at in self._near.get(key, ())}


def _joined_edits(a: str, b: str) -> int:
    return 1 if min(len(a), len(b)) < 8 else 2


def longest(found: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The longest mentions that do not overlap, as (entry, start, length)."""
    taken: list[tuple[int, int, int]] = []
    for canon, start, n in sorted(found, key=lambda m: (-m[2], m[1], m[0])):
        if all(start + n <= s or s + m <= start for _, s, m in taken):
            taken.append((canon, start, n))
    return taken


def _rest(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """The words outside of all mentions."""
    rest, at = [], 0
    for word in words:
        if not any(s <= at < s + n for _, s, n in found):
            rest.append(word)
        at += len(word) + 1
    return rest


def beside(value: str, found: list[tuple[int, int, int]]) -> list[tuple[str, int]]:
    """The words that stand beside a long mention of one entry, with the entry."""
    long = [m for m in longest(found) if m[2] >= SHORT]
    if len({m[0] for m in long}) != 1:
        return []
    return [(word, long[0][0]) for word in sorted(set(_rest(fold(value), long)))]


def mentioned(value: str, found: list[tuple[int, int, int]], decoration: frozenset[str]) -> int | None:
    """The entry that the mentions of a value decide for, 0 where they tie, None where nothing is mentioned."""
    taken = longest(found)
    kept = [m for m in taken if m[2] >= SHORT or all(w in decoration for w in _rest(fold(value), taken))]
    if not kept:
        return None
    order = sorted(kept, key=lambda m: -m[2])
    if len({m[0] for m in kept}) == 1 or order[0][2] > order[1][2]:
        return order[0][0]
    return 0


def closest(scores: list[tuple[float, int]]) -> int:
    """The best entry, if it is alike enough and no other comes close; else 0."""
    order = sorted(scores, key=lambda e: (-e[0], e[1]))
    if not order or order[0][0] < LEAST or (len(order) > 1 and order[0][0] - order[1][0] < GAP):
        return 0
    return order[0][1]


def _matchers(rows: list) -> dict[str, Matcher]:
    """A matcher for each field of some reference rows."""
    fields: dict[str, list] = {}
    for r in rows:
        fields.setdefault(r["field"], []).append((r["canon_id"], r["name"] or "", r["aliases"]))
    return {field: Matcher(entries) for field, entries in fields.items()}


def canonical_map(values: DataFrame, reference: DataFrame) -> DataFrame:
    """``(field, value, canon_id)`` for the distinct ``(field, value)`` of ``values``; all fields go together.

    Null and blank values are left out; a field without reference entries maps everything to 0.
    """
    spark = values.sparkSession
    listed = reference.where("field IS NOT NULL").select("field", "canon_id", "name", "aliases").distinct()
    few = listed.limit(BLOCK + 1).collect()
    blocks = 1 if len(few) <= BLOCK else 1 + listed.count() // BLOCK
    width = spark.sparkContext.defaultParallelism
    bare = F.regexp_replace("value", r"\p{Z}|\s", "")
    distinct = values.select("field", "value").where("value is not null").where(bare != "").distinct().repartition(width, "field", "value")
    nothing = Matcher([])

    def over_blocks(df: DataFrame, run, schema: str) -> DataFrame:
        """``df`` through the matchers of one block after the other."""
        out = None
        for b in range(blocks):
            rows = few if blocks == 1 else listed.where(F.pmod(F.xxhash64("canon_id"), F.lit(blocks)) == b).collect()
            part = df.mapInPandas(functools.partial(run, [r.asDict() for r in rows]), f"field string, value string, {schema}")
            out = part if out is None else out.unionByName(part)
        return out

    def mentions(rows, batches):
        matchers = _matchers(rows)
        for pdf in batches:
            out = []
            for field, value in zip(pdf["field"], pdf["value"], strict=True):
                words, matcher = fold(value), matchers.get(field, nothing)
                found = [{"canon": c, "start": s, "n": n} for c, s, n in matcher.mentions(words)]
                out.append((field, value, matcher.names.get(" ".join(words)), matcher.joined.get("".join(words)), found))
            yield pd.DataFrame(out, columns=["field", "value", "whole", "joined", "found"]).astype({"field": "str", "value": "str", "whole": "Int64", "joined": "Int64"})

    found = over_blocks(distinct, mentions, "whole bigint, joined bigint, found array<struct<canon:bigint,start:int,n:int>>")
    if blocks > 1:
        found = found.groupBy("field", "value").agg(F.min("whole").alias("whole"), F.min("joined").alias("joined"), F.flatten(F.collect_list("found")).alias("found"))
    found = durable(found, "mentions").withColumn("whole", F.coalesce("whole", "joined"))
    tuples = lambda rows: [(r["canon"], r["start"], r["n"]) for r in rows]

    def words_beside(batches):
        for pdf in batches:
            rows = [(field, *x) for field, value, marks in zip(pdf["field"], pdf["value"], pdf["found"], strict=True) for x in beside(value, tuples(marks))]
            yield pd.DataFrame(rows, columns=["field", "word", "canon"]).astype({"field": "str", "word": "str", "canon": "int64"})

    # A decoration stands beside two entries and makes up a thousandth of all such words of its field: at most 1000
    # words of a field return.
    seen = found.select("field", "value", "found").mapInPandas(words_beside, "field string, word string, canon bigint")
    seen = durable(seen.groupBy("field", "word").agg(F.countDistinct("canon").alias("canons"), F.count("*").alias("n")), "beside")
    common = seen.join(F.broadcast(seen.groupBy("field").agg(F.sum("n").alias("whole"))), "field")  # a row for each field of the list
    decoration: dict[str, set[str]] = {}
    for r in common.where("canons > 1 AND n * 1000 >= whole").select("field", "word").collect():
        decoration.setdefault(r["field"], set()).add(r["word"])
    decoration = {field: frozenset(words) for field, words in decoration.items()}
    no_words: frozenset[str] = frozenset()

    def decide(batches):
        for pdf in batches:
            canon = [mentioned(v, tuples(m), decoration.get(f, no_words)) for f, v, m in zip(pdf["field"], pdf["value"], pdf["found"], strict=True)]
            yield pd.DataFrame({"field": pdf["field"], "value": pdf["value"], "canon_id": pd.array(canon, dtype="Int64")})

    settled = found.where("whole IS NOT NULL").select("field", "value", F.col("whole").alias("canon_id"))
    decided = durable(found.where("whole IS NULL").select("field", "value", "found").mapInPandas(decide, "field string, value string, canon_id bigint"), "mentioned")

    def similar(rows, batches):
        matchers = _matchers(rows)
        for pdf in batches:
            best = [[{"score": s, "canon": c} for s, c in matchers.get(f, nothing).scores(fold(v), decoration.get(f, no_words))] for f, v in zip(pdf["field"], pdf["value"], strict=True)]
            yield pd.DataFrame({"field": pdf["field"], "value": pdf["value"], "best": best})

    open_ = decided.where("canon_id IS NULL").select("field", "value").repartition(width, "field", "value")
    scored = over_blocks(open_, similar, "best array<struct<score:double,canon:bigint>>")
    if blocks > 1:
        scored = scored.groupBy("field", "value").agg(F.flatten(F.collect_list("best")).alias("best"))

    def choose(batches):
        for pdf in batches:
            canon = [closest([(r["score"], r["canon"]) for r in best]) for best in pdf["best"]]
            yield pd.DataFrame({"field": pdf["field"], "value": pdf["value"], "canon_id": pd.array(canon, dtype="Int64")})

    nearest = scored.mapInPandas(choose, "field string, value string, canon_id bigint")
    return settled.unionByName(decided.where("canon_id IS NOT NULL")).unionByName(nearest)


def mapped_fields(columns: list[tuple[DataFrame, str, str, str]], reference: DataFrame) -> DataFrame:
    """``(field, rec_id, value, canon_id)`` of several columns, each (records, key, column, field); see ``mapped``."""
    typed = None
    for records, key, column, field in columns:
        part = records.select(F.lit(field).alias("field"), F.col(key).alias("rec_id"), F.col(column).alias("value")).where("value is not null").distinct()
        typed = part if typed is None else typed.unionByName(part)
    return typed.join(canonical_map(typed, reference), ["field", "value"]).select("field", "rec_id", "value", "canon_id")


def mapped(records: DataFrame, key: str, column: str, reference: DataFrame, field: str) -> DataFrame:
    """``(field, rec_id, value, canon_id)`` for each record with a value; a repeated record counts once.

    The map of distinct values joins the records by value; a value that a third of the records share is one row of
    the map, so the join is broadcast while the map is small and otherwise split by the skew rules of the session.
    """
    return mapped_fields([(records, key, column, field)], reference.where(F.col("field") == field))
