"""Encoding of whole texts with a public byte-level BPE vocabulary.

The merges are compiled once per worker into a deterministic token automaton by successive merge gadgets, after
Berglund, Martens and van der Merwe, "Constructing a BPE Tokenization DFA" (2024).  The automaton starts as one
state that loops on every byte.  The merge ``(u, v) -> w`` at time ``m`` adds one gadget:

* the state after ``u`` is replaced by a copy that lacks the arc ``v``;
* every state that has the arc ``u`` gets the arc ``w``;
* the state after ``w`` is the state that followed ``v`` at that time.

Copies share what they do not change, so the automaton is kept as its gadgets (what each copy removes and when)
and a transition is looked up along two short chains and then kept in the transition table.  A token sequence is
accepted exactly if it is the BPE encoding of its bytes, hence each prefix of a word has one accepted path: the
encoder advances over the bytes with the arcs that leave each reached state and emits the labels of the path.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = os.environ.get("LECTERN_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"

#: Fixed value: how the vocabulary splits a text into words before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words kept with their ids by each worker; beyond it the table is emptied, which changes no result.
KEPT_WORDS = 400_000
#: Transitions kept by each worker, under the same rule.
KEPT_ARCS = 4_000_000

_START = -1
_WORKER: dict = {}


class MergeAutomaton:
    """Deterministic automaton over tokens, compiled from merges in order of rank."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.tokens = tokens
        self.labels = {i: t for t, i in tokens.items()}
        self.removed: dict[tuple[int, int], int] = {}
        left: dict[int, int] = {}
        right: dict[int, int] = {}
        born: dict[int, int] = {}
        for time, (u, v) in enumerate(merges):
            a, b, w = tokens[u], tokens[v], tokens[u + v]
            self.removed[a, b] = time
            left[w], right[w], born[w] = a, b, time
        self._left, self._right, self._born = left, right, born
        self._table: dict[tuple[int, int], bool] = {}
        #: Arcs by first two bytes, so that a state only tries labels that can match.
        self.longest = max(map(len, tokens), default=1)
        self._trie: dict = {}
        for token, i in tokens.items():
            node = self._trie
            for byte in token:
                node = node.setdefault(byte, {})
            node[-1] = i

    def arc(self, state: int, label: int) -> bool:
        """Whether the state after token ``state`` has the arc ``label``."""
        if state == _START:
            return True
        known = self._table.get((state, label))
        if known is None:
            if len(self._table) >= KEPT_ARCS:
                self._table.clear()
            known = self._table[state, label] = self._compile(state, label)
        return known

    def _compile(self, state: int, label: int) -> bool:
        never = 1 << 60
        # The copies that lead to this state: the token, its right part, that part's right part, and so on, each
        # with the time from which the next larger one was a state of its own.
        copy, until = state, never
        while copy is not None:
            part, before = label, never
            while part is not None:
                time = self.removed.get((copy, part))
                # A pair of equal parts is merged from the left: the removal comes before the new arc.
                if time is not None and time < until and (time < before or (time == before and copy == part)):
                    return False
                before = self._born.get(part, never)
                part = self._left.get(part)
            until = self._born.get(copy, never)
            copy = self._right.get(copy)
        return True

    def encode(self, word: bytes) -> list[int]:
        """The ids of one pre-split word."""
        whole = self.tokens.get(word)
        n = len(word)
        if whole is not None and n < 3:
            return [whole]
        last: list[int | None] = [None] * (n + 1)
        back = [0] * (n + 1)
        last[0] = _START
        arc, trie = self.arc, self._trie
        for at in range(n):
            state = last[at]
            if state is None:
                continue
            node, end = trie, at
            while end < n:
                node = node.get(word[end])
                if node is None:
                    break
                end += 1
                label = node.get(-1)
                if label is not None and last[end] is None and arc(state, label):
                    last[end], back[end] = label, at
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of an id sequence: its arc labels in order."""
        return b"".join(self.labels[i] for i in ids)


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that the vocabulary file uses for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(path: str) -> MergeAutomaton:
    """Compile the automaton of a vocabulary file with tokens and merges."""
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = _byte_letters()
    spell = lambda token: bytes(letters[c] for c in token)
    merged = [tuple(map(spell, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    made = {u + v for u, v in merged}
    tokens = {}
    for token, i in model["vocab"].items():
        if all(c in letters for c in token):
            b = spell(token)
            if len(b) == 1 or b in made:
                tokens[b] = i
    return MergeAutomaton(tokens, merged)


def splitter():
    """``text -> words`` by the vocabulary's word pattern, in the standard library's faster matcher.

    Its own classes agree with the pattern's letter, number and blank classes but for some characters, such as
    fractions; texts that hold one of those go to the pattern itself.
    """
    import re

    import regex

    exact = regex.compile(PATTERN).findall
    quick = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    apart: set[str] = set()
    for theirs, ours in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")):
        apart |= set(regex.findall(theirs, every)) ^ set(re.findall(ours, every))
    plain = frozenset(apart).isdisjoint
    return lambda text: quick(text) if plain(text) else exact(text)


class _Words(dict):
    """Ids by word; a missing word is encoded by the automaton."""

    def __init__(self, automaton: MergeAutomaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = self[word] = tuple(self.automaton.encode(word.encode("utf-8")))
        return ids


def encoder(path: str):
    """``text -> ids``, kept by the worker for its later tasks."""
    if path not in _WORKER:
        from itertools import chain

        words, split = _Words(load(path)), splitter()

        def encode(text: str | None) -> list[int]:
            return list(chain.from_iterable(map(words.__getitem__, split(text)))) if text else []

        _WORKER[path] = encode
    return _WORKER[path]


def vocabulary_path(folder: str = TOKENIZERS, name: str = VOCABULARY) -> str:
    return os.path.join(folder, f"{name}.json")


def shipped(spark: SparkSession, path: str) -> str:
    """The name under which workers find a vocabulary file; only the driver needs the folder it lies in."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encode_texts(df: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """``(key, ids)`` for every row: the text's ids without special tokens.

    An empty and a null text both give the empty list; a null key stays null; repeated rows stay repeated.  One
    narrow pass: no shuffle, and only the two columns are read.  Texts may be of any length.
    """
    import numpy as np

    name = shipped(df.sparkSession, path or vocabulary_path())
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(SparkFiles.get(name))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start in range(0, len(texts), 2000):
                flat, ends = [], [0]
                for t in texts[start : start + 2000]:
                    flat.extend(encode(t))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype="i4")), pa.array(np.array(flat, dtype="i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, 2000), ids], names=[key, "ids"])

    return df.select(key, F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keys: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``keys`` and ``n_tokens`` of every row; the ids themselves never leave the worker."""
    name = shipped(df.sparkSession, path or vocabulary_path())
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(SparkFiles.get(name))
        for batch in batches:
            n = pa.array([len(encode(t)) for t in batch.column(len(keys)).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], n], names=[*keys, "n_tokens"])

    return df.select(*keys, F.col(text).alias("__text")).mapInArrow(run, schema)
