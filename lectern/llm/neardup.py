"""Near-duplicate records among too many for pairwise comparison, by Order MinHash.

Marçais et al., "Locality-sensitive hashing for the edit distance" (2019): of the k-mers of a text, labelled by their
number of occurrence, each of several hash functions samples the ``SAMPLED`` smallest and keeps them in the order of
the text.  Texts that agree in a whole sample are candidates; a pair within a small edit distance agrees in some
sample almost surely, also when its words were inserted, replaced or moved.  k-mers are word triples; triples that
stand in more than ``FREQUENT`` of all texts are phrases of the language or belong to a large group of near-copies:
each text is sampled without them, and a text of which they make up more than ``PHRASED`` is sampled from all its
k-mers too.  Any other pair has enough common k-mers outside of them: two texts of similarity 0.75 with scattered
changes share about 0.63 of their triples, of which at most ``PHRASED`` may be frequent.

Candidates are verified by a banded alignment: its matches are words common to both texts in the same order, and only
the words that it leaves over on either side (those of moved sentences) are then counted against each other.  Taking a
matched word from both sides lowers the smaller count by one, so the two numbers add up to the exact common words,
whatever the band.

A signature shared by very many texts is a hot key of one sort-merge join, which adaptive execution splits on both
sides; neither words nor signatures are ever broadcast.

Texts with the same words are one class from the start, so a text copied into a third of all records is one text here.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import discard, durable

#: Words of a k-mer, sampled k-mers of a signature, signatures of a text.
K = 3
SAMPLED = 2
SIGNATURES = 56
#: Share of all texts beyond which a k-mer is a phrase of the language.
FREQUENT = 0.002
#: Below so many informative k-mers a text is sampled from all of them too.
FEW = 8
#: Share of frequent k-mers in a text beyond which it is sampled from all of them too.
PHRASED = 1 / 3
#: Below so many words a text is (also) sampled from single words.
SHORT, SHORTISH = 8, 12
#: Texts whose k-mers are counted together; a phrase counts where half its share is reached.
CHUNK = 20_000
#: Half the width of the alignment's band; rows of bands that are in memory together.
BAND = 8
CELLS = 100_000
#: Keys of records without a text of their own that may be sent to every worker.
MOST_ODD = 500_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(_U, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> _U(shift)
        x *= _U(factor)
    x ^= x >> _U(33)
    return x


def _flat(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All words of the texts and each text's number of words."""
    lengths = column.map(len).to_numpy(dtype=np.int64)
    return (np.concatenate(column.to_numpy()).astype(np.int64) if lengths.sum() else np.zeros(0, dtype=np.int64)), lengths


def _kmers(words: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of every text in order, and the text of each; a shorter text is one k-mer."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    h = _mix(words.view(_U) + _U(1))
    out = h.copy()
    n = len(h)
    for j in range(1, k):
        follows = np.zeros(n, dtype=_U)
        if n > j:
            same = doc[:-j] == doc[j:]
            follows[:-j][same] = h[j:][same]
        out = _mix(out * _U(31) + follows)
    if k > 1 and n:
        place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        whole = (place + k <= np.repeat(lengths, lengths)) | (place == 0)
        out, doc = out[whole], doc[whole]
    return out, doc


def _label(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Number of occurrence of each k-mer within its text, from 0."""
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    at = np.arange(len(h))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    out = np.empty(len(h), dtype=np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def signatures(h: np.ndarray, doc: np.ndarray, salt: int = 0, count: int = SIGNATURES) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have a k-mer, and their signatures (texts x count)."""
    if not len(h):
        return np.zeros(0, dtype=np.int64), np.zeros((0, count), dtype=np.int64)
    labelled = _mix(h + _label(h, doc).astype(_U) * _U(0x9E3779B97F4A7C15))
    start = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])
    texts, sizes = doc[start], np.diff(np.concatenate([start, [len(h)]]))
    out = np.empty((len(texts), count), dtype=np.int64)
    last = _U(2**64 - 1)
    for j in range(count):
        x = _mix(labelled ^ _U((j + 1) * 0x12345671 + salt))
        picked, places = [], []
        for _ in range(SAMPLED):
            least = np.minimum.reduceat(x, start)
            hit = np.flatnonzero(x == np.repeat(least, sizes))
            row = np.searchsorted(texts, doc[hit])
            place = np.zeros(len(texts), dtype=np.int64)
            place[row[::-1]] = hit[::-1]
            picked.append(least)
            places.append(place)
            x[place] = last
        a, b = picked[0], np.where(sizes > 1, picked[1], _U(0))
        swap = (places[1] < places[0]) & (sizes > 1)
        first, second = np.where(swap, b, a), np.where(swap, a, b)
        out[:, j] = _mix(first * _U(3) + second + _U(j * 7919 + salt)).view(np.int64)
    return texts, out


def _digest(words: np.ndarray) -> bytes:
    """A digest of a multiset of words."""
    return hashlib.blake2b(np.sort(words).tobytes(), digest_size=16).digest()


def tokenized(records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, class, words)``: 32-bit hashes of a record's words in order, and a digest of their multiset.

    Words are the longest runs of letters or digits in the lower-cased columns, joined by blanks; a null column
    counts as empty.
    """
    words = re.compile(r"[^\W_]+").findall
    kept: dict[str, int] = {}

    def code(word: str) -> int:
        if len(kept) > 500_000:
            kept.clear()
        kept[word] = value = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=4).digest(), "little", signed=True)
        return value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for text in batch.column(1).to_pylist():
                flat.extend([kept[w] if w in kept else code(w) for w in words(text)])
                ends.append(len(flat))
            all_words = np.array(flat, dtype=np.int32)
            digests = [_digest(all_words[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            column = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(all_words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, type=pa.binary()), column], names=[key, "class", "words"])

    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    return records.select(key, text.alias("__text")).mapInArrow(run, f"`{key}` string, class binary, words array<int>")


def phrases(texts: DataFrame, share: float = FREQUENT) -> DataFrame:
    """``(kmer)``: k-mers that stand in more than ``share`` of all texts.

    Each chunk reports the k-mers that reach half that share of its texts, so what is reported is bounded by the
    words of a text over the share, whatever the size of the collection.
    """
    n = texts.count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.Series] = []
        size = 0

        def counted() -> pd.DataFrame:
            h, doc = _kmers(*_flat(pd.concat(held)), K)
            order = np.argsort(h, kind="stable")  # the texts of a k-mer stay in order
            h, doc = h[order].view(np.int64), doc[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            kmer, texts_with = np.unique(h[new], return_counts=True)
            often = texts_with >= max(2, share / 2 * size)
            return pd.DataFrame({"kmer": kmer[often], "n": texts_with[often].astype("int64")})

        for pdf in batches:
            held.append(pdf["words"])
            size += len(pdf)
            if size >= CHUNK:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    counts = texts.select("words").mapInPandas(run, "kmer bigint, n bigint").groupBy("kmer").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") > 1 + share * n).select("kmer")


def signed(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``(sig, cid)``: the signatures of every text."""
    shared = texts.sparkSession.sparkContext.broadcast(np.sort(frequent))

    def emit(pdf: pd.DataFrame, texts_at: np.ndarray, sigs: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"sig": sigs.ravel(), "cid": np.repeat(pdf["cid"].to_numpy()[texts_at], sigs.shape[1])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases_ = shared.value
        for pdf in batches:
            words, lengths = _flat(pdf["words"])
            h, doc = _kmers(words, lengths, K)
            at = np.minimum(np.searchsorted(phrases_, h.view(np.int64)), max(0, len(phrases_) - 1))
            rare = phrases_[at] != h.view(np.int64) if len(phrases_) else np.ones(len(h), dtype=bool)
            yield emit(pdf, *signatures(h[rare], doc[rare]))
            informative, whole = np.bincount(doc[rare], minlength=len(lengths)), np.bincount(doc, minlength=len(lengths))
            poor = (informative < np.maximum(FEW, (1 - PHRASED) * whole))[doc]
            if poor.any():
                yield emit(pdf, *signatures(h[poor], doc[poor], salt=1 << 40))
            small = (lengths < SHORTISH) & (lengths > 0)
            if small.any():
                keep = np.repeat(small, lengths)
                yield emit(pdf, *signatures(*[x[keep] for x in _kmers(words, lengths, 1)], salt=1 << 41))

    return texts.select("cid", "words").mapInPandas(run, "sig bigint, cid bigint")


def aligned(a: list[np.ndarray], b: list[np.ndarray], band: int = BAND) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Banded alignment of each pair of word sequences: the number of matches, and the words left over on either side.

    The matches are a longest common subsequence within the band.  All pairs advance together, one row of the band at
    a time, and are traced back together.
    """
    n, m = np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64)
    pairs, rows, width = len(a), int(n.max(initial=0)), 2 * band + 1
    left = np.full((pairs, rows), -1, dtype=np.int64)
    right = np.full((pairs, rows + 2 * band + 1), -2, dtype=np.int64)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        left[i, : len(x)] = (x.astype(np.int64) << 1) + 1
        y = y[: rows + band + 1]
        right[i, band : band + len(y)] = (y.astype(np.int64) << 1) + 1
    scores = np.zeros((rows + 1, pairs, width), dtype=np.int32)
    for r in range(rows):
        # Cell (r, c) of the band is row r, column r + c - band.
        up = np.zeros_like(scores[r])
        up[:, :-1] = scores[r][:, 1:]
        diagonal = scores[r] + (left[:, r : r + 1] == right[:, r : r + width])
        scores[r + 1] = np.maximum.accumulate(np.maximum(up, diagonal), axis=1)
    every = np.arange(pairs)
    used_a, used_b = np.zeros((pairs, rows), dtype=bool), np.zeros((pairs, rows + 2 * band + 1), dtype=bool)
    matches = scores[n, every, width - 1].astype(np.int64)
    value, cell = matches.copy(), np.full(pairs, width - 1)
    for r in range(rows, 0, -1):
        live = (n >= r) & (value > 0)
        if not live.any():
            continue
        # Scores grow with the column: the first cell of this score is where it was reached.
        cell = np.where(live, (scores[r] < value[:, None]).sum(axis=1), cell)
        came = live & (left[:, r - 1] == right[every, r - 1 + cell]) & (scores[r - 1][every, cell] + 1 == value)
        used_a[came, r - 1] = True
        used_b[came, (r - 1 + cell)[came]] = True
        value -= came
        cell = np.where(live & ~came, np.minimum(cell + 1, width - 1), cell)
    over_a = [x[~used_a[i, : len(x)]] for i, x in enumerate(a)]
    over_b = [np.concatenate([y[: rows + band + 1][~used_b[i, band : band + min(len(y), rows + band + 1)]], y[rows + band + 1 :]]) for i, y in enumerate(b)]
    return matches, over_a, over_b


def common_words(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sum of the smaller counts of each word of each pair."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    pair = np.concatenate([np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)])
    word = np.concatenate([*a, *b]).astype(np.int64)
    side = np.concatenate([np.zeros(na.sum(), dtype=bool), np.ones(nb.sum(), dtype=bool)])
    key = (pair << 32) | (word & 0xFFFFFFFF)
    order = np.argsort(key, kind="stable")
    key, side = key[order], side[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1]) if len(key) else np.zeros(0, dtype=np.int64)
    if not len(start):
        return np.zeros(len(a), dtype=np.int64)
    in_b = np.add.reduceat(side.astype(np.int64), start)
    sizes = np.diff(np.concatenate([start, [len(key)]]))
    return np.bincount(key[start] >> 32, weights=np.minimum(in_b, sizes - in_b), minlength=len(a)).astype(np.int64)


def classes(records: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(key, class)`` of every record, once each, and ``(cid, class, words)`` of every class of equal words.

    Only keys and digests are exchanged to find what repeats: the words of a class are those of the record whose key
    hashes least, and all other records, and rows delivered again, are left out where they lie while their keys are few
    enough to be broadcast.
    """
    tokens = durable(tokenized(records, key, columns), "words")
    words = tokens.where(F.col("class") != F.lit(bytearray(_digest(np.zeros(0, dtype=np.int32)))))
    keyed = durable(words.groupBy(key, "class").agg(F.count("*").alias("n")), "keyed")
    several = keyed.groupBy("class").agg(F.min(F.xxhash64(key)).alias("least"), F.count("*").alias("keys")).where("keys > 1").drop("keys")
    several = durable(several, "several")
    texts = None
    if several.count() <= MOST_ODD:
        is_first = F.coalesce(F.xxhash64(key) == F.col("least"), F.lit(True))
        odd = keyed.join(F.broadcast(several), "class", "left").withColumn("is_first", is_first).where("NOT is_first OR n > 1")
        odd = durable(odd.select(key, "is_first"), "odd")
        if odd.count() <= MOST_ODD:
            others, twice = F.broadcast(odd.select(key)), F.broadcast(odd.where("is_first").select(key))
            texts = words.join(others, key, "left_anti").unionByName(words.join(twice, key, "left_semi").dropDuplicates([key])).select("class", "words")
    if texts is None:
        texts = words.groupBy("class").agg(F.first("words").alias("words"))
    texts = durable(texts.withColumn("cid", F.monotonically_increasing_id()), "classes")
    discard(tokens)
    return keyed.select(key, "class"), texts


def similar(texts: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, similarity)``: pairs of classes (their cid, a < b) whose word multisets are similar enough."""
    frequent = phrases(texts).toPandas()["kmer"].to_numpy(dtype=np.int64)
    sigs = signed(texts, frequent)  # both sides of the join read one exchange
    pairs = (
        sigs.alias("x").hint("merge").join(sigs.alias("y"), "sig").where("x.cid < y.cid").selectExpr("x.cid AS a", "y.cid AS b").distinct()
    )
    named = texts.select("cid", "words").hint("merge")  # the size of arrays is estimated too low for a choice by size

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y = list(pdf["wa"]), list(pdf["wb"])
            na, nb = np.array([len(w) for w in x], dtype=np.int64), np.array([len(w) for w in y], dtype=np.int64)
            both = na + nb
            # sim >= t  <=>  common >= t / (1 + t) * (na + nb)
            need = np.ceil(threshold / (1 + threshold) * both - 1e-9)
            common = np.zeros(len(pdf), dtype=np.int64)
            possible = np.flatnonzero(np.minimum(na, nb) >= need)
            possible = possible[np.argsort(na[possible], kind="stable")]
            # Pairs of like length go together, so many that their bands stay small in memory.
            for group in _groups(na[possible], CELLS):
                some = possible[group]
                matches, over_a, over_b = aligned([x[i] for i in some], [y[i] for i in some])
                common[some] = matches + common_words(over_a, over_b)
            keep = (common >= need) & (both > 0)
            yield pd.DataFrame({"a": pdf["a"][keep], "b": pdf["b"][keep], "similarity": (common / np.maximum(1, both - common))[keep]})

    full = pairs.join(named.select(F.col("cid").alias("a"), F.col("words").alias("wa")), "a").join(
        named.select(F.col("cid").alias("b"), F.col("words").alias("wb")), "b"
    )
    return full.select("a", "b", "wa", "wb").mapInPandas(verify, "a bigint, b bigint, similarity double")


def _groups(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of ascending sizes whose number times the largest stays within ``most``, one member at least."""
    at = 0
    while at < len(sizes):
        end = at + 1
        while end < len(sizes) and (end + 1 - at) * sizes[end] <= most:
            end += 1
        yield slice(at, end)
        at = end


def pairs(records: DataFrame, key: str, columns: list[str], threshold: float) -> DataFrame:
    """``(key_a, key_b, similarity)``: all pairs of different records that are similar enough, the smaller key first.

    Records without any word are like nothing.  A record delivered twice counts once.
    """
    members, texts = classes(records, key, columns)
    found = durable(similar(texts, threshold), "similar")
    named = members.join(texts.select("cid", "class").hint("merge"), "class").select("cid", key).hint("merge")
    # Only classes with several members pair within themselves.
    several = named.groupBy("cid").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(1.0).alias("similarity"))
    links = found.unionByName(several)
    out = (
        links.join(named.select(F.col("cid").alias("a"), F.col(key).alias("ka")), "a")
        .join(named.select(F.col("cid").alias("b"), F.col(key).alias("kb")), "b")
        .where((F.col("a") != F.col("b")) | (F.col("ka") < F.col("kb")))
    )
    return out.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b"), "similarity")
