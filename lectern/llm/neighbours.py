"""The k most similar vectors of every vector.

Vectors are routed to shards by the nearest of a set of pivots; each shard holds a directed graph whose edges are
chosen by robust pruning (Subramanya et al., "DiskANN", 2019): greedy beam searches from an entry point propose
neighbours, and a candidate is kept only if no kept neighbour is closer to it by the factor ``alpha``, so that
diverse edges survive.  Beam search answers the queries of each shard: its own members and the vectors for which it is
the second, third ... nearest shard.  All searches of a shard advance in lockstep as matrix work.  The proposals meet
by query, and exact cosines in double precision, rounded to six decimals, give the final order.

Vectors of one direction are one node of the graph, whatever their lengths: its members share its answers and each
other, so a vector repeated in a third of all rows, rescaled or not, costs one search.  No tie is cut before ids are
compared: a shard keeps whatever may equal its k-th answer at six decimals, scanning all of its nodes where more tie
than a beam holds, and where the small differences of a node's vectors may change a sixth decimal, its vectors are
compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.session import durable

#: Vectors of a shard on average, and rows of the bounded sample to which the pivots are fitted.
SHARD = 4_000
SAMPLE = 40_000
#: Shards that each vector is stored in and searched in.
PROBES = 2
#: A shard that receives more than this many times ``SHARD`` rows gets pivots of its own, in so many rounds; what no
#: pivots can part is cut at random, and each part answers all of the shard's queries.
MOST, ROUNDS = 4, 6
#: Cells of the table of nodes that the queries of a batch have seen; it sets the size of a batch.
SEEN = 50_000_000
#: Edges of a node, width of a beam, relaxation of the pruning.
DEGREE = 24
BEAM = 40
ALPHA = 1.2
#: Width of the cells of normalised numbers that make a node: in 64 dimensions any two vectors of a cell have a cosine
#: above 1 - 3.2e-7, which is 1 at six decimals.
CELL = 1e-4


def usable(points: DataFrame, size: int) -> DataFrame:
    """``(point_id, vector)`` once for each point whose vector has ``size`` numbers, none NaN or infinite, not all zero."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        points.select("point_id", "vector")
        .where(F.col("point_id").isNotNull() & (F.size(v) == size) & ~bad & F.exists(v, lambda x: x != 0))
        .dropDuplicates(["point_id"])
    )


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    scale = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / scale
    return (rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))).astype(np.float32)


def fit_pivots(sample: np.ndarray, n: int, seed: int = 5, rounds: int = 8) -> np.ndarray:
    """Directions of ``n`` pivots by spherical k-means from random rows, so dense regions get more of them."""
    rng = np.random.default_rng(seed)
    n = max(1, min(n, len(sample)))
    pivots = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(rounds if n > 1 else 1):
        owner = np.concatenate([(part @ pivots.T).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        sums = np.zeros_like(pivots)
        np.add.at(sums, owner, sample)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        pivots = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), pivots).astype(np.float32)
    return pivots


class Graph:
    """A robust-pruned directed graph over unit vectors, built and searched in lockstep batches."""

    def __init__(self, data: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 3):
        self.data, self.degree, self.alpha = np.ascontiguousarray(data, dtype=np.float32), degree, alpha
        n = len(data)
        self.edges = np.full((n, degree), -1, dtype=np.int32)
        order = np.random.default_rng(seed).permutation(n)
        # Searches start at the best of some scattered nodes: in clustered data one entry would reach few clusters.
        self.entries = order[: min(n, max(32, int(4 * n**0.5)))].copy()
        at = len(self.entries)
        first = self.data[self.entries]
        near = np.argsort(-(first @ first.T), axis=1, kind="stable")[:, 1 : beam + 1]
        if near.shape[1]:
            self._connect(self.entries, self.entries[near])
        # Batches grow with what is already connected, so a search always meets most of the graph.
        while at < n:
            batch = order[at : at + min(max(16, at), self.batch())]
            visited: list[np.ndarray] = []
            ids, _ = self.search(self.data[batch], beam, beam, visited=visited)
            self._connect(batch, np.concatenate([ids, *visited], axis=1))
            at += len(batch)

    def batch(self, most: int = 2048) -> int:
        """How many queries to search for at once."""
        return max(1, min(most, SEEN // max(1, len(self.data))))

    def search(self, queries: np.ndarray, k: int, beam: int, width: int = 4, visited: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the ``k`` best found for each query, best first, -1 where there are fewer.

        ``visited`` receives the expanded nodes that did not stay in the beam.
        """
        q, n = len(queries), len(self.data)
        ids = np.full((q, beam), -1, dtype=np.int32)
        sims = np.full((q, beam), -9.0, dtype=np.float32)
        done = np.ones((q, beam), dtype=bool)
        starts = min(len(self.entries), max(1, beam // 2))
        begin = queries @ self.data[self.entries].T
        best = np.argpartition(-begin, starts - 1, axis=1)[:, :starts]
        ids[:, :starts], sims[:, :starts], done[:, :starts] = self.entries[best], np.take_along_axis(begin, best, axis=1), False
        seen = np.zeros((q, n), dtype=bool)
        np.put_along_axis(seen, self.entries[best], True, axis=1)
        live = np.arange(q)
        while len(live):
            waiting = np.where(done[live], -9.0, sims[live])
            pick = np.argpartition(-waiting, width - 1, axis=1)[:, :width] if beam > width else np.argsort(-waiting, axis=1)[:, :width]
            ready = np.take_along_axis(waiting, pick, axis=1) > -9.0
            keep = ready.any(axis=1)
            live, pick, ready = live[keep], pick[keep], ready[keep]
            if not len(live):
                break
            done[live[:, None], pick] = True
            nodes = np.where(ready, ids[live[:, None], pick], -1)
            if visited is not None:
                log = np.full((q, width), -1, dtype=np.int32)
                log[live] = nodes
                visited.append(log)
            near = np.where(nodes[:, :, None] >= 0, self.edges[nodes], -1).reshape(len(live), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = (near >= 0) & ~seen[live[:, None], near]
            rows, cols = np.nonzero(fresh)
            seen[live[rows], near[rows, cols]] = True
            got = np.full(near.shape, -9.0, dtype=np.float32)
            got[rows, cols] = np.einsum("ij,ij->i", queries[live[rows]], self.data[near[rows, cols]])
            all_sims = np.concatenate([sims[live], got], axis=1)
            all_ids = np.concatenate([ids[live], near], axis=1)
            all_done = np.concatenate([done[live], ~fresh], axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[live] = np.take_along_axis(all_sims, best, axis=1)
            ids[live] = np.take_along_axis(all_ids, best, axis=1)
            done[live] = np.take_along_axis(all_done, best, axis=1)
        best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        ids, sims = np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)
        ids[sims <= -9.0] = -1
        return ids, sims

    def prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Edges of each node out of its candidates (-1: none): nearest first, each kept one removes those it covers."""
        candidates = np.sort(candidates, axis=1)
        usable = (candidates >= 0) & (candidates != nodes[:, None])
        usable[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
        here, there = self.data[nodes], self.data[candidates]
        to_node = np.einsum("bd,bcd->bc", here, there)
        between = there @ there.transpose(0, 2, 1)
        out = np.full((len(nodes), self.degree), -1, dtype=np.int32)
        # Squared distances of unit vectors; alpha stretches the covering distance.
        far, apart = 2 - 2 * to_node, 2 - 2 * between
        rows = np.arange(len(nodes))
        for slot in range(self.degree):
            score = np.where(usable, to_node, -9.0)
            best = score.argmax(axis=1)
            some = score[rows, best] > -9.0
            if not some.any():
                break
            out[some, slot] = candidates[some, best[some]]
            usable &= ~((self.alpha**2 * apart[rows, best] <= far) & some[:, None])
            usable[rows, best] = False
        return out

    def _connect(self, batch: np.ndarray, found: np.ndarray) -> None:
        for part, near in zip(np.array_split(batch, max(1, len(batch) // 512)), np.array_split(found, max(1, len(batch) // 512)), strict=True):
            self.edges[part] = self.prune(part, near)
        # Edges back, gathered by target; a node with too many is pruned again.
        source = np.repeat(batch, self.degree)
        target = self.edges[batch].ravel()
        real = target >= 0
        source, target = source[real], target[real]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        slot = np.arange(len(target)) - np.repeat(start, count)
        most = 2 * self.degree
        rows = np.repeat(np.arange(len(nodes)), count)
        inside = slot < most  # the rest already have an edge to the node
        back = np.full((len(nodes), most), -1, dtype=np.int32)
        back[rows[inside], slot[inside]] = source[inside]
        have = (self.edges[nodes] >= 0).sum(axis=1)
        fits = have + count <= self.degree
        for i in np.nonzero(fits)[0]:
            self.edges[nodes[i], have[i] : have[i] + count[i]] = back[i, : count[i]]
        crowded = np.nonzero(~fits)[0]
        for part in np.array_split(crowded, max(1, len(crowded) // 512)):
            if len(part):
                self.edges[nodes[part]] = self.prune(nodes[part], np.concatenate([self.edges[nodes[part]], back[part]], axis=1))


def _kept(lower: np.ndarray, upper: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Which answers of each row may be among its first ``k`` by similarity and rank; absent ones are below -1."""
    real = lower > -2
    if lower.shape[1] <= k:
        return real
    last = np.lexsort((rank, -lower), axis=-1)[:, k - 1 : k]
    least, first = np.take_along_axis(lower, last, axis=1), np.take_along_axis(rank, last, axis=1)
    return real & ((upper > least) | ((upper == least) & (rank <= first)))


def _shard_answers(k: int, beam: int):
    """Answers of one shard, or of one part of it: ``(node, near, lower, upper)`` for the rows that ask, out of the rows
    that are held; the bounds of the cosine of any two of their vectors, at six decimals."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node", ignore_index=True)
        raw = np.stack(pdf["vector"].to_numpy()).astype("f8")
        every = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))
        node, spread = pdf["node"].to_numpy(), pdf["radius"].to_numpy()
        held, asked = pdf["held"].to_numpy(), np.flatnonzero(pdf["asked"].to_numpy())
        exact, names, radius = every[held], node[held], spread[held]
        rank = pdf["first"][held].rank(method="first").to_numpy().astype("int64")
        out: list[pd.DataFrame] = [pd.DataFrame({"node": node[:0], "near": node[:0], "lower": spread[:0], "upper": spread[:0]})]
        if not len(exact):
            return out[0]
        graph = Graph(unit(raw[held]), seed=3 + int(pdf["shard"].iloc[0]))

        def bounds(queries: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            around = spread[queries][:, None] + radius[ids]
            absent = (ids < 0) | (names[ids] == node[queries][:, None])
            return tuple(np.where(absent, -9.0, np.round(x, 6)) for x in (sims - around, sims + around))

        def keep(queries: np.ndarray, ids: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> None:
            rows, cols = np.nonzero(_kept(lower, upper, rank[ids], k))
            out.append(pd.DataFrame({"node": node[queries[rows]], "near": names[ids[rows, cols]], "lower": lower[rows, cols], "upper": upper[rows, cols]}))

        step = graph.batch()
        for start in range(0, len(asked), step):
            queries = asked[start : start + step]
            ids, near = graph.search(every[queries].astype(np.float32), max(beam, k + 1), max(beam, k + 1))
            lower, upper = bounds(queries, ids, np.einsum("ij,icj->ic", every[queries], exact[ids]))
            # Where the last of a full beam may still tie with the k-th, others may too: all of the shard is compared.
            kth = -np.sort(-lower, axis=1)[:, k - 1]
            open_ = (ids[:, -1] >= 0) & (near[:, -1] + spread[queries] + radius.max() + 2e-6 >= kth)
            keep(queries[~open_], ids[~open_], lower[~open_], upper[~open_])
            for some in np.array_split(queries[open_], -(-open_.sum() // 256)) if open_.any() else ():
                all_ids = np.broadcast_to(np.arange(len(exact)), (len(some), len(exact)))
                keep(some, all_ids, *bounds(some, all_ids, every[some] @ exact.T))
        return pd.concat(out)

    return run


def _nearest_pivots(vectors: pd.Series, pivots: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest pivots of each vector, in no order."""
    m = min(probes, len(pivots))
    near = unit(np.stack(vectors.to_numpy())) @ pivots.T
    return np.argpartition(-near, m - 1, axis=1)[:, :m].astype("int32")


def fitted_shards(nodes: DataFrame, shard: int, probes: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Pivots, and into how many parts the shard of each must be cut at random.

    Pivots are fitted on at most ``sample`` rows; then every row is routed and counted, and a shard that receives more
    than ``MOST * shard`` rows is given pivots of its own, fitted on at most ``sample`` rows of such shards.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    rows = nodes.select("vector").sample(min(1.0, 1.2 * sample / max(1, n)), seed=11).limit(sample).toPandas()
    if not len(rows):
        rows = nodes.select("vector").limit(sample).toPandas()
    pivots = fit_pivots(unit(np.stack(rows["vector"].to_numpy())), -(-n // shard))
    for at in range(rounds + 1):
        shared = spark.sparkContext.broadcast(pivots)

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    ids, n = np.unique(_nearest_pivots(pdf["vector"], shared.value, probes), return_counts=True)
                    yield pd.DataFrame({"shard": ids, "n": n.astype("int64")})

        sizes = nodes.select("vector").mapInPandas(count, "shard int, n bigint").groupBy("shard").agg(F.sum("n").alias("n"))
        over = sizes.where(F.col("n") > MOST * shard).toPandas().sort_values("shard", ignore_index=True)
        parts = np.ones(len(pivots), dtype=np.int64)
        if not len(over) or at == rounds:
            parts[over["shard"]] = -(-over["n"] // (MOST * shard // 2))
            return pivots, parts
        wanted = spark.sparkContext.broadcast(over["shard"].to_numpy())

        def crowded(batches: Iterator[pd.DataFrame], shared=shared, wanted=wanted) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    owner = _nearest_pivots(pdf["vector"], shared.value, 1)[:, 0]
                    kept = np.isin(owner, wanted.value)
                    yield pd.DataFrame({"shard": owner[kept], "vector": pdf["vector"][kept]})

        within = nodes.select("vector").sample(min(1.0, 1.2 * sample / over["n"].sum()), seed=12 + at).mapInPandas(crowded, "shard int, vector array<float>").limit(sample).toPandas()
        new = [pivots[np.setdiff1d(np.arange(len(pivots)), within["shard"])]]
        for owner, group in within.groupby("shard"):
            size = int(over["n"][over["shard"] == owner].iloc[0])
            new.append(fit_pivots(unit(np.stack(group["vector"].to_numpy())), -(-size // shard), seed=5 + at))
        pivots = np.concatenate(new)
    raise AssertionError


def nearest(points: DataFrame, k: int = 10, size: int = 64, probes: int = PROBES, beam: int = BEAM, shard: int = SHARD) -> DataFrame:
    """``(point_id, neighbour_id, sim, rank)``: the ``k`` most similar other points of each usable point.

    Order is by cosine in double precision rounded to 6 decimals, then by the smaller id; a point is not its own
    neighbour.  Unusable vectors (null, other size, NaN, all zero) have no row and are nobody's neighbour; fewer
    than ``k`` other points give fewer rows.  The neighbours are those the graphs find: see the README for recall.
    """
    spark = points.sparkSession
    # One node for each direction; its members in order of id, the first k + 1 of them kept beside it.
    rows = durable(usable(points, size).withColumn("node", _direction("vector")).withColumn("raw", F.xxhash64("vector")), "usable")
    variants = durable(rows.groupBy("node", "raw").agg(F.min("point_id").alias("first"), F.min_by("vector", "point_id").alias("vector")), "variants")
    nodes = variants.groupBy("node").agg(F.min_by("vector", "first").alias("vector"), F.min("first").alias("first"), F.count("*").alias("n"))
    several = nodes.where("n > 1").select("node", F.col("vector").alias("centre")).hint("merge")
    radii = variants.join(several, "node").groupBy("node").agg(F.max(_apart("vector", "centre")).alias("radius"))
    nodes = durable(nodes.join(radii, "node", "left").select("node", "vector", "first", F.coalesce("radius", F.lit(0.0)).alias("radius")), "nodes")
    n = nodes.count()
    if not n:
        return spark.createDataFrame([], "point_id string, neighbour_id string, sim double, rank int")
    # At most a quarter as many pivots as the sample has rows, which bounds the broadcast; beyond that shards grow.
    shared = spark.sparkContext.broadcast(fitted_shards(nodes, max(shard, -(-4 * n // SAMPLE)), probes))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, parts = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            best = _nearest_pivots(pdf["vector"], pivots, probes)
            row, owner = np.repeat(np.arange(len(pdf)), best.shape[1]), best.ravel()
            part, chunk = np.zeros(len(row), dtype="int32"), np.zeros(len(row), dtype="int32")
            held = asked = np.ones(len(row), dtype=bool)
            if (parts[owner] > 1).any():
                # Held in one part beside every chunk of queries, and asked in every part within one chunk.
                own = (pdf["node"].to_numpy()[row] & 0x7FFFFFFF) % parts[owner]
                cells = [[(o, j) for j in range(p)] + [(i, o) for i in range(p) if i != o] for o, p in zip(own, parts[owner], strict=True)]
                times = np.array([len(c) for c in cells])
                part, chunk = np.array([x for c in cells for x in c], dtype="int32").T
                row, owner, own = np.repeat(row, times), np.repeat(owner, times), np.repeat(own, times)
                held, asked = part == own, chunk == own
            frame = pdf[["node", "vector", "first", "radius"]].iloc[row].reset_index(drop=True)
            yield frame.assign(shard=owner, part=part, chunk=chunk, held=held, asked=asked)

    routed = nodes.select("node", "vector", "first", "radius").mapInPandas(
        route, "node bigint, vector array<float>, first string, radius double, shard int, part int, chunk int, held boolean, asked boolean"
    )
    proposals = routed.groupBy("shard", "part", "chunk").applyInPandas(_shard_answers(k, beam), "node bigint, near bigint, lower double, upper double")
    best = W.partitionBy("node").orderBy(F.desc("lower"))
    # A proposal serves both of its ends; all that may tie with the k-th stay until ids are compared.
    proposals = durable(proposals, "answers")
    proposals = proposals.unionByName(proposals.select(F.col("near").alias("node"), F.col("node").alias("near"), "lower", "upper"))
    proposals = proposals.dropDuplicates(["node", "near"]).withColumn("rn", F.row_number().over(best))
    proposals = proposals.withColumn("least", F.max(F.when(F.col("rn") == k, F.col("lower"))).over(W.partitionBy("node")))
    proposals = durable(proposals.where("least IS NULL OR upper >= least").drop("rn", "least"), "proposals")
    settled = proposals.where("lower = upper").select("node", "near", F.col("lower").alias("sim"))
    # Where vectors of the two nodes may differ in a sixth decimal, each is compared with each.
    a = variants.select("node", F.col("raw"), F.col("vector").alias("va")).hint("merge")
    b = variants.select(F.col("node").alias("near"), F.col("raw").alias("near_raw"), F.col("vector").alias("vb")).hint("merge")
    open_ = proposals.where("lower < upper").select("node", "near").join(a, "node").join(b, "near").select("node", "raw", "near", "near_raw", _cosine("va", "vb").alias("sim"))
    # The first members of each node, for the nodes that name it and for itself.
    first = W.partitionBy("node").orderBy("point_id")
    members = rows.select("point_id", "node").withColumn("rn", F.row_number().over(first)).where(f"rn <= {k + 1}").drop("rn")
    own = members.select("node", F.col("point_id").alias("neighbour_id"), F.lit(1.0).alias("sim"))
    others = settled.join(members.select(F.col("node").alias("near"), F.col("point_id").alias("neighbour_id")), "near").select("node", "neighbour_id", "sim")
    order = W.partitionBy("node").orderBy(F.desc("sim"), "neighbour_id")
    top = own.unionByName(others).withColumn("rn", F.row_number().over(order)).where(f"rn <= {k + 1}").drop("rn")
    in_raw = W.partitionBy("node", "raw").orderBy("point_id")
    firsts = rows.select("node", "raw", "point_id").withColumn("rn", F.row_number().over(in_raw)).where(f"rn <= {k + 1}").select(
        F.col("node").alias("near"), F.col("raw").alias("near_raw"), F.col("point_id").alias("neighbour_id")
    )
    of_raw = W.partitionBy("node", "raw").orderBy(F.desc("sim"), "neighbour_id")
    single = open_.join(firsts, ["near", "near_raw"]).withColumn("rn", F.row_number().over(of_raw)).where(f"rn <= {k}").select("node", "raw", "neighbour_id", "sim")
    listed = rows.select("point_id", "node").join(top, "node").unionByName(rows.select("point_id", "node", "raw").join(single, ["node", "raw"]).drop("raw"))
    listed = listed.where("point_id != neighbour_id")
    final = W.partitionBy("point_id").orderBy(F.desc("sim"), "neighbour_id")
    return listed.withColumn("rank", F.row_number().over(final)).where(f"rank <= {k}").select("point_id", "neighbour_id", "sim", "rank")


def _normed(column: pd.Series) -> np.ndarray:
    rows = np.stack(column.to_numpy()).astype("f8")
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _direction(vector: str):
    """Hash of the cell in which the normalised vector lies."""

    @F.pandas_udf("bigint")
    def direction(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int64")
        cells = np.rint(_normed(x) / CELL).astype("<i8")
        return pd.Series([int.from_bytes(hashlib.blake2b(c.tobytes(), digest_size=8).digest(), "little", signed=True) for c in cells], dtype="int64")

    return direction(vector)


def _apart(a: str, b: str):
    """Distance of two normalised vector columns."""

    @F.pandas_udf("double")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        difference = _normed(x) - _normed(y)
        return pd.Series(np.sqrt((difference * difference).sum(axis=1)))

    return apart(a, b)


def _cosine(a: str, b: str):
    """Cosine of two vector columns in double precision, rounded to 6 decimals."""

    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        x, y = np.stack(x.to_numpy()).astype("f8"), np.stack(y.to_numpy()).astype("f8")
        dot = np.einsum("ij,ij->i", x, y)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
        return pd.Series(np.round(dot / norm, 6))

    return cosine(a, b)


def pairs(neighbours: DataFrame) -> DataFrame:
    """``(point_id_a, point_id_b)``: pairs of which one is a neighbour of the other, the smaller id first."""
    return neighbours.select(
        F.least("point_id", "neighbour_id").alias("point_id_a"), F.greatest("point_id", "neighbour_id").alias("point_id_b")
    ).distinct()
