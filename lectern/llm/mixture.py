"""Mixing sources to target shares of a token budget.

Sources get integer quotas of equal-token blocks by the Sainte-Laguë method (the highest quotients ``w / (2q + 1)``
are served first, which is rounding ``w / d`` to the nearest integer under one common divisor ``d``), each up to what
its documents hold when used ``max_repeats`` times.  A source's quota is then apportioned over its hash shards by the
same rule, and within a shard a seeded order of the documents is cut into blocks and served from the front.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.session import durable

#: Tokens of a block.
BLOCK = 512
#: Documents that a shard holds on average; a shard is one window group.
SHARD_ROWS = 20_000
#: Sources whose totals may come to the driver: the target table is a list kept by people.
MAX_SOURCES = 100_000


def sainte_lague(weights: Sequence[float], caps: Sequence[int], seats: int) -> list[int]:
    """Integer quotas that sum to ``min(seats, sum(caps))``, none above its cap.

    Ties go to the earlier entry; entries of weight 0 get nothing.  Without caps it is the plain method.
    """
    w = np.asarray(weights, dtype=float)
    cap = np.where(w > 0, np.asarray(caps, dtype=np.int64), 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0:
        return [0] * len(w)

    def at(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(w / divisor + 0.5).astype(np.int64), cap)

    low, high = w[w > 0].min() / (2.0 * cap.max() + 4), w.max() * 4  # many seats, none
    for _ in range(200):
        middle = (low + high) / 2
        if at(middle).sum() > seats:
            low = middle
        else:
            high = middle
    quota = at(high)
    while quota.sum() < seats:  # the entries that tie at the last divisor
        quotient = np.where(quota < cap, w / (2 * quota + 1), -1.0)
        quota[int(np.argmax(quotient))] += 1
    return [int(q) for q in quota]


def mix(counted: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Documents with their number of uses, and the shares that come out.

    ``counted`` has doc_id, source, n_tokens; ``targets`` has source, target_share, max_repeats.  ``total_tokens`` is
    the size of the mixture, by default what the documents of all targeted sources hold once.  Returns
    ``(doc_id, source, n_tokens, uses)`` for every document used at least once and ``(source, target_share,
    actual_share, target_tokens, actual_tokens, available_tokens, max_repeats)`` for every target.

    Documents of a null source or one without target are not used; a target without documents gets share 0; a source
    too small for its target is used ``max_repeats`` times as a whole and the rest goes to the others in proportion.
    Documents without tokens are never drawn.  Repeated target rows count once.
    """
    spark = counted.sparkSession
    targets = targets.select("source", "target_share", "max_repeats").where("source is not null").distinct()
    listed = targets.limit(MAX_SOURCES + 1).toPandas().sort_values("source", ignore_index=True)
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    held = (
        counted.where("n_tokens > 0")
        .join(F.broadcast(targets.select("source")), "source", "left_semi")
        .select("doc_id", "source", "n_tokens")
    )
    held = durable(held, "held")
    totals = held.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).toPandas()
    listed = listed.merge(totals, on="source", how="left").fillna({"tokens": 0, "n": 0, "target_share": 0.0, "max_repeats": 0})
    listed["tokens"], listed["n"] = listed["tokens"].astype("int64"), listed["n"].astype("int64")
    total = int(listed["tokens"].sum()) if total_tokens is None else int(total_tokens)
    listed["cap"] = -(-listed["tokens"] * listed["max_repeats"].clip(lower=0).astype("int64") // block)
    listed["quota"] = sainte_lague(listed["target_share"].clip(lower=0), listed["cap"], round(total / block))
    listed["shards"] = 1 + listed["n"] // SHARD_ROWS

    plan = spark.createDataFrame(
        listed[["source", "quota", "shards", "max_repeats"]].astype({"quota": "int64", "shards": "int64", "max_repeats": "int64"}),
        "source string, quota bigint, shards bigint, max_repeats bigint",
    )
    placed = held.join(F.broadcast(plan), "source").withColumns(
        {"order": F.xxhash64(F.lit(seed), "source", "doc_id"), "shard": F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("shards"))}
    )

    def over_shards(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard", ignore_index=True)
        caps = -(-pdf["held"] * pdf["max_repeats"] // block)
        pdf["blocks"] = sainte_lague(pdf["held"], caps, int(pdf["quota"].iloc[0]))
        return pdf[["source", "shard", "held", "blocks"]]

    shards = (
        placed.groupBy("source", "shard", "quota", "max_repeats")
        .agg(F.sum("n_tokens").alias("held"))
        .groupBy("source")
        .applyInPandas(over_shards, "source string, shard bigint, held bigint, blocks bigint")
    )
    inside = W.partitionBy("source", "shard").orderBy("order", "doc_id")
    wanted = F.least(F.col("blocks") * block, F.col("held") * F.col("max_repeats"))
    used = (
        placed.join(shards, ["source", "shard"])
        .withColumn("before", F.sum("n_tokens").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens"))
        .withColumn("passes", F.floor(wanted / F.col("held")))
        .withColumn("rest", wanted - F.col("passes") * F.col("held"))
        .withColumn("uses", (F.col("passes") + F.when(F.col("before") + F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)).cast("int"))
        .where("uses > 0")
        .select("doc_id", "source", "n_tokens", "uses")
    )
    used = durable(used, "mixture")
    drawn = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("actual_tokens"))
    facts = spark.createDataFrame(
        listed[["source", "target_share", "tokens", "max_repeats"]].astype({"max_repeats": "int64"}),
        "source string, target_share double, available_tokens bigint, max_repeats bigint",
    )
    drawn_tokens = used.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("uses")), F.lit(0))).first()[0]
    shares = (
        facts.join(drawn, "source", "left")
        .select(
            "source",
            "target_share",
            F.coalesce(F.try_divide(F.coalesce("actual_tokens", F.lit(0)), F.lit(drawn_tokens)), F.lit(0.0)).alias("actual_share"),
            F.round(F.col("target_share") * total).cast("bigint").alias("target_tokens"),
            F.coalesce("actual_tokens", F.lit(0)).alias("actual_tokens"),
            "available_tokens",
            "max_repeats",
        )
    )
    return used, shares
