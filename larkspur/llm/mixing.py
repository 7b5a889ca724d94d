"""Mixing sources to target weights by fitting token budgets exactly.

Documents are counted by exact token length within each source. A source's budget is first shared out over its lengths in
proportion; what remains is a bounded subset sum over the lengths left, solved by dynamic programming on bit sets. The
counts by length are then drawn in a seeded order. Only (source, length, count) goes to the solver, a group a source, so
neither the driver nor any task ever holds a list of documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import OWN, columns_of, finished, materialize, row_hash, seeded, without
from larkspur.llm.token_counts import TOKENIZER, token_count

#: Weights where none are given: each source's tokens to this power, which flattens a dominant source.
ALPHA = 0.7
#: Tokens of a source's budget that are left to the exact solver at most, and the part of it that is at first.
SLACK, ROOM = 1 << 14, 8
#: Sources that hold this part of the weights or less together don't limit a mixture without a budget.
MINOR = 0.02
#: Parts of the seeded order that are counted apart, a power of two.
SLOTS = 1024
#: Cutoffs (one a source and length) that may be broadcast, some 80 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def bounded_subset_sum(lengths: list[int], counts: list[int], target: int) -> list[int]:
    """How many of each length to take, at most counts, so that the sum is as near target as it can be without passing it.

    Multiplicities are split in binary; each part shifts a bit set of reachable sums. It ends early once target is reached.
    """
    take, parts, reach, full = [0] * len(lengths), [], 1, (1 << (target + 1)) - 1
    for i, (length, count) in enumerate(zip(lengths, counts)):
        left, part = min(count, target // length if length else 0), 1
        while left > 0 and not reach >> target & 1:
            part = min(part, left)
            parts.append((i, part, reach))
            reach |= reach << part * length & full
            left, part = left - part, part * 2
    best = reach.bit_length() - 1
    for i, part, before in reversed(parts):
        if not before >> best & 1:
            take[i] += part
            best -= part * lengths[i]
    return take


def in_proportion(lengths: np.ndarray, counts: np.ndarray, tokens: int) -> np.ndarray:
    """How many documents of each length for some `tokens` in all: about the same part everywhere, evenly along the lengths."""
    order, part = np.argsort(lengths, kind="stable"), tokens / int((lengths * counts).sum())
    upto = np.floor(np.cumsum(counts[order]) * part + 0.5).astype(np.int64)
    take = np.zeros(len(counts), np.int64)
    take[order] = np.diff(upto, prepend=0)
    return np.minimum(take, counts)


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, slack: int = SLACK) -> np.ndarray:
    """How many documents of each length (distinct, positive) come as near budget as can be without passing it.

    At every budget each length gives its share first, and the solver has what is left: a ROOM-th part of the budget, at most
    slack. Where that doesn't meet the budget (up to slack: the best there is), the solver gets twice as much, up to slack.
    """
    total, budget = int((lengths * counts).sum()), max(0, budget)
    if budget >= total:
        return counts.copy()
    order = [int(i) for i in np.argsort(-lengths, kind="stable")]

    def solve(take: np.ndarray, rest: int) -> np.ndarray:
        some = [i for i in order if lengths[i] <= rest and take[i] < counts[i]]
        take = take.copy()
        for i, n in zip(some, bounded_subset_sum([int(lengths[i]) for i in some], [int(counts[i] - take[i]) for i in some], rest)):
            take[i] += n
        return take

    used = lambda take: int((lengths * take).sum())
    found = solve(np.zeros(len(counts), np.int64), budget) if budget <= slack else None
    goal, most, nearest = budget if found is None else used(found), min(budget, slack), None
    room = min(most, budget // ROOM)
    while True:
        aim = budget - room
        take = in_proportion(lengths, counts, aim)
        while (rest := budget - used(take)) < room // 2:  # the solver needs some room
            aim = max(0, aim - max(1, room // 8, room // 2 - rest))
            take = in_proportion(lengths, counts, aim)
        take = solve(take, rest)
        if nearest is None or used(take) > used(nearest):
            nearest = take
        if used(nearest) == goal or room >= most:
            return nearest if found is None or used(nearest) == goal else found
        room = min(most, max(1, 2 * room))


def level(tokens: DataFrame, budget: int | None) -> float:
    """Tokens a unit of weight, of sources with own have and own w.

    With a budget: such that sources with less than their share give all they have and the others make up for it. None: as many
    as all sources have but those with the least, which hold no more than MINOR of all weights together.
    """
    have, w = F.col(OWN + "have"), F.col(OWN + "w")
    if budget is None:
        # Bins of one per cent, some thousand at any number of sources.
        bins = tokens.groupBy(F.floor(F.log2(have / w) * 64).alias("bin")).agg(F.sum(w), F.min(have / w)).orderBy("bin").collect()
        left = MINOR * sum(r[1] for r in bins)
        for _, weight, least in bins:
            left -= weight
            if left < 0:
                return least
        return 0.0
    found = 0.0
    while True:  # more sources are short each time
        short = have <= w * found
        given, weights = tokens.agg(F.sum(F.when(short, have)), F.sum(F.when(~short, w))).first()
        more = (budget - (given or 0)) / weights if weights else found
        if more <= found * (1 + 1e-12):
            return found
        found = more


def plan(histogram: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, alpha: float = ALPHA, slack: int = SLACK) -> DataFrame:
    """(source, n_tokens, take) from (source, n_tokens, n_docs); lengths of which none is taken are left out.

    weights: by source, in any unit; a source that has none gets nothing. None: tokens to the power alpha. budget: tokens of
    the mixture; None: as many as the weights allow without repeating a document, but for sources that hold little of the
    weights (see level). A source with less than its share gives all it has, and the others share out the rest of a budget.
    """
    tokens = histogram.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_docs")).alias(OWN + "have"))
    if weights is None:
        tokens = tokens.withColumn(OWN + "w", F.pow(F.col(OWN + "have"), F.lit(float(alpha))))
    else:
        given = histogram.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], f"{OWN}s string, {OWN}w double")
        tokens = tokens.join(given, F.col("source").eqNullSafe(F.col(OWN + "s")), "left").drop(OWN + "s")
    tokens = tokens.where(F.col(OWN + "w") > 0)
    share = F.floor(F.round(F.col(OWN + "w") * F.lit(level(tokens, budget)), 2)).cast("long")  # rounded: the order of summing mustn't matter
    shares = tokens.select(F.col("source").alias(OWN + "source"), share.alias(OWN + "share"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n_tokens", ignore_index=True)
        take = fit_counts(rows["n_tokens"].to_numpy(np.int64), rows["n_docs"].to_numpy(np.int64), int(rows[OWN + "share"].iloc[0]), slack)
        return pd.DataFrame({"source": rows["source"], "n_tokens": rows["n_tokens"], "take": take})[take > 0]

    joined = histogram.join(shares, F.col("source").eqNullSafe(F.col(OWN + "source"))).select("source", "n_tokens", "n_docs", OWN + "share")
    return joined.groupBy("source").applyInPandas(solve, "source string, n_tokens long, take long")


def draw(counted: DataFrame, takes: DataFrame) -> DataFrame:
    """Of counted (with source, n_tokens and own order, text, hash) the first `take` rows of each source and length, in that order.

    The order is a seeded hash, so its first bits cut each length into SLOTS of like size. Slots before the one where `take`
    is reached go whole, ranks are counted within that one only, and each length gets one cutoff: no task ever holds all
    rows of a length, and whole rows stay where they are. Rows at a cutoff that are alike in all columns are counted too.
    """
    order = [OWN + c for c in ("order", "text", "hash")]
    slot = F.shiftright(OWN + "order", 64 - SLOTS.bit_length() + 1)
    thin = counted.select("source", "n_tokens", *order, slot.alias(OWN + "slot"))
    takes = takes.select(F.col("source").alias(OWN + "source"), F.col("n_tokens").alias(OWN + "n"), F.col("take").alias(OWN + "take"))
    same = F.col("source").eqNullSafe(F.col(OWN + "source")) & (F.col("n_tokens") == F.col(OWN + "n"))
    upto = Window.partitionBy("source", "n_tokens").orderBy(OWN + "slot")
    slots = thin.groupBy("source", "n_tokens", OWN + "slot").agg(F.count(F.lit(1)).alias(OWN + "count"))
    slots = slots.withColumn(OWN + "upto", F.sum(OWN + "count").over(upto)).join(takes, same)
    last = slots.where((F.col(OWN + "upto") >= F.col(OWN + "take")) & (F.col(OWN + "upto") - F.col(OWN + "count") < F.col(OWN + "take")))
    last = last.select(OWN + "source", OWN + "n", F.col(OWN + "slot").alias(OWN + "last"), (F.col(OWN + "take") - F.col(OWN + "upto") + F.col(OWN + "count")).alias(OWN + "need"))
    # Of the last slot: how many rows come before each kind of row, and how many are alike.
    kinds = thin.join(last, same & (F.col(OWN + "slot") == F.col(OWN + "last"))).groupBy("source", "n_tokens", OWN + "need", *order).agg(F.count(F.lit(1)).alias(OWN + "alike"))
    within = Window.partitionBy("source", "n_tokens").orderBy(*order)
    kinds = kinds.withColumn(OWN + "upto", F.sum(OWN + "alike").over(within))
    cut = kinds.where((F.col(OWN + "upto") >= F.col(OWN + "need")) & (F.col(OWN + "upto") - F.col(OWN + "alike") < F.col(OWN + "need")))
    cut = cut.select(
        F.col("source").alias(OWN + "source"), F.col("n_tokens").alias(OWN + "n"), F.struct(*order).alias(OWN + "cut"),
        F.when(F.col(OWN + "upto") > F.col(OWN + "need"), F.col(OWN + "need") - F.col(OWN + "upto") + F.col(OWN + "alike")).alias(OWN + "some"),
    )
    cut = materialize(cut, "cutoffs")
    size, split = cut.agg(F.count(F.lit(1)), F.count(OWN + "some")).first()
    reached = counted.join(F.broadcast(cut) if size <= BROADCAST_ROWS else cut, same & (F.struct(*order) <= F.col(OWN + "cut")))
    if split:  # of the rows alike at these cutoffs only some are drawn; which is the same
        apart = F.col(OWN + "some").isNotNull() & (F.struct(*order) == F.col(OWN + "cut"))
        ranked = reached.where(apart).withColumn(OWN + "rank", F.row_number().over(Window.partitionBy("source", "n_tokens").orderBy(*order)))
        reached = reached.where(~apart).unionByName(ranked.where(F.col(OWN + "rank") <= F.col(OWN + "some")).drop(OWN + "rank"))
    return reached.select(*[c for c in counted.columns if c not in order])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, alpha: float = ALPHA, seed: int = 17, slack: int = SLACK, tokenizer: str = TOKENIZER, columns: list[str] | None = None, lengths: bool = True) -> DataFrame:
    """The documents of the mixture: columns (all by default) and, with lengths, n_tokens. docs has doc_id, text and source.

    Null and empty texts hold no tokens and are never drawn. A null source is a source of its own. A document of any length
    counts whole. Repeated rows are documents of their own; ties in the seeded order (rows with the same doc_id) fall to the
    hash of the text, then to that of the columns asked for, and beyond that the rows are alike. An empty table gives an empty one. With
    lengths, an input column n_tokens is replaced; other columns may have any name.
    """
    docs = without(docs, "n_tokens") if lengths else docs
    columns = columns or docs.columns
    # The row goes along in a struct, so that its names can't clash with those used here.
    counted = docs.select(
        F.struct(*columns_of(docs, columns)).alias(OWN + "row"), "source", token_count("text", tokenizer).alias("n_tokens"),
        seeded(seed, "doc_id").alias(OWN + "order"), F.xxhash64("text").alias(OWN + "text"), row_hash(docs, columns).alias(OWN + "hash"),
    ).where(F.col("n_tokens") > 0)
    counted = materialize(counted, "lengths")  # encoded once
    takes = finished(docs.sparkSession, lambda: plan(histogram_of(counted), weights, budget, alpha, slack), "takes")
    drawn = draw(counted, takes)
    return drawn.select(OWN + "row.*", "n_tokens") if lengths else drawn.select(OWN + "row.*")


def histogram_of(counted: DataFrame) -> DataFrame:
    return materialize(counted.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "histogram")
