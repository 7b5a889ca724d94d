"""Best-fit packing of documents into bins of a fixed number of tokens, with large-item matching.

The packing is planned on the histogram of lengths, which has at most `capacity` entries at any size of the corpus, and
gives exactly what packing document by document would. Documents above a third of the capacity pair at most twice a
bin: each, largest first, takes the largest that still fits beside it. Smaller ones then go, largest first, into the fullest
bin that still has room. The plan is a list of runs (length, first rank, first bin, how many a bin, offset); documents get
their rank within their length by a distributed count, and look their bin up.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from larkspur.llm.common import OWN, materialize, partitions, seeded
from larkspur.llm.token_counts import TOKENIZER, token_count

#: Bits of a run's key that hold the rank.
RANK_BITS = 45


class Plan:
    """Runs of documents of one length placed alike: rank r of the length, from first on, lies in bin + (r - first) // each at
    offset + (r - first) % each * length."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.bins, self.runs = capacity, 0, []
        self.left = {n: c for n, c in histogram.items() if c > 0}
        self.placed = dict.fromkeys(self.left, 0)
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens: [(first bin, bins)]
        self.sizes: list[int] = []  # the gaps that there are, rising
        self._large(sorted((n for n in self.left if 3 * n > capacity), reverse=True))
        self._small(sorted((n for n in self.left if 3 * n <= capacity), reverse=True))
        if any(c >> RANK_BITS for c in histogram.values()):
            raise ValueError(f"more than 2^{RANK_BITS} documents of one length")

    def _run(self, length: int, count: int, bin_: int, each: int, offset: int) -> None:
        self.runs.append((length, self.placed[length], bin_, each, offset))
        self.placed[length] += count
        self.left[length] -= count

    def _free(self, gap: int, bin_: int, count: int) -> None:
        if gap > 0 and count > 0:
            if not self.gaps.setdefault(gap, []):
                bisect.insort(self.sizes, gap)
            self.gaps[gap].append((bin_, count))

    def _large(self, lengths: list[int]) -> None:
        up = lengths[::-1]
        below = list(range(len(up)))  # by length: the next one down, itself included, that may have documents left

        def partner(i: int) -> int:
            """The longest at i or below with documents left; -1 without any."""
            path = []
            while i >= 0 and not self.left[up[i]]:
                path.append(i)
                i = below[i] if below[i] < i else i - 1
            for j in path:
                below[j] = i
            return i

        for a in lengths:
            i = partner(bisect.bisect_right(up, min(a, self.capacity - a)) - 1)
            while self.left[a] and i >= 0:
                b = up[i]
                m = self.left[a] // 2 if a == b else min(self.left[a], self.left[b])
                if m:
                    if a == b:
                        self._run(a, 2 * m, self.bins, 2, 0)
                    else:
                        self._run(a, m, self.bins, 1, 0)
                        self._run(b, m, self.bins, 1, a)
                    self._free(self.capacity - a - b, self.bins, m)
                    self.bins += m
                i = partner(i - 1)
            if alone := self.left[a]:
                self._run(a, alone, self.bins, 1, 0)
                self._free(self.capacity - a, self.bins, alone)
                self.bins += alone

    def _small(self, lengths: list[int]) -> None:
        """The tightest gap that fits is always the least one that is large enough; lengths fall, so gaps below the present
        length wait for later."""
        for n in lengths:
            while self.left[n] and (i := bisect.bisect_left(self.sizes, n)) < len(self.sizes):
                gap = self.sizes[i]
                bin_, count = self.gaps[gap].pop()
                if not self.gaps[gap]:
                    del self.sizes[i]
                self._fill(n, gap, bin_, count)
            if self.left[n]:
                bin_, count = self.bins, -(-self.left[n] // (self.capacity // n))
                self.bins += count
                self._fill(n, self.capacity, bin_, count)

    def _fill(self, n: int, gap: int, bin_: int, count: int) -> None:
        """As many of length n as there are, into count bins with this gap, one bin after the other."""
        each = gap // n
        full = min(count, self.left[n] // each)
        if full:
            self._run(n, full * each, bin_, each, self.capacity - gap)
            self._free(gap - each * n, bin_, full)
        if full < count:
            some = min(self.left[n], each)
            if some:
                self._run(n, some, bin_ + full, each, self.capacity - gap)
                self._free(gap - some * n, bin_ + full, 1)
                full += 1
            self._free(gap, bin_ + full, count - full)

    def arrays(self) -> tuple[np.ndarray, ...]:
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        return (runs[:, 0] << RANK_BITS | runs[:, 1]), runs[:, 2], runs[:, 3], runs[:, 4]


def pieces(docs: DataFrame, capacity: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens): documents cut into full bins and a rest of less than a bin."""
    counted = docs.select("doc_id", F.xxhash64("text").alias(OWN + "text"), token_count("text", tokenizer).alias(OWN + "n"))
    counted = materialize(counted.where(F.col(OWN + "n") > 0), "lengths")
    last = F.floor((F.col(OWN + "n") - 1) / capacity)
    cut = counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return cut.select(
        "doc_id", OWN + "text", "piece", (F.col("piece") * capacity).alias("first_token"),
        F.least(F.lit(capacity).cast("long"), F.col(OWN + "n") - F.col("piece") * capacity).alias("n_tokens"),
    )


def ranked(rows: DataFrame, seed: int) -> DataFrame:
    """rows and their rank from 0 within n_tokens, without a task that holds all rows of a length: ranks within (length,
    salt), and the count of the salts before."""
    order = seeded(seed, "doc_id", "piece")
    rows = rows.withColumn(OWN + "order", order).withColumn(OWN + "salt", F.pmod(F.col(OWN + "order"), F.lit(partitions(rows))))
    keys = ["n_tokens", OWN + "salt"]
    before = Window.partitionBy("n_tokens").orderBy(OWN + "salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(OWN + "count"))
    counts = counts.select(*keys, F.coalesce(F.sum(OWN + "count").over(before), F.lit(0)).alias(OWN + "before"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(OWN + "order", "doc_id", OWN + "text", "piece")) - 1
    return rows.withColumn(OWN + "local", local).join(counts, keys).withColumn(OWN + "rank", F.col(OWN + "before") + F.col(OWN + "local"))


def pack(docs: DataFrame, capacity: int = 2048, seed: int = 17, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, bin_id, bin_offset): where each piece of each document lies.

    docs has doc_id and text; other columns are not read. A document longer than a bin is cut into full bins and one rest;
    nothing is dropped or truncated. Null and empty texts have no tokens and no rows. Rows with the same doc_id (null too)
    are documents of their own. Equal lengths are ranked by a seeded hash of doc_id, then doc_id and text; beyond that the
    rows are alike. An empty table gives an empty one.
    """
    cut = pieces(docs, capacity, tokenizer)
    # At most `capacity` rows come to the driver, whatever the size of the corpus.
    histogram = {r[0]: r[1] for r in cut.groupBy("n_tokens").count().collect()}
    keys, bins, each, offsets = Plan(histogram, capacity).arrays()

    @arrow_udf("struct<bin_id: bigint, bin_offset: bigint>")
    def place(n: pa.Array, rank: pa.Array) -> pa.Array:
        n, rank = n.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        i = np.searchsorted(keys, n << RANK_BITS | rank, side="right") - 1
        ahead = rank - (keys[i] & (1 << RANK_BITS) - 1)
        return pa.StructArray.from_arrays([pa.array(bins[i] + ahead // each[i]), pa.array(offsets[i] + ahead % each[i] * n)], ["bin_id", "bin_offset"])

    at = ranked(cut, seed).withColumn(OWN + "at", place("n_tokens", OWN + "rank"))
    return at.select("doc_id", "piece", "first_token", "n_tokens", OWN + "at.bin_id", OWN + "at.bin_offset")
