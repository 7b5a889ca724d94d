"""Approximate nearest neighbours with randomly rotated one-bit codes.

A vector is coded by the signs of its rotated residual to its cell's centre, packed to bits, and two scalars: the residual's
norm and its inner product with its own code. From these an inner product with any query is estimated without bias, with an
error bound that the scalars give; only vectors whose upper bound passes the k-th best so far are reranked on full vectors.
Vectors stay where their cells lie, and blocks of queries come to them, so nothing is copied with the square of the table. A query looks
at the cells nearest to its own; how many is found by a pilot that searches a bounded sample of queries exactly, so that the target
recall holds on clustered data with few cells and on shapeless data with as many as it takes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import finished, integer, materialize, partitions, seeded

#: Vectors of a cell, and vectors for each cell that centres are trained on.
CELL, TRAINING = 4096, 32
#: More cells than this are made in two steps: some on the driver, and on executors those within each. Their centres, which every task
#: has, take dimensions / 1,024 bytes a vector: 63 MB for 10^9 vectors of 64 dimensions.
ONE_STEP = 4096
#: Queries that the pilot searches exactly.
PILOT = 512
#: How many standard deviations of the estimate the error bound spans.
EPSILON = 1.9
#: Bytes of queries that are searched at once (every task has them), and tasks that search: each gives k rows a query at most.
QUERIES, SEARCHERS = 1 << 25, 64
_CODED = "id long, cell int, code binary, norm float, dot float, vec binary"


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _nearest(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(unit[i : i + 8192] @ centres.T).argmax(1) for i in range(0, len(unit), 8192)]) if len(unit) else np.zeros(0, np.int64)


def assign(unit: np.ndarray, centres: np.ndarray, tops: np.ndarray | None = None, first: np.ndarray | None = None) -> np.ndarray:
    """The cell of each unit vector. With tops: that nearest among the cells first[t] to first[t + 1] of its nearest top."""
    if tops is None:
        return _nearest(unit, centres)
    top, cell = _nearest(unit, tops), np.zeros(len(unit), np.int64)
    for t in np.unique(top):
        own = np.nonzero(top == t)[0]
        cell[own] = first[t] + _nearest(unit[own], centres[first[t] : first[t + 1]])
    return cell


def encode(unit: np.ndarray, centres: np.ndarray, turn: np.ndarray, tops: np.ndarray | None = None, first: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Of unit vectors: cell, packed signs, norm of the residual, inner product of the residual's direction with its code."""
    cell = assign(unit, centres, tops, first)
    residual = unit - centres[cell]
    norm = np.linalg.norm(residual, axis=1)
    turned = residual / np.maximum(norm, 1e-12)[:, None] @ turn.T
    signs = turned >= 0
    dot = np.abs(turned).sum(1) / np.sqrt(unit.shape[1])
    return cell, np.packbits(signs, axis=1), norm.astype(np.float32), dot.astype(np.float32)


def estimate(queries: np.ndarray, codes: np.ndarray, norm: np.ndarray, dot: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The estimated inner products (query, vector) of one cell's vectors, and the half-width of each vector's bound."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32)
    signs = (signs * 2 - 1) / np.float32(np.sqrt(dim))
    scale = norm / np.maximum(dot, 1e-6)
    found = (queries @ turn.T) @ (signs * scale[:, None]).T
    found += (queries @ centre)[:, None]
    width = EPSILON * scale * np.sqrt(np.maximum(0, 1 - dot**2) / max(1, dim - 1))
    return found, width.astype(np.float32)


def _unit(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of vectors of this dimension with a direction, and them at length one."""
    lengths = np.array([-1 if x is None else x for x in pc.list_value_length(vectors).to_pylist()])
    places = np.nonzero(lengths == dim)[0]
    if not len(places):
        return places, np.zeros((0, dim), np.float32)
    flat = vectors.take(pa.array(places)).flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return places[good], (x[good] / norm[good, None]).astype(np.float32)


class _Best:
    """The k best of each query so far: similarity, then the least identifier."""

    def __init__(self, n: int, k: int):
        self.k, self.value, self.id = k, np.full((n, k), -np.inf, np.float32), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        """q: rising query numbers."""
        touched, first = np.unique(q, return_index=True)
        count = np.diff(np.append(first, len(q)))
        wide = int(count.max(initial=0))
        v, i = np.full((len(touched), wide + self.k), -np.inf, np.float32), np.full((len(touched), wide + self.k), np.iinfo(np.int64).max)
        row = np.repeat(np.arange(len(touched)), count)
        at = np.arange(len(q)) - np.repeat(first, count)
        v[row, at], i[row, at] = values, ids
        v[:, wide:], i[:, wide:] = self.value[touched], self.id[touched]
        order = np.lexsort((i, -v), axis=1)[:, : self.k]
        self.value[touched], self.id[touched] = np.take_along_axis(v, order, 1), np.take_along_axis(i, order, 1)

    def raise_(self, q: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        """Identifiers that are among the best already, by a better vector."""
        np.maximum.at(self.value, (q, at), values)
        touched = np.unique(q)
        order = np.lexsort((self.id[touched], -self.value[touched]), axis=1)
        self.value[touched], self.id[touched] = np.take_along_axis(self.value[touched], order, 1), np.take_along_axis(self.id[touched], order, 1)


def _search(k: int, dim: int, held, asked):
    """For mapInArrow over rows (cell, id, code, norm, dot, vec), best those of a cell together: the k best of each query among them.

    asked: identifiers, vectors and cells of queries, and for each cell how near to it the farthest cell is that its queries look at."""

    def block(best: _Best, ids: np.ndarray, queries: np.ndarray, some: np.ndarray, rows: tuple[np.ndarray, ...], centre: np.ndarray, turn: np.ndarray) -> None:
        item, codes, norm, dot, vectors = rows
        for i in range(0, len(some), 1024):
            own = some[i : i + 1024]
            near, width = estimate(queries[own], codes, norm, dot, centre, turn)
            fresh = ~np.isfinite(best.value[own, -1])
            if fresh.any():  # no bound yet: begin with the k best estimates
                top = np.argpartition(-near, min(k, near.shape[1] - 1), axis=1)[:, : k + 1]
                rerank(best, np.repeat(own, top.shape[1]), top.ravel(), ids, item, queries, vectors)
            near += width
            q, v = np.nonzero(near >= best.value[own, -1][:, None])
            rerank(best, own[q], v, ids, item, queries, vectors)

    def rerank(best: _Best, q: np.ndarray, v: np.ndarray, ids: np.ndarray, item: np.ndarray, queries: np.ndarray, vectors: np.ndarray) -> None:
        exact = np.empty(len(q), np.float32)
        for i in range(0, len(q), 1 << 17):
            s = slice(i, i + (1 << 17))
            exact[s] = np.einsum("ij,ij->i", queries[q[s]], vectors[v[s]])
        pick = (exact >= best.value[q, -1]) & (item[v] != ids[q])
        q, v, exact = q[pick], v[pick], exact[pick]
        known = best.id[q] == item[v][:, None]
        seen, at = known.any(1), known.argmax(1)
        if (better := seen & (exact > best.value[q, at])).any():
            best.raise_(q[better], at[better], exact[better])
        order = np.lexsort((-exact, item[v], q))
        order = order[~seen[order]]
        q, v, exact = q[order], v[order], exact[order]
        same = np.zeros(len(q), bool)  # rows with the same identifier count once, as their best
        same[1:] = (q[1:] == q[:-1]) & (item[v[1:]] == item[v[:-1]])
        if len(q):
            best.add(q[~same], item[v[~same]], exact[~same])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, turn = held.value[:2]
        ids, queries, cells, cut = asked.value
        lines, line = np.unique(cells, return_inverse=True)
        best = _Best(len(ids), k)
        for batch in batches:
            cell, item, norm, dot = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(cell), -1)
            vectors = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.float32).reshape(len(cell), dim)
            for c in np.unique(cell):
                some = np.nonzero(((centres[lines] @ centres[c] >= cut[lines]) | (lines == c))[line])[0]
                if len(some):
                    own = np.nonzero(cell == c)[0]
                    block(best, ids, queries, some, (item[own], codes[own], norm[own], dot[own], vectors[own]), centres[c], turn)
        q, r = np.nonzero(np.isfinite(best.value))
        for i in range(0, len(q), 1 << 16):
            a, b = q[i : i + (1 << 16)], r[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(best.id[a, b]), pa.array(best.value[a, b].astype(np.float64))], ["vec_id", "neighbour_id", "similarity"])

    return search


def _train(sample: np.ndarray, count: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 8192] @ centres.T).argmax(1) for i in range(0, len(sample), 8192)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres).astype(np.float32)
    return centres


def neighbours(vectors: DataFrame, k: int = 10, recall: float = 0.95, seed: int = 17, cell: int = CELL, every: int = 1) -> DataFrame:
    """(vec_id, neighbour_id, rank, similarity): the k vectors of the greatest cosine similarity to each query, among all vectors.

    Queries are the vectors whose vec_id is divisible by `every`.

    vectors has vec_id, an integer (any other kind is a TypeError), and embedding; other columns, whatever their names, are not read. A
    vector is never its own neighbour, nor is one with the same vec_id. Rows with the same vec_id are one thing with several
    vectors: its neighbours are the k best identifiers by the greatest similarity of any of the vectors of both. Equal similarities rank by identifier.
    The dimension is the most frequent one (the least of equals); rows with a null vec_id, a null embedding, another
    dimension, a null or infinite component or length zero are left out. With fewer than k others there are fewer rows; an empty table gives
    an empty one. recall: of the true neighbours, found on average; similarities are exact to 5 digits.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(integer(vectors, "vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    out = "vec_id long, neighbour_id long, rank int, similarity double"
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d > 0").orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    dim, total = sizes[0]
    rows = rows.where(F.size("v") == dim)
    turn = rotation(dim, seed)
    count = max(1, -(-total // cell))
    tops = count if count <= ONE_STEP else math.isqrt(count)
    drawn = rows.orderBy(seeded(seed, "id"), "id").limit(max(PILOT, tops * TRAINING)).toArrow()
    sample = _unit(drawn["v"].combine_chunks(), dim)[1] if drawn.num_rows else np.zeros((0, dim), np.float32)
    if not len(sample):
        return spark.createDataFrame([], out)
    centres, above, first = _train(sample, tops, seed), None, None
    if tops < count:
        above = centres
        centres, first = _within(rows, above, count, total, dim, seed)
    held = spark.sparkContext.broadcast((centres, turn, above, first))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, unit = _unit(batch.column(1), dim)
            at, codes, norm, dot = encode(unit, *held.value)
            binary = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array(at.astype(np.int32)), binary(codes), pa.array(norm), pa.array(dot), binary(unit)], ["id", "cell", "code", "norm", "dot", "vec"])

    # A cell's vectors lie together, in several parts where cells are few.
    apart = F.pmod(F.xxhash64("id"), F.lit(max(1, 4 * partitions(rows) // count)))
    coded = materialize(rows.mapInArrow(code, _CODED).repartition(partitions(rows), F.col("cell"), apart).sortWithinPartitions("cell"), "codes")
    probes = _pilot(coded, sample[:PILOT], *held.value, k, recall, dim)

    cut = _cut(centres, probes)
    asking = coded.where(F.pmod("id", F.lit(every)) == 0)
    blocks = max(1, -(-asking.count() * 4 * dim // QUERIES))
    parts = [finished(spark, lambda: _nearest_of(coded, asking.where(F.pmod(seeded(seed + 2, "id"), F.lit(blocks)) == n), held, cut, k, dim), "neighbours") for n in range(blocks)]  # noqa: B023 - called at once
    return functools.reduce(DataFrame.unionByName, parts)


def _nearest_of(coded: DataFrame, asking: DataFrame, held, cut: np.ndarray, k: int, dim: int) -> DataFrame:
    """The neighbours of one block of queries, which is sent to all tasks; what these find for a query is put together."""
    spark = coded.sparkSession
    block = asking.select("id", "cell", "vec").toArrow()  # QUERIES bytes or so
    order = np.lexsort((block["id"].to_numpy(), block["cell"].to_numpy()))
    vectors = np.frombuffer(b"".join(block["vec"].to_pylist()), np.float32).reshape(-1, dim)[order]
    asked = spark.sparkContext.broadcast((block["id"].to_numpy()[order], vectors, block["cell"].to_numpy()[order], cut))
    found = coded.select("cell", "id", "code", "norm", "dot", "vec").coalesce(SEARCHERS).mapInArrow(_search(k, dim, held, asked), "vec_id long, neighbour_id long, similarity double")
    best = found.groupBy("vec_id", "neighbour_id").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "neighbour_id", "rank", F.round("similarity", 5).alias("similarity"))


def _cut(centres: np.ndarray, probes: int) -> np.ndarray:
    """For each cell how near the farthest of the `probes` cells nearest to it is."""
    if probes >= len(centres):
        return np.full(len(centres), -np.inf, np.float32)
    near = [np.partition(-_alike(centres, np.arange(i, min(i + 128, len(centres)))), probes - 1, axis=1)[:, probes - 1] for i in range(0, len(centres), 128)]
    return -np.concatenate(near) - np.float32(1e-6)  # products of other shapes differ in their last digits


def _alike(centres: np.ndarray, own: np.ndarray) -> np.ndarray:
    like = centres[own] @ centres.T
    like[np.arange(len(own)), own] = np.inf
    return like


def _ranked(centres: np.ndarray, own: np.ndarray) -> np.ndarray:
    """By nearness: the cells as seen from each of own, itself first."""
    return np.argsort(-_alike(centres, own), axis=1, kind="stable")


def _within(rows: DataFrame, tops: np.ndarray, count: int, total: int, dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(centres, first): cells within each top, as many as its share of the vectors asks for, trained where a seeded sample of its vectors
    comes together."""
    held = rows.sparkSession.sparkContext.broadcast(tops)
    share = min(1.0, count * TRAINING / total)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, unit = _unit(batch.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array(_nearest(unit, held.value).astype(np.int32)), pa.array([r.tobytes() for r in unit], pa.binary())], ["top", "vec"])

    def train(group: pd.DataFrame) -> pd.DataFrame:
        sample = np.frombuffer(b"".join(group["vec"]), np.float32).reshape(-1, dim)
        sample = sample[np.lexsort(sample.T)]  # whatever order they came in
        found = _train(sample, max(1, round(len(sample) / TRAINING)), seed)
        return pd.DataFrame({"top": group["top"].iloc[0], "n": np.arange(len(found), dtype=np.int32), "vec": [r.tobytes() for r in found]})

    some = rows.where(F.pmod(seeded(seed + 1, "id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v")
    found = some.mapInArrow(place, "top int, vec binary").groupBy("top").applyInPandas(train, "top int, n int, vec binary").toPandas()
    found = found.sort_values(["top", "n"])
    missing = np.setdiff1d(np.arange(len(tops)), found["top"])  # a top without a vector in the sample is a cell of its own
    found = pd.concat([found, pd.DataFrame({"top": missing, "n": 0, "vec": [tops[t].astype(np.float32).tobytes() for t in missing]})]).sort_values(["top", "n"])
    sizes = np.bincount(found["top"].to_numpy(np.int64), minlength=len(tops))
    return np.frombuffer(b"".join(found["vec"]), np.float32).reshape(-1, dim), np.concatenate([[0], np.cumsum(sizes)])


def _pilot(coded: DataFrame, queries: np.ndarray, centres: np.ndarray, turn: np.ndarray, above: np.ndarray | None, first: np.ndarray | None, k: int, recall: float, dim: int) -> int:
    """The least number of nearest cells that hold the wanted share of the sampled queries' true neighbours."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(queries), k + 1), -np.inf, np.float32)
        cells = np.zeros((len(queries), k + 1), np.int32)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, dim)
            at = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(x), 8192):
                value = np.concatenate([best, queries @ x[i : i + 8192].T], axis=1)
                place = np.concatenate([cells, np.broadcast_to(at[i : i + 8192], (len(queries), len(at[i : i + 8192])))], axis=1)
                order = np.argpartition(-value, k, axis=1)[:, : k + 1]
                best, cells = np.take_along_axis(value, order, 1), np.take_along_axis(place, order, 1)
        q = np.repeat(np.arange(len(queries)), k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(best.ravel()), pa.array(cells.ravel())], ["q", "s", "cell"])

    found = coded.select("cell", "vec").mapInArrow(top, "q int, s float, cell int").where(F.col("s") > float("-inf"))
    best = found.groupBy("q").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("s", "cell")))), 1, k + 1).alias("b"))
    own, ranks = assign(queries, centres, above, first), []
    for q, b in best.collect():  # PILOT rows
        place = {c: r for r, c in enumerate(_ranked(centres, own[q : q + 1])[0].tolist())}
        ranks += [place[x["cell"]] for x in b[1:]]  # without the query itself
    if not ranks:
        return len(centres)
    ranks = np.sort(ranks)
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1
