"""Suffix-array dedup: every passage of at least `least` words that occurs more than once, by sorting suffixes.

A full suffix array holds a suffix for every word, each as long as what it is compared by: far more than the text. But a window
of `least` words repeats only if the run of `lead` words in it that hashes least repeats too, at the same place in it. So
windows are grouped to runs with a common leading run of words (of `lead` words, a parameter), and only runs whose lead occurs again
are carried on; the rest can't repeat. Those suffixes are range-partitioned by their leading words with sampled splitters, so that buckets are of
like size; a lead with very many suffixes is spread over several buckets. Each bucket sorts its suffixes by multikey quicksort, all
groups of equal prefixes at once and ten words a step, dropping what has become unique, until equal neighbours share `least`
words. The first and last lead of a bucket may go on in the next one: their windows are compared across boundaries by a
128-bit fingerprint. Texts that are equal as a whole are sorted once, for all their copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import OWN, claim, integer, materialize, partitions, release

LEAST, LEAD = 50, 8
#: Words that one step of the sort compares.
STEP = 10
#: Words that are cut to runs at once (or one document), and windows that are sorted at once (or one lead).
SLICE, SORTED = 1 << 18, 1 << 16
#: Runs that are sent on in a batch.
CARRIED = 5000
#: Suffixes that are sampled for each splitter, and that a bucket holds about, at most.
SAMPLES, BUCKET = 50, 200_000
BROADCAST_ROWS = 500_000
REMEMBERED = 400_000

_U = np.uint64
_M = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M[0]
    x = (x ^ (x >> _U(27))) * _M[1]
    return x ^ (x >> _U(31))


class _Words(dict):
    """The 64-bit hash of a word's letters and digits in lower case, or of the word itself if it has none."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        text = word.decode()
        value = xxh3_64_intdigest("".join(c for c in text.lower() if c.isalnum()) or text)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


_words = _Words()


def word_hashes(text: bytes | None) -> np.ndarray:
    """Words are cut at ASCII white space and compared in lower case by their letters and digits alone."""
    words = text.split() if text else []
    return np.fromiter(map(_words.__getitem__, words), _U, len(words))


def _rolling(w: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    g = w[: len(w) - size + 1].copy()
    for i in range(1, size):
        g = g * factor + w[i : len(w) - size + 1 + i]
    return _mix(g)


def runs(texts: list[np.ndarray], least: int, lead: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, key) of the runs of windows with a common lead. key: the leading word, then the
    fingerprint of the lead, 32 bits each."""
    ends = np.cumsum([len(t) for t in texts])
    w, doc = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    grams = _rolling(w, lead, _M[2])
    # The leftmost of the least is at the same place in equal windows, whatever else the batch holds.
    low, at = grams, np.arange(len(grams))

    def least_of(a: int, b: int) -> None:
        nonlocal low, at
        n = len(low) - b
        second = low[b:] < low[a : a + n]
        low, at = np.where(second, low[b:], low[a : a + n]), np.where(second, at[b:], at[a : a + n])

    width, size = least - lead + 1, 1
    while size * 2 <= width:
        least_of(0, size)
        size *= 2
    if size < width:
        least_of(0, width - size)
    inside = doc[: len(low)] == doc[least - 1 :]
    at = np.where(inside, at, -1)
    starts = np.nonzero(inside & np.concatenate([[True], at[1:] != at[:-1]]))[0]
    stops = np.nonzero(inside & np.concatenate([at[1:] != at[:-1], [True]]))[0]
    a = at[starts]
    key = (w[a] >> _U(32) << _U(32) | grams[a] >> _U(32)).view(np.int64)
    first = (ends - [len(t) for t in texts])[doc[starts]]
    return doc[starts], starts - first, stops - first, key


def _cut(least: int, lead: int):
    """For mapInArrow over (id, hash, text): a row (id, hash, key, p, q) for each run."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_words)
        for batch in batches:
            rows, held, size = [], [], 0
            texts = batch.column(2)
            for i in range(batch.num_rows):
                w = word_hashes(texts[i].as_py())
                if len(w) >= least:
                    rows.append(i)
                    held.append(w)
                    size += len(w)
                if held and (size >= SLICE or i == batch.num_rows - 1):
                    doc, p, q, key = runs(held, least, lead)
                    take = pa.array(np.array(rows)[doc])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(key), pa.array(p.astype(np.int32)), pa.array(q.astype(np.int32))], ["id", "hash", "key", "p", "q"])
                    rows, held, size = [], [], 0

    return cut


def _carry(least: int):
    """For mapInArrow over (id, hash, text, runs of (bucket, key, p, q)): a row a run, with the words it needs."""

    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def batch_of(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["bucket", "key", "id", "hash", "p", "words"])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_words)
        for batch in batches:
            ids, hashes, texts, lists = (batch.column(i) for i in range(4))
            out: list[list] = [[] for _ in range(6)]
            for i in range(batch.num_rows):
                w = (word_hashes(texts[i].as_py()) >> _U(32)).astype(np.uint32)
                flat = lists[i].values
                bucket, key, p, q = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                for j in range(0, len(p), CARRIED):
                    k = slice(j, j + CARRIED)
                    n = len(p[k])
                    for held, new in zip(out, (bucket[k].tolist(), key[k].tolist(), [ids[i].as_py()] * n, [hashes[i].as_py()] * n, p[k].tolist(), [w[a : b + least].tobytes() for a, b in zip(p[k], q[k])])):
                        held.extend(new)
                    if len(out[0]) >= CARRIED:
                        yield batch_of(out)
                        out = [[] for _ in range(6)]
            if out[0]:
                yield batch_of(out)

    return carry


def multikey_quicksort(symbols: np.ndarray, start: np.ndarray, group: np.ndarray, depths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, group) of the suffixes that equal another one in their group up to the last depth, in order.

    Each round cuts every group in three by the symbol of its middle suffix at its own depth: less, equal and greater; the equal
    ones go on to the next depth. All groups are cut at once. Suffixes that are alone in theirs are dropped.
    """
    at, deep = np.array(depths), np.zeros(len(start), np.int64)
    alive = np.argsort(group, kind="stable")
    group = group[alive]
    done: list[np.ndarray] = []
    while True:
        new = np.ones(len(alive), bool)
        new[1:] = group[1:] != group[:-1]
        group = np.cumsum(new) - 1
        size = np.bincount(group, minlength=1)
        keep, ready = size[group] > 1, deep[alive] == len(at)
        done.append(alive[keep & ready])
        done.append(group[keep & ready])
        keep &= ~ready
        alive, group = alive[keep], group[keep]
        if not len(alive):
            break
        first = np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0]
        size = np.diff(np.append(first, len(group)))
        symbol = symbols[start[alive] + at[deep[alive]]]
        pivot = np.repeat(symbol[first + size // 2], size)
        begin = np.repeat(first, size)
        side = np.where(symbol < pivot, 0, np.where(symbol == pivot, 1, 2))
        place = begin.copy()
        for k in range(3):
            own = side == k
            upto = np.cumsum(own) - own
            place[own] += (upto - np.repeat(upto[first], size))[own]
            place[side > k] += np.repeat(np.add.reduceat(own, first), size)[side > k]
        order = np.empty(len(alive), np.int64)
        order[place] = np.arange(len(alive))
        alive, group = alive[order], group[order] * 3 + side[order]
        deep[alive[side[order] == 1]] += 1
    alive = np.concatenate(done[::2])
    sizes = [len(x) for x in done[::2]]
    # Groups of different rounds are different ones.
    rounds = np.repeat(np.arange(len(sizes)), sizes)
    found = np.concatenate(done[1::2])
    new = np.ones(len(alive), bool)
    new[1:] = (found[1:] != found[:-1]) | (rounds[1:] != rounds[:-1])
    return alive, np.cumsum(new) - 1


def _sort(least: int):
    """For mapInArrow over rows of _carry, sorted by bucket and key: (id, hash, p, q, x, y). With x null: the windows p to q
    repeat. Else x and y are the fingerprint of window p of a lead at a bucket's boundary; id and hash are null and p is -1
    if all of its windows are known to repeat already."""
    depths = [*range(0, least - STEP, STEP), least - STEP]

    def one(rows: list[tuple], at_boundary: np.ndarray) -> Iterator[pa.RecordBatch]:
        words = [np.frombuffer(r[4], np.uint32) for r in rows]
        sizes = np.array([len(w) for w in words])
        w, first = np.concatenate(words).astype(_U) + _U(1), np.cumsum(sizes) - sizes
        count = sizes - least + 1
        row = np.repeat(np.arange(len(rows)), count)
        within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = first[row] + within
        symbols = _rolling(w, STEP, _M[3])
        keys = np.unique([r[0] for r in rows], return_inverse=True)[1]
        alive, group = multikey_quicksort(symbols, start, keys[row], depths)
        dup = np.zeros(len(row), bool)
        dup[alive] = True
        begins = dup & np.concatenate([[True], ~dup[:-1] | (row[1:] != row[:-1])])
        ends = dup & np.concatenate([~dup[1:] | (row[1:] != row[:-1]), [True]])
        b, e = np.nonzero(begins)[0], np.nonzero(ends)[0]
        offset = np.array([r[3] for r in rows])
        ids, hashes = [r[1] for r in rows], [r[2] for r in rows]
        edge = np.nonzero(at_boundary[row] & ~dup)[0]
        # One window for each group that is settled here, and every other one.
        heads = alive[np.concatenate([[True], group[1:] != group[:-1]])] if len(alive) else alive
        heads = heads[at_boundary[row[heads]]]

        def print_(windows: np.ndarray, seed: int) -> np.ndarray:
            f = np.full(len(windows), seed, _U)
            for d in depths:
                f = _mix(f * _M[2] + symbols[start[windows] + d])
            return f.view(np.int64)

        n, fp = len(b), np.concatenate([edge, heads]).astype(np.int64)
        i64 = lambda x: pa.array(x, pa.int64())
        yield pa.RecordBatch.from_arrays([
            i64([ids[r] for r in row[b]] + [ids[r] for r in row[edge]] + [None] * len(heads)),
            i64([hashes[r] for r in row[b]] + [hashes[r] for r in row[edge]] + [None] * len(heads)),
            pa.array(np.concatenate([offset[row[b]] + within[b], offset[row[edge]] + within[edge], np.full(len(heads), -1)]).astype(np.int32)),
            pa.array(np.concatenate([offset[row[e]] + within[e], offset[row[edge]] + within[edge], np.full(len(heads), -1)]).astype(np.int32)),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(print_(fp, 1))]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(print_(fp, 2))]),
        ], ["id", "hash", "p", "q", "x", "y"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # of whole leads, but for the last one
        bucket = first = None
        windows = lead_from = 0

        def flush(upto: int, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rows, windows, lead_from
            if upto:
                part, rest = rows[:upto], rows[upto:]
                boundary = np.array([r[0] == first or (last and r[0] == part[-1][0]) for r in part])
                yield from one(part, boundary)
                rows = rest
                windows, lead_from = sum(len(r[4]) // 4 - least + 1 for r in rows), 0

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for b, key, id_, hash_, p, words in zip(*columns):
                if b != bucket:
                    yield from flush(len(rows), True)
                    bucket, first = b, key
                elif rows and key != rows[-1][0]:
                    if windows >= SORTED:
                        yield from flush(len(rows), False)
                rows.append((key, id_, hash_, p, words))
                windows += len(words) // 4 - least + 1
        yield from flush(len(rows), True)

    return sort


def _broadcast(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if count <= BROADCAST_ROWS else df


def repeats(docs: DataFrame, least: int = LEAST, lead: int = LEAD) -> DataFrame:
    """(doc_id, start_word, end_word): the longest stretches of each document that repeated windows of `least` words cover,
    end exclusive; stretches of one document neither overlap nor touch. A window repeats if it occurs at two places, in other
    documents or the same one.

    docs has doc_id, an integer (any other kind is a TypeError), and text; other columns, whatever their names, are not read. Words are counted from 0, cut at ASCII white space, and compared in
    lower case by letters and digits. Null and empty texts, and those of fewer than `least` words, have no row, copies of them
    neither. Rows with the same doc_id and text have their stretches once; with the same doc_id and another text, each its own.
    Rows with a null doc_id take part and have rows with a null doc_id. Texts of any length are taken whole. An empty table
    gives an empty one.
    """
    if not least >= max(STEP, lead):
        raise ValueError(f"least must be {max(STEP, lead)} or more")
    text = F.col("text")
    source = docs.where(text.isNotNull()).select(integer(docs, "doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.xxhash64(F.lit(7), text).alias("hash2"), "text")
    members = materialize(source.select("id", "hash", "hash2"), "members")
    least_id = F.min(F.struct(F.col("id").isNull(), "id"))
    classes = members.groupBy("hash", "hash2").agg(least_id.alias("r"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "hash2", F.col("r.id").alias("rep"))
    classes = materialize(classes, "copied")
    copies = members.join(classes, ["hash", "hash2"])
    others = materialize(copies.where(~F.col("id").eqNullSafe(F.col("rep"))).select(F.col("id").alias(OWN + "i"), F.col("hash").alias(OWN + "h")), "copies")
    same = F.col("id").eqNullSafe(F.col(OWN + "i")) & (F.col("hash") == F.col(OWN + "h"))
    source = source.select("id", "hash", "text")
    count = others.count()
    once = source.join(_broadcast(others, count), same, "left_anti") if count else source
    binary = lambda df: df.withColumn("text", F.col("text").cast("binary"))

    cut = binary(once).mapInArrow(_cut(least, lead), "id long, hash long, key long, p int, q int")
    # Counted where they lie first, so that a lead of very many suffixes is nobody's alone; then the others are dropped.
    cut = materialize(cut, "cut")
    repeated = cut.groupBy("key").agg(F.count(F.lit(1)).alias(OWN + "n")).where(F.col(OWN + "n") > 1).select("key")
    again = materialize(cut.join(repeated, "key", "left_semi"), "runs")
    release(cut)

    total = again.count()
    buckets = max(4 * partitions(docs), -(-total // BUCKET))
    salt = F.pmod(F.xxhash64("id", "hash"), F.lit(1 << 31))
    some = again.sample(min(1.0, buckets * SAMPLES / max(1, total)), seed=17).select("key", salt.alias("salt")).toArrow()
    order = sorted(zip(some["key"].to_pylist(), some["salt"].to_pylist()))
    splitters = [order[i * len(order) // buckets] for i in range(1, buckets)] if order else []
    bounds = F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(s).cast("long").alias("salt")) for k, s in splitters]) if splitters else None
    mine = F.struct(F.col("key"), salt.alias("salt"))
    bucket = F.lit(0) if bounds is None else F.size(F.filter(bounds, lambda b: b <= mine))
    if len(splitters) > 64:  # found by bisection in Python, where a comparison with each would be slow
        bucket = _bisect(splitters)("key", salt)
    listed = again.groupBy("id", "hash").agg(F.collect_list(F.struct(bucket.cast("int").alias("bucket"), "key", "p", "q")).alias("runs"))
    listed = listed.select(F.col("id").alias(OWN + "i"), F.col("hash").alias(OWN + "h"), "runs")
    wanted = materialize(again.select(F.col("id").alias(OWN + "i"), F.col("hash").alias(OWN + "h")).distinct(), "holders")
    count = wanted.count()
    # With few holders, the other texts stay where they are.
    holders = once.join(F.broadcast(wanted), same, "left_semi") if count <= BROADCAST_ROWS else once
    carried = binary(holders.join(listed, same).select("id", "hash", "text", "runs")).mapInArrow(_carry(least), "bucket int, key long, id long, hash long, p int, words binary")
    ordered = carried.repartition(partitions(docs), "bucket").sortWithinPartitions("bucket", "key")
    sorted_ = materialize(ordered.mapInArrow(_sort(least), "id long, hash long, p int, q int, x long, y long"), "sorted")
    crossing = sorted_.where(F.col("x").isNotNull()).withColumn(OWN + "n", F.count(F.lit(1)).over(Window.partitionBy("x", "y")))
    crossing = crossing.where((F.col(OWN + "n") > 1) & (F.col("p") >= 0))
    found = sorted_.where(F.col("x").isNull()).select("id", "hash", "p", "q").unionByName(crossing.select("id", "hash", "p", "q"))
    spans = found.select("id", "hash", F.col("p").alias("start"), (F.col("q") + least).alias("end"))

    # Stretches that overlap or touch are joined.
    before = Window.partitionBy("id", "hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("id", "hash").orderBy("start", "end")
    fresh = F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1)
    islands = spans.withColumn(OWN + "new", fresh).withColumn(OWN + "island", F.sum(OWN + "new").over(upto))
    islands = islands.groupBy("id", "hash", OWN + "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))

    # A text with copies repeats as a whole.
    reps = classes.select(F.col("rep").alias(OWN + "i"), F.col("hash").alias(OWN + "h"))
    count = reps.count()
    whole_of = source.join(_broadcast(reps, count), same, "left_semi").select("id", "hash", F.size(F.filter(F.split(text, "[ \\t\\n\\r\\f\\x0B]+"), lambda x: x != "")).alias("words"))
    whole_of = whole_of.where(F.col("words") >= least).distinct()
    lengths = whole_of.select(F.col("id").alias(OWN + "i"), F.col("hash").alias(OWN + "h"), "words")
    whole = copies.join(lengths, F.col("rep").eqNullSafe(F.col(OWN + "i")) & (F.col("hash") == F.col(OWN + "h")))
    whole = whole.select("id", "hash", F.lit(0).alias("start"), F.col("words").alias("end")).distinct()
    parts = islands.join(reps, same, "left_anti").select("id", "hash", "start", "end")
    return parts.unionByName(whole).select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"))


def _bisect(splitters: list[tuple[int, int]]):
    from pyspark.sql.functions import arrow_udf

    keys = np.array([s[0] for s in splitters], np.int64)
    salts = np.array([s[1] for s in splitters], np.int64)

    @arrow_udf("int")
    def place(key: pa.Array, salt: pa.Array) -> pa.Array:
        key, salt = key.to_numpy(zero_copy_only=False), salt.to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        out = high.astype(np.int32)
        for i in np.nonzero(high > low)[0]:
            out[i] = low[i] + np.searchsorted(salts[low[i] : high[i]], salt[i], "right")
        return pa.array(out)

    return place


def oracle_sql(least: int = LEAST) -> str:
    """DuckDB SQL for repeats(documents)."""
    return f"""WITH words AS (
        SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''),
            lambda w: CASE WHEN regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}]', '', 'g') = '' THEN w ELSE regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}]', '', 'g') END) AS w
        FROM documents WHERE text IS NOT NULL),
    windows AS (SELECT doc_id, w, unnest(range(0, len(w) - {least} + 1)) AS p FROM words WHERE len(w) >= {least}),
    keyed AS (SELECT doc_id, p, md5(array_to_string(w[p + 1:p + {least}], ' ')) AS k FROM windows),
    found AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM keyed) WHERE n > 1),
    marked AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {least} THEN 0 ELSE 1 END AS fresh FROM found),
    islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM marked)
    SELECT doc_id, CAST(min(p) AS INTEGER) AS start_word, CAST(max(p) + {least} AS INTEGER) AS end_word FROM islands GROUP BY doc_id, island"""
