"""N-gram Jaccard join: all pairs of documents whose sets of word n-grams are alike, and groups of near duplicates.

MinHash banding: with b bands of r hashes a pair of similarity s shares a band with probability 1 - (1 - s^r)^b; r is the
largest, and b the least for it, that reach the wanted recall at the threshold within the allowed number of hashes. A band's
hashes are packed into one word (64 // rows bits of each), which is both the key of its bucket and, lane by lane, a sketch of the set. Documents
with the same set are one class, so copies cost nothing beyond their own row. Only bands are shuffled to find candidates, in blocks
of bounded size, and where a pair meets it is dropped if its sizes can't reach the threshold, if an earlier band has it too, or
if fewer hashes agree than all but a counted share of pairs at the threshold have. Sets are then sent to where candidates
are left, and every one of these is verified on the full sets.

Bands miss some pairs by chance. links() therefore takes what they find only as groups: within a group every pair is compared, and
between groups sets meet by their prefixes, which similar sets can't but share, in an order that has frequent n-grams last.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from xxhash import xxh3_64_intdigest

from larkspur.llm.common import OWN, claim, columns_of, finished, integer, materialize, one_of, release, slices

N, THRESHOLD, RECALL, MAX_HASHES = 3, 0.5, 0.99, 128
#: Rows of a band, of which two bits each at least fit into its word.
MAX_ROWS = 32
#: Members of a bucket that meet in one place; larger buckets are cut into blocks, and each two blocks meet.
MEET = 8192
#: Sets, and n-grams in them, that are verified against each other in one place.
BLOCK, GRAMS = 512, 1 << 20
#: Pairs that are looked at in one step.
STEP = 1 << 14
#: Identifiers that may be broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
SLICE = 1 << 20
#: Documents, and of these the n-grams that most and FREQUENT of them at least have, that the order of prefixes is made from; it changes work, not results.
SAMPLE, FREQUENT_GRAMS, FREQUENT = 1 << 15, 1 << 18, 3
#: N-grams that prefixes have to share, where two sets have as many in common; postings of one bucket, and those sent at once.
SHARED, POSTINGS = 4, 1 << 20

_U = np.uint64
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows) with 1 - (1 - threshold^rows)^bands >= recall and bands * rows <= max_hashes, of the most rows (MAX_ROWS at most)."""
    best = None
    for rows in range(1, min(max_hashes, MAX_ROWS) + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p)) if p > 1e-12 else max_hashes + 1
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("more hashes are needed for this recall at this threshold")
    return best


def choose_sketch(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int, int]:
    """(bands, rows, agreeing): half of what the recall lets through is the bands', the other half is that of pairs of which fewer
    hashes than `agreeing` agree. A pair at the threshold or above passes both with probability recall at least: more
    agreeing hashes make a common band more likely, so the two never work against each other."""
    missed = (1 - recall) / 2
    try:
        bands, rows = choose_bands(threshold, 1 - missed, max_hashes)
    except ValueError:  # then all is the bands'
        return (*choose_bands(threshold, recall, max_hashes), 0)
    hashes, below = bands * rows, 0.0
    for agreeing in range(hashes + 1):
        below += math.comb(hashes, agreeing) * threshold**agreeing * (1 - threshold) ** (hashes - agreeing)
        if below > missed:
            return bands, rows, agreeing
    return bands, rows, hashes


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[0]
    x = (x ^ (x >> _U(27))) * _MIX[1]
    return x ^ (x >> _U(31))


#: Of ASCII texts: letters in lower case, white space as it is, and what is neither of these nor a digit.
_LOWER = bytes(range(256)).lower()
_SIGNS = bytes(b for b in range(128) if not (chr(b).isalnum() or b in b" \t\n\r\x0b\x0c"))

#: Nothing is remembered here, but what other operators remembered goes.
_none: dict = {}


def _word(word: bytes) -> int:
    """The 64-bit hash of a word's letters and digits in lower case; 0 for a word without any."""
    core = word.decode().lower()
    if not core.isalnum():
        core = "".join(filter(str.isalnum, core))
    return (xxh3_64_intdigest(core) | 1) if core else 0


def gram_sets(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word n-grams: words are cut at ASCII white space, put in lower case and
    stripped of all but letters and digits. A text of fewer than n words has one gram of them all, one without words none.

    Each different word of all the texts is hashed once, and their n-grams are made together."""
    raw = ((t or "").encode() for t in texts)
    plain = pa.array([t.translate(_LOWER, _SIGNS) if t.isascii() else t for t in raw], pa.large_binary())
    split = pc.ascii_split_whitespace(plain.cast(pa.large_string()))
    words = split.values.dictionary_encode()
    known = words.dictionary.cast(pa.large_binary()).to_pylist()
    w = np.fromiter((xxh3_64_intdigest(x.lower()) | 1 if x.isascii() and x.isalnum() else _word(x) for x in known), _U, len(known))
    w = w[words.indices.to_numpy()]
    bounds = np.concatenate([[0], np.cumsum(w != 0)])[split.offsets.to_numpy()].tolist()
    w = w[w != 0]
    whole = max(0, len(w) - n + 1)
    grams = np.full(whole, n, _U)
    for i in range(n):
        grams = _mix(grams * _MIX[2] + w[i : whole + i])
    sets = []
    for start, end in itertools.pairwise(bounds):
        if end - start >= n:
            s = np.sort(grams[start : end - n + 1])
            sets.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            s = np.full(min(1, end - start), end - start, _U)
            for i in range(start, end):
                s = _mix(s * _MIX[2] + w[i : i + 1])
            sets.append(s)
    return sets


def _digest(grams: np.ndarray) -> bytes:
    """128 bits that tell sets apart, in any order."""
    with np.errstate(over="ignore"):
        return np.array([_mix(grams).sum(), _mix(grams ^ _MIX[3]).sum() + _U(len(grams))], _U).tobytes()


def signatures(text: Column | str, n: int, bands: int, rows: int, seed: int) -> Column:
    """struct(digest, grams, words): a set's digest and size, and for each band a word of 64 // rows bits of each of its hashes;
    null for a text without words."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, bands * rows, dtype=np.int64).astype(_U) << _U(1) | _U(1)
    add = rng.integers(0, 1 << 63, bands * rows, dtype=np.int64).astype(_U)
    bits = 64 // rows
    lane = _U((1 << bits) - 1)

    @arrow_udf("struct<digest: binary, grams: bigint, words: array<bigint>>")
    def sign(texts: pa.Array) -> pa.Array:
        claim(_none)
        digests, sizes, words, null = [], [], [], []
        for _, _, some_texts in slices(texts, SLICE):
            sets = gram_sets(some_texts, n)
            some = [s for s in sets if len(s)]
            starts = np.cumsum([0] + [len(s) for s in some[:-1]])
            least = np.zeros((len(some), bands), _U)
            if some:
                grams = np.concatenate(some)
                held = np.empty_like(grams)
                for h in range(bands * rows):
                    np.bitwise_xor(grams, add[h], out=held)
                    np.multiply(held, odd[h], out=held)
                    # Low bits of a product know low bits only, so the least is mixed before it is cut.
                    least[:, h // rows] |= (_mix(np.minimum.reduceat(held, starts)) & lane) << _U(bits * (h % rows))
            words.append(least)
            null += [not len(s) for s in sets]
            sizes += [len(s) for s in sets]
            digests += [_digest(s) if len(s) else None for s in sets]
        flat = np.concatenate(words).reshape(-1).view(np.int64) if words else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum([0 if x else bands for x in null])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists], ["digest", "grams", "words"], mask=pa.array(null, pa.bool_()))

    # Taken as not deterministic, so that a filter on the result doesn't compute it twice.
    return sign.asNondeterministic()(text)


def packed_sets(text: Column | str, n: int) -> Column:
    """struct(digest, set): the 64-bit hashes of a text's n-grams, sorted."""

    @arrow_udf("struct<digest: binary, set: binary>")
    def pack(texts: pa.Array) -> pa.Array:
        claim(_none)
        digests, packed = [], []
        for s in (s for _, _, some in slices(texts, SLICE) for s in gram_sets(some, n)):
            digests.append(_digest(s))
            packed.append(s.tobytes())
        return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], ["digest", "set"])

    return pack.asNondeterministic()(text)


def _meet(threshold: float, bands: int, rows: int, agreeing: int):
    """For mapInArrow over rows (at, half, band, digest, grams, words) sorted by `at` and digest: the candidates (at, a, b), a < b,
    with the place where they are to be verified. Members of the same half of two blocks don't meet (0: all meet)."""
    bits = 64 // rows
    lanes = [_U((1 << bits) - 1 << bits * r) for r in range(rows)]
    types = (pa.int64(), pa.binary(), pa.binary())

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        at, half, band, grams = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
        digest = np.frombuffer(b"".join(batch.column(3).to_pylist()), "V16")
        return [at, half, band, digest, grams, batch.column(5).flatten().to_numpy().view(_U).reshape(-1, bands)]

    def pairs(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (i, j), i < j, of the groups, about STEP at a time."""
        i = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends)]) if len(starts) else np.zeros(0, np.int64)
        count = np.repeat(ends, ends - starts) - i - 1
        upto, start = np.cumsum(count), 0
        while start < len(i):
            end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + STEP, "right")))
            c = count[start:end]
            left = np.repeat(i[start:end], c)
            yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)
            start = end

    def look(held: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, half, band, digest, grams, words = held
        sums = np.add.reduceat(grams, starts)
        blocks = np.maximum(-(-(ends - starts) // BLOCK), -(-sums // GRAMS))
        blocks = np.repeat(blocks, ends - starts).astype(_U)
        place = np.zeros(len(at), _U)
        place[starts[0] : ends[-1]] = digest[starts[0] : ends[-1]].view(_U).reshape(-1, 2)[:, 0] % blocks
        for i, j in pairs(starts, ends):
            x, y = grams[i], grams[j]
            fit = (np.minimum(x, y) >= threshold * np.maximum(x, y)) & (band[i] == band[j]) & ((half[i] == 0) | (half[i] != half[j]))
            i, j = i[fit], j[fit]
            apart = words[i] ^ words[j]
            first = (apart == 0).argmax(1) == band[i]
            first &= apart[np.arange(len(i)), band[i]] == 0
            i, j, apart = i[first], j[first], apart[first]
            if agreeing:
                likely = sum(((apart & lane) == 0).sum(1) for lane in lanes) >= agreeing
                i, j = i[likely], j[likely]
            if len(i):
                p, q = place[i], place[j]
                where = _mix(_mix(at[i].view(_U) * _MIX[2] + np.minimum(p, q)) * _MIX[3] + np.maximum(p, q))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((where.view(np.int64), digest[i].tolist(), digest[j].tolist()), types)], ["at", "a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = columns(batch)
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            new = np.nonzero(held[0][1:] != held[0][:-1])[0] + 1
            if len(new):  # all but the last group are whole
                yield from look(held, np.concatenate([[0], new[:-1]]), new)
                held = [x[new[-1] :] for x in held]
        if held:
            yield from look(held, np.zeros(1, np.int64), np.array([len(held[0])]))

    return meet


def _jaccards(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, skip=lambda a, b: False, found=lambda a, b, s: None) -> np.ndarray:
    """The similarities of pairs (left[i], right[i]) of sets; -1 where skip(left, right) says that it needn't be known."""
    out = np.full(len(left), -1.0)
    order = np.argsort(left, kind="stable")
    ids, at = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    mark = np.zeros(len(ids), np.int32)
    for a, some in itertools.groupby(order, key=left.__getitem__):
        some = np.fromiter(some, np.int64)
        own = at[ends[a] - sizes[a] : ends[a]]
        mark[own] = 1
        for i in some:
            b = right[i]
            if skip(a, b):
                continue
            common = int(mark[at[ends[b] - sizes[b] : ends[b]]].sum())
            out[i] = common / (sizes[a] + sizes[b] - common)
            found(a, b, out[i])
        mark[own] = 0
    return out


def _verify(threshold: float, forest: bool):
    """For mapInArrow over rows (at, a, b, set) sorted by `at`, with sets (b null) before pairs: the pairs (a, b, jaccard) that
    reach the threshold; for forest only as many as hold together what they hold together."""

    def one(digests: list[bytes], packed: list[bytes], pairs: list[tuple[bytes, bytes]]) -> tuple[list[bytes], list[bytes], np.ndarray]:
        number = {d: i for i, d in enumerate(digests)}
        sets = [np.frombuffer(p, np.int64) for p in packed]
        left, right = (np.array([number[p[k]] for p in pairs]) for k in (0, 1))
        parent = list(range(len(sets)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def tie(a: int, b: int, jaccard: float) -> None:
            if jaccard >= threshold:
                parent[root(a)] = root(b)

        # For a forest, what hangs together already needn't be compared.
        jaccard = _jaccards(sets, left, right, lambda a, b: root(a) == root(b), tie) if forest else _jaccards(sets, left, right)
        keep = np.nonzero(jaccard >= threshold)[0]
        return [pairs[i][0] for i in keep], [pairs[i][1] for i in keep], jaccard[keep]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digests, packed, pairs = None, [], [], []
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            if pairs:
                for held, new in zip(out, one(digests, packed, pairs)):
                    held.extend(new)

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.float64())], ["a", "b", "jaccard"])
            for held in out:
                held.clear()
            return batch

        for batch in batches:
            for at, a, b, s in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if at != now:
                    close()
                    now, digests, packed, pairs = at, [], [], []
                    if len(out[0]) >= 10_000:
                        yield rows()
                if b is None:
                    digests.append(a)
                    packed.append(s)
                else:
                    pairs.append((a, b))
        close()
        yield rows()

    return verify


def _cross(threshold: float):
    """For mapInArrow over rows (bucket, prints, refs) sorted by bucket: (a, b, n), two refs of different groups and sizes that can
    reach the threshold, and how many prints they share."""
    apart = math.log(1 / threshold) / math.log(SIZE_STEP) + 1

    def close(prints: np.ndarray, refs: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((refs, prints))
        prints, refs = prints[order], refs[order]
        group, code = refs >> _U(24), ((refs >> _U(CODE_AT)) & _U(CODES)).astype(np.int64)
        run = np.append(np.nonzero(prints[1:] != prints[:-1])[0] + 1, len(prints))
        like = np.append(np.nonzero((prints[1:] != prints[:-1]) | (group[1:] != group[:-1]))[0] + 1, len(prints))
        here = np.arange(len(prints))
        start = like[np.searchsorted(like, here, "right")]  # the first of another group; a run's end where there is none
        count = run[np.searchsorted(run, here, "right")] - start
        here = here[count > 0]
        upto, at, held, size = np.cumsum(count[here]), 0, [], 0

        def rows() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), axis=0, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy().view(np.int64)), pa.array(found[:, 1].copy().view(np.int64)), pa.array(n.astype(np.int64))], ["a", "b", "n"])

        while at < len(here):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
            c = count[here[at:end]]
            i = np.repeat(here[at:end], c)
            j = np.repeat(start[here[at:end]], c) + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            fit = np.abs(code[i] - code[j]) <= apart
            x, y = refs[i[fit]], refs[j[fit]]
            held.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            size, at = size + len(x), end
            if size >= POSTINGS // 4:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prints, refs = None, [], []
        for batch in batches:
            for bucket, p, r in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and prints:
                    yield from close(np.concatenate(prints), np.concatenate(refs))
                    prints, refs = [], []
                now = bucket
                prints.append(np.frombuffer(p, np.uint32))
                refs.append(np.frombuffer(r, _U))
        if prints:
            yield from close(np.concatenate(prints), np.concatenate(refs))

    return cross


#: Sizes of sets are told apart by this factor before sets meet; a ref has their logarithm in 10 bits, which no text that Spark can hold exceeds.
SIZE_STEP, CODE_AT, CODES = 1.025, 14, 1023


def _needed(threshold: float, sizes: tuple[Column, Column], step: float = 1.0) -> Column:
    """The n-grams that the prefixes of two sets share at least if the sets reach the threshold. sizes: from each up to `step` times it.

    Of two prefixes one ends first in the order of n-grams, and what the sets have in common but the prefixes haven't is in the rest of that one's set."""
    common = (sizes[0] + sizes[1]) * (threshold / (1 + threshold))
    rest = F.greatest(F.greatest(*sizes) * (step * threshold) + 1 - SHARED, F.lit(0.0))
    return F.ceil(F.greatest(F.least(F.lit(float(SHARED)), common), common - rest) - 1e-6 - common * 1e-9)


def _prefixes(n: int, threshold: float, frequent, buckets: int):
    """For mapInArrow over rows (ref, text): rows (bucket, prints, refs), the n-grams of prefixes by bucket. Those of a pair that
    reaches the threshold share SHARED n-grams, or all that the two have in common."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_none)
        known, times = frequent.value
        grams, refs, size = [], [], 0

        def rows() -> pa.RecordBatch:
            g = _mix(np.concatenate(grams) ^ _MIX[4])
            r = np.repeat(np.array([x for x, _ in refs], np.int64), [c for _, c in refs])
            bucket = (g % _U(buckets)).astype(np.min_scalar_type(buckets))  # of 16 bits they are sorted by radix
            order = np.argsort(bucket, kind="stable")
            g, r, bucket = (g[order] >> _U(32)).astype(np.uint32), r[order], bucket[order]
            starts = np.concatenate([[0], np.nonzero(bucket[1:] != bucket[:-1])[0] + 1, [len(bucket)]])
            cut = lambda x: pa.array([x[i:j].tobytes() for i, j in itertools.pairwise(starts)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(bucket[starts[:-1]].astype(np.int64)), cut(g), cut(r)], ["bucket", "prints", "refs"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, end, texts in slices(batch.column(1), SLICE):
                for ref, s in zip(ids[start:end], gram_sets(texts, n)):
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        often = np.where(known[at] == s, times[at], 0)
                        if often.any():
                            s = s[np.argsort(often, kind="stable")]
                    s = s[: len(s) - math.ceil(threshold * len(s) - 1e-9) + SHARED]
                    grams.append(s)
                    refs.append((ref, len(s)))
                    size += len(s)
                if size >= POSTINGS:
                    yield rows()
                    grams, refs, size = [], [], 0
        if size:
            yield rows()

    return send


def _within(threshold: float):
    """For mapInArrow over rows (at, half, digest, weight, set) sorted by `at`: (digest, links), the weights of the sets that are like
    each one where they meet. Members of the same half of two blocks don't meet (0: all meet)."""

    def one(half: np.ndarray, weight: np.ndarray, packed: list[bytes]) -> np.ndarray:
        sets = [np.frombuffer(p, np.int64) for p in packed]
        sizes, links = np.array([len(s) for s in sets]), np.zeros(len(sets), np.int64)
        _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        several = times[at] > 1  # others are common to no two
        upto = np.concatenate([[0], np.cumsum(several)])[np.concatenate([[0], np.cumsum(sizes)])]
        at, mark = at[several], np.zeros(len(times), np.int32)
        for a in np.nonzero(half < 2)[0]:
            own = at[upto[a] : upto[a + 1]]
            mark[own] = 1
            common = np.concatenate([[0], np.cumsum(mark[at])])[upto]
            mark[own] = 0
            common = common[1:] - common[:-1]
            like = common / (sizes + sizes[a] - common) >= threshold
            like &= (half == 0) | (half == 2)
            like[a] = False
            links[a] += weight[like].sum()
            if half[a]:
                links[like] += weight[a]
        return links

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def rows() -> pa.RecordBatch:
            half, digest, weight, packed = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(one(np.array(half), np.array(weight), packed))], ["digest", "links"])

        for batch in batches:
            for at, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if at != now and held:
                    yield rows()
                    held = []
                now = at
                held.append(row)
        if held:
            yield rows()

    return within


class Join:
    """What the join finds of docs (doc_id, text): `rows`, a row a document (own doc_id, text hash and digest), and pairs()."""

    def __init__(self, docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES, seed: int = 17):
        self.docs, self.n, self.threshold = docs, n, threshold
        self.bands, self.per_band, self.agreeing = choose_sketch(threshold, recall, max_hashes)
        signed = docs.where(F.col("text").isNotNull()).select(
            integer(docs, "doc_id").alias("id"), F.xxhash64("text").alias("hash"), signatures("text", n, self.bands, self.per_band, seed).alias("s")
        )
        self.signed = materialize(signed.select("id", "hash", "s.digest", "s.grams", "s.words"), "signatures")
        self.rows = self.signed.where(F.col("digest").isNotNull())

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """(digest, id, hash) of each class, of its least document; (at, a, b) of pairs to be verified."""
        least = F.min(F.struct(F.col("id").isNull(), "id", "hash"))
        classes = self.rows.groupBy("digest").agg(F.first("grams").alias("grams"), F.first("words").alias("words"), least.alias("r"))
        classes = materialize(classes.select("digest", "grams", "words", F.col("r.id").alias("id"), F.col("r.hash").alias("hash")), "classes")
        banded = classes.select(F.posexplode("words").alias("band", "word"), "digest")
        shared = banded.groupBy("band", "word").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
        blocks = F.ceil(F.col("members") / MEET).cast("int")
        crowded = banded.join(shared, ["band", "word"]).select("band", "word", "digest", blocks.alias("blocks")).join(classes.select("digest", "grams", "words"), "digest")
        # Each block meets itself and every other one: (own, other) in order; its half tells which of the two a member is of.
        crowded = crowded.withColumn("own", F.pmod(F.xxhash64("digest"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        half = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        at = F.xxhash64("band", "word", F.least("own", "other"), F.greatest("own", "other"))
        met = crowded.select(at.alias("at"), half.alias("half"), "band", "digest", "grams", "words").repartition("at").sortWithinPartitions("at", "digest")
        met = met.mapInArrow(_meet(self.threshold, self.bands, self.per_band, self.agreeing), "at long, a binary, b binary")
        return classes.select("digest", "id", "hash"), materialize(met, "candidates")

    def pairs(self, forest: bool = False) -> DataFrame:
        """(a, b, jaccard): digests a < b of classes whose similarity reaches the threshold."""
        return self.verified(*self.candidates(), forest)

    def texts(self, whose: DataFrame, *more: str) -> DataFrame:
        """(text, more) of documents by their own id and hash; of several equal ones all."""
        whose = materialize(whose, "representatives")
        few = whose.count() <= BROADCAST_ROWS
        texts = self.docs.where(F.col("text").isNotNull()).select(integer(self.docs, "doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
        same = (F.col("hash") == F.col(OWN + "hash")) & F.col("id").eqNullSafe(F.col(OWN + "id"))
        return texts.join(F.broadcast(whose) if few else whose, same, "inner" if more else "left_semi").select("text", *more)

    def sets(self, whose: DataFrame) -> DataFrame:
        """(digest, set) of classes (digest, id, hash)."""
        return self.texts(whose.select(F.col("id").alias(OWN + "id"), F.col("hash").alias(OWN + "hash"))).select(packed_sets("text", self.n).alias("s")).select("s.*")

    def verified(self, classes: DataFrame, candidates: DataFrame, forest: bool = False) -> DataFrame:
        """(a, b, jaccard): of candidates (at, a, b) those that reach the threshold."""
        needed = candidates.select("at", F.explode(F.array("a", "b")).alias("digest")).distinct()
        sets = self.sets(classes.join(needed.select("digest").distinct(), "digest", "left_semi"))
        sent = needed.join(sets, "digest").select("at", F.col("digest").alias("a"), F.lit(None).cast("binary").alias("b"), "set")
        both = sent.unionByName(candidates.select("at", "a", "b", F.lit(None).cast("binary").alias("set")))
        sorted_ = both.repartition("at").sortWithinPartitions("at", F.col("b").isNotNull())
        return sorted_.mapInArrow(_verify(self.threshold, forest), "a binary, b binary, jaccard double")

    def crossing(self, classes: DataFrame) -> DataFrame:
        """(a, b, jaccard): all similar pairs of classes (digest, label, grams, id, hash) with different labels, none left out.

        A class has a ref of 64 bits: 40 of its label's hash, 10 of its size's logarithm, 14 of its digest's. Classes with the same ref stand
        for each other until they are verified; a pair would be lost only if both labels had the same 40 bits."""
        spark = classes.sparkSession
        code = F.floor(F.log(F.col("grams")) / math.log(SIZE_STEP))
        high = F.shiftleft(F.shiftright(F.xxhash64("label"), 24), 24)
        ref = high.bitwiseOR(F.shiftleft(code.cast("long"), CODE_AT)).bitwiseOR(F.xxhash64("digest").bitwiseAND((1 << CODE_AT) - 1))
        known = materialize(classes.select("digest", "grams", "id", "hash", ref.alias("ref")), "refs")
        whose = known.groupBy(F.col("id").alias(OWN + "id"), F.col("hash").alias(OWN + "hash")).agg(F.first("ref").alias("ref"))
        total = classes.agg(F.sum("grams")).first()[0] or 0
        frequent = spark.sparkContext.broadcast(self._frequent(classes))
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (2 * POSTINGS)))
        sent = self.texts(whose, "ref").select("ref", "text").mapInArrow(_prefixes(self.n, self.threshold, frequent, buckets), "bucket long, prints binary, refs binary")
        met = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_cross(self.threshold), "a long, b long, n long")
        low = [F.pow(F.lit(SIZE_STEP), F.shiftright(c, CODE_AT).bitwiseAND(CODES)) for c in ("a", "b")]
        pairs = met.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= _needed(self.threshold, low, SIZE_STEP * (1 + 1e-9)))
        x, y = (known.select(F.col("ref").alias(ref), F.col("digest").alias(x), F.col("grams").alias(size)) for ref, x, size in (("a", "x", "p"), ("b", "y", "q")))
        named = pairs.join(x, "a").join(y, "b").where(F.col("n") >= _needed(self.threshold, (F.col("p"), F.col("q"))))
        named = materialize(named.select(F.col("a").alias("at"), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "crossing")
        return self.verified(known, named)

    def _frequent(self, classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """N-grams that many of a seeded sample of classes have, sorted, and how many."""
        n = self.n

        @arrow_udf("array<bigint>")
        def grams(texts: pa.Array) -> pa.Array:
            claim(_none)
            return pa.array([s.view(np.int64) for _, _, some in slices(texts, SLICE) for s in gram_sets(some, n)], pa.list_(pa.int64()))

        some = classes.orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE).select(F.col("id").alias(OWN + "id"), F.col("hash").alias(OWN + "hash"))
        counted = self.texts(some).select(F.explode(grams("text")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).cast("int").alias("n")).where(F.col("n") >= FREQUENT)
        found = counted.orderBy(F.desc("n"), "gram").limit(FREQUENT_GRAMS).toArrow()
        known, times = found["gram"].to_numpy().view(_U), found["n"].to_numpy()
        order = np.argsort(known)
        return known[order], times[order]

    def within(self, classes: DataFrame) -> DataFrame:
        """(digest, links): for classes (digest, label, grams, weight, id, hash) the weights of the similar ones of the same label; each is compared with each."""
        groups = classes.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.sum("grams").alias("all")).where("members > 1")
        blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("all") / GRAMS)).cast("int")
        held = materialize(classes.join(groups.select("label", blocks.alias("blocks")), "label"), "members")
        sent = held.withColumn("own", F.pmod(F.xxhash64("digest"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        half = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        at = F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other"))
        sets = self.sets(held).dropDuplicates(["digest"])
        rows = sent.select(at.alias("at"), half.alias("half"), "digest", "weight").join(sets, "digest").select("at", "half", "digest", "weight", "set")
        return rows.repartition("at").sortWithinPartitions("at").mapInArrow(_within(self.threshold), "digest binary, links long")


def links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES, seed: int = 17) -> DataFrame:
    """(doc_id, class_id, links): a row for each document, exact whatever recall is.

    links: how many other documents have a set of n-grams whose similarity to this one's reaches the threshold, copies included.
    class_id: the least doc_id among the documents that links connect with this one, itself included. No link is left out: bands find
    most, all pairs of what they connect are compared, and between such groups prefixes find the others (up to 64-bit hashes, as in join).

    docs has doc_id, an integer (any other kind is a TypeError), and text; other columns, whatever their names, are not read. Texts without
    any word (null, empty, only signs) have no link and their own doc_id as class. Repeated rows, and rows with a null doc_id, are
    documents of their own; class_id is null where none in the class has a doc_id. Texts of any length are taken whole. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    found = Join(docs, n, threshold, recall, max_hashes, seed)
    edges = finished(spark, lambda: found.pairs(forest=True).select("a", "b"), "edges")
    labels = components(edges)
    least = F.min(F.struct(F.col("id").isNull(), "id", "hash"))
    classes = found.rows.groupBy("digest").agg(F.first("grams").alias("grams"), F.count(F.lit(1)).alias("weight"), least.alias("r"))
    classes = classes.join(labels, F.col("digest") == F.col("node"), "left")
    classes = materialize(classes.select("digest", F.coalesce("label", "digest").alias("label"), "grams", "weight", F.col("r.id").alias("id"), F.col("r.hash").alias("hash")), "classes")
    release(edges, labels)
    across = finished(spark, lambda: found.crossing(classes).select("a", "b").distinct(), "across")
    both = across.unionByName(across.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(classes.select(F.col("digest").alias("b"), "weight"), "b").select(F.col("a").alias("digest"), F.col("weight").alias("links"))
    linked = linked.unionByName(finished(spark, lambda: found.within(classes), "within")).groupBy("digest").agg(F.sum("links").alias("links"))
    whose = classes.select("digest", "label")
    between = across.join(whose.select(F.col("digest").alias("a"), F.col("label").alias("x")), "a").join(whose.select(F.col("digest").alias("b"), F.col("label").alias("y")), "b")
    joined = components(between.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("whole"))
    final = classes.join(joined, "label", "left").join(linked, "digest", "left")
    final = final.select("digest", F.coalesce("whole", "label").alias("label"), "id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    names = final.groupBy("label").agg(F.min("id").alias("class_id"))
    final = materialize(final.join(names, "label").select("digest", "class_id", "links"), "links")
    rows = found.rows.select(F.col("id").alias("doc_id"), "digest").join(final, "digest").select("doc_id", "class_id", "links")
    none = found.signed.where(F.col("digest").isNull()).select("id").unionByName(docs.where(F.col("text").isNull()).select(integer(docs, "doc_id").alias("id")))
    return rows.unionByName(none.select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links")))


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES, seed: int = 17, expand: bool = False) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: all similar pairs, those among equal sets in short.

    Documents with the same set of n-grams are named by the least doc_id among them: each other one has a row with it
    (jaccard 1), and two different sets have one row, of their least doc_ids, if their similarity reaches the threshold. So every
    similar pair of documents is there, by way of its two names, and thousands of copies take thousands of rows instead of
    millions. jaccard is that of the sets of 64-bit hashes. recall is the probability of finding a pair right at the threshold, which
    bands and sketch share; none is capped. expand: every pair of documents has a row of its own instead.

    docs has doc_id, an integer (any other kind is a TypeError), and text; other columns, whatever their names, are not read. Texts without any word (null, empty, only signs) have an empty set
    and no pair. Rows with a null doc_id can't be named: they stand for nothing, though they never hide another row. Repeated
    doc_ids give no row with themselves. Texts of any length are taken whole. An empty table gives an empty one.
    """
    found = Join(docs, n, threshold, recall, max_hashes, seed)
    ids = found.rows.where(F.col("id").isNotNull()).select("digest", "id")
    if expand:
        x, y = ids.select(F.col("digest").alias("a"), F.col("id").alias("x")).distinct(), ids.select(F.col("digest").alias("b"), F.col("id").alias("y")).distinct()
        across = finished(docs.sparkSession, found.pairs, "pairs").join(x, "a").join(y, "b").select("x", "y", "jaccard")
        within = x.join(y, F.col("a") == F.col("b")).select("x", "y", F.lit(1.0).alias("jaccard"))
        both = across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
        return both.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))
    names = ids.groupBy("digest").agg(F.min("id").alias("name"))
    pairs = finished(docs.sparkSession, found.pairs, "pairs")
    named = pairs.join(names.select(F.col("digest").alias("a"), F.col("name").alias("x")), "a").join(names.select(F.col("digest").alias("b"), F.col("name").alias("y")), "b")
    across = named.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard").where("doc_a < doc_b")
    copies = ids.join(names, "digest").where(F.col("id") > F.col("name")).select(F.col("name").alias("doc_a"), F.col("id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    # A pair of ids occurs more than once only where an id has several texts.
    return across.unionByName(copies).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def components(edges: DataFrame, nodes: str = "binary") -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the least node that it hangs together with.

    Alternating large and small stars: each round, every node's larger, then smaller, neighbours are tied to its least one,
    until nothing changes. Rounds grow with the logarithm of the longest chain; each is written to the shared folder.
    """
    now, before = edges.select("a", "b").where("a <> b").distinct(), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now, old = materialize(small.where("a <> b").distinct(), "stars"), now
        release(old)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            done = now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
            labels = finished(edges.sparkSession, lambda: done, "labels")
            release(now)
            return labels
        before = state


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES, seed: int = 17) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the least doc_id (null last), then text hash.

    A group is what similar pairs connect. Rows whose text has no word (null, empty, only signs) are in no group and all stay. Rows
    with the same doc_id and text are one document: of them the one stays that is least as JSON. Null doc_ids are compared like others.
    Texts of any length are taken whole. An empty table gives an empty one. All columns are kept, whatever they are called; doc_id
    is an integer, any other kind is a TypeError.
    """
    found = Join(docs, n, threshold, recall, max_hashes, seed)
    edges = finished(docs.sparkSession, lambda: found.pairs(forest=True).select("a", "b"), "edges")
    labels = components(edges)
    grouped = found.rows.join(labels, F.col("digest") == F.col("node"), "left").select("id", "hash", F.coalesce("label", "digest").alias("label"))
    grouped = grouped.groupBy("label", "id", "hash").agg(F.count(F.lit(1)).alias("rows"))
    best = F.min(F.struct(F.col("id").isNull(), "id", "hash"))
    winners = grouped.groupBy("label").agg(best.alias("w"))
    marked = grouped.join(winners, "label").select("id", "hash", "rows", (F.col("id").eqNullSafe(F.col("w.id")) & (F.col("hash") == F.col("w.hash"))).alias("wins"))
    marked = materialize(marked.where(~F.col("wins") | (F.col("rows") > 1)), "losers")
    release(found.signed, edges, labels)
    losers = marked.where(~F.col("wins")).select(F.col("id").alias(OWN + "i"), F.col("hash").alias(OWN + "h"))
    again = marked.where("wins").select(F.col("id").alias(OWN + "i"), F.col("hash").alias(OWN + "h"))
    some, repeated = losers.count(), again.count()
    rows = docs.withColumn(OWN + "hash", F.xxhash64("text"))
    same = lambda: integer(docs, "doc_id").eqNullSafe(F.col(OWN + "i")) & (F.col(OWN + "hash") == F.col(OWN + "h")) & F.col("text").isNotNull()
    if some:
        rows = rows.join(F.broadcast(losers) if some <= BROADCAST_ROWS else losers, same(), "left_anti")
    if repeated:  # winners that stand in several equal rows: one of them stays
        twice = rows.join(F.broadcast(again) if repeated <= BROADCAST_ROWS else again, same(), "left_semi")
        rows = rows.join(F.broadcast(again) if repeated <= BROADCAST_ROWS else again, same(), "left_anti").unionByName(one_of(twice, docs.columns, ["doc_id", OWN + "hash"]))
    return rows.select(*columns_of(docs))


def links_sql(n: int = N, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for links(documents): every pair of sets with a common n-gram."""
    return f"""WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda w: w <> '') AS w
        FROM documents),
    sets AS (
        SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')) END)) AS s
        FROM words WHERE len(w) > 0),
    classes AS (SELECT row_number() OVER () AS c, s, min(doc_id) AS name, len(s) AS size, count(*) AS weight FROM sets GROUP BY s),
    grams AS (SELECT c, size, weight, unnest(s) AS g FROM classes),
    shared AS (
        SELECT x.c AS a, y.c AS b, count(*) AS n, any_value(x.size) AS p, any_value(y.size) AS q, any_value(y.weight) AS weight
        FROM grams x JOIN grams y ON x.g = y.g AND x.c <> y.c GROUP BY 1, 2),
    pairs AS (SELECT a, b, weight FROM shared WHERE n / (p + q - n) >= {threshold}),
    reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
    whole AS (SELECT r.a AS c, min(k.name) AS class_id FROM reach r JOIN classes k ON k.c = r.b GROUP BY 1),
    linked AS (SELECT a AS c, sum(weight) AS links FROM pairs GROUP BY 1)
    SELECT s.doc_id, w.class_id, CAST(coalesce(l.links, 0) + k.weight - 1 AS BIGINT) AS links
    FROM sets s JOIN classes k ON s.s = k.s JOIN whole w ON w.c = k.c LEFT JOIN linked l ON l.c = k.c
    UNION ALL SELECT doc_id, doc_id, 0 FROM words WHERE w IS NULL OR len(w) = 0"""


def oracle_sql(n: int = N, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for join(documents): exact, without candidates (so equal where recall is complete)."""
    return f"""WITH words AS (
        SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda w: w <> '') AS w
        FROM documents WHERE text IS NOT NULL),
    sets AS (
        SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')) END)) AS s
        FROM words WHERE len(w) > 0),
    classes AS (SELECT s, min(doc_id) AS name, len(s) AS size FROM sets GROUP BY s),
    grams AS (SELECT name, size, unnest(s) AS g FROM classes),
    shared AS (
        SELECT x.name AS doc_a, y.name AS doc_b, count(*) AS c, any_value(x.size) AS p, any_value(y.size) AS q
        FROM grams x JOIN grams y ON x.g = y.g AND x.name < y.name GROUP BY 1, 2)
    SELECT doc_a, doc_b, c / (p + q - c) AS jaccard FROM shared WHERE c / (p + q - c) >= {threshold}
    UNION ALL
    SELECT c.name, s.doc_id, 1.0 FROM sets s JOIN classes c ON s.s = c.s WHERE s.doc_id > c.name"""
