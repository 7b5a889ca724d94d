"""Quality classifier: importance resampling with hashed n-gram models of target and raw text, drawn by Gumbel top-k.

A document's weight is p_target(text) / p_raw(text). Both are bags of hashed n-grams: words, pairs of words, the first four and
five letters of words, and shapes of words (punctuation and case); a word that follows itself is one pair of its own. The raw text is a mixture of documents like the target, of
low quality and toxic ones, so p_raw(text) = sum of share * p_part(text), with the shares found by expectation maximization
over all documents; one bag for all raw text would let a long document's ordinary words outweigh a few toxic ones. A bucket
whose count in a part is no more than chance away from the target's keeps the target's rate there, up to a common factor, so
rare words add no noise. The parts are counted on documents with labels, and smoothed by the counts of all documents. They have
no document in common: toxic documents of low quality are in the low part only, for their junk would be most of the toxic one.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from larkspur.llm.common import OWN, claim, columns_of, integer, materialize, seeded, slices, without

#: Buckets: 2^BITS for words, as many for pairs, 2^STEM_BITS for each length of beginnings, 2^SHAPE_BITS for shapes.
BITS, STEM_BITS, SHAPE_BITS = 18, 16, 10
WORD_BITS = 64 - 2 * STEM_BITS - SHAPE_BITS
STEMS = 2 << BITS
SHAPES = STEMS + (2 << STEM_BITS)
SIZE = SHAPES + (1 << SHAPE_BITS)
#: At most so many labels are used, drawn by a seeded hash: the bounded sample that the models of the parts are fitted on.
MAX_LABELS = 50_000
#: A bucket counts as different in a part beyond so many standard deviations and this log ratio.
DEVIATIONS, LEAST_RATIO = 8.0, 0.5
#: Raw n-grams that smooth each model.
SMOOTHING = 100.0
#: A document with more n-grams than this counts as so many in its part, all scaled alike, in units of 1 / UNIT.
MOST, UNIT = 1 << 14, 1 << 10
#: Bytes of text that are turned to features at once (or one document, if it is longer).
SLICE = 1 << 18
#: Words whose features a worker remembers.
REMEMBERED = 120_000
REPEATED = 1 << BITS

#: Shares that stand for a model without parts.
ONE_BAG = (0.0, 1.0, 0.0)
COUNTS = ("raw", "target", "low", "toxic")


def _digest(text: str, bits: int) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text) & (1 << bits) - 1


@functools.lru_cache(maxsize=1 << 16)
def _shape(signs: str, case: str) -> int:
    return _digest(signs[:8] + case, SHAPE_BITS)


@functools.lru_cache(maxsize=1 << 16)
def _stem(stem: str) -> int:
    return _digest(stem[:4], STEM_BITS) << STEM_BITS + SHAPE_BITS | _digest(stem + "-", STEM_BITS) << SHAPE_BITS


class _Words(dict):
    """Of each word, in 64 bits: hashes of its letters and digits, of the first four and five of them, and of its shape."""

    def __missing__(self, word: str) -> int:
        core, signs = word.lower(), ""
        if not core.isalnum():
            core, signs = "".join(filter(str.isalnum, core)), "".join([c for c in word if not c.isalnum()])
        case = "U" if len(core) > 1 and word.isupper() else "T" if word[:1].isupper() else "l"
        if core.isdigit():
            case += "9"
        value = _digest(core, WORD_BITS) << 64 - WORD_BITS | _stem(core[:5]) | _shape(signs, case)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value

    def clear(self) -> None:
        super().clear()
        _shape.cache_clear()
        _stem.cache_clear()


_words = _Words()


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram of the texts, whole texts."""
    words = [t.split() if t else [] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    values = np.fromiter(map(_words.__getitem__, itertools.chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(words)), sizes)
    part = lambda shift, bits: (values >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
    core = values >> np.uint64(64 - WORD_BITS)
    first, second, same = core[:-1], core[1:], doc[:-1] == doc[1:]
    pair = ((first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS)
    pair[first == second] = REPEATED
    return np.concatenate([doc, doc, doc, doc, doc[:-1][same]]), np.concatenate([
        (core & np.uint64((1 << BITS) - 1)).astype(np.int64), STEMS + part(STEM_BITS + SHAPE_BITS, STEM_BITS),
        STEMS + (1 << STEM_BITS) + part(SHAPE_BITS, STEM_BITS), SHAPES + part(0, SHAPE_BITS), pair[same],
    ])


def count_ngrams(docs: DataFrame, labels: DataFrame, max_labels: int, seed: int) -> np.ndarray:
    """Counts by COUNTS and bucket: raw over all documents, the others over documents with labels, none of them for more than MOST."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias(OWN + "q"), F.max("toxic").alias(OWN + "t"))
    # Bounded by max_labels, so it can be sent to all.
    known = F.broadcast(known.orderBy(seeded(seed, "doc_id"), "doc_id").limit(max_labels))
    quality, toxic = F.coalesce(F.col(OWN + "q"), F.lit(-1)), F.coalesce(F.col(OWN + "t"), F.lit(-1))
    parts = F.when((quality == 1) & (toxic == 0), 1).otherwise(0) + F.when(quality == 0, 2).otherwise(0) + F.when((toxic == 1) & (quality != 0), 4).otherwise(0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, SIZE), np.int64)
        claim(_words)
        for batch in batches:
            part = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, texts in slices(batch.column(0), SLICE):
                doc, bucket = features(texts)
                sums[0] += np.bincount(bucket, minlength=SIZE)
                # Whole units: the order of summing mustn't matter.
                units = np.rint(UNIT * np.minimum(1.0, MOST / np.maximum(1, np.bincount(doc, minlength=j - i))))
                for k in (1, 2, 3):
                    if (own := (part[i:j] >> k - 1 & 1).astype(bool)).any():
                        at = own[doc]
                        sums[k] += np.bincount(bucket[at], units[doc[at]], minlength=SIZE).astype(np.int64)
        (at,) = np.nonzero(sums[0])
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(s[some]) for s in sums)], ["bucket", *COUNTS])

    texts = docs.join(known, "doc_id", "left").select("text", parts.cast("int").alias(OWN + "part"))
    sums = texts.mapInArrow(count, "bucket long, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in COUNTS])
    table, counts = sums.toArrow(), np.zeros((4, SIZE))  # at most SIZE rows, at any size of the corpus
    for k, c in enumerate(COUNTS):
        counts[k, table["bucket"].to_numpy()] = table[c].to_numpy() / (UNIT if k else 1)
    return counts


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log(p_part / p_target) by bucket, for low quality and toxic."""
    raw = counts[0] / max(1.0, counts[0].sum())
    target, found = counts[1], []
    for part in counts[2:]:
        if not part.sum() or not target.sum():
            found.append(np.zeros(SIZE, np.float32))
            continue
        n, m = part.sum(), target.sum()
        p, q = (part + SMOOTHING * raw) / (n + SMOOTHING), (target + SMOOTHING * raw) / (m + SMOOTHING)
        expected = (part + target) * n / (n + m)
        seen = part + target > 0
        ratio = np.zeros(SIZE)
        ratio[seen] = np.log(p[seen] / q[seen])
        away = seen & (np.abs(part - expected) > DEVIATIONS * np.sqrt(expected * m / (n + m))) & (np.abs(ratio) > LEAST_RATIO)
        rest = np.log(max(1e-9, 1 - p[away].sum()) / max(1e-9, 1 - q[away].sum()))
        found.append(np.where(away, ratio, rest).astype(np.float32))
    return np.stack(found)


def raw_ratio(counts: np.ndarray) -> np.ndarray:
    """log(p_raw / p_target) by bucket, with one bag for all raw text: the plain form of the method. In place of log_ratios."""
    raw, target = counts[0] / max(1.0, counts[0].sum()), counts[1]
    seen, found = raw > 0, np.zeros((2, SIZE), np.float32)
    if target.sum():
        found[0, seen] = np.log(raw[seen] / ((target[seen] + SMOOTHING * raw[seen]) / (target.sum() + SMOOTHING)))
    return found


@dataclass
class Model:
    """log_ratios: 4 MB at any size of the corpus. shares: of the target, low quality and toxic documents among all."""

    log_ratios: np.ndarray
    shares: tuple[float, float, float]


def ratios(text: Column | str, model_ratios, session) -> Column:
    """struct(low, toxic): log(p_part(text) / p_target(text)). 0 for an empty text, null for null."""
    held = session.sparkContext.broadcast(model_ratios)

    @arrow_udf("struct<low: double, toxic: double>")
    def score(texts: pa.Array) -> pa.Array:
        claim(_words)
        table, out = held.value, np.zeros((2, len(texts)))
        for i, j, some in slices(texts, SLICE):
            doc, bucket = features(some)
            for k in (0, 1):
                out[k, i:j] = np.bincount(doc, table[k][bucket], minlength=j - i)
        return pa.StructArray.from_arrays([pa.array(out[0]), pa.array(out[1])], ["low", "toxic"], mask=texts.is_null())

    # Taken as not deterministic, so that a filter on the result doesn't compute it twice.
    return score.asNondeterministic()(text)


def _weight(scores: str, shares: tuple[float, float, float]) -> Column:
    """log(p_target / p_raw), from the ratios of the parts."""
    low, toxic = F.col(scores + ".low"), F.col(scores + ".toxic")
    if shares == ONE_BAG:
        return F.round(-low, 6)
    most = F.greatest(F.lit(0.0), low, toxic)
    mixed = sum((F.lit(s) * F.exp(x - most) for s, x in zip(shares, (F.lit(0.0), low, toxic))), F.lit(0.0))
    return F.round(-(most + F.log(mixed)), 6)  # rounded: the order of summing mustn't matter


def fit_shares(scored: DataFrame, start: tuple[float, float, float], rounds: int = 6) -> tuple[float, float, float]:
    """The parts' shares of all documents, by expectation maximization over their scores."""
    shares = start
    for _ in range(rounds):
        weight = _weight(OWN + "s", shares)
        posts = [F.lit(s) * F.exp(weight + x) for s, x in zip(shares, (F.lit(0.0), F.col(OWN + "s.low"), F.col(OWN + "s.toxic")))]
        found = scored.where(F.col(OWN + "s").isNotNull()).agg(*[F.avg(p) for p in posts]).first()
        if found[0] is None:
            return start
        shares = tuple(round(min(1.0, max(1e-4, x)), 6) for x in found)
    return shares


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096, few: int = 50_000) -> float | None:
    """The k-th largest value, exactly, by histograms that narrow down; few values at last come to the driver."""
    low, high, count = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or not count:
        return None
    if k >= count:
        return low
    inside = values
    while True:
        if low == high:
            return low
        if count <= few:
            return sorted((r[0] for r in inside.select(column).collect()), reverse=True)[k - 1]
        bin_ = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1))
        found = sorted(inside.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)), F.min(column), F.max(column)).collect(), reverse=True)
        for b, n, least, most in found:
            if k <= n:
                inside, low, high, count = values.where(F.col(column).between(least, most)), least, most, n
                break
            k -= n


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, seed: int = 17, columns: list[str] | None = None, one_bag: bool = False) -> tuple[Model, DataFrame]:
    """The model, and (own row of columns, doc_id, own scores) of all documents: each is scored once and kept in the shared folder,
    so that threshold and result are read from there."""
    counts = count_ngrams(docs, labels, max_labels, seed)
    table = raw_ratio(counts) if one_bag else log_ratios(counts)
    # The row goes along in a struct, so that its names can't clash with those used here.
    row = [F.struct(*columns_of(docs, columns)).alias(OWN + "row")] if columns else []
    scored = materialize(docs.select(*row, integer(docs, "doc_id").alias("doc_id"), ratios("text", table, docs.sparkSession).alias(OWN + "s")), "scores")
    if one_bag:
        return Model(table, ONE_BAG), scored
    sizes = np.maximum(counts[1:].sum(1), 1.0)
    start = tuple(float(x) for x in sizes / sizes.sum())
    return Model(table, fit_shares(scored, start)), scored


def keyed(scored: DataFrame, model: Model, seed: int) -> DataFrame:
    """Of rows with scores: with their own weight, and key of Gumbel top-k: the weight plus seeded Gumbel noise."""
    uniform = (F.shiftrightunsigned(seeded(seed, F.lit("gumbel"), F.col("doc_id")), 11) + 0.5) / float(1 << 53)
    weighted = scored.where(F.col(OWN + "s").isNotNull()).withColumn(OWN + "w", _weight(OWN + "s", model.shares))
    return weighted.withColumn(OWN + "key", F.col(OWN + "w") - F.log(-F.log(uniform)))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, max_labels: int = MAX_LABELS, seed: int = 17, columns: list[str] | None = None, weights: bool = True, one_bag: bool = False) -> DataFrame:
    """The k documents with the largest keys: columns (all by default) and, with weights, log_weight: k draws without replacement.

    docs has doc_id, an integer (any other kind is a TypeError), and text; labels has doc_id, quality (1: good) and toxic (1: toxic), null for
    unknown; of several labels of a document the worst holds. one_bag: p_raw is one bag of all raw n-grams instead of a mixture of
    parts; with k None as many as are likelier in the target than in it. k None: as many as are more likely of the target's part than not. Null texts are never
    drawn. An empty text has no n-gram and the neutral weight 0. Rows with the same doc_id and text have the same key; all
    rows that tie with the last one drawn are drawn. Without any label for the target, or for neither other part, all weights
    are alike and all documents with a text are kept (or k by noise alone). An empty table gives an empty one. With
    weights, an input column log_weight is replaced.
    """
    docs = without(docs, "log_weight") if weights else docs
    columns = columns or docs.columns
    model, scored = fit(docs, labels, max_labels, seed, columns, one_bag)
    keys = keyed(scored, model, seed)
    if k is None:
        likely = F.col(OWN + "w") + (0.0 if one_bag else float(np.log(model.shares[0]))) >= (0.0 if one_bag else float(np.log(0.5)))
        k = keys.where(likely).count() if model.log_ratios.any() else keys.count()
    least = kth_largest(keys, OWN + "key", k)
    kept = keys.where(F.col(OWN + "key") >= least if least is not None else F.lit(False))
    return kept.select(OWN + "row.*", F.col(OWN + "w").alias("log_weight")) if weights else kept.select(OWN + "row.*")
