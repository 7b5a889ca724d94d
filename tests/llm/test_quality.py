"""Held-out accuracy, and the parts by hand."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from larkspur.llm import quality as Q
from larkspur.llm.common import seeded
from tests.llm.helpers import SF_MORE, docs, rows, sample

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_documents(spark):
    d = sample(spark, SF_MORE)
    labels = spark.read.parquet(f"{SF_MORE}/labels.parquet")
    kept = {r.doc_id for r in Q.resample(d, labels.where("doc_id % 2 = 0"), columns=["doc_id"]).collect()}
    held = [tuple(r) for r in labels.where("doc_id % 2 = 1").collect()]
    share = lambda test: np.mean([i in kept for i, q, t in held if test(q, t)])
    assert share(lambda q, t: q == 1 and t == 0) >= 0.97
    assert share(lambda q, t: q == 0) <= 0.05


def prose(rng, bad=0, junk=False):
    words = [rng.choice(["river", "stone", "green", "walks", "under", "light", "paper", "seven"]) + rng.choice(["", "s", "ly", "."]) for _ in range(80)]
    for _ in range(bad):
        words[rng.randrange(80)] = rng.choice(["vilebad", "nastygrr", "hatefu"])
    return " ".join(w.upper() + "!!" if junk else w for w in words)


def test_planted_toxic_and_junk(spark):
    rng = random.Random(7)
    data, labels = [], []
    for i in range(900):
        kind = i % 10
        data.append((i, prose(rng, bad=3 if kind == 0 else 0, junk=kind == 1), "s"))
        if i < 600:
            labels.append((i, int(kind != 1), int(kind == 0)))
    kept = {r.doc_id for r in Q.resample(docs(spark, data), spark.createDataFrame(labels, LABELS), columns=["doc_id"]).collect()}
    assert kept == {i for i in range(900) if i % 10 > 1}


def test_weight_is_the_ratio_of_the_models():
    """log p_part / p_target by hand, from counts, for a bucket that stands out and one that doesn't."""
    counts = np.zeros((4, Q.SIZE))
    counts[1, :4], counts[2, :4], counts[3, :4] = [5000, 5000, 0, 10], [480, 490, 900, 5], [500, 495, 0, 0]
    counts[0] = counts[1:].sum(0)
    low, toxic = Q.log_ratios(counts)
    raw = counts[0] / counts[0].sum()
    p = lambda k, b: (counts[k, b] + Q.SMOOTHING * raw[b]) / (counts[k].sum() + Q.SMOOTHING)
    assert low[2] == pytest.approx(np.log(p(2, 2) / p(1, 2)), rel=1e-5)
    assert toxic[0] == toxic[1] == toxic[5]  # nothing stands out


def test_features_of_every_word():
    texts = ["Aa aa. AA!! 12", "", None, "x x"]
    doc, bucket = Q.features(texts)
    assert sorted(doc) == [0] * (4 * 4 + 3) + [3] * (2 * 4 + 1)
    assert (bucket[doc == 3] == Q.REPEATED).sum() == 1 and (bucket[doc == 0] == Q.REPEATED).sum() == 2
    one = np.concatenate([Q.features([t])[1] for t in texts])
    assert sorted(one) == sorted(bucket)


@pytest.mark.parametrize("few", [3, 100_000])
def test_kth_largest(spark, few):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.standard_normal(400), np.full(300, 0.25), [-1e6, 1e6]])
    d = spark.createDataFrame([(float(v),) for v in values], "v double")
    ordered = np.sort(values)[::-1]
    for k in (1, 2, 150, 300, 450, 700, 702):
        assert Q.kth_largest(d, "v", k, bins=16, few=few) == ordered[k - 1]
    assert Q.kth_largest(d, "v", 10_000) == ordered[-1] and Q.kth_largest(d, "v", 0) is None and Q.kth_largest(d.where("v > 1e9"), "v", 3) is None


def test_k_draws_by_weight(spark):
    """With all weights alike the draw is even; k rows are drawn, the same ones for the same seed."""
    d = docs(spark, [(i, f"word{i}", "s") for i in range(200)])
    none = spark.createDataFrame([], LABELS)
    a, b, c = (rows(Q.resample(d, none, k=50, seed=s, columns=["doc_id"])) for s in (1, 1, 2))
    assert len(a) == len(c) == 50 and a == b and a != c


def test_odd_rows(spark):
    long = "river stone " * 50_000
    d = docs(spark, [(1, None, "a"), (2, "", "a"), (None, "no id", "a"), (3, "same text", "a"), (3, "same text", "a"), (4, long, None)])
    labels = spark.createDataFrame([(3, 1, 0), (3, None, None), (None, 0, 1), (4, 0, None), (99, 1, 1)], LABELS)
    got = Q.resample(d, labels)
    assert got.columns == ["doc_id", "text", "source", "log_weight"] and got.where("text is null").count() == 0
    assert rows(Q.resample(d, spark.createDataFrame([], LABELS)).select("doc_id", "text")) == rows(d.where("text is not null").select("doc_id", "text"))
    assert rows(Q.resample(docs(spark, []), labels)) == [] and rows(Q.resample(docs(spark, []), labels, k=3)) == []
    clash = docs(spark, [(1, "x", "a", 5, 6), (2, "y", "b", 5, 6)], "doc_id long, text string, source string, log_weight int, quality int")
    got = Q.resample(clash, spark.createDataFrame([(1, 1, 0)], LABELS))
    assert got.columns == ["doc_id", "text", "source", "quality", "log_weight"] and got.count() == 2


@pytest.mark.parametrize("sf", [SF_MORE, "/root/testdata/sf0.1"])
def test_labelled_toxic_documents_go_in_every_language(spark, sf):
    d, labels = sample(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in Q.resample(d, labels, columns=["doc_id"]).collect()}
    known = d.join(labels, "doc_id").select("doc_id", "lang", "quality", "toxic").collect()
    for lang in {r.lang for r in known}:
        toxic = [r.doc_id for r in known if r.lang == lang and r.toxic == 1]
        assert toxic and not kept & set(toxic), lang
    good = [r.doc_id in kept for r in known if (r.quality, r.toxic) == (1, 0)]
    assert np.mean(good) >= 0.97


def test_parts_have_no_document_in_common_and_none_dominates(spark):
    long = "junk " * 50_000
    d = docs(spark, [(1, "a b c", "s"), (2, "d e", "s"), (3, "f g", "s"), (4, long, "s"), (5, long, "s")])
    counts = Q.count_ngrams(d, spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, 1), (4, 1, 1)], LABELS), 100, 1)
    of = lambda *texts: np.bincount(np.concatenate([Q.features([t])[1] for t in texts]), minlength=Q.SIZE)
    assert (counts[0] == of("a b c", "d e", "f g", long, long)).all()
    assert (counts[1] == of("a b c")).all() and (counts[2] == of("d e")).all()
    scaled = of(long) * round(Q.MOST / of(long).sum() * Q.UNIT) / Q.UNIT
    assert np.allclose(counts[3], of("f g") + scaled) and counts[3].sum() <= 1.1 * Q.MOST


def own_ngrams(text):
    """Every n-gram's bucket, a word at a time, with nothing of the operator's."""
    h = lambda t, bits: xxh3_64_intdigest(t) % 2**bits
    out, last = Counter(), None
    for word in text.split():
        core = "".join(c for c in word.lower() if c.isalnum())
        signs = "" if word.lower().isalnum() else "".join(c for c in word if not c.isalnum())
        case = ("U" if len(core) > 1 and word.isupper() else "T" if word[0].isupper() else "l") + ("9" if core.isdigit() else "")
        this = h(core, 22)
        out["word", this % 2**18] += 1
        out["stem4", h(core[:4], 16)] += 1
        out["stem5", h(core[:5] + "-", 16)] += 1
        out["shape", h(signs[:8] + case, 10)] += 1
        if last is not None:
            out["pair", 0 if this == last else (last * 0x9E3779B97F4A7C15 + this * 0xC2B2AE3D27D4EB4F) % 2**64 >> 46] += 1
        last = this
    return out


def own_weights(docs_, labels, seed=17):
    """{doc_id: log weight} by the formulas, in plain Python."""
    bags = {i: own_ngrams(t) for i, t in docs_.items()}
    raw, parts = Counter(), {"target": Counter(), "low": Counter(), "toxic": Counter()}
    for i, bag in bags.items():
        raw.update(bag)
        q, t = labels.get(i, (None, None))
        part = "low" if q == 0 else "toxic" if t == 1 else "target" if (q, t) == (1, 0) else None
        if part:
            share = round(1024 * min(1, 16384 / max(1, bag.total()))) / 1024
            for g, n in bag.items():
                parts[part][g] += n * share
    total, target, ratios = raw.total(), parts["target"], {}
    m = target.total()
    for name in ("low", "toxic"):
        part, found, away_p, away_q = parts[name], {}, 0.0, 0.0
        n = part.total()
        for g in part.keys() | target.keys():
            p, q = ((c[g] + 100 * raw[g] / total) / (s + 100) for c, s in ((part, n), (target, m)))
            expected = (part[g] + target[g]) * n / (n + m)
            if abs(part[g] - expected) > 8 * math.sqrt(expected * m / (n + m)) and abs(math.log(p / q)) > 0.5:
                found[g] = math.log(p / q)
                away_p, away_q = away_p + p, away_q + q
        rest = math.log(max(1e-9, 1 - away_p) / max(1e-9, 1 - away_q))
        ratios[name] = {i: sum(c * found.get(g, rest) for g, c in bag.items()) for i, bag in bags.items()}
    sizes = [max(1.0, c.total()) for c in parts.values()]
    shares = [s / sum(sizes) for s in sizes]
    logs = lambda i: (0.0, ratios["low"][i], ratios["toxic"][i])

    def weight(i):
        most = max(logs(i))
        return -(most + math.log(sum(s * math.exp(x - most) for s, x in zip(shares, logs(i)))))

    for _ in range(6):
        posts = [[s * math.exp(weight(i) + x) for s, x in zip(shares, logs(i))] for i in bags]
        shares = [min(1, max(1e-4, sum(p[k] for p in posts) / len(posts))) for k in range(3)]
    return {i: weight(i) for i in bags}, shares[0]


def test_against_plain_python(spark):
    """Every weight, and the documents drawn, by an own count of n-grams; then the draw of 100 by the same keys."""
    d = sample(spark, SF_MORE).where("doc_id < 400")
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF_MORE}/labels.parquet").collect()}
    wanted, share = own_weights({r.doc_id: r.text for r in d.collect()}, labels)
    known = spark.read.parquet(f"{SF_MORE}/labels.parquet").where("doc_id < 400")
    noise = {r.doc_id: -math.log(-math.log(((r.h % 2**64 >> 11) + 0.5) / 2**53)) for r in d.select("doc_id", seeded(17, F.lit("gumbel"), F.col("doc_id")).alias("h")).collect()}
    order = sorted(wanted, key=lambda i: wanted[i] + noise[i], reverse=True)
    for k in (None, 100):
        got = {r.doc_id: r.log_weight for r in Q.resample(d, known, k=k).collect()}
        count = k or sum(w + math.log(share) >= math.log(0.5) for w in wanted.values())
        assert set(got) == set(order[:count]) and 0 < count < 400
        assert all(got[i] == pytest.approx(wanted[i], abs=2e-3, rel=1e-4) for i in got)


def test_one_bag(spark):
    """The plain form: log p_target - log p_raw, summed over a document's n-grams."""
    d = docs(spark, [(1, "a b", "s"), (2, "a c c", "s"), (3, "z z z", "s")])
    got = {r.doc_id: r.log_weight for r in Q.resample(d, spark.createDataFrame([(1, 1, 0)], LABELS), k=3, one_bag=True).collect()}
    bags = {i: own_ngrams(t) for i, t in ((1, "a b"), (2, "a c c"), (3, "z z z"))}
    raw = sum(bags.values(), Counter())
    weight = lambda bag: sum(c * math.log((bags[1][g] + 100 * raw[g] / raw.total()) / (bags[1].total() + 100) * raw.total() / raw[g]) for g, c in bag.items())
    assert got == {i: pytest.approx(weight(b), abs=1e-4) for i, b in bags.items()}
