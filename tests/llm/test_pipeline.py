"""The pipeline against a version without Spark's joins, windows or sketches: every pair, one document after the other."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import mixing, secret_scan
from larkspur.llm import token_counts as K
from larkspur.llm.common import seeded
from tests.llm.helpers import SF_MORE, sample
from tests.llm.test_ngram_join import groups
from tests.llm.test_packing import one_by_one
from tests.llm.test_quality import own_weights

ENCODE = K.encoding(K.TOKENIZER).encode_ordinary


def by_hand(spark):
    """After each stage: {doc_id: text}; at last the loads of the bins."""
    docs = {r.doc_id: r for r in sample(spark, SF_MORE).collect()}
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF_MORE}/labels.parquet").collect()}
    # 1
    weights, share = own_weights({i: r.text for i, r in docs.items()}, labels)
    k = sum(w + math.log(share) >= math.log(0.5) for w in weights.values())
    hashes = {r.doc_id: r.h % 2**64 for r in sample(spark, SF_MORE).select("doc_id", seeded(17, F.lit("gumbel"), F.col("doc_id")).alias("h")).collect()}
    keys = {i: w - math.log(-math.log(((hashes[i] >> 11) + 0.5) / 2**53)) for i, w in weights.items()}
    kept = {i: docs[i].text for i in sorted(keys, key=keys.__getitem__, reverse=True)[:k]}
    stages = [kept]
    # 2
    kept = {min(g): kept[min(g)] for g in groups(list(kept.items()))}
    stages.append(kept)
    # 3
    kept = dict(kept)
    for i in kept:
        for r in secret_scan.RULES:
            kept[i] = re.sub(r.pattern, f"[{r.id}]", kept[i])
    stages.append(kept)
    # 4
    order = {r.doc_id: (r.h, r.t) for r in spark.createDataFrame(list(kept.items()), "doc_id long, text string").select("doc_id", seeded(17, "doc_id").alias("h"), F.xxhash64("text").alias("t")).collect()}
    length = {i: len(ENCODE(t)) for i, t in kept.items()}
    sources = defaultdict(Counter)
    for i, n in length.items():
        if n:
            sources[docs[i].source][n] += 1
    have = {s: sum(n * c for n, c in h.items()) for s, h in sources.items()}
    weight = {s: t**0.7 for s, t in have.items()}
    scale = min(have[s] / weight[s] for s in have)
    mixed = {}
    for s, h in sources.items():
        lengths = np.array(sorted(h))
        take = mixing.fit_counts(lengths, np.array([h[n] for n in lengths]), int(np.floor(round(weight[s] * scale, 2))))
        for n, c in zip(lengths, take):
            of = sorted((i for i in kept if docs[i].source == s and length[i] == n), key=order.__getitem__)
            mixed |= {i: kept[i] for i in of[:c]}
    stages.append(mixed)
    # 5
    pieces = [m for i in mixed for m in [2048] * (length[i] // 2048) + [length[i] % 2048] if m]
    return stages, sorted(one_by_one(pieces, 2048))


def test_run(spark):
    wanted, loads = by_hand(spark)
    docs = sample(spark, SF_MORE)
    columns = docs.columns
    for (_, stage), kept in zip(corpus_pipeline.STAGES[:-1], wanted):
        docs = stage(spark, docs, SF_MORE)
        assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == kept
    assert len(wanted[0]) < 1000 and len(wanted[1]) < len(wanted[0]) and wanted[2] != wanted[1] and len(wanted[3]) < len(wanted[2])
    found = corpus_pipeline.run(spark, SF_MORE).collect()
    bins = Counter()
    for r in found:
        bins[r.bin_id] += r.n_tokens
    assert {r.doc_id for r in found} == {i for i, t in wanted[3].items() if t} and sorted(bins.values()) == loads


ODD = "doc_id long, text string, lang string, source string, n_chars long, log_weight string, n_tokens int, hash int, id int, take int, `a.b` int"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, name, stage):
    prose = " ".join(f"word{i}" for i in range(40))
    more = ("w", 1, 2, 3, 4, 5)
    data = [(1, prose, "en", "a", 9), (1, prose, "en", "a", 9), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "without a number", None, "b", 1), (4, "tie", "en", None, 3), (5, "x " * 200_000, "en", "b", 7)]
    docs = spark.createDataFrame([(*r, *more) for r in data], ODD)
    for table in (docs, docs.limit(0)):
        out = stage(spark, table, SF_MORE)
        found = out.collect()
        if stage is corpus_pipeline.STAGES[-1][1]:
            assert out.columns == ["doc_id", "piece", "first_token", "n_tokens", "bin_id", "bin_offset"]
        else:
            assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert all(tuple(r)[5:] == more for r in found)
        assert bool(found) == (table is docs)


def test_registered(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert {"op2_suffix_dedup", "op4_ngram_jaccard_join", "op6_secret_scan"} <= set(entry.oracle_sql())
