"""Against packing one document after the other."""

from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import packing as P
from larkspur.llm import token_counts as K
from tests.llm.helpers import docs, rows, sample

ENCODE = K.encoding(K.TOKENIZER).encode_ordinary


def one_by_one(lengths, capacity):
    """The loads of the bins."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    loads = []
    while large:
        a = large.pop(0)
        mate = next((i for i, b in enumerate(large) if a + b <= capacity), None)
        loads.append(a + (large.pop(mate) if mate is not None else 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fit = [i for i, load in enumerate(loads) if load + n <= capacity]
        if fit:
            loads[max(fit, key=loads.__getitem__)] += n
        else:
            loads.append(n)
    return loads


def placed(histogram, capacity):
    plan = P.Plan(histogram, capacity)
    runs = sorted(plan.runs)
    found = []
    for i, (n, first, bin_, each, offset) in enumerate(runs):
        end = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == n else histogram[n]
        found += [(bin_ + (r - first) // each, offset + (r - first) % each * n, n) for r in range(first, end)]
    return plan, found


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_plan_is_best_fit(case):
    capacity, lengths = case
    plan, found = placed(Counter(lengths), capacity)
    bins = defaultdict(list)
    for b, o, n in found:
        bins[b].append((o, n))
    assert Counter(n for _, _, n in found) == Counter(lengths) and len(bins) == plan.bins
    for items in bins.values():
        at = 0
        for o, n in sorted(items):
            assert o == at  # neither gaps nor overlaps
            at += n
        assert at <= capacity and sum(3 * n > capacity for _, n in items) <= 2
    assert sorted(sum(n for _, n in x) for x in bins.values()) == sorted(one_by_one(lengths, capacity))


def check(frame, wanted, capacity):
    bins, parts = defaultdict(list), defaultdict(list)
    for r in frame.collect():
        bins[r.bin_id].append((r.bin_offset, r.n_tokens))
        parts[r.doc_id].append((r.piece, r.first_token, r.n_tokens))
    for items in bins.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))
    return parts, bins


def test_pack_documents(spark):
    lengths = {r.doc_id: len(ENCODE(r.text)) for r in sample(spark).collect()}
    parts, bins = check(P.pack(sample(spark), 256), lengths, 256)
    assert {k: sum(n for _, _, n in v) for k, v in parts.items()} == {k: n for k, n in lengths.items() if n}
    pieces = []
    for k, v in parts.items():
        v.sort()
        assert [p for p, _, _ in v] == list(range(len(v))) and [f for _, f, _ in v] == [256 * i for i in range(len(v))]
        pieces += [n for _, _, n in v]
    assert sorted(sum(n for _, n in x) for x in bins.values()) == sorted(one_by_one(pieces, 256))


def test_same_in_any_partitioning(spark):
    assert rows(P.pack(sample(spark), 300)) == rows(P.pack(sample(spark).repartition(3), 300))


def test_odd_rows(spark):
    long = "word " * 5_000
    d = docs(spark, [(1, None, "a"), (2, "", "a"), (None, "no id", "a"), (None, "no id", "a"), (3, "same", "a"), (3, "same", "a"), (3, "other text", "a"), (4, long, None)])
    frame = P.pack(d, 64)
    parts, _ = check(frame, None, 64)
    wanted = Counter()
    for i, t, _ in [tuple(r) for r in d.collect()]:
        wanted[i] += len(ENCODE(t)) if t else 0
    assert Counter({k: sum(n for _, _, n in v) for k, v in parts.items()}) == +wanted
    assert rows(P.pack(docs(spark, []), 64)) == []
    clash = docs(spark, [(1, "hi", "a", 7, 8)], "doc_id long, text string, source string, n_tokens int, bin_id int")
    assert rows(P.pack(clash, 64)) == [(1, 0, 0, 1, 0, 0)]


def test_large_capacities_are_planned_fast():
    """A dense histogram of a capacity of 131,072: neither partners nor gaps are looked for one by one."""
    import time

    began = time.process_time()
    plan = P.Plan({n: 1 + n % 5 for n in range(1, 1 << 17)}, 1 << 17)
    assert plan.bins > 1 << 16 and not any(plan.left.values()) and time.process_time() - began < 60


def test_very_long_blanks(spark):
    d = docs(spark, [(1, " " * 1_200_000 + "x", "a"), (2, "y", "a")])
    out = P.pack(d, 1 << 20).collect()
    assert sum(r.n_tokens for r in out if r.doc_id == 1) == K.length(K.encoding(K.TOKENIZER), " " * 1_200_000 + "x")
