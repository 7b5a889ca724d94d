"""Against trying every choice, and against the plan drawn by hand."""

import itertools
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import mixing as M
from larkspur.llm import token_counts as K
from tests.llm.helpers import docs, rows, sample

ENCODE = K.encoding(K.TOKENIZER).encode_ordinary


def best(lengths, counts, target):
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= target}
    return max(sums)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 4)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 300))
def test_subset_sum_is_optimal(items, target):
    lengths, counts = [x[0] for x in items], [x[1] for x in items]
    take = M.bounded_subset_sum(lengths, counts, target)
    assert all(0 <= t <= c for t, c in zip(take, counts))
    assert sum(t * n for t, n in zip(take, lengths)) == best(lengths, counts, target)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 30)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.integers(0, 6000))
def test_budgets_fit(items, budget):
    lengths, counts = (np.array([x[k] for x in items]) for k in (0, 1))
    take = M.fit_counts(lengths, counts, budget, slack=512)
    used, total = int((take * lengths).sum()), int((counts * lengths).sum())
    assert (take >= 0).all() and (take <= counts).all() and used <= budget
    if budget <= 512 or budget >= total:
        assert used == min(total, best(lengths.tolist(), counts.tolist(), budget))


def test_large_budgets_are_met_exactly():
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(1, 20_000, 3000))
    counts = rng.integers(1, 60, len(lengths))
    for share in (0.001, 0.2, 0.77):
        budget = int((lengths * counts).sum() * share)
        assert int((M.fit_counts(lengths, counts, budget) * lengths).sum()) == budget


def test_mixture_keeps_weights_and_counts(spark):
    d = sample(spark)
    got = M.mix(d, weights={"src0": 2.0, "src1": 1.0}, budget=3000, columns=["doc_id", "source"]).collect()
    used = Counter()
    for r in got:
        used[r.source] += r.n_tokens
    have = {"src0": [], "src1": []}
    for r in d.where("source in ('src0', 'src1')").collect():
        have[r.source].append(len(ENCODE(r.text)))
    assert used == {s: best(n, [1] * len(n), b) for s, n, b in (("src0", have["src0"], 2000), ("src1", have["src1"], 1000))}


def test_whole_rows_and_thin_rows_agree(spark):
    d = sample(spark)
    thin = rows(M.mix(d, columns=["doc_id", "source"]))
    whole = M.mix(d)
    assert whole.columns == [*d.columns, "n_tokens"] and rows(whole.select("doc_id", "source", "n_tokens")) == thin
    assert thin == rows(M.mix(d.repartition(3), columns=["doc_id", "source"]))


def test_seeded_by_length(spark):
    """Within a source and length the first ones in seeded order are drawn."""
    from pyspark.sql import functions as F

    from larkspur.llm.common import seeded

    d = docs(spark, [(i, "one two", "a") for i in range(50)] + [(100 + i, "x y", "b") for i in range(9)])
    order = defaultdict(list)
    for r in d.select("doc_id", "source", seeded(5, "doc_id").alias("h")).orderBy("h").collect():
        order[r.source].append(r.doc_id)
    n = len(ENCODE("one two"))
    got = rows(M.mix(d, weights={"a": 1, "b": 1}, budget=2 * 7 * n, seed=5).where(F.col("source") == "a").select("doc_id"))
    assert [x[0] for x in got] == sorted(order["a"][: len(got)], key=repr) and len(got) == 7


def test_odd_rows(spark):
    long = "word " * 30_000
    d = docs(spark, [(1, None, "a"), (2, "", "a"), (3, "hi you", None), (4, "same", "a"), (4, "same", "a"), (4, "other", "a"), (None, "no id", "a"), (5, long, "b")])
    everything = M.mix(d, weights={"a": 1, "b": 1}, budget=10**9)
    assert rows(everything.select("doc_id", "text")) == rows(d.where("source in ('a','b') and text <> ''").select("doc_id", "text"))
    assert {r.source for r in M.mix(d, budget=10**9).collect()} == {None, "a", "b"}
    assert rows(M.mix(docs(spark, []))) == [] and rows(M.mix(d, budget=0)) == [] and rows(M.mix(d, weights={"zzz": 1.0})) == []
    clash = docs(spark, [(1, "hi", "a", 7, 1)], "doc_id long, text string, source string, n_tokens int, take int")
    assert rows(M.mix(clash, budget=9)) == [(1, "hi", "a", 1, 1)] and M.mix(clash, budget=9).columns == ["doc_id", "text", "source", "take", "n_tokens"]


def test_small_budgets_are_drawn_from_all_lengths():
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.choice(np.arange(250, 1277), 212, replace=False))
    counts = np.ones(len(lengths), np.int64)
    for budget in (16_000, 17_000):
        take = M.fit_counts(lengths, counts, budget)
        assert int((take * lengths).sum()) == budget
        quarters = [int(q.sum()) for q in np.array_split(take, 4)]
        assert min(quarters) >= 3 and max(quarters) <= 10


def histogram(spark, have):
    return spark.createDataFrame([(s, 10, n // 10) for s, n in have.items()], "source string, n_tokens long, n_docs long")


def taken(plan):
    return {r.source: r.n for r in plan.groupBy("source").agg({"take": "sum"}).withColumnRenamed("sum(take)", "n").collect()}


def test_a_rare_source_does_not_decide(spark):
    """A source of 40 M tokens, 18 of 2 M, and one of 200 or a null one of 10, which give all they have."""
    have = {"hot": 40_000_000} | {f"s{i}": 2_000_000 for i in range(18)}
    for rare in ({"rare": 200}, {None: 10}):
        got = taken(M.plan(histogram(spark, have | rare)))
        assert all(got[s] * 10 == n for s, n in (have | rare).items() if s != "hot")
        assert got["hot"] == int(2_000_000 * 20**0.7) // 10


def test_others_share_what_a_short_source_lacks(spark):
    have = {"a": 1_000, "b": 50_000, "c": 50_000, "d": 8_000}
    got = taken(M.plan(histogram(spark, have), weights={"a": 1, "b": 2, "c": 1, "d": 1}, budget=50_000))
    # b and c share 50,000 - 1,000 - 8,000 two to one.
    assert got == {"a": 100, "b": 2733, "c": 1366, "d": 800}


def test_rows_alike_at_a_cutoff(spark):
    """Of equal rows exactly as many are drawn as are taken, and of rows that differ in other columns alone always the same."""
    same = [(5, "one two three", "a", 1)] * 6 + [(5, "one two three", "a", k) for k in range(2, 6)]
    schema = "doc_id long, text string, source string, more int"
    n = len(ENCODE("one two three"))
    seen = set()
    for order in (same, same[::-1], same[3:] + same[:3]):
        d = docs(spark, order, schema)
        for parts in (1, 4):
            got = rows(M.mix(d.repartition(parts), weights={"a": 1}, budget=4 * n, lengths=False))
            assert len(got) == 4
            seen.add(tuple(got))
    assert len(seen) == 1


def test_slots_draw_the_first_in_seeded_order(spark):
    """However the order is cut, the same rows come out as by sorting all of a length."""
    from pyspark.sql import functions as F

    from larkspur.llm.common import seeded

    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one two").otherwise("one two three").alias("text"), F.lit(None).cast("string").alias("source"))
    order = [(r.doc_id, len(ENCODE(r.text))) for r in d.orderBy(seeded(9, "doc_id")).collect()]
    got = {r.doc_id: r.n_tokens for r in M.mix(d, budget=3 * 1000, seed=9).collect()}
    for n in set(got.values()):
        mine = [i for i, m in order if m == n]
        assert {i for i, m in got.items() if m == n} == set(mine[: sum(m == n for m in got.values())])


def test_budget_is_met_on_both_sides_of_slack():
    """The solver's room decides the way, not the total: where single tokens are there, every budget is met exactly."""
    lengths, counts = np.array([1, 7, 40, 333]), np.array([400, 900, 900, 600])
    for budget in (100, M.SLACK - 1, M.SLACK, M.SLACK + 1, 3 * M.SLACK, 10 * M.SLACK):
        totals = {int((M.fit_counts(lengths, counts, budget, slack) * lengths).sum()) for slack in (512, M.SLACK, 1 << 16)}
        assert totals == {budget}


def test_very_long_blanks(spark):
    d = docs(spark, [(1, " " * 1_200_000 + "x", "a"), (2, "y", "a")])
    assert len(rows(M.mix(d, weights={"a": 1}, budget=10**9, columns=["doc_id"]))) == 2
