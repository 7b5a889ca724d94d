"""Against comparing every pair."""

import itertools
import math
import random

import pytest

from larkspur.llm import ngram_join as J
from tests.llm.helpers import SF_MORE, docs, rows, sample, texts


def grams(text, n=3):
    words = ["".join(c for c in w.decode().lower() if c.isalnum()) for w in (text or "").encode().split()]
    words = [w for w in words if w]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def every_pair(items, threshold=0.5, n=3):
    """What join() gives: by the least identifier of equal sets."""
    sets = {i: frozenset(grams(t, n)) for i, t in items}
    names, found = {}, set()
    for i in sorted(sets):
        if sets[i]:
            if sets[i] in names:
                found.add((names[sets[i]], i, 1.0))
            else:
                names[sets[i]] = i
    for (a, x), (b, y) in itertools.combinations(names.items(), 2):
        s = len(a & b) / len(a | b)
        if s >= threshold:
            found.add((min(x, y), max(x, y), s))
    return sorted(found)


def near_copies(seed, count, edits, base):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_bands_reach_the_recall():
    for t, r in ((0.5, 0.99), (0.7, 0.9), (0.9, 0.999), (0.3, 0.8)):
        bands, rows_ = J.choose_bands(t, r)
        assert 1 - (1 - t**rows_) ** bands >= r and bands * rows_ <= J.MAX_HASHES
        assert 1 - (1 - t**rows_) ** (bands - 1) < r
    with pytest.raises(ValueError):
        J.choose_bands(0.01, 0.999)


def test_documents(spark):
    assert sorted(tuple(r) for r in J.join(sample(spark, SF_MORE)).collect()) == every_pair(texts(spark, SF_MORE).items())


def test_recall_on_many_near_copies(spark):
    items = []
    for g in range(12):
        base = [f"b{g}x{i}" for i in range(120)]
        items += [(1000 * g + i, t) for i, t in enumerate(near_copies(g, 25, 14, base))]
    wanted = {x[:2] for x in every_pair(items)}
    got = {tuple(r)[:2] for r in J.join(docs(spark, [(i, t, "s") for i, t in items])).collect()}
    assert got <= wanted and len(got) >= 0.98 * len(wanted) and len(wanted) > 1000


def test_blocks_of_large_buckets_lose_nothing(spark, monkeypatch):
    base = [f"q{i}" for i in range(60)]
    items = [(i, t) for i, t in enumerate(near_copies(5, 60, 3, base))]
    wanted = sorted(tuple(r) for r in J.join(docs(spark, [(i, t, "s") for i, t in items])).collect())
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in J.join(docs(spark, [(i, t, "s") for i, t in items])).collect()) == wanted


def groups(items):
    """Sets of identifiers that similar pairs connect."""
    parent = {i: i for i, _ in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in every_pair(items):
        parent[root(a)] = root(b)
    found = {}
    for i in parent:
        found.setdefault(root(i), set()).add(i)
    return list(found.values())


def test_one_of_each_group_stays(spark):
    items = list(texts(spark, SF_MORE).items())
    kept = {r.doc_id for r in J.keep_one(sample(spark, SF_MORE)).collect()}
    assert kept == {min(g) for g in groups(items)}


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    other = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    edges = chain + other + [(1, 1)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    wanted = sorted((x, root(x)) for e in edges if e[0] != e[1] for x in e)
    got = sorted(tuple(r) for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == sorted(set(wanted))
    assert J.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_odd_rows(spark):
    long = " ".join(f"l{i}" for i in range(40_000))
    d = docs(spark, [
        (1, None, "a"), (2, "", "a"), (3, " .,! ", "a"), (4, " .,! ", "a"), (5, "one two", "a"), (6, "One, TWO!", "b"), (7, "one", None), (None, "one two", "a"),
        (8, long, "a"), (9, long + " more", "a"), (10, "a b c d", "a"), (10, "a b c d", "a"), (11, "a b c d", "a"),
    ])
    assert [r[:2] for r in rows(J.join(d))] == [(10, 11), (5, 6), (8, 9)]
    kept = J.keep_one(d)
    assert sorted((tuple(r)[0] or 0) for r in kept.collect()) == [1, 2, 3, 4, 5, 7, 8, 10] and kept.columns == d.columns
    assert J.keep_one(docs(spark, [(None, "x y z", "a"), (None, "x y z", "b"), (7, "X y z", "c")])).collect()[0].doc_id == 7
    assert rows(J.join(docs(spark, []))) == [] and rows(J.keep_one(docs(spark, []))) == []
    clash = docs(spark, [(1, "x y z", "a", 1, 2), (2, "x y z", "a", 3, 4)], "doc_id long, text string, source string, id int, hash int")
    assert rows(J.join(clash)) == [(1, 2, 1.0)] and rows(J.keep_one(clash)) == [(1, "x y z", "a", 1, 2)]


def test_sketch_keeps_the_recall():
    for t, r in ((0.5, 0.99), (0.7, 0.9), (0.9, 0.999)):
        bands, per_band, agreeing = J.choose_sketch(t, r)
        hashes = bands * per_band
        missed = sum(math.comb(hashes, i) * t**i * (1 - t) ** (hashes - i) for i in range(agreeing))
        assert (1 - missed) * (1 - (1 - t**per_band) ** bands) >= r and hashes <= J.MAX_HASHES and agreeing > 0
    assert J.choose_sketch(0.3, 0.8)[:2]


def expanded(items, threshold=0.5):
    sets = {i: grams(t) for i, t in items}
    found = []
    for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
        if x and y and len(x & y) / len(x | y) >= threshold:
            found.append((a, b, len(x & y) / len(x | y)))
    return sorted(found)


def test_expanded_to_every_pair(spark):
    base = [f"e{i}" for i in range(40)]
    texts_ = near_copies(3, 9, 2, base)
    items = list(enumerate([*texts_, *texts_[:4], texts_[0], "lone words here"]))
    assert sorted(tuple(r) for r in J.join(docs(spark, [(i, t, "s") for i, t in items]), expand=True).collect()) == expanded(items)


def test_few_candidates(spark, monkeypatch):
    """2,000 near copies of each other, and as many documents that share a third of their words with all others."""
    rng = random.Random(4)
    base, shared = [f"c{i}" for i in range(100)], [f"s{i}" for i in range(120)]
    near = near_copies(9, 2000, 8, base)
    other = [" ".join(shared + [f"o{rng.randrange(10**9)}" for _ in range(150)]) for _ in range(2000)]
    d = docs(spark, [(i, t, "s") for i, t in enumerate(near + other)]).repartition(4)
    found = J.Join(d)
    pairs = found.pairs().count()
    assert pairs > 100_000 and found.candidates()[1].count() <= 2 * pairs
    # Buckets in several blocks give the same candidates, and no pair twice.
    wanted = found.candidates()[1].select("a", "b")
    monkeypatch.setattr(J, "MEET", 300)
    again = found.candidates()[1].select("a", "b")
    assert again.count() == again.distinct().count() == wanted.count() and again.exceptAll(wanted).count() == 0


def test_repeated_documents_and_identifiers(spark):
    rows_ = [(1, "x y z", "b", 2), (1, "x y z", "a", 1), (1, "x y z", "a", 9), (2, "X y z", "c", 3)]
    d = docs(spark, rows_, "doc_id long, text string, source string, more int")
    assert {rows(J.keep_one(x))[0] for x in (d, d.repartition(3), docs(spark, rows_[::-1], d.schema))} == {(1, "x y z", "a", 1)}
    with pytest.raises(TypeError):
        J.join(docs(spark, [("k", "x y z", "a")], "doc_id string, text string, source string"))


@pytest.mark.parametrize("threshold", [0.2, 0.8, 0.97, 1.0])
def test_other_thresholds(spark, threshold):
    """Few rows of many bits, and many of few."""
    base = [f"g{i}" for i in range(50)]
    items = list(enumerate([*near_copies(2, 12, 6, base), *near_copies(3, 12, 1, base), "some other words altogether", " ".join(base[:9])]))
    recall = 0.9 if threshold < 0.3 else 0.999
    wanted = {x[:2] for x in every_pair(items, threshold)}
    got = {tuple(r)[:2] for r in J.join(docs(spark, [(i, t, "s") for i, t in items]), threshold=threshold, recall=recall).collect()}
    assert got <= wanted and len(got) >= 0.9 * len(wanted) and wanted


def linked(items):
    """What links() gives."""
    count = {i: 0 for i, _ in items}
    parent = {i: i for i, _ in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in expanded(items):
        count[a], count[b] = count[a] + 1, count[b] + 1
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return sorted((i, root(i), count[i]) for i, _ in items)


def test_no_link_is_left_out(spark, monkeypatch):
    """Many pairs right at the threshold, and bands that find a third of such: groups, prefixes and blocks find the others."""
    items = []
    for g in range(10):
        items += near_copies(g, 12, 22, [f"b{g}x{i}" for i in range(110)])
    items = list(enumerate([*items, *items[:5], "one two", "One, TWO!", "lone words here", "", "a b c d e", "a b c d f"]))
    wanted = linked(items)
    d = docs(spark, [(i, t, "s") for i, t in items])
    some = {tuple(r)[:2] for r in J.join(d, recall=0.3, max_hashes=24, expand=True).collect()}
    assert len(some) < sum(n for _, _, n in wanted) / 2
    for block, sample_ in ((512, 1 << 15), (3, 0)):
        monkeypatch.setattr(J, "BLOCK", block)
        monkeypatch.setattr(J, "SAMPLE", sample_)
        assert rows(J.links(d, recall=0.3, max_hashes=24)) == sorted(wanted, key=repr)


def test_links_of_documents_and_of_odd_rows(spark):
    assert rows(J.links(sample(spark, SF_MORE))) == sorted(linked(list(texts(spark, SF_MORE).items())), key=repr)
    d = docs(spark, [(1, None, "a"), (2, " .,! ", "a"), (5, "one two", "a"), (6, "One, TWO!", "b"), (None, "one two", "a"), (7, "x y z", "a"), (7, "x y z", "a"), (None, "q", "a"), (8, "x " * 40_000 + "y z", "a")])
    assert rows(J.links(d)) == sorted([(1, 1, 0), (2, 2, 0), (5, 5, 2), (6, 5, 2), (None, 5, 2), (7, 7, 1), (7, 7, 1), (None, None, 0), (8, 8, 0)], key=repr)
    assert rows(J.links(docs(spark, []))) == []


def test_sets_of_many_texts_at_once(monkeypatch):
    """Texts are hashed together: each different word once, nothing across their ends, and the sets are those of the words."""
    texts_ = ["", None, " .,! ", "one", "One, TWO", "one two three", "a b c d", "Hello é Hello, World a-B hello", "hello É hello world AB Hello", "ΑΣ-Β ΟΔΟΣ. x", "lead\x1cx trail\x0b b\x0cc", "x " * 9, "x x x y", None]
    for n in (1, 3, 5):
        got = [set(s.tolist()) for s in J.gram_sets(texts_, n)]
        wanted = [grams(t, n) for t in texts_]
        assert [len(s) for s in got] == [len(s) for s in wanted]
        assert all(len(got[i] & got[j]) == len(wanted[i] & wanted[j]) for i, j in itertools.combinations(range(len(texts_)), 2))
    assert J.gram_sets([]) == []
    hashed = []
    digest = J.xxh3_64_intdigest
    monkeypatch.setattr(J, "xxh3_64_intdigest", lambda word: hashed.append(word) or digest(word))
    J.gram_sets(["many words, Many WORDS. ", "words many"] * 1000)
    assert len(hashed) == 2


def test_groups_that_share_little_are_not_verified(spark, monkeypatch):
    """400 documents with a fifth of their n-grams in common, and none of it known as frequent: no similar pair, and next to none is looked at."""
    rng = random.Random(6)
    shared = [f"s{i}" for i in range(32)]
    items = [(i, " ".join(shared + [f"o{rng.randrange(10**9)}" for _ in range(120)])) for i in range(400)]
    items += [(1000, " ".join(f"p{i}" for i in range(90))), (1001, " ".join(f"p{i}" for i in range(46)))]
    monkeypatch.setattr(J, "SAMPLE", 0)
    monkeypatch.setattr(J, "_meet", lambda *_: lambda batches: iter(()))
    looked, verified = [], J.Join.verified
    monkeypatch.setattr(J.Join, "verified", lambda self, classes, candidates, forest=False: looked.append(candidates.count()) or verified(self, classes, candidates, forest))
    found = rows(J.links(docs(spark, [(i, t, "s") for i, t in items])))
    assert found == sorted(linked(items), key=repr) and sum(n for _, _, n in found) == 2
    assert looked[0] == 0 and 1 <= looked[1] <= 40


def test_prefixes_find_every_link_between_sizes(spark, monkeypatch):
    """Bands that find nothing: sets of all sizes, down to the half of each other, many of them right at the threshold."""
    rng = random.Random(8)
    items = []
    for g in range(14):
        base = [f"b{g}x{i}" for i in range(rng.choice((4, 7, 30, 82, 150)))]
        for _ in range(12):
            kept = base[: rng.randint(len(base) // 2, len(base))]
            for _ in range(rng.randint(0, 1 + len(kept) // 12)):
                kept[rng.randrange(len(kept))] = f"w{rng.randrange(10**6)}"
            items.append(" ".join(kept + [f"e{rng.randrange(10**6)}" for _ in range(rng.randint(0, len(base) // 4))]))
        items += [" ".join(base), " ".join(base[: len(base) // 2 + 1])]
    items = list(enumerate(items))
    wanted = linked(items)
    assert sum(s == 0.5 for _, _, s in expanded(items)) > 20
    monkeypatch.setattr(J, "_meet", lambda *_: lambda batches: iter(()))
    for sample_ in (1 << 15, 0):
        monkeypatch.setattr(J, "SAMPLE", sample_)
        assert rows(J.links(docs(spark, [(i, t, "s") for i, t in items]))) == sorted(wanted, key=repr)
