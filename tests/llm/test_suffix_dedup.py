"""Against comparing every window."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import suffix_dedup as S
from tests.llm.helpers import SF_MORE, docs, rows, sample, texts


def words(text):
    out = []
    for w in (text or "").encode().split():
        w = w.decode()
        out.append("".join(c for c in w.lower() if c.isalnum()) or w)
    return out


def by_hand(items, least):
    lists = [(i, words(t)) for i, t in items]
    seen = Counter(tuple(w[p : p + least]) for _, w in lists for p in range(len(w) - least + 1))
    found = []
    for i, w in lists:
        at = [p for p in range(len(w) - least + 1) if seen[tuple(w[p : p + least])] > 1]
        spans = []
        for p in at:
            if spans and p <= spans[-1][1]:
                spans[-1][1] = p + least
            else:
                spans.append([p, p + least])
        found += [(i, a, b) for a, b in spans]
    return sorted(found, key=repr)


def repeats(spark, items, least=12, lead=4):
    return rows(S.repeats(docs(spark, [(i, t, "s") for i, t in items]), least, lead))


def test_documents(spark):
    assert rows(S.repeats(sample(spark, SF_MORE))) == by_hand(texts(spark, SF_MORE).items(), 50)


def planted(seed, count, least):
    rng = random.Random(seed)
    passages = [[f"p{k}w{i}" for i in range(rng.randint(least - 2, 3 * least))] for k in range(8)]
    items = []
    for i in range(count):
        body = [f"d{rng.randrange(40)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            at = rng.randint(0, len(body))
            body[at:at] = p[rng.randint(0, 3) : len(p) - rng.randint(0, 3)]
        items.append((i, " ".join(body)))
    return items + [(count + k, items[k][1]) for k in range(5)]


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages(spark, seed):
    items = planted(seed, 120, 12)
    wanted = by_hand(items, 12)
    assert wanted and repeats(spark, items) == wanted


def test_passage_within_one_document_and_low_entropy(spark):
    items = [(1, "a " * 100), (2, " ".join(f"x{i}" for i in range(30)) + " gap " + " ".join(f"x{i}" for i in range(30))), (3, "b " * 12), (4, "c " * 11)]
    assert repeats(spark, items) == by_hand(items, 12)


def test_hot_lead_across_buckets(spark, monkeypatch):
    """One passage in very many documents is spread over several buckets, and found across their boundaries."""
    monkeypatch.setattr(S, "SAMPLES", 400)
    monkeypatch.setattr(S, "SORTED", 64)
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    hot = " ".join(f"h{i}" for i in range(14))
    rare = " ".join(f"h{i}" for i in range(10)) + " r1 r2 r3 r4 r5 r6"
    items = [(i, f"u{i} {hot} v{i}") for i in range(300)] + [(900, "q " + rare), (901, rare + " z")]
    assert repeats(spark, items) == by_hand(items, 12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=12, max_size=70), min_size=1, max_size=6))
def test_runs_cover_each_window_once(lists):
    """Equal windows have the same key, and lie at the same place of their runs' leads."""
    hashes = [np.array([(x + 1) * 0x9E3779B97F4A7C15 % 2**64 for x in t], np.uint64) for t in lists]
    doc, p, q, key = S.runs(hashes, 12, 4)
    by_window = {}
    for d, a, b, k in zip(doc, p, q, key):
        for i in range(a, b + 1):
            assert (d, i) not in by_window
            by_window[d, i] = k
    assert sorted(by_window) == [(d, i) for d, t in enumerate(lists) for i in range(len(t) - 11)]
    keys = {}
    for (d, i), k in by_window.items():
        assert keys.setdefault(tuple(lists[d][i : i + 12]), k) == k


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=6, max_size=80), st.integers(1, 3))
def test_multikey_quicksort(words_, groups):
    """The suffixes that agree with another one of their group in all depths, and groups of those that do."""
    symbols, depths = np.array(words_, np.uint64), [0, 2, 5]
    start = np.arange(len(words_) - 5)
    group = start % groups
    alive, found = S.multikey_quicksort(symbols, start, group, depths)
    key = lambda i: (i % groups, *(words_[i + d] for d in depths))
    count = Counter(key(i) for i in start)
    assert sorted(alive) == [i for i in start if count[key(i)] > 1]
    by = {}
    for i, g in zip(alive, found):
        by.setdefault(g, set()).add(key(i))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({key(i) for i in alive})


def test_nothing_to_sort():
    assert S.multikey_quicksort(np.zeros(3, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), [0])[0].size == 0


@pytest.mark.parametrize("lead", [3, 4, 8, 12])
def test_against_a_plain_suffix_array(spark, lead):
    """The lead decides what is carried on, not what is found."""
    items = planted(11, 60, 12)
    text, ends = [], {}
    for i, t in items:
        for j, w in enumerate(words(t)):
            text.append((w, i, j))
        ends[i] = len(words(t))
    order = sorted(range(len(text)), key=lambda x: [w for w, _, _ in text[x : x + 12]])
    window = lambda x: tuple(w for w, _, _ in text[x : x + 12]) if text[x][2] + 12 <= ends[text[x][1]] else None
    order = [x for x in order if window(x)]
    again = {y for x, z in zip(order, order[1:]) if window(x) == window(z) for y in (x, z)}
    covered = {}
    for x in again:
        covered.setdefault(text[x][1], set()).update(range(text[x][2], text[x][2] + 12))
    got = {}
    for i, a, b in repeats(spark, items, 12, lead):
        got.setdefault(i, set()).update(range(a, b))
    assert got == covered


def test_odd_rows(spark):
    twelve = " ".join(f"t{i}" for i in range(12))
    long = " ".join(f"l{i % 9973}" for i in range(300_000))
    items = [(1, None), (2, ""), (3, twelve), (3, twelve), (None, twelve), (None, "x " + twelve), (4, twelve.upper().replace(" ", ",  ")), (5, "  ".join(["..."] * 13)), (6, long), (3, "y " + twelve), (7, "short"), (7, "short")]
    got = repeats(spark, items)
    assert got == sorted(set(by_hand(items, 12)), key=repr)
    assert repeats(spark, []) == []
    clash = docs(spark, [(1, twelve, "s", 1, 2), (2, twelve, "s", 1, 2)], "doc_id long, text string, source string, hash int, id int")
    assert rows(S.repeats(clash, 12, 4)) == [(1, 0, 12), (2, 0, 12)]
    with pytest.raises(ValueError):
        S.repeats(clash, 5)
