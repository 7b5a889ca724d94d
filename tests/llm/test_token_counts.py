"""Against encoding every text by itself."""

import random
from collections import Counter

from larkspur.llm import token_counts as K
from tests.llm.helpers import docs, rows, sample, texts

ENCODE = K.encoding(K.TOKENIZER).encode_ordinary


def test_histogram_is_exact(spark):
    wanted = Counter(len(ENCODE(t)) for t in texts(spark).values())
    assert dict(rows(K.length_histogram(sample(spark)))) == wanted


def test_every_limit(spark):
    lengths = [len(ENCODE(t)) for t in texts(spark).values()]
    table = K.context_table(K.length_histogram(sample(spark))).collect()
    assert [r.context_limit for r in sorted(table)] == sorted(set(lengths))
    for r in table:
        c = r.context_limit
        assert r.tokens_truncated == sum(min(n, c) for n in lengths) and r.tokens_lost == sum(lengths) - r.tokens_truncated
        assert r.docs_longer == sum(n > c for n in lengths) and r.tokens_longer == sum(n for n in lengths if n > c)
        assert (r.docs_total, r.tokens_total) == (len(lengths), sum(lengths))
    middle = K.quantile(K.context_table(K.length_histogram(sample(spark))), 0.5).first()[0]
    assert middle == sorted(lengths)[-(-len(lengths) // 2) - 1]


def test_odd_rows(spark):
    long = "word " * 60_000 + "x" * 50_000
    d = docs(spark, [(1, None, "a"), (2, "", "a"), (3, "hi", None), (3, "hi", None), (None, "hi", "a"), (4, long, "a"), (5, "<|endoftext|>", "a")])
    got = dict(rows(K.length_histogram(d)))
    assert got == Counter([0, 1, 1, 1, len(ENCODE(long)), len(ENCODE("<|endoftext|>"))]) and len(ENCODE("<|endoftext|>")) > 1
    by = K.context_table(K.length_histogram(d, by=("source",)), by=("source",))
    assert {r.source for r in by.collect()} == {None, "a"}
    assert rows(K.context_table(K.length_histogram(docs(spark, [])))) == []
    clash = docs(spark, [(1, "hi", "a", 7)], "doc_id long, text string, source string, n_tokens int")
    assert rows(K.length_histogram(clash)) == [(1, 1)]


def test_long_runs_count_as_the_whole():
    held, r = K.encoding(K.TOKENIZER), random.Random(1)
    for _ in range(1500):
        text = ""
        for _ in range(r.randint(1, 5)):
            text += r.choice(["a", "Zed", "12", "--", "\x1c", "​", "'s", ""])
            text += r.choice([" ", "\n", "　", "\xa0", "\t", "\x85"]) * r.choice([1, 2, K.LONG - 1, K.LONG, K.LONG + 1, 3000]) + r.choice(["", "\n", " "])
        text += r.choice(["", "x"])
        assert K.length(held, text) == len(ENCODE(text)), text


def very_long():
    """Five million of one sign, a letter behind."""
    return [(i, c * 5_000_000 + "x", "a") for i, c in enumerate(" \na-")]


def test_very_long_runs(spark):
    got = dict(rows(K.length_histogram(docs(spark, very_long()))))
    # Blanks and line feeds by what their run and the rest give apart: the whole is too much for the split.
    held = K.encoding(K.TOKENIZER)
    blanks = len(held._encode_single_piece(" " * 4_999_999)) + len(ENCODE(" x"))
    feeds = len(held._encode_single_piece("\n" * 4_999_999)) + len(ENCODE("\nx"))
    assert got == Counter([blanks, feeds, len(ENCODE("a" * 5_000_000 + "x")), len(ENCODE("-" * 5_000_000 + "x"))])
