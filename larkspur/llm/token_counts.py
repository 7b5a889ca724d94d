"""Token counts: an exact histogram of encoded lengths and what its suffix sums answer.

Every document is encoded once by a public tokenizer and reduced to its length; only (length, count) pairs are
shuffled. All questions about context limits are then answered from the histogram alone.
"""

from __future__ import annotations

import base64
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from larkspur.llm.common import OWN, claim, slices

#: Where the public tokenizers lie on each machine; nothing of them is copied into this repository.
TOKENIZER = os.path.join(os.environ.get("LARKSPUR_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")

#: The split that belongs to the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Runs of white space as long as this are encoded apart: the split looks ahead behind them, a frame of its stack for each sign.
LONG = 1024
_LONG_RUN = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG},}}")


#: What a worker has loaded. It goes when another operator claims the worker's memory.
_encodings: dict[str, object] = {}


def encoding(path: str):
    """The encoding of a rank file; one per Python worker."""
    import tiktoken

    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def length(encoding, text: str) -> int:
    """The tokens of a text. The split never joins a sign and white space behind it, and of a run of white space only the last
    sign may belong to what follows. So a text can be cut there, and a long run is a piece of its own, with the same tokens."""
    total = start = 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(encoding.encode_ordinary(text[start : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        start = end
    return total + len(encoding.encode_ordinary(text[start:] if start else text))


def token_count(text: Column | str, tokenizer: str = TOKENIZER) -> Column:
    """The number of tokens of a text: null for null, 0 for an empty text. Whole texts are encoded, of any length and whatever
    runs of one sign they hold; strings of special tokens are ordinary text."""

    @arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        claim(_encodings)
        held = encoding(tokenizer)
        return pa.array([None if t is None else length(held, t) for _, _, some in slices(texts) for t in some], pa.int64())

    # Taken as not deterministic, so that a filter on the count doesn't encode twice.
    return count.asNondeterministic()(text)


def length_histogram(docs: DataFrame, text: str = "text", by: tuple[str, ...] = (), tokenizer: str = TOKENIZER) -> DataFrame:
    """(by..., n_tokens, n_docs): how many documents have each exact length. Null texts are not counted."""
    counted = docs.select(*[F.col(c) for c in by], token_count(text, tokenizer).alias("n_tokens"))
    return counted.where(F.col("n_tokens").isNotNull()).groupBy(*by, "n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_table(histogram: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For every exact length L that occurs, as a context limit: what suffix sums over the histogram say.

    by..., context_limit = L, n_docs of that length, docs_longer (than L), docs_total, tokens_total, tokens_longer (of
    the documents longer than L), tokens_truncated (the sum of min(length, L)), tokens_lost, share_of_docs (with length
    <= L: L is the quantile of that share). Between two lengths L < c < L' tokens_truncated is exact as well:
    tokens_truncated(L) + (c - L) * docs_longer(L). An empty histogram gives an empty table. The windows hold one row for each
    distinct length (of a group), so they don't grow with the number of documents.
    """
    up = Window.partitionBy(*by).orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    tokens = F.col("n_tokens") * F.col("n_docs")
    c = lambda name: F.col(OWN + name)
    sums = histogram.select(
        *by, "n_tokens", "n_docs",
        F.sum("n_docs").over(up).alias(OWN + "docs"), F.sum(tokens).over(up).alias(OWN + "tokens"),
        F.sum("n_docs").over(whole).alias("docs_total"), F.sum(tokens).over(whole).alias("tokens_total"),
    )
    longer = F.col("docs_total") - c("docs")
    truncated = c("tokens") + F.col("n_tokens") * longer
    return sums.select(
        *by, F.col("n_tokens").alias("context_limit"), "n_docs", longer.alias("docs_longer"), "docs_total", "tokens_total",
        (F.col("tokens_total") - c("tokens")).alias("tokens_longer"), truncated.alias("tokens_truncated"),
        (F.col("tokens_total") - truncated).alias("tokens_lost"), (c("docs") / F.col("docs_total")).alias("share_of_docs"),
    )


def quantile(table: DataFrame, share: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n_tokens): the least length that at least this share of the documents doesn't exceed; exact, ties included."""
    return table.where(F.col("share_of_docs") >= share).groupBy(*by).agg(F.min("context_limit").alias("n_tokens"))
