"""From raw documents to packed training bins: a stage an operator, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import mixing, ngram_join, packing, quality, secret_scan
from larkspur.llm.common import finished, load, release


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rather of low quality or toxic go.

    Null texts go too, as nothing can be told of them; an empty text has the neutral weight. Rows with the same doc_id and text are
    judged alike and go or stay together, and so do ties at the last place. A very long text counts whole. An empty table gives an empty one.
    """
    return quality.resample(docs, load(spark, sf_dir, "labels"), max_labels=50_000, seed=17, weights=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id (null last), then text hash.

    Texts without a word (null, empty, only signs) are no copies of each other and all stay. Of rows with the same doc_id and text
    one stays. A very long text is compared whole. An empty table gives an empty one.
    """
    return ngram_join.keep_one(docs, n=3, threshold=0.5, recall=0.99, seed=17)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their rule, and n_chars follows. No row goes. Blobs are scanned once, from an empty ledger, and
    what is found goes to all rows that hold them.

    Null and empty texts and those without a secret stay as they are; repeated rows are treated alike; of rules that overlap the first
    names the secret. A very long text is searched whole, and so is a very long secret. An empty table gives an empty one.
    """
    return secret_scan.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources flattened by the power 0.7 of their tokens, in the largest mixture without repeats.

    Null and empty texts hold no tokens and go. A null source is a source of its own. Repeated rows are documents of their own;
    ties in the seeded order fall to the text, then to the other columns. A very long text counts whole. An empty table gives an empty one.
    """
    return mixing.mix(docs, alpha=0.7, seed=17, lengths=False)


def packed_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, bin_id, bin_offset): bins of 2,048 tokens.

    Null and empty texts have no piece; a text longer than a bin has several, and none of its tokens is lost. Repeated rows, and rows
    with a null doc_id, are documents of their own. Equal lengths are ranked by a seeded order. An empty table gives an empty one.
    """
    return packing.pack(docs, capacity=2048, seed=17)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secrets),
    ("source_mix", source_mix),
    ("best_fit_packing", packed_bins),
]

#: SQL can't express the classifier's models, the exact fit of budgets or the packing; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on documents; each is written to the shared folder and read again by the next, and what a
    stage has written on its way, and its input, is deleted when its result is there."""
    docs = load(spark, sf_dir, "documents", spread=True)
    for name, stage in STAGES[:-1]:
        before = docs
        docs = finished(spark, lambda: stage(spark, before, sf_dir), name)  # noqa: B023 - called at once
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
