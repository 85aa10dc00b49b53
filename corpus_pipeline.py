"""From raw documents to token digests: quality, near-duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's documents. All but the last return the columns of the documents table.

Defined results: a null or empty text is scored like any other; without words it is nobody's near copy; it has no
bytes to remove, no tokens, and an empty list of ids. Rows that are equal in full are one document from the second stage
on, and rows of one id with different texts are different documents; a row without an id is kept unless a near copy has
one. Ties between near copies go to the smallest id. A null source is a source of its own. Texts of any length pass
whole. An empty table gives an empty one at every stage; extra columns are kept up to the last stage, which returns
doc_id, source, token count and digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pitwarden.llm import chosen_path, factor_machine, rank_queue_bpe, repeats, temperature_mixing
from pitwarden.llm.common import stage
from pitwarden.llm.queries import RANKS, labels

# Near copies are linked from 0.8 on; 26 trees of depth 6 miss (1 - 0.8**6)**26 = 0.04 % of the pairs at that bound.
NEAR = chosen_path.JoinRule(percent=80, trees=26)

# Passages of over 50 words: of those that repeat on sf0.1, 43 % are below the 400 bytes of op9's contract and 3 % below 250.
PASSAGE = repeats.RepeatRule(length=250)

BATCH_ROWS = 1000  # whole texts travel to the workers, so fewer rows at a time than Spark's 10,000


def lean(spark: SparkSession) -> None:
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject; it is fitted on the labels of these documents."""
    lean(spark)
    return factor_machine.reject_poor(docs, factor_machine.train(docs, labels(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    lean(spark)
    return chosen_path.keep_first(docs, NEAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat elsewhere; n_chars follows the text."""
    lean(spark)
    return repeats.remove_repeats(docs, PASSAGE, count="n_chars")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them."""
    return temperature_mixing.mix(docs).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, digest of the token ids and of the bytes decoded from them, per document of the mixture."""
    lean(spark)
    ranks = rank_queue_bpe.read_ranks(spark, public_tokenizers.path(RANKS))
    return rank_queue_bpe.round_trip(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("temperature_mixing", mixing),
    ("byte_level_bpe", encoding),
]

ORACLE_SQL = None  # a trained model and a byte-level tokenizer have no SQL form; tests/llm has brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
