"""From documents to token ids: quality rules, line dedup, near-dedup, source mix, byte-level BPE.

Each stage works on all that the one before kept, and is written as Parquet in the shared folder before the next reads it.

Edge cases: empty tables pass all stages. All stages but the last return the columns of documents, whatever further columns there
are and whatever they are called.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeforms.llm import bpe, line_dedup, mixing, quality, shared, simhash
from tapeforms.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go. A null, empty or blank text has no words, so its document goes; repeated rows stand or fall together."""
    return quality.kept(docs)


def drop_duplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and near-equal lines, of any length, the first stays, in the order of id (null last), text and line; documents that are left without a line go. Blank lines stay;
    repeated rows are one document and keep the same lines."""
    return line_dedup.deduplicated(docs, min_chars=0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays, one row of it; rows without an id stay. Texts without a word are alike."""
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, at most three times; those that it doesn't take go. A null source is a source; rows with equal id, source and size share one decision."""
    return mixing.taken_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every row of the mix; other columns end here. A null text has no ids; copies give equal rows."""
    import public_tokenizers

    return bpe.round_trip(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_duplicate_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("byte_bpe", tokenize),
]

#: MinHash components, fingerprints, dependent rounding and BPE are beyond SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of sf_dir."""
    folder = f"{shared.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
