"""A training-corpus pipeline over `documents`: quality, repeated lines, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next stage's docs. All but the last
keep the columns of `documents`; the last gives the token ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import byte_bpe, decontaminate, line_dedup, minhash, quality
from tidebar.llm.common import free_names, materialize, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels outside the held-out fold.

    Null and empty texts have one common score; repeated rows stay or go together. Without labels every score is 0.5, and all stay.
    """
    model = quality.learn(spark, docs, sf_dir)
    return docs.where(quality.quality_score(docs, model) >= quality.THRESHOLD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more share, but for the last holder; n_chars follows the text. A null text stays null."""
    (lines,) = free_names(docs, "lines")
    found = line_dedup.dedup_lines(docs, into=lines)
    changed = {"text": F.when(F.col("text").isNotNull(), F.col(f"{lines}.kept"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("text").isNotNull(), F.length(f"{lines}.kept")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id. Texts without words and rows without an id stay; rows that share an id stay together."""
    return minhash.keep_one_of_each_group(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are benchmark passages; null, empty and word-free texts are clean, repeated rows stay or go together."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32) and digests of the ids and of what they decode to, a row per row; a null text has no ids."""
    return byte_bpe.bpe_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True, memo=150_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Learned scores and hashing can't be written as SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
