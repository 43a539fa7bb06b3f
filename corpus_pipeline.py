"""Curation pipeline over ``documents``: STAGES in order, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumweave.llm import common as C
from sumweave.llm import decontaminate, mixing, near_dedup, quality, token_files


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their host's frequent lines.

    Null and empty texts go (they have no words); a null source is a host of its own; repeated rows
    are decided each; columns of any names stay; an empty table stays empty.
    """
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8).

    The smallest doc_id stays (of equal rows one); rows without an id stay if no row of their group has
    one, one for each different text; texts without words have no group and stay; empty tables stay empty.
    """
    return near_dedup.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item of three words or more.

    Null and empty texts and null ids stay; repeated rows are decided alike; with no items all stay.
    """
    return decontaminate.decontaminated(docs, C.table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture uses them.

    Equal rows stand together as often as all of them are used; a null source is a source of its
    own; texts without words come once; an empty table stays empty.
    """
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, read back: a row a document and copy.

    Null and empty texts hold the end id alone; null ids come first; rows that repeat an id are
    copies 0, 1, ... by their texts; an empty table gives no rows.
    """
    out = token_files.token_files(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "copy", "shard", F.col("start").cast("long").alias("start"), "n_tokens", "ids_crc32")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("source mix", source_mix), ("token files", token_output)]

#: Sketches, alignment and encoding are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with C.scratch(spark):  # a stage's own tables go when its result is written
            docs = C.written(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return docs
