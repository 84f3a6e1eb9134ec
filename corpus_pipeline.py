"""Corpus pipeline: five stages over ``documents``, each one of the package's operators.

Every stage is a function (spark, docs, sf_dir) → DataFrame; all but the last return the
columns of ``documents``, the last one the token store's rows. ``run`` writes each
stage's result to the shared folder and reads it again, so a lost executor never costs
more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkgrove import ship
from sparkgrove.llm import decontam, mixing, simhash, token_store, toxicity
from sparkgrove.llm.common import Scratch, in_files, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon, fitted on the labels, does not reject."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, the one of least doc_id."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.mixed_rows(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of the mix, its shards in the mix's order (that of the rows in
    their files), read back by key: doc_id, start, n_tokens, ids_crc32."""
    return token_store.written_and_read(docs, order=in_files(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]
#: Fingerprints, learned scores and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:  # the token store, read by the result, needs none of these any more
        for name, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
