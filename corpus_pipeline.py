"""A training corpus from `documents`: toxicity, exact copies, near copies, source weights, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one gets; all but the last return
the columns of `documents`. run() writes each stage's rows to the shared folder, reads them again and
removes what the stage kept on the way.

All stages: an empty table gives no rows, texts of any length count whole, extra columns are passed on
by all but the last, which drops them. What each does with nulls, ties and repeated rows stands there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from quillgraph.llm.common import saved, scratch, table

#: No SQL: the lexicon is learned and the packing is sequential. Tests hold run() against a plain version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon learned from `labels` doesn't predict to be toxic. Null and empty texts stay; repeated rows are judged alike."""
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null as empty) the row with the largest doc_id; of several rows with that doc_id one; rows without doc_id stay."""
    return exact_dedup.drop_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group (five-word shingles, 0.8). Rows without doc_id or words stay."""
    return near_dedup.drop_near(docs, width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's repetition rate and its draw say. Null sources are one; texts without words have no size and, where their source's rate is below one, are drawn like others."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, repeated ones too, and their places in sequences of 4096 tokens. A null text is an empty one."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark):
            docs = saved(stage(spark, docs, sf_dir), outlives=True)
    return docs
