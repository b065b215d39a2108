"""Corpus pipeline: filter, deduplicate, decontaminate, mix and shard documents.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each stage's rows as Parquet in the shared folder and reads them again
as the next stage's documents.  All stages but the last return the columns of
``documents``; the last returns each row's shard and slot.

The toxicity model is a trained classifier, which SQL cannot express, so there
is no oracle; the stages are tested one by one against plain versions.

In every stage null texts are empty and without words, rows without an id stay where
nothing else takes them, an empty table gives an empty result, and further columns of
any name and type pass through; the operators' docstrings say more.
"""
from __future__ import annotations

from spendlens.llm import decontaminate, hilbert, jaccard_join, mixing, toxicity
from spendlens.llm.common import ship_code, stored, table


def drop_toxic(spark, docs, sf_dir):
    """Documents that the weakly supervised classifier rejects go."""
    ship_code(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_per_group(spark, docs, sf_dir):
    """One document of each near-duplicate component stays."""
    ship_code(spark)
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that contain a benchmark item go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    """Documents as often as the mix of sources takes them, in the order of its schedule."""
    return mixing.mixed_rows(docs)


def shard(spark, docs, sf_dir):
    """Whole rows in files of shards along the Hilbert curve; every row's shard and slot from them."""
    return hilbert.sharded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_per_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; the shards of what remains."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
