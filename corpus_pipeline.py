"""A corpus pipeline of five stages: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which ``run`` writes as Parquet to the
shared folder and reads again as the next stage's docs. All stages but the last return the columns of
documents, whatever they are and whatever they are called; the last adds its own, with underscores after
those names that are taken.

Stages need doc_id, text and source. Null texts and empty ones are not toxic and hold no benchmark passage,
are copies of each other, and are repeated in the mix as often as their source is as a whole. A null source
is a source, null ids are documents of their own. Equal rows leave one; of texts with one id each stays. Very long texts are
taken whole. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, mixing, shards, similar, toxicity
from gristmill.llm.common import forget, free_name, settle, table, unpacked


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the network scores at or above its threshold."""
    model, score = toxicity.fit(docs, table(spark, sf_dir, "labels")), free_name(docs, "toxicity")
    return toxicity.score(docs, model, out=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id, of each group of texts with 0.8 or more of their 5-word shingles in common.

    SimHash finds and connects those within its radius, and what it cannot see is found by prefixes of shingle sets.
    """
    return similar.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold windows of benchmark items, those without an id too."""
    found = free_name(docs, "found")
    return decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"), out=found).where(F.col(found)["n_hit"] < 1).drop(found)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come to their target weights."""
    mixed = mixing.mix(docs, rows=True, whole_documents=True).where(F.col("times") > 0)
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*unpacked("row", docs.columns))


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix, beside its columns."""
    own = [F.col(c).alias(free_name(docs, c)) for c in ("size", "text_crc32", "shard", "slot")]
    return shards.shard(docs, rows=True).select(*unpacked("row", docs.columns), *own)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]
#: A trained network and XXH64 are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        made = settle(stage(spark, docs, sf_dir), name)
        if k:
            forget(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
