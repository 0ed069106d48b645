"""The corpus pipeline: five stages over documents, each on all that its predecessor kept.

1. quality: documents that the classifier rejects go.
2. near_duplicates: one document of each class of near copies stays, that of the least id.
3. secrets: live-looking secrets are replaced; widely copied examples stay.
4. mixing: a document stays as often as the mix to target weights takes it (0, 1 or 2 times).
5. tokens: the whole texts become token ids.

All but the last return the columns of documents. Null texts count as empty; rows with null ids are
kept or dropped like any other; repeated rows are one class of near copies; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import bpe, mixing, neardup, quality, secrets
from framewise.llm.common import read, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resampled(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Smaller tables than the operator's own: the other stages' executors have little memory left.
    return bpe.encoded(docs, *bpe.default_vocabulary(), most_states=100_000, keep_tables=False)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

#: The classifier, the signatures and BPE are beyond SQL; tests compare run() with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
