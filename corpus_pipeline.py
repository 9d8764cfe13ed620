"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

STAGES: (name, function of (spark, docs, sf_dir)). run() applies them in order; the folder it writes to
is the shared one that spark.checkpoint.dir names (a folder of the working directory where that is unset). A stage's
folder is deleted when the next one is written, but for the mixture: packing names for each piece its file and row
there (`file`, `row`), where the text and all columns are, in the mixture's order.

Null and empty texts go through to the mixture and have no pieces. Null ids and rows that share an id are kept as
the stages' docstrings state; empty tables give empty results. documents must have a column `text` (a frame without one
has nothing to scan and raises).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import minhash, mixing, packing, secrets, toxicity
from quern.llm.common import table
from quern.sources.shared import Folder, shared


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon rejects go."""
    return toxicity.keep_clean(docs, toxicity.train(spark, docs, table(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the names of their rules."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order and with the epochs of the mixture."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their bins, in the mixture's order: each bin is of neighbouring rows, and no two epochs
    of a document are in one."""
    return packing.best_fit(docs, in_order=True)


STAGES = [("toxicity", clean), ("near_dedup", dedup), ("secrets", redact), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    done: list[str] = []
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
        done.append(f"{i}_{name}")
        if 1 < len(done) < len(STAGES):
            Folder(spark, folder).delete(done[-2])
    return docs
