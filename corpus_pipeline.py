"""A corpus from documents to training sequences, in five stages.

Each stage gets what the one before kept, written as Parquet and read again, and returns the columns of
documents; the last returns pieces of sequences. SQL can't express the learnt first stage or the tokenizer of
the last, so there is no ORACLE_SQL; tests/llm/test_pipeline.py holds the stages against plain versions.

Defined cases, for every stage: documents with a null or empty text are documents like others (not toxic, equal to each
other, without shingles or benchmark words, one separator long when packed). Rows without identifier are kept by the first four
stages, but for all but one of those whose texts are equal; labels without identifier or label teach nothing. Texts of any
length are read whole. Rows that are repeated in full are equal texts, of which one stays; of equal largest identifiers one row
stays. Columns beside doc_id and text may be null and may have any name; they go through the first four stages unchanged. Empty
tables give no rows.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordflow.llm import decontam, exact_dedup, ngram_join, packing, toxicity
from recordflow.llm.common import drop_tables, held_out, owned, shared_dir
from recordflow.llm.queries import tokenizer_path
from recordflow.session import ship


#: The tables of the stage of each name that was called last; they go when the next stage begins, whose docs are written by then.
_TABLES: dict[str, list[str]] = {}


def _stage(name: str, after: str | None):
    def named(stage):
        @functools.wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            ship(spark)
            drop_tables(spark, _TABLES.pop(after, []))
            with owned([]) as tables:
                out = stage(spark, docs, sf_dir)
            _TABLES[name] = tables
            return out

        return run

    return named


@_stage("toxicity", None)
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is at least 0.5 go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 5, 0))
    scored, score = toxicity.score(docs, toxicity.fit(docs, labels, "toxic"))
    return scored.where(F.col(score) < 0.5).drop(score)


@_stage("exact_dedup", "toxicity")
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z as a-z) the one with the largest doc_id stays."""
    return exact_dedup.dedup(docs, keep="largest")


@_stage("ngram_join", "exact_dedup")
def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles one stays."""
    return ngram_join.dedup(docs, k=5, num=80, den=100)


@_stage("decontam", "ngram_join")
def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more are hit by benchmark windows go."""
    marked, names = decontam.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(~F.col(names[-1])).drop(*names)


@_stage("packing", "decontam")
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, with their ids."""
    return packing.pack(docs, tokenizer_path(), size=1024, separator=0, with_ids=True)


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_stage),
    ("ngram_join", ngram_stage),
    ("decontam", decontam_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the whole pipeline makes of documents. A stage's result goes when the next one's is written; the last that is
    kept is what the pieces are read from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = f"{shared_dir(spark)}/recordflow-pipeline-{uuid.uuid4().hex}", []
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        drop_tables(spark, before)
        before = [f"{base}/{name}"]
    return STAGES[-1][1](spark, docs, sf_dir)
