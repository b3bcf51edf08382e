"""The corpus pipeline: documents in, packed training bins out.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a
DataFrame that is written and read again as the next one's docs. All but the last return the
columns of their input, whatever these are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialmill.llm import exact_dedup, jaccard_join, langid, mixing, packing
from trialmill.llm.common import shared_dir, store
from trialmill.llm.queries import CAPACITY, held_out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no text, no letter, or no clear lead of one language.

    The models learn from labelled rows only, as in the query of this operator. Defined cases: see
    trialmill.llm.langid; without labelled rows all documents are rejected.
    """
    model = langid.train(docs, ~held_out("doc_id") & F.col("doc_id").isNotNull())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    found = langid.identify(rows, model)
    return found.filter((F.col("language.lang_pred") != langid.UND) & ~F.col("language.ambiguous")).select("row.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, that with the largest doc_id.

    Defined cases: a null text counts as empty, and one such document stays; a null doc_id loses to any other; of rows
    that agree in doc_id and text one stays. See trialmill.llm.exact_dedup.
    """
    return exact_dedup.deduplicate(docs, keep="max")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id.

    Defined cases: documents without words and rows without a doc_id are near nothing and stay; rows that share a doc_id
    stay or go together. See trialmill.llm.jaccard_join.
    """
    return jaccard_join.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for.

    Defined cases: null is a source, ordered last; a source without words is left out; repeated rows share their
    decision. See trialmill.llm.mixing.
    """
    return mixing.mix(docs, weights=(5, 2, 1), cap=3, seed=17)


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins; copies of a text never share one.

    Defined cases: a document without words takes a piece of size 0, one longer than a bin is cut. See
    trialmill.llm.packing.
    """
    return packing.pack(docs, capacity=CAPACITY).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("jaccard_join", near_duplicates),
    ("mixing", mixture),
    ("best_fit_packing", bins),
]

#: Language identification cannot be put into SQL; the stages are tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the cluster's shared folder."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = store(stage(spark, docs, sf_dir), f"{path}/{k}_{name}")
    return docs
