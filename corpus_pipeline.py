"""Documents to packed training sequences, in five stages.

language_id   drops documents whose language cannot be told
near_copies   keeps one document of each group of similar texts
secrets       masks what the secret scan finds
mixture       keeps the documents that the leaf budgets pay for, once for each epoch that reads them
packing       packs the token pieces of what is left

Every stage reads all that its predecessor kept; all but the last return the columns of documents. No stage
fails on nulls in any column, empty or very long texts, repeated rows or empty tables; extra columns of the
input come along whatever their names, set aside while an operator is at work. What each does with such rows is
said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import langid, mixing, ngram_join, packing, secrets
from tidewell.llm.common import set_aside, settle

#: What the operators read; every other column is set aside.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter. Null, empty and letterless texts go; repeated rows stay, each by itself. Where
    no row can be learnt from, every document is ``und`` and goes."""
    own, back = set_aside(docs, *READ)
    return back(langid.keep_identified(own))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts, the one of the smallest id. Null, empty and wordless texts
    are groups of their own, and rows with a null id stay; of rows that repeat an id one stays."""
    own, back = set_aside(docs, *READ)
    return back(ngram_join.keep_one(own))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked, and n_chars with them. Null texts stay null, clean rows as they are."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their leaf's budget pays for, once for each epoch that reads them. Null languages and
    sources are leaves; texts without words cost nothing and come along with their leaf."""
    own, back = set_aside(docs, *READ)
    chosen = mixing.mix(own)
    return back(chosen.withColumn("_epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*own.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places. Null and empty texts are one id 0 each; repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("secrets", mask_secrets),
    ("mixture", mixture),
    ("packing", packed),
]

#: Language identification and the set join cannot be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
