"""A corpus pipeline of five operators; each stage's result is written as Parquet and read again as the next one's documents.

The stages return the columns of documents, the last one the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.llm import jaccard_groups, langid, mixture, pieces, secret_scan
from graphtide.llm.common import Store, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; `lang` is what was found. Learned from the documents at hand.

    Null and empty texts and those without a letter have no language and go, as do ties; repeated rows are judged alike;
    very long texts are judged whole; a null id, lang, source or n_chars changes nothing; other columns are dropped.
    """
    found = langid.classify(docs, langid.learn(docs), keep=True)
    return found.filter("not rejected").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a Jaccard similarity of 0.8 or more on five-word shingles, that of the least doc_id.

    Rows of one id are one document: what any of them links to is linked, and the least row (by text, then the other
    columns, nulls first) stays. Rows with a null id can't be told apart and all stay. Null and empty texts are linked
    with nothing and stay; very long texts are compared whole; other columns are dropped.
    """
    found = jaccard_groups.near_duplicates(docs, k=5, num=80, den=100).filter("doc_id is not null")
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    repeated = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    least = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*[c for c in COLUMNS if c != "doc_id"])).alias("row")).select("doc_id", "row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(least.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked; n_chars is that of the new text.

    Null texts stay null, with a null n_chars; empty ones stay empty; repeated rows are masked alike; very long texts are
    masked whole; other columns are dropped.
    """
    return secret_scan.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask, in random order.

    A null source is a source; rows of one id, or with a null id, come equally often; texts of any kind are carried along;
    other columns are dropped.
    """
    return mixture.replicate(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's pieces. Null and empty texts have none; repeated rows, such as copies, are encoded alike; very long texts are encoded whole."""
    return pieces.encode(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("encode", encode)]

#: Compression and lattice have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. A stage's table goes to the shared folder and is removed when the next one's is written; the last, which the result is read from, when the application ends."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        store = Store(spark)
        docs = store.table(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        before = store
    return STAGES[-1][1](spark, docs, sf_dir)
