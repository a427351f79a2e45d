"""Ranked lexical search over postings.

Documents become a table of postings (bucket, term, row, doc_id, tf, n, lead), one row for each term of each document, with
its count and the document's length. `bucket` comes from the term's hash and orders each file, so that a search for a few
terms reads the pages that hold their buckets. A search joins the items' terms to the postings, scores each match in
integers, sums by item and document and numbers each item's documents from the best.

Nothing is dealt out by term, so a term that every document holds is scored where its postings lie. A document's postings
are in one file; the sums by item and document are combined there before they are shuffled.

Defined results: a null or empty text, or one without a term, isn't a document of the corpus and matches nothing. Each row
is a document of its own: repeated rows, or rows of one id, are ranked side by side, and a null id comes after the others of
its score. Items of one id are one item with the terms of all its rows, once each; a null item_id is an item. Very long texts
are cut into terms whole. Other columns, of whatever name, are ignored. Without documents or terms the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphtide.llm.common import Store, released, sliced

BUCKETS = 4096
BEST = 10
#: Fixed values of the score.
WHOLE, LENGTH_SHARE, SATURATION, UNIT, FINE = 100, 90, 8, 1000, 1_000_000_000
#: Rows and characters of the items' terms that are sent to all tasks; more are joined by shuffling.
SENT_ROWS, SENT_CHARS = 1 << 19, 1 << 23

_BYTE = np.arange(256, dtype=np.uint8)
INSIDE = (_BYTE >= 0x80) | ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each term of the texts, in order, the text's place and the term. Terms are runs of letters and digits and of all that is beyond ASCII, A-Z in lower case."""
    n = len(texts)
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    # A text's first byte begins a term even if the text before ended in one.
    heads = ends[:-1][ends[:-1] < ends[1:]]
    first[heads] = inside[heads]
    begins = np.flatnonzero(first)
    kept = np.concatenate([[0], np.cumsum(inside)])
    offsets = np.append(kept[begins], kept[-1])
    found = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(LOWER[data[inside]]))
    return np.searchsorted(ends, begins, side="right") - 1, found


POSTINGS = "row long, doc_id long, term string, tf int, n long, lead boolean"


def postings(docs: DataFrame) -> DataFrame:
    """row, doc_id, term, tf, n, lead, bucket: a row for each different term of each document. `row` tells documents apart; `lead` marks one posting of each."""
    struct = StructType.fromDDL(POSTINGS)
    schema = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            doc, found = terms(batch.column("text"))
            if not len(doc):
                continue
            coded = found.dictionary_encode()
            pairs, tf = np.unique(doc * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
            doc_of, term_of = np.divmod(pairs, len(coded.dictionary))
            lead = np.ones(len(doc_of), dtype=bool)
            lead[1:] = doc_of[1:] != doc_of[:-1]
            n = np.bincount(doc, minlength=batch.num_rows)
            at = pa.array(doc_of)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(at), batch.column("doc_id").take(at), coded.dictionary.take(pa.array(term_of)).cast(pa.string()), pa.array(tf.astype(np.int32)), pa.array(n[doc_of]), pa.array(lead)], schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(released(run), struct)
    return rows.withColumn("bucket", bucket(F.col("term")))


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def index(docs: DataFrame, store: Store) -> DataFrame:
    """The postings of all terms as a table in the store, in the order of their buckets within each file."""
    return store.table(postings(docs).sortWithinPartitions("bucket"))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, each once."""
    struct = StructType([items.select("item_id").schema[0], *StructType.fromDDL("term string")])
    schema = to_arrow_schema(struct)

    def run(batches):
        for batch in sliced(batches):
            row, found = terms(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(row)), found.cast(pa.string())], schema=schema)

    return items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(released(run), struct).distinct()


def search(postings: DataFrame, items: DataFrame, best: int = BEST, store: Store | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `best` documents with a score above 0, equal scores by ascending doc_id.

    A term's weight falls with the number of documents that hold it, a match's with the document's length against the mean.
    """
    store = store or Store(postings.sparkSession)
    wanted = store.table(item_terms(items))
    size = wanted.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    sent = F.broadcast if size["rows"] <= SENT_ROWS and size["chars"] <= SENT_CHARS else (lambda df: df)
    total = postings.agg(F.count(F.when(F.col("lead"), 1)).alias("docs"), F.coalesce(F.sum("tf"), F.lit(0)).alias("terms")).first()

    buckets = [r[0] for r in wanted.select(bucket(F.col("term"))).distinct().collect()]  # BUCKETS at most
    near = postings.filter(F.col("bucket").isin(buckets)) if len(buckets) < BUCKETS // 8 else postings
    held = near.join(sent(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(UNIT * F.log((F.lit(2 * total["docs"] + 2)) / (2 * F.col("df") + 1)))
    weighted = store.table(wanted.join(held, "term").select("item_id", "term", weight.alias("w")).filter("w > 0"))

    length = WHOLE - LENGTH_SHARE + F.expr(f"{LENGTH_SHARE}L * n * {total['docs']}L div {max(1, total['terms'])}L")
    scored = near.join(sent(weighted), "term").withColumn("m", length).selectExpr("item_id", "row", "doc_id", f"w * ({FINE}L * tf div ({UNIT}L * tf + {SATURATION}L * m)) as score")
    sums = scored.groupBy("item_id", "row", "doc_id").agg(F.sum("score").alias("score")).filter("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    return sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """`search` over all of `docs`, which are indexed whole."""
    store = Store(docs.sparkSession)
    return search(index(docs, store), items, best, store)
