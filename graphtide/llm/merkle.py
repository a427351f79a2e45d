"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text is cut into lines; a long line is cut again behind a sentence's end or a word's end, at places that depend on
the text alone, so that each paragraph is short and an edit moves no other cut. Sections are runs of paragraphs that
end where a paragraph's hash says so. Each node is a SHA-256 of its children; equal roots mean equal texts, and the
branches that differ locate an edit. The fingerprint is `root:section[length.leaf,...];...`.

Defined results: a null text counts as empty, and an empty text is one paragraph of length 0. Repeated rows of one id
follow each other in the order of their texts; rows with a null id come last. A very long text is cut and hashed whole, in
time that grows with its length, and is one row. Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphtide.llm.common import released, sliced

#: A paragraph that is longer is cut; a cut falls behind a sentence's end if there is one between these two lengths.
SHORT, LONG = 64, 256
#: Marks that end a sentence: so many at most, so that a run of them is looked at once.
MARKS = 8
#: One paragraph in so many, by its hash, ends a section.
SECTION = 8
#: Most ranges of ids.
RANGES = 8192
LEAF_HEX, SECTION_HEX, ROOT_HEX = 16, 16, 64
PIECE = re.compile(rf"[^\n]{{1,{LONG}}}(?:\n|\Z)|[^\n]{{{SHORT},{LONG}}}?[.!?;]{{1,{MARKS}}}\x20|[^\n]{{{SHORT},{LONG}}}\x20|[^\n]{{{LONG}}}|\n")


def paragraphs(text: str) -> list[str]:
    """Consecutive pieces that make up the text."""
    return PIECE.findall(text) or [""]


def _hash(tag: bytes, parts: list[bytes]) -> bytes:
    return hashlib.sha256(tag + b"".join(parts)).digest()


def tree(text: str | None) -> tuple[str, list[tuple[str, list[tuple[int, str]]]]]:
    """The root, and each section with (length in code points, hash) of its paragraphs."""
    sections, current, hashes, tops = [], [], [], []
    for piece in paragraphs(text or ""):
        leaf = _hash(b"\0", [piece.encode("utf-8", "surrogatepass")])
        current.append((len(piece), leaf.hex()[:LEAF_HEX]))
        hashes.append(leaf)
        if leaf[-1] % SECTION == 0:
            tops.append(_hash(b"\1", hashes))
            sections.append((tops[-1].hex()[:SECTION_HEX], current))
            current, hashes = [], []
    if current:
        tops.append(_hash(b"\1", hashes))
        sections.append((tops[-1].hex()[:SECTION_HEX], current))
    return _hash(b"\2", tops).hex(), sections


def fingerprint(text: str | None) -> str:
    root, sections = tree(text)
    return root + ":" + ";".join(f"{top}[{','.join(f'{n}.{leaf}' for n, leaf in leaves)}]" for top, leaves in sections)


def parse(mark: str) -> tuple[str, list[tuple[str, list[tuple[int, str]]]]]:
    root, _, rest = mark.partition(":")
    out = []
    for part in rest.split(";"):
        top, _, leaves = part.partition("[")
        out.append((top, [(int(n), leaf) for n, _, leaf in (x.partition(".") for x in leaves[:-1].split(","))]))
    return root, out


def likeness(a: str, b: str) -> float:
    """Twice the code points in paragraphs that both trees have over the sum of both texts' code points: 1 for equal roots. Sections that are equal aren't opened."""
    (root_a, left), (root_b, right) = parse(a), parse(b)
    if root_a == root_b:
        return 1.0
    tops = Counter(top for top, _ in left) & Counter(top for top, _ in right)
    shared, counts = 0, []
    for sections in (left, right):
        rest, bag = tops.copy(), Counter()
        for top, leaves in sections:
            if rest[top] > 0:
                rest[top] -= 1
                if sections is left:
                    shared += sum(n for n, _ in leaves)
            else:
                bag.update(leaves)
        counts.append(bag)
    shared += sum(n * k for (n, _), k in (counts[0] & counts[1]).items())
    whole = sum(n for s in (left, right) for _, leaves in s for n, _ in leaves)
    return 2 * shared / whole if whole else 0.0


def changed(a: str, b: str) -> list[tuple[int, int]]:
    """Ranges (start, end) of code points of the first text whose paragraphs the second lacks."""
    (_, left), (_, right) = parse(a), parse(b)
    tops = Counter(top for top, _ in right)
    bag = Counter(leaf for _, leaves in right for leaf in leaves)
    for top, leaves in left:
        if tops[top] > 0:
            bag.subtract(leaves)
    out, at = [], 0
    for top, leaves in left:
        same = tops[top] > 0
        tops[top] -= same
        for n, leaf in leaves:
            if same or bag[n, leaf] > 0:
                bag[n, leaf] -= not same
            elif out and out[-1][1] == at:
                out[-1] = (out[-1][0], at + n)
            else:
                out.append((at, at + n))
            at += n
    return out


def edited(text: str, following: str) -> str:
    """`text` with its last floor(n / 4) code points replaced by the first as many (or all) of `following`."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id, text: str, mark: str, following: str, next_mark: str) -> tuple:
    new = edited(text, following)
    new_mark = fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), mark, new_mark, likeness(mark, new_mark), likeness(mark, next_mark)


def _ranges(docs: DataFrame) -> tuple[list[float], list[tuple[int, int | None, int]]]:
    """Bounds that cut the ids into ranges of about equal numbers of rows, and for each range with rows its number, its least id and the range before it (of the first: the last). Null ids are the last range."""
    spark = docs.sparkSession
    wanted = min(RANGES, max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ids = docs.select("doc_id")
    cuts = ids.approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 1 / (4 * wanted))
    bounds = [float("-inf"), *sorted({0.0, *cuts}), float("inf")]
    least = sorted((r["place"], r["first"]) for r in _placed(ids, bounds).groupBy("place").agg(F.min("doc_id").alias("first")).collect())
    return bounds, [(place, first, least[i - 1][0]) for i, (place, first) in enumerate(least)]


def _placed(df: DataFrame, bounds: list[float]) -> DataFrame:
    """`df` with the number of the range that holds doc_id, found by binary search in the JVM."""
    ids = df.withColumn("_id", F.col("doc_id").cast("double"))
    cut = Bucketizer(splits=bounds, inputCol="_id", outputCol="_place", handleInvalid="keep").transform(ids)
    return cut.withColumn("place", F.coalesce(F.col("_place").cast("int"), F.lit(len(bounds)))).drop("_id", "_place")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each row's tree, and that of its text edited with the next row's, in ascending doc_id (null ids last); the last row is followed by the first.

    The ids alone give ranges and the least id of each. The texts are dealt out by range once; the first rows of a range
    go to the range before it as well, to follow its last row.
    """
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds, heads = _ranges(whole)
    if not heads:
        return docs.sparkSession.createDataFrame([], OUT)
    spark = docs.sparkSession
    placed = _placed(whole, bounds).withColumn("after", F.lit(False))
    # At most RANGES + 1 rows.
    known = spark.createDataFrame([(first, before) for _, first, before in heads if first is not None], "first long, before int")
    following = whole.join(F.broadcast(known), F.col("doc_id") == F.col("first")).select("doc_id", "text", F.col("before").alias("place"), F.lit(True).alias("after"))
    for _, first, before in heads:
        if first is None:
            following = following.unionByName(whole.filter("doc_id is null").agg(F.min("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(before).alias("place"), F.lit(True).alias("after")))
    # One task for each range; hashing would put several into one.
    dealt = placed.unionByName(following).repartitionById(len(bounds) + 1, "place").sortWithinPartitions("after", F.col("doc_id").asc_nulls_last(), "text")
    struct = StructType.fromDDL(OUT)
    arrow = to_arrow_schema(struct)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches) -> Iterator[pa.RecordBatch]:
        before, out = None, []
        for batch in sliced(batches):
            for row in batch.to_pylist():
                now = None if row["after"] and before is None else (row["place"], row["doc_id"], row["text"], fingerprint(row["text"]))
                if before and now and before[0] == now[0]:
                    out.append(_row(*before[1:], *now[2:]))
                before = None if row["after"] else now
                if len(out) >= 256:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return dealt.select("place", "after", "doc_id", "text").mapInArrow(released(run), struct)
