"""Alignment of two tokenizers' ids over the bytes that both cover.

Each text, behind a space, is encoded by a byte-level tokenizer A and by a sentencepiece model B. np.repeat spreads each
token's number over its bytes, for A and for B; where two neighbouring bytes differ in either owner a new pair of tokens
begins (a link), where they differ in both, both tokenizers end a token (a cut between groups). Texts are cut into chunks at
which both end a token (see `chunks`), so a chunk's owners are computed once however often it stands in the corpus.

How many documents hold an id pair linked is a grouped sum over all documents' distinct pairs. To bring the counts back, the
most frequent pairs, PAIRS at most, go to all tasks; the others, which few documents hold, are joined by shuffling.

Defined results: null and empty texts, and texts whose tokens' joined bytes differ from space and text (such as those with
U+2581, which B takes for a space), have no tokens: zeros and an empty groups_sha256. Each row is a document of its own:
repeated rows, or rows of one or a null id, count side by side. Very long texts are aligned whole. Ties between the pairs
of an A id are all best. Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphtide.llm.chunks import ByteLevel, Numbered, places, sums
from graphtide.llm.common import Store, released, sliced

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: A pair is one number, A's id times this plus B's.
WIDTH = 1 << 20
#: Most pairs that are sent to all tasks.
PAIRS = 1 << 18
#: Most chunks that a worker remembers: with their groups and pairs a chunk takes about half a KB.
REMEMBERED = 1 << 18


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable characters of Latin-1 stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _byte_level(words: ByteLevel) -> list[bytes]:
    table, entries = byte_of(), words.entries()
    return [words.special[i].encode() if i in words.special else bytes(table[c] for c in entries.get(i, "")) for i in range(len(words.widths))]


def _pieces(sp: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    out = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace(SPACE, " ").encode())
    if any(SPACE in sp.id_to_piece(i).lstrip(SPACE) for i in range(len(out))):
        raise ValueError("a piece reaches over a word's end")
    return out


class Aligner:
    """Aligns chunks, each with a space before it, and keeps what it has found of them under their numbers."""

    def __init__(self, a: str = A, b: str = B, most: int = REMEMBERED) -> None:
        self.a, self.b = ByteLevel(a, special=False), sentencepiece.SentencePieceProcessor(model_file=b)
        self.bytes_a, self.bytes_b = _byte_level(self.a), _pieces(self.b)
        self.width_a, self.width_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.names = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        self.numbered = Numbered(self._add, self._keep, most)
        self.good, self.counts, self.groups = np.zeros(0, bool), np.zeros((0, 4), np.int64), []
        self.pairs, self.begins, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _keep(self, numbers: np.ndarray) -> None:
        sizes = self.sizes[numbers]
        self.good, self.counts, self.groups = self.good[numbers], self.counts[numbers], [self.groups[i] for i in numbers.tolist()]
        self.pairs, self.begins, self.sizes = self.pairs[places(self.begins[numbers], sizes)], np.cumsum(sizes) - sizes, sizes

    def _add(self, even: list[str], odd: list[str]) -> None:
        for chunks in (even, odd):
            good, counts, groups, links = self.align(chunks, even=chunks is even)
            sizes = counts[:, 3]
            self.begins = np.concatenate([self.begins, len(self.pairs) + np.cumsum(sizes) - sizes])
            self.good, self.counts = np.concatenate([self.good, good]), np.concatenate([self.counts, counts])
            self.pairs, self.sizes = np.concatenate([self.pairs, links]), np.concatenate([self.sizes, sizes])
            self.groups += groups

    def align(self, chunks: list[str], even: bool = False) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Of each chunk behind a space: whether both tokenizers give its bytes; tokens of A and B, groups and links; the groups' text; and the links of all chunks, one after the other."""
        a, sizes_a = self.a.chunks(chunks, even)
        ids_b = self.b.encode(chunks, num_threads=1)
        b, sizes_b = np.array(list(chain.from_iterable(ids_b)), dtype=np.int64), np.fromiter(map(len, ids_b), dtype=np.int64, count=len(chunks))
        wholes = [f" {c}".encode() for c in chunks]
        lengths = np.fromiter(map(len, wholes), dtype=np.int64, count=len(chunks))
        good = (sums(self.width_a[a], sizes_a) == lengths) & (sums(self.width_b[b], sizes_b) == lengths)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != b"".join(wholes) or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != b"".join(wholes):
            # Some chunk isn't given back; rare, so one by one.
            end_a, end_b = np.cumsum(sizes_a).tolist(), np.cumsum(sizes_b).tolist()
            list_a, list_b = a.tolist(), b.tolist()
            for i, whole in enumerate(wholes):
                good[i] = good[i] and b"".join([self.bytes_a[t] for t in list_a[end_a[i] - int(sizes_a[i]) : end_a[i]]]) == whole == b"".join([self.bytes_b[t] for t in list_b[end_b[i] - int(sizes_b[i]) : end_b[i]]])
        a, b = a[np.repeat(good, sizes_a)], b[np.repeat(good, sizes_b)]
        owner_a, owner_b = np.repeat(np.arange(len(a)), self.width_a[a]), np.repeat(np.arange(len(b)), self.width_b[b])
        new_a, new_b = (np.concatenate([[True], o[1:] != o[:-1]]) if len(o) else np.zeros(0, bool) for o in (owner_a, owner_b))
        linked, heads = np.flatnonzero(new_a | new_b), np.flatnonzero(new_a & new_b)
        links = a[owner_a[linked]] * WIDTH + b[owner_b[linked]]
        # A chunk's first byte begins a token of both, so a group.
        chunk_ends = np.cumsum(np.where(good, lengths, 0))
        counts = np.stack([np.where(good, sizes_a, 0), np.where(good, sizes_b, 0), np.diff(np.searchsorted(heads, chunk_ends), prepend=0), np.diff(np.searchsorted(linked, chunk_ends), prepend=0)], axis=1)
        # Most groups have one id of each.
        at_a, at_b = owner_a[heads], owner_b[heads]
        text_a, text_b = list(map(self.names.__getitem__, a.tolist())), list(map(self.names.__getitem__, b.tolist()))
        one = (np.diff(at_a, append=len(a)) == 1) & (np.diff(at_b, append=len(b)) == 1)
        ends_a, ends_b = np.append(at_a, len(a))[1:].tolist(), np.append(at_b, len(b))[1:].tolist()
        said = [f"{text_a[i]}|{text_b[k]}" if single else f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}" for single, i, j, k, m in zip(one.tolist(), at_a.tolist(), ends_a, at_b.tolist(), ends_b, strict=True)]
        ends = np.cumsum(counts[:, 2]).tolist()
        groups = [";".join(said[e - n : e]) if n > 1 else said[e - 1] if n else "" for e, n in zip(ends, counts[:, 2].tolist(), strict=True)]
        return good, counts, groups, links

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: tokens of A and B, groups and links; the groups' hash; and the distinct pairs of all texts: the text's place, pair, links."""
        self.numbered.renew()
        _, numbers, chunks = self.numbered([t or "" for t in texts])
        doc = np.repeat(np.arange(len(texts)), chunks)
        odd = np.unique(doc[~self.good[numbers]]).tolist()
        counts = np.stack([sums(self.counts[numbers, k], chunks) for k in range(4)], axis=1)
        number_list, ends = numbers.tolist(), np.cumsum(chunks).tolist()
        hashes, at, said = [], 0, self.groups
        for n, end in zip(chunks.tolist(), ends, strict=True):
            hashes.append(hashlib.sha256(";".join([said[i] for i in number_list[at:end]]).encode()).hexdigest() if n else "")
            at = end
        # A chunk that stands in a text again and again is opened once.
        ours, times = np.unique(doc * (self.numbered.size + 1) + numbers, return_counts=True)
        doc, numbers = np.divmod(ours, self.numbered.size + 1)
        found = (np.repeat(doc, self.sizes[numbers]), self.pairs[places(self.begins[numbers], self.sizes[numbers])], np.repeat(times, self.sizes[numbers]))
        if odd:
            # Some chunk isn't given back: what counts is the whole text.
            found = [x[~np.isin(found[0], odd)] for x in found]
            good, own, texts_of, links = self.align([texts[i] for i in odd])
            counts[odd] = own
            for i, g, t in zip(odd, good, texts_of, strict=True):
                hashes[i] = hashlib.sha256(t.encode()).hexdigest() if g else ""
            found = [np.concatenate(x) for x in zip(found, (np.repeat(odd, own[:, 3]), links, np.ones(len(links), np.int64)), strict=True)]
        doc, pair, times = found
        distinct, codes = np.unique(pair, return_inverse=True)
        keys, where = np.unique(doc * (len(distinct) + 1) + codes, return_inverse=True)
        doc, code = np.divmod(keys, len(distinct) + 1)
        return counts, hashes, doc, distinct[code], np.bincount(where, times, len(keys)).astype(np.int64)


@lru_cache(maxsize=1)
def _aligner(a: str, b: str) -> Aligner:
    """Stays with the worker, so that its next task finds the frequent chunks."""
    return Aligner(a, b)


TABLE = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<int>"


def aligned(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links: each document's distinct id pairs, and how many links each has."""
    struct = StructType.fromDDL(TABLE)
    schema = to_arrow_schema(struct)

    def run(batches):
        for batch in sliced(batches):
            aligner = _aligner(a, b)
            counts, hashes, doc, pair, links = aligner.texts(batch.column("text").to_pylist())
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)).cast(f.type) for x, f in ((pair, schema.field("pairs")), (links.astype(np.int32), schema.field("links")))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *[pa.array(counts[:, k]) for k in range(4)], pa.array(hashes, pa.string()), *lists], schema=schema)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), struct)


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best: whether no other pair of its A id has more. Takes `aligned`."""
    counts = table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    return counts


def _best(counts: DataFrame) -> DataFrame:
    # A row for each id of A at most.
    most = counts.groupBy(F.floor(F.col("pair") / WIDTH).alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", F.floor(F.col("pair") / WIDTH)).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _least_sent(counts: DataFrame) -> int:
    """The least count of which all pairs, with those of greater counts, are PAIRS at most."""
    level = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, None
    # Some hundreds of rows.
    for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("n")).orderBy(F.desc("level")).collect():
        total += r["pairs"]
        if total > PAIRS:
            break
        least = r["n"]
    return least if least is not None else (1 << 62)


def align(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the A id's best), count_sum (of the links' pairs), groups_sha256."""
    store = Store(docs.sparkSession)
    table = store.table(aligned(docs, a, b))
    counts = store.table(_best(store.table(pair_counts(table))))
    least = _least_sent(counts)
    each = table.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    sent = F.broadcast(counts.filter(F.col("n") >= least))
    known = each.join(sent, "pair")
    rare = each.join(F.broadcast(counts.filter(F.col("n") >= least).select("pair")), "pair", "left_anti").join(counts.filter(F.col("n") < least), "pair")
    totals = known.select("row", "links", "n", "best").unionByName(rare.select("row", "links", "n", "best"))
    totals = totals.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    whole = table.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(totals, "row", "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
