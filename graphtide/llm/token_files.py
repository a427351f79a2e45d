"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds the ids of consecutive documents as little-endian unsigned 32-bit integers, cut into frames that are
compressed alone. Behind them stand a skippable frame with the documents' index (doc_id and number of ids, an Arrow table)
and a seek table in the public seekable format: each frame's sizes and the low half of the XXH64 of its content. So any
zstandard tool unpacks the whole file, and a reader takes the file's end, and then only the frames that hold what it wants.

Texts are dealt out by ranges of doc_id; each task sorts its range, encodes it and writes one file under a new name. The
tasks' results are the manifest, a table that Spark commits: what a lost or repeated task has written isn't in it and is
never read. Equal chunks of text are encoded once (see `chunks`).

Defined results: a null or empty text has the end id alone. Null ids come first; rows of one id follow each other in the
order of their texts' hashes and texts, each as a document of its own. A very long text is encoded whole and spread over
frames. Other columns, of whatever name, are ignored. An empty table has no files and no rows.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphtide.llm.chunks import ByteLevel, Numbered, places, sums
from graphtide.llm.common import Store, released, sliced

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
END = 0
#: Bytes of ids in a frame, and the level they are compressed at.
FRAME, LEVEL = 1 << 18, 3
#: Fixed values of the seekable format: magic numbers of the table's and of the index's skippable frames and of the table's end; the flag that says that entries have checksums.
TABLE_MAGIC, INDEX_MAGIC, SEEKABLE_MAGIC, CHECKED = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80
ENTRY, HEAD, FOOT = struct.Struct("<III"), struct.Struct("<II"), struct.Struct("<IBI")
INDEX = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64())])


# ---- encoding


class Encoder:
    """Ids of texts, those of equal chunks looked up."""

    def __init__(self, path: str, end: int = END) -> None:
        self.words, self.end = ByteLevel(path, special=True), end
        self.numbered = Numbered(self._add, self._keep)
        self.flat, self.begins, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _keep(self, numbers: np.ndarray) -> None:
        sizes = self.sizes[numbers]
        self.flat, self.begins, self.sizes = self.flat[places(self.begins[numbers], sizes)], np.cumsum(sizes) - sizes, sizes

    def _add(self, even: list[str], odd: list[str]) -> None:
        parts = self.words.chunks(even, even=True), self.words.chunks(odd, even=False)
        flat, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat, self.sizes = np.concatenate([self.flat, flat.astype(np.uint32)]), np.concatenate([self.sizes, sizes])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with its end id, and how many each has."""
        self.numbered.renew()
        first, numbers, chunks = self.numbered(texts)
        # A text's first chunk has no space before it.
        heads, head_sizes = self.words.each(first)
        tail = np.ones(len(numbers), dtype=bool)
        tail[(np.cumsum(chunks) - chunks)[chunks > 0]] = False
        numbers, chunks = numbers[tail], np.maximum(chunks - 1, 0)
        tails, tail_sizes = self.flat[places(self.begins[numbers], self.sizes[numbers])], sums(self.sizes[numbers], chunks)
        sizes = head_sizes + tail_sizes + 1
        out, begins = np.full(sizes.sum(), self.end, dtype=np.uint32), np.cumsum(sizes) - sizes
        out[places(begins, head_sizes)] = heads
        out[places(begins + head_sizes, tail_sizes)] = tails
        return out, sizes


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """Stays with the worker, so that its next task finds the frequent chunks."""
    return Encoder(path)


# ---- one file


class FrameWriter:
    """Writes ids to an open file, frame by frame; `close` adds the index and the seek table."""

    def __init__(self, file) -> None:
        self.file, self.held, self.entries = file, bytearray(), []
        self.doc_ids, self.counts, self.bytes = [], [], 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL)

    def _frame(self, size: int) -> None:
        content = bytes(self.held[:size])
        del self.held[:size]
        packed = self.packer.compress(content)
        self.entries.append((len(packed), size, xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self._put(packed)

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.bytes += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A frame ends behind the document that fills it; a document that is longer fills several."""
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.held += ids
        while len(self.held) > 2 * FRAME:
            self._frame(FRAME)
        if len(self.held) >= FRAME:
            self._frame(len(self.held))

    def close(self) -> None:
        if self.held:
            self._frame(len(self.held))
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, INDEX) as out:
            out.write_table(pa.table([pa.array(self.doc_ids, pa.int64()), pa.array(self.counts, pa.int64())], schema=INDEX))
        index = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(sink.getvalue())
        self._put(HEAD.pack(INDEX_MAGIC, len(index)) + index)
        self.entries.append((HEAD.size + len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(ENTRY.pack(*e) for e in self.entries) + FOOT.pack(len(self.entries), CHECKED, SEEKABLE_MAGIC)
        self._put(HEAD.pack(TABLE_MAGIC, len(table)) + table)


class FrameReader:
    """Reads an open file of `size` bytes by its seek table. A frame that isn't what its checksum says is an error."""

    def __init__(self, file, size: int) -> None:
        self.file, self.opened = file, 0
        count, flags, magic = FOOT.unpack(self._at(size - FOOT.size, FOOT.size))
        if magic != SEEKABLE_MAGIC or not flags & CHECKED:
            raise ValueError("no seek table with checksums at the file's end")
        raw = self._at(size - FOOT.size - count * ENTRY.size, count * ENTRY.size)
        self.entries = [ENTRY.unpack_from(raw, i * ENTRY.size) for i in range(count)]
        self.places = [0, *accumulate(e[0] for e in self.entries)]
        self.begins = np.array([0, *accumulate(e[1] for e in self.entries)], dtype=np.int64)
        packed = self._at(self.places[-2] + HEAD.size, self.entries[-1][0] - HEAD.size)
        index = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed)).read_all()
        self.doc_ids, self.counts = index.column(0).to_pylist(), index.column(1).to_numpy()
        self.starts = np.cumsum(self.counts) - self.counts

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("the file ends too soon")
        return data

    def frame(self, i: int) -> bytes:
        packed, size, check = self.entries[i]
        content = zstandard.ZstdDecompressor().decompress(self._at(self.places[i], packed), max_output_size=size)
        self.opened += 1
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return content

    def document(self, i: int) -> np.ndarray:
        """The ids of the file's i-th document, from the frames that hold it."""
        begin, end = 4 * int(self.starts[i]), 4 * int(self.starts[i] + self.counts[i])
        first, last = (int(np.searchsorted(self.begins, x, side="right")) - 1 for x in (begin, end - 1))
        data = b"".join(self.frame(k) for k in range(first, last + 1))
        return np.frombuffer(data[begin - int(self.begins[first]) : end - int(self.begins[first])], dtype="<u4")

    def each(self) -> Iterator[tuple[int | None, int, Iterator[bytes]]]:
        """Each document's id, number of ids and ids in parts, frame by frame."""
        frames, held = iter(range(len(self.entries))), b""

        def parts(left: int) -> Iterator[bytes]:
            nonlocal held
            while left:
                held = held or self.frame(next(frames))
                part, held = held[:left], held[left:]
                left -= len(part)
                yield part

        for doc_id, n in zip(self.doc_ids, self.counts.tolist(), strict=True):
            ids = parts(4 * n)
            yield doc_id, n, ids
            for _ in ids:
                pass


# ---- a corpus


@dataclass(frozen=True)
class TokenFiles:
    """Files of ids and their manifest: path, shard, base (ids in the files before), first_id, last_id, docs, ids, bytes."""

    manifest: DataFrame
    shards: int


MANIFEST = "path string, part int, first_id long, last_id long, docs long, ids long, bytes long"


def write(docs: DataFrame, store: Store, tokenizer: str = TOKENIZER) -> TokenFiles:
    """Encodes all documents and writes them in ascending doc_id. Files go to the store's folder, which the tasks open with Arrow's file systems."""
    struct = StructType.fromDDL(MANIFEST)
    schema = to_arrow_schema(struct)
    folder = store.folder.toString()
    store.files.mkdirs(store.folder)

    def run(batches):
        encoder = _encoder(tokenizer)
        path, file, writer = f"{folder}/ids-{uuid.uuid4()}.zst", None, None
        for batch in sliced(batches):
            if not writer:
                system, name = _system(path)
                file = system.open_output_stream(name, compression=None)
                writer = FrameWriter(file)
            ids, sizes = encoder([t or "" for t in batch.column("text").to_pylist()])
            data, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes)
            for doc_id, begin, end in zip(batch.column("doc_id").to_pylist(), (4 * (ends - sizes)).tolist(), (4 * ends).tolist(), strict=True):
                writer.add(doc_id, data[begin:end])
        if writer:
            writer.close()
            file.close()
            known = [i for i in writer.doc_ids if i is not None] or [None]
            row = (path, TaskContext.get().partitionId(), known[0], known[-1], len(writer.doc_ids), sum(writer.counts), writer.bytes)
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    made = store.table(dealt.mapInArrow(released(run), struct))
    # A row for each task that had documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = store.table(made.withColumn("shard", (F.row_number().over(Window.orderBy("part")) - 1).cast("int")).withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))))
    return TokenFiles(manifest, manifest.count())


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def _opened(path: str, size: int) -> FrameReader:
    system, name = _system(path)
    return FrameReader(system.open_input_file(name), size)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
ROWS = 4096


def read(files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files: one task a file, one frame in memory."""
    struct = StructType.fromDDL(READ)
    schema = to_arrow_schema(struct)

    def run(batches):
        for batch in batches:
            for file in batch.to_pylist():
                at, out = file["base"], []
                for doc_id, n, parts in _opened(file["path"], file["bytes"]).each():
                    check = 0
                    for part in parts:
                        check = zlib.crc32(part, check)
                    out.append((doc_id, at, n, check))
                    at += n
                    if len(out) >= ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    spread = files.manifest.repartitionById(max(1, files.shards), "shard")
    return spread.select("path", "base", "bytes").mapInArrow(released(run), struct)


def fetch(files: TokenFiles, wanted: DataFrame) -> DataFrame:
    """doc_id, ids, frames: the ids of the wanted documents (doc_id), each row of an id, and how many frames were opened for the row. Ids that no file holds, and null, give no row."""
    # A few numbers for each file.
    known = sorted((r["first_id"], r["last_id"], r["shard"], r["path"], r["bytes"]) for r in files.manifest.filter("first_id is not null").collect())
    lows, highs = np.array([r[0] for r in known], dtype=np.int64), np.array([r[1] for r in known], dtype=np.int64)
    place, frames = pa.schema([("doc_id", pa.int64()), ("k", pa.int32())]), pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("frames", pa.int32())])

    def placed(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            a, b = np.searchsorted(highs, ids, side="left"), np.searchsorted(lows, ids, side="right")
            sizes = np.maximum(b - a, 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(places(a, sizes).astype(np.int32))], schema=place)

    def run(batches):
        now, reader, at = None, None, {}
        for batch in batches:
            for doc_id, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != now:
                    now, reader, at = k, _opened(*known[k][3:]), {}
                    for i, d in enumerate(reader.doc_ids):
                        at.setdefault(d, []).append(i)
                for i in at.get(doc_id, []):
                    before = reader.opened
                    ids = reader.document(i)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id]), pa.array([ids.astype(np.int64)], type=frames.field(1).type), pa.array([reader.opened - before], pa.int32())], schema=frames)

    ids = wanted.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    dealt = ids.mapInArrow(placed, "doc_id long, k int").repartition("k").sortWithinPartitions("k", "doc_id")
    return dealt.mapInArrow(run, "doc_id long, ids array<long>, frames int")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Writes all documents' ids and reads the files back; they stay until the application ends."""
    spark: SparkSession = docs.sparkSession
    return read(write(docs, Store(spark), tokenizer))
