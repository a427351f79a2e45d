"""Matroska media columns: a lossless writer of 8-bit PCM and a reader that turns a file into packet tables.

The reader walks variable-length EBML elements (unknown sizes included), clusters, SimpleBlocks and BlockGroups,
undoes Xiph, fixed-size and EBML lacing, and gives each frame's track, timestamp and byte range, with the cues.

Defined results: a null media value has no packets; a damaged file gives the packets found before the damage and
a non-null `error`, also where a number has more than 8 bytes or a timestamp passes 64 bits; repeated rows give repeated
packets, and packets that tie in time stay in file order. A null text is stored as an empty one, a very long one whole,
in time that grows with its length. Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtide.llm.common import map_rows

# Element ids of the EBML and Matroska specifications (RFC 8794, RFC 9559).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C
CODEC_ID, DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS, SEGMENT, EBML}
LACING_NAMES = ("none", "xiph", "fixed", "ebml")

SAMPLE_RATE = 8000
FRAME_BYTES = 1024
FRAMES_PER_BLOCK = 4
BLOCKS_PER_CLUSTER = 16
SCALE_NS = 1_000_000


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    keyframe: bool
    lacing: str
    cluster: int
    offset: int
    size: int


class Media:
    """What the reader found: tracks by number, packets in file order, cues as (time in ns, track, cluster's position)."""

    def __init__(self) -> None:
        self.doc_type, self.scale, self.tracks, self.packets, self.cues, self.clusters, self.error = "", SCALE_NS, {}, [], [], [], None


# ---- writing


def _size(n: int) -> bytes:
    """The shortest size field; all ones is reserved for 'unknown'."""
    length = next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * length).to_bytes(length, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _signed_size(n: int) -> bytes:
    """The difference of two EBML-laced sizes, biased so that it is unsigned."""
    length = next(k for k in range(1, 9) if abs(n) < (1 << 7 * k - 1) - 1)
    return (n + (1 << 7 * length - 1) - 1 | 1 << 7 * length).to_bytes(length, "big")


def laced(frames: list[bytes], kind: int) -> bytes:
    """The frames of one block behind the header of their lacing (0 none, 1 Xiph, 2 fixed, 3 EBML)."""
    if kind == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames[:-1]]
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)
    elif kind == 3:
        head += _size(sizes[0]) + b"".join(_signed_size(b - a) for a, b in zip(sizes, sizes[1:], strict=False))
    return head + b"".join(frames)


def write_pcm(payload: bytes) -> bytes:
    """`payload` as one track of unsigned 8-bit samples. Blocks take the kinds of lacing in turn; every cluster has a cue."""
    frame_ns = FRAME_BYTES * 1_000_000_000 // SAMPLE_RATE
    header = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
    info = _element(INFO, _uint(TIMESTAMP_SCALE, SCALE_NS) + _element(MUXING_APP, b"graphtide") + _element(WRITING_APP, b"graphtide") + _element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE)))
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", SAMPLE_RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    tracks = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, frame_ns) + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues = [info, tracks], b""
    at = len(info) + len(tracks)
    block_bytes = FRAME_BYTES * FRAMES_PER_BLOCK
    for c, start in enumerate(range(0, len(payload), block_bytes * BLOCKS_PER_CLUSTER)):
        base = start * 1000 // SAMPLE_RATE
        parts = [_uint(TIMESTAMP, base)]
        for b, first in enumerate(range(start, min(len(payload), start + block_bytes * BLOCKS_PER_CLUSTER), block_bytes)):
            block = payload[first : first + block_bytes]
            frames = [block[i : i + FRAME_BYTES] for i in range(0, len(block), FRAME_BYTES)]
            kind = 0 if len(frames) == 1 else (2, 1, 3)[(c + b) % 3]
            if kind == 2 and len(frames[-1]) != FRAME_BYTES:
                kind = 3
            head = _size(1) + struct.pack(">h", first * 1000 // SAMPLE_RATE - base)
            if b % 4 == 3:
                parts.append(_element(BLOCK_GROUP, _element(BLOCK, head + bytes([kind << 1]) + laced(frames, kind))))
            else:
                parts.append(_element(SIMPLE_BLOCK, head + bytes([0x80 | kind << 1]) + laced(frames, kind)))
        cluster = _element(CLUSTER, b"".join(parts))
        cues += _element(CUE_POINT, _uint(CUE_TIME, base) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at)))
        at += len(cluster)
        body.append(cluster)
    body.append(_element(CUES, cues))
    return header + _element(SEGMENT, b"".join(body))


# ---- reading


def _vint(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """The number at `at` and the place behind it; None: all ones, an unknown size."""
    if at >= end or not data[at]:
        raise ValueError(f"no EBML number at byte {at}")
    length = 9 - data[at].bit_length()
    if at + length > end:
        raise ValueError(f"EBML number cut off at byte {at}")
    n = int.from_bytes(data[at : at + length], "big")
    if not keep_marker:
        n -= 1 << 7 * length
        if n == (1 << 7 * length) - 1:
            return None, at + length
    return n, at + length


def elements(data: bytes, at: int, end: int, stop: frozenset[int] | set[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of element, start of body, end of body) of the children in data[at:end]. Unknown sizes reach to `end`; ids in `stop` end the walk."""
    while at < end:
        ident, body = _vint(data, at, end, keep_marker=True)
        if ident in stop:
            return
        size, body = _vint(data, body, end)
        last = end if size is None else body + size
        if last > end:
            raise ValueError(f"element {ident:X} at byte {at} passes its parent's end")
        if size is None and ident == CLUSTER:
            # It ends where its children do; with damage among them, the caller walks them up to it.
            try:
                last = body
                for _, _, _, last in elements(data, body, end, TOP_LEVEL):
                    pass
            except ValueError:
                last = end
        yield ident, at, body, last
        at = last


def _int(data: bytes, at: int, end: int) -> int:
    if end - at > 8:
        raise ValueError(f"number of {end - at} bytes at byte {at}")
    return int.from_bytes(data[at:end], "big")


def _ns(n: int, at: int) -> int:
    """A timestamp that a table can hold."""
    if not -(1 << 63) <= n < 1 << 63:
        raise ValueError(f"timestamp out of range at byte {at}")
    return n


def frame_ranges(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of each frame of a block's body."""
    if kind == 0:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % count:
            raise ValueError(f"fixed lacing of {count} frames doesn't fit at byte {at}")
        sizes = [(end - at) // count] * count
    else:
        for i in range(count - 1):
            if kind == 1:
                n = 0
                while True:
                    n, at = n + data[at], at + 1
                    if data[at - 1] != 255:
                        break
            else:
                before = at
                n, at = _vint(data, at, end)
                if n is None:
                    raise ValueError(f"unknown laced size at byte {before}")
                if i:
                    n += sizes[-1] - ((1 << 7 * (at - before) - 1) - 1)
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise ValueError(f"laced sizes pass the block's end at byte {end}")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def _block(media: Media, data: bytes, at: int, end: int, base: int, key: bool | None) -> None:
    track, at = _vint(data, at, end)
    relative, flags = struct.unpack_from(">hB", data, at)
    kind = flags >> 1 & 3
    step = media.tracks.get(track, {}).get("default_duration", 0)
    for i, (offset, size) in enumerate(frame_ranges(data, at + 3, end, kind)):
        media.packets.append(Packet(track, _ns((base + relative) * media.scale + i * step, at), bool(flags & 0x80) if key is None else key, LACING_NAMES[kind], len(media.clusters) - 1, offset, size))


def _track(data: bytes, at: int, end: int) -> dict:
    out = {}
    for ident, _, a, b in elements(data, at, end):
        if ident in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
            out[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration"}[ident]] = _int(data, a, b)
        elif ident == CODEC_ID:
            out["codec"] = data[a:b].decode("ascii", "replace")
        elif ident == AUDIO:
            for k, _, x, y in elements(data, a, b):
                if k == SAMPLING_FREQUENCY:
                    out["rate"] = struct.unpack(">d" if y - x == 8 else ">f", data[x:y])[0]
                elif k in (CHANNELS, BIT_DEPTH):
                    out["channels" if k == CHANNELS else "bits"] = _int(data, x, y)
    return out


def _segment(media: Media, data: bytes, at: int, end: int) -> None:
    start = at
    for ident, begun, a, b in elements(data, at, end):
        if ident == INFO:
            for k, _, x, y in elements(data, a, b):
                if k == TIMESTAMP_SCALE:
                    media.scale = _int(data, x, y)
        elif ident == TRACKS:
            for k, _, x, y in elements(data, a, b):
                if k == TRACK_ENTRY:
                    track = _track(data, x, y)
                    media.tracks[track.get("number", 0)] = track
        elif ident == CLUSTER:
            media.clusters.append(begun - start)
            base = 0
            for k, _, x, y in elements(data, a, b):
                if k == TIMESTAMP:
                    base = _int(data, x, y)
                elif k == SIMPLE_BLOCK:
                    _block(media, data, x, y, base, None)
                elif k == BLOCK_GROUP:
                    inner = {i: (p, q) for i, _, p, q in elements(data, x, y)}
                    if BLOCK in inner:
                        _block(media, data, *inner[BLOCK], base, REFERENCE_BLOCK not in inner)
        elif ident == CUES:
            for k, _, x, y in elements(data, a, b):
                if k == CUE_POINT:
                    time = 0
                    for i, _, p, q in elements(data, x, y):
                        if i == CUE_TIME:
                            time = _ns(_int(data, p, q) * media.scale, p)
                        elif i == CUE_TRACK_POSITIONS:
                            where = {j: _int(data, r, s) for j, _, r, s in elements(data, p, q)}
                            media.cues.append((time, where.get(CUE_TRACK, 0), where.get(CUE_CLUSTER_POSITION, -1)))


def read_media(data: bytes) -> Media:
    media = Media()
    try:
        for ident, _, a, b in elements(data, 0, len(data)):
            if ident == EBML:
                for k, _, x, y in elements(data, a, b):
                    if k == DOC_TYPE:
                        media.doc_type = data[x:y].decode("ascii", "replace")
            elif ident == SEGMENT:
                _segment(media, data, a, b)
        if not media.doc_type:
            media.error = "no EBML header"
    except (ValueError, IndexError, struct.error) as e:
        media.error = str(e) or type(e).__name__
    return media


PACKETS = "track long, timestamp_ns long, keyframe boolean, lacing string, cluster long, `offset` long, size long"


def packet_table(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row for each frame of each file: the key, the frame's columns, its cluster's cue time if it has a cue, and the file's error."""

    def rows(batch):
        for row in batch:
            if row["m"] is not None:
                found = read_media(bytes(row["m"]))
                cues = {position: time for time, _, position in found.cues}
                for p in found.packets:
                    yield (row["k"], *p, cues.get(found.clusters[p.cluster]), found.error)

    kind = dict(df.dtypes)[key]
    return map_rows(df.select(F.col(key).alias("k"), F.col(media).alias("m")), rows, f"{key} {kind}, {PACKETS}, cue_ns long, error string")


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes((-len(raw)) % 64 if raw else 64), len(raw)


def store_documents(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the Matroska file that holds the padded UTF-8 text."""

    def rows(batch):
        for row in batch:
            payload, n = payload_of(row["text"])
            yield row["doc_id"], n, write_pcm(payload)

    return map_rows(df.select("doc_id", "text"), rows, "doc_id long, n_bytes long, media binary")


def media_features(df: DataFrame) -> DataFrame:
    """Reads stored files back by their packets' byte ranges and describes them. Takes doc_id, n_bytes, media."""

    def rows(batch):
        for row in batch:
            data = bytes(row["media"])
            found = read_media(data)
            payload = b"".join([data[p.offset : p.offset + p.size] for p in found.packets])
            kinds = [p.lacing for p in found.packets]
            track = found.tracks.get(1, {})
            good = sum(position in found.clusters for _, _, position in found.cues)
            last = max((p.timestamp_ns for p in found.packets), default=0)
            feature = f"{found.doc_type};{track.get('codec')};rate={track.get('rate', 0):g};bits={track.get('bits')};clusters={len(found.clusters)};packets={len(kinds)};" + ";".join(f"{k}={kinds.count(k)}" for k in LACING_NAMES) + f";keyframes={sum(p.keyframe for p in found.packets)};cues={good}/{len(found.cues)};last_ns={last};mean={sum(payload) / max(1, len(payload)):.6f};zeros={payload.count(0)}"
            yield row["doc_id"], row["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, found.error

    return map_rows(df, rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
