"""Texts cut where no tokenizer joins what stands on both sides, so that equal chunks are encoded once.

A cut falls before a space between a character that isn't white space and a letter, digit or mark. The byte-level pattern
begins a word there, and no piece of the sentencepiece model reaches from another character into a U+2581 (`alignment`
checks it), so the ids of a text are those of its chunks one after the other.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Tasks share the cores already.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

CUT = re.compile(r"(?<=\S) (?=[!-~\w])")
#: A chunk between two spaces that aren't both cuts, or that a text's end may have left so.
ODD = re.compile(r"\A(?![!-~\w])|\s\Z| ")
#: Longest chunk, and most chunks, that a worker remembers.
LONGEST, REMEMBERED = 64, 1 << 20


def is_odd(chunk: str) -> bool:
    # Most are printable ASCII, and a chunk that stands between spaces holds none.
    return not (chunk.isascii() and chunk.isprintable() and chunk and " " not in chunk) and ODD.search(chunk) is not None


class Numbered:
    """Numbers chunks; `make` is given the new ones of a batch, the even ones and the odd ones, whose numbers follow those before.

    When more than `most` chunks are numbered, `renew`, between batches, keeps the half of them that was met most often and
    passes their numbers, which become 0, 1, ..., to `keep`.
    """

    def __init__(self, make: Callable[[list[str], list[str]], None], keep: Callable[[np.ndarray], None], most: int = REMEMBERED) -> None:
        self.make, self.keep, self.most, self.known, self.size, self.met = make, keep, most, {}, 0, np.zeros(0, np.int64)

    def renew(self) -> None:
        if self.size <= self.most:
            return
        chunks, numbers = list(self.known), np.fromiter(self.known.values(), dtype=np.int64, count=len(self.known))
        best = np.argsort(-self.met[numbers], kind="stable")[: self.most // 2]
        self.keep(numbers[best])
        # Halved, so that what is met no more goes in time.
        self.known, self.size, self.met = {chunks[i]: k for k, i in enumerate(best.tolist())}, len(best), self.met[numbers[best]] // 2

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Each text's first chunk, the numbers of all chunks, and each text's count. An empty text has none."""
        if not texts:
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Where all that stands between spaces is even, the spaces are the cuts.
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        own, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = np.fromiter(map(self.known.get, own, repeat(-1)), dtype=np.int64, count=len(own))
        # Odd ones are never remembered.
        unknown = np.flatnonzero(found < 0).tolist()
        odd = np.zeros(len(own), dtype=bool)
        odd[[i for i in unknown if is_odd(own[i])]] = True
        again = np.add.reduceat(odd[at], offsets[:-1]) > 0
        recut = {i: CUT.split(texts[i]) if texts[i] else [] for i in np.flatnonzero(again).tolist()}
        counts = np.diff(offsets)
        used = np.zeros(len(own), dtype=bool)
        used[at[np.repeat(~again, counts)]] = True
        fresh = [i for i in unknown if used[i]]
        new = dict.fromkeys([own[i] for i in fresh]) | dict.fromkeys(c for p in recut.values() for c in p if c not in self.known)
        if new:
            apart = [c for c in new if is_odd(c)] if recut else []
            gone = set(apart)
            even = [c for c in new if c not in gone]
            self.make(even, apart)
            new = dict(zip([*even, *apart], range(self.size, self.size + len(new)), strict=True))
            self.size += len(new)
            self.known.update((c, new[c]) for c in even if len(c) <= LONGEST)
            found[fresh] = [new[own[i]] for i in fresh]
        out, heads = found[at], [own[i] for i in at[offsets[:-1]].tolist()]
        if recut:
            slices = np.split(out, offsets[1:-1])
            for i, p in recut.items():
                slices[i] = np.array([new[c] if c in new else self.known[c] for c in p], dtype=np.int64)
                heads[i], counts[i] = p[0] if p else "", len(p)
            out = np.concatenate(slices)
        self.met = np.bincount(out, minlength=self.size) + np.append(self.met, np.zeros(self.size - len(self.met), np.int64))
        return heads, out, counts


class ByteLevel:
    """A byte-level tokenizer of the tokenizers library, for chunks."""

    def __init__(self, path: str, special: bool) -> None:
        """`special`: whether the special tokens' strings in a text are such tokens."""
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        entries = self.entries()
        # A character of an entry stands for a byte.
        self.widths = np.array([len(self.special[i].encode()) if i in self.special else len(entries.get(i, "")) for i in range(max(entries) + 1)], dtype=np.int64)

    def entries(self) -> dict[int, str]:
        return {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), dtype=np.int64), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    def chunks(self, chunks: list[str], even: bool) -> tuple[np.ndarray, np.ndarray]:
        """`each` of the chunks, every one behind a space. Even chunks are encoded in one text, whose ids are dealt out by their bytes."""
        if not even or not chunks:
            return self.each([f" {c}" for c in chunks])
        text = " " + " ".join(chunks)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int64)
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        ends = np.append(np.flatnonzero(data == 32)[1:], len(data))
        bounds = np.searchsorted(np.cumsum(self.widths[ids]), ends, side="left") + 1
        return ids, np.diff(bounds, prepend=0)


def places(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of slices that begin at `begins`, one slice after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sums of consecutive runs of `values`."""
    ends = np.cumsum(sizes)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - sizes]
