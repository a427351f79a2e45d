"""SentencePiece encoding and decoding over a relational lattice.

Text gets a leading U+2581 and U+2581 for each space; a run of U+2581 with what follows is cut where two characters meet
that no piece holds side by side. No piece reaches over such a word's end, so words are encoded apart. For a word every substring of bounded length is equi-joined to the piece
table; the matches are its edges, grouped by word and folded with Spark's `aggregate`. For a unigram model the fold is
Viterbi (ties go to the longer last piece). A byte-pair model's scores are ranks, whose best sum isn't what the model
means; for it the fold merges: again and again the edge of the best score, the leftmost of these, that joins two
neighbours. Characters without a piece become byte pieces. Both folds give what the sentencepiece library gives.

The frequent words of the corpus are encoded so in Spark, and the resulting table of fixed size goes to every task. The
other words would have to be shuffled with their places in all documents; for them the same fold runs where they stand
(see the README for figures). Which words are frequent changes no result.

Defined results: null and empty texts have no ids; repeated rows give equal results; a U+2581 of the text is decoded as
a space; ties between edges go to the leftmost (merging) or to the longer last piece (Viterbi). A very long text is
encoded whole, in time that grows with its length (times its logarithm for a word without a cut); its ids are one row.
Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import heapq
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, repeat
from operator import concat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.llm.common import Store, map_rows, released, sliced, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
RUN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
UNKNOWN_PENALTY = 10.0
#: Most pieces of a table that is broadcast; a larger table is an error.
PIECES = 1 << 20
#: Bounds of the table of frequent words: words, and a word's length.
FREQUENT = 1 << 16
FREQUENT_LENGTH = 48
#: Most words and most runs that a task remembers beside these, and most different runs that it counts before it sends them. A batch of texts holds some 60,000 different runs.
CACHED_WORDS = 1 << 18
COUNTED_RUNS = 1 << 18
#: Runs that are cut together: bounds the arrays over their characters.
CUT_AT_ONCE = 1 << 13


class Pieces(NamedTuple):
    #: piece to (id, score), without control and byte pieces.
    table: dict[str, tuple[int, float]]
    #: ids of the 256 byte pieces; empty without byte fallback.
    byte_ids: list[int]
    unknown_id: int
    unknown_score: float
    longest: int
    unigram: bool
    #: Two characters that some piece holds side by side.
    pairs: frozenset[str]

    def words(self, run: str) -> list[str]:
        pairs = self.pairs
        cuts = [i for i, pair in enumerate(map(concat, run, run[1:]), 1) if pair not in pairs]
        return [run[i:j] for i, j in zip([0, *cuts], [*cuts, len(run)], strict=True)] if cuts else [run]


def is_unigram(model: str) -> bool:
    """Field 3 (model_type) of field 2 (trainer_spec) of the file, 1 or absent for a unigram model."""
    data = open(model, "rb").read()

    def varint(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n, shift, at = n | (data[at] & 127) << shift, shift + 7, at + 1
            if data[at - 1] < 128:
                return n, at

    def field(wanted: int, at: int, end: int) -> tuple[int, int] | None:
        while at < end:
            key, at = varint(at)
            first, after = varint(at) if key & 7 in (0, 2) else (0, at + (8 if key & 7 == 1 else 4))
            last = after + first if key & 7 == 2 else after
            if key >> 3 == wanted:
                return (at if key & 7 == 0 else after), last
            at = last
        return None

    spec = field(2, 0, len(data))
    kind = spec and field(3, *spec)
    return not kind or data[kind[0]] == 1


def load(model: str = MODEL) -> Pieces:
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = range(sp.get_piece_size())
    table = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    if len(table) > PIECES:
        raise ValueError(f"{len(table)} pieces; at most {PIECES} are broadcast")
    if any(SPACE in p.lstrip(SPACE) for p in table):
        raise ValueError("a piece reaches over a word's end")
    named = {sp.id_to_piece(i): i for i in ids if sp.is_byte(i)}
    return Pieces(table, [named[f"<0x{b:02X}>"] for b in range(256)] if named else [], sp.unk_id(), min(s for _, s in table.values()) - UNKNOWN_PENALTY, max(map(len, table)), is_unigram(model), frozenset(p[i : i + 2] for p in table for i in range(len(p) - 1)))


def runs_of(text: str | None) -> list[str]:
    """Each run without its first U+2581, which every run has."""
    if not text:
        return []
    words = text.split(" ")
    if "" not in words and SPACE not in text:
        return words
    return [run[1:] for run in RUN.findall(SPACE + text.replace(" ", SPACE))]


# ---- the lattice in Spark


def edges(words: DataFrame, pieces: DataFrame, longest: int, unknown_score: float) -> DataFrame:
    """(word, start, end, id, score): id is -1 for a character without a piece. Takes words (word) and pieces (piece, id, score)."""
    size = F.length("word")
    spans = words.select("word", F.explode(F.sequence(F.lit(1), size)).alias("start")).select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("start") + 1))).alias("size"))
    named = spans.withColumn("piece", F.substr("word", "start", "size"))
    joined = named.join(F.broadcast(pieces), "piece", "left").filter("id is not null or size = 1")
    return joined.select("word", "start", (F.col("start") + F.col("size")).alias("end"), F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(unknown_score)).alias("score"))


def best_edges(found: Column) -> Column:
    """array<struct<score, start, id>>: for each place from 1 on the best edge into it. Takes edges sorted by (end, start)."""
    node = lambda score, start, ident: F.struct(score.alias("score"), start.alias("start"), ident.alias("id"))
    origin = node(F.lit(0.0), F.lit(0), F.lit(-1))
    # Every place has an edge into it, so ends come one after the other: `nodes` holds the places that are done, `open` the best edge into the next.
    begun = F.struct(F.array().cast("array<struct<score:double,start:int,id:int>>").alias("nodes"), origin.alias("open"), F.lit(1).alias("end"))

    def step(s, e):
        same = s["end"] == e["end"]
        nodes = F.when(same, s["nodes"]).otherwise(F.concat(s["nodes"], F.array(s["open"])))
        new = node(F.element_at(F.when(same, s["nodes"]).otherwise(F.concat(s["nodes"], F.array(s["open"]))), e["start"])["score"] + e["score"], e["start"], e["id"])
        best = F.when(same & (s["open"]["score"] >= new["score"]), s["open"]).otherwise(new)
        return F.struct(nodes.alias("nodes"), best.alias("open"), e["end"].alias("end"))

    return F.aggregate(found, begun, step, lambda s: F.concat(s["nodes"], F.array(s["open"])))


def best_path(nodes: Column, length: Column) -> Column:
    """array<struct<start, id>>: the edges that lead back from the last place, in reading order. `nodes` must be a column, as each step looks into it."""
    back = F.struct((length + 1).alias("at"), F.array().cast("array<struct<start:int,id:int>>").alias("path"))

    def walk(s, i):
        n = F.element_at(nodes, i)
        here = F.struct(n["start"].alias("at"), F.concat(F.array(F.struct(n["start"].alias("start"), n["id"].alias("id"))), s["path"]).alias("path"))
        return F.when(s["at"] == i, here).otherwise(s)

    return F.aggregate(F.sequence(length + 1, F.lit(2), F.lit(-1)), back, walk, lambda s: s["path"])


def _place(start: Column, end: Column) -> Column:
    """One number for an edge's ends."""
    return start.cast("long") * 10_000_000 + end


def merged(costs: Column, length: Column) -> Column:
    """array<int>: the places where the pieces that byte-pair merging leaves begin, and the end. `costs` must be a column: a map from the ends of each edge of two characters or more to its negative score.

    A step looks at the places two apart, takes the cheapest edge between such, the leftmost of these, and drops the place in its middle; n characters need at most n - 1 steps.
    """
    begun = F.struct(F.sequence(F.lit(1), length + 1).alias("cuts"), F.lit(True).alias("go"))

    def step(s, _):
        cuts = s["cuts"]
        pairs = F.transform(F.slice(cuts, 1, F.greatest(F.size(cuts) - 2, F.lit(0))), lambda c, i: F.struct(F.try_element_at(costs, _place(c, F.element_at(cuts, i + 3))).alias("cost"), (i + 2).alias("middle")))
        # One element, so that the best edge is looked for once.
        best = F.array(F.array_min(F.filter(pairs, lambda p: p["cost"].isNotNull())))
        change = F.transform(best, lambda b: F.struct(F.filter(cuts, lambda c, i: b.isNull() | (i + 1 != b["middle"])).alias("cuts"), b.isNotNull().alias("go")))
        return F.when(s["go"], F.element_at(change, 1)).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), length), begun, step, lambda s: s["cuts"])


def cut_path(ids: Column, cuts: Column) -> Column:
    """array<struct<start, id>> of the edges between neighbouring places of `cuts`. `ids` is a map from an edge's ends to its id."""
    return F.transform(F.slice(cuts, 1, F.size(cuts) - 1), lambda c, i: F.struct(c.alias("start"), F.try_element_at(ids, _place(c, F.element_at(cuts, i + 2))).alias("id")))


def _char_ids(char: Column, pieces: Pieces) -> Column:
    if not pieces.byte_ids:
        return F.array(F.lit(pieces.unknown_id))
    code = F.hex(F.encode(char, "UTF-8"))
    value = lambda i: F.conv(F.substr(code, i * 2 - 1, F.lit(2)), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(1), (F.length(code) / 2).cast("int")), lambda i: F.element_at(F.array(*[F.lit(x) for x in pieces.byte_ids]), value(i) + 1))


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of each distinct word. Words are dealt out over all cores: their lattices are far larger than they."""
    spark = words.sparkSession
    table = spark.createDataFrame([(p, i, s) for p, (i, s) in pieces.table.items()], "piece string, id int, score double")
    found = edges(words.distinct().repartition(4 * spark.sparkContext.defaultParallelism, "word"), table, pieces.longest, pieces.unknown_score)
    grouped = found.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("end", "start", "id", "score"))).alias("found"))
    if pieces.unigram:
        path = grouped.withColumn("nodes", best_edges(F.col("found"))).select("word", best_path(F.col("nodes"), F.length("word")).alias("path"))
    else:
        keyed = lambda edges, value: F.map_from_entries(F.transform(edges, lambda e: F.struct(_place(e["start"], e["end"]), value(e))))
        long_edges = F.filter("found", lambda e: (e["id"] >= 0) & (e["end"] > e["start"] + 1))
        tables = grouped.select("word", keyed(long_edges, lambda e: -e["score"]).alias("costs"), keyed(F.col("found"), lambda e: e["id"]).alias("ids"))
        path = tables.withColumn("cuts", merged(F.col("costs"), F.length("word"))).select("word", cut_path(F.col("ids"), F.col("cuts")).alias("path"))
    ids = F.flatten(F.transform("path", lambda p: F.when(p["id"] >= 0, F.array(p["id"])).otherwise(_char_ids(F.substr("word", p["start"], F.lit(1)), pieces))))
    return path.select("word", ids.alias("ids"))


# ---- the lattice of one word where it stands


class Cuts:
    """Pieces.words of many runs at once."""

    def __init__(self, pieces: Pieces) -> None:
        chars = {c: i for i, c in enumerate(dict.fromkeys(c for pair in pieces.pairs for c in pair))}
        self.size = len(chars) + 1
        #: The last number stands for characters that no piece holds beside another.
        self.number = np.full(0x110000, len(chars), np.int32)
        for c, i in chars.items():
            self.number[ord(c)] = i
        self.pairs = np.array(sorted(chars[a] * self.size + chars[b] for a, b in pieces.pairs) + [self.size**2], np.int64)

    def __call__(self, runs: list[str]) -> tuple[list[str], np.ndarray]:
        """All words, and how many each run has. Takes runs without their first U+2581."""
        parts = [self._cut(runs[i : i + CUT_AT_ONCE]) for i in range(0, len(runs), CUT_AT_ONCE)]
        return list(chain.from_iterable(words for words, _ in parts)), np.concatenate([np.zeros(0, np.int64), *(counts for _, counts in parts)])

    def _cut(self, runs: list[str]) -> tuple[list[str], np.ndarray]:
        text = SPACE + SPACE.join(runs)
        number = self.number[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        key = number[:-1] * self.size + number[1:]
        begins = np.append(True, self.pairs[np.searchsorted(self.pairs, key)] != key)
        sizes = np.fromiter(map(len, runs), np.int64, len(runs)) + 1
        heads = np.cumsum(sizes) - sizes
        begins[heads] = True
        at = [*np.flatnonzero(begins).tolist(), len(text)]
        return [text[i:j] for i, j in zip(at, at[1:])], np.add.reduceat(begins.astype(np.int64), heads)  # noqa: B905


class Merges:
    """The merging fold for many words of one length at once: a row of symbols for each, and a row of the costs of joining neighbours.

    Symbols are the pieces and the characters that pieces consist of; a pair of symbols that make up a piece is a number in a sorted table.
    """

    def __init__(self, pieces: Pieces) -> None:
        strings = dict.fromkeys([*pieces.table, *(c for p in pieces.table for c in p)])
        number = {p: i for i, p in enumerate(strings)}
        self.size = len(number) + 1
        #: -1 for a character without a piece. The last symbol stands for characters that no piece holds.
        self.ids = np.array([pieces.table[p][0] if p in pieces.table else -1 for p in strings] + [-1], np.int32)
        self.symbol = np.full(0x110000, len(number), np.int32)
        for p, i in number.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        pairs = sorted((number[p[:i]] * self.size + number[p[i:]], -score, number[p]) for p, (_, score) in pieces.table.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        # A last pair that none equals.
        self.pairs = np.array([k for k, _, _ in pairs] + [self.size**2], np.int64)
        self.costs = np.array([c for _, c, _ in pairs] + [np.inf], np.float64)
        self.whole = np.array([w for _, _, w in pairs] + [0], np.int32)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cost of joining, infinite where no piece comes of it, and the piece."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.costs[at], np.inf), self.whole[at]

    def __call__(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words of at most FREQUENT_LENGTH characters, with the bytes of their ids; those in which a character has no piece are left out."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            if len(w) <= FREQUENT_LENGTH:
                by_size.setdefault(len(w), []).append(w)
        for n, some in by_size.items():
            of = np.arange(len(some))
            row = self.symbol[np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)].reshape(-1, n)
            cost, whole = self._pair(row[:, :-1], row[:, 1:])
            while len(of):
                lines = np.arange(len(of))
                least = cost.argmin(1) if cost.shape[1] else np.zeros(len(of), np.int64)
                going = np.isfinite(cost[lines, least]) if cost.shape[1] else np.zeros(len(of), bool)
                ids = self.ids[row[~going]]
                good, data, step = (ids >= 0).all(1).tolist(), ids.tobytes(), 4 * ids.shape[1]
                yield from ((some[i], data[k * step : (k + 1) * step]) for k, i in enumerate(of[~going].tolist()) if good[k])
                of, row, cost, whole, least = of[going], row[going], cost[going], whole[going], least[going]
                if not len(of):
                    break
                lines = np.arange(len(of))
                row[lines, least] = whole[lines, least]
                wide = np.arange(row.shape[1] - 1)
                row = row[lines[:, None], wide + (wide > least[:, None])]
                wide = wide[:-1]
                past = wide + (wide >= least[:, None])
                cost, whole = cost[lines[:, None], past], whole[lines[:, None], past]
                for at in (least - 1, least):
                    some_lines = np.flatnonzero((at >= 0) & (at < cost.shape[1]))
                    there = at[some_lines]
                    cost[some_lines, there], whole[some_lines, there] = self._pair(row[some_lines, there], row[some_lines, there + 1])


class Encoder:
    """Ids are kept as the bytes of 32-bit numbers, which are joined without making numbers of them.

    Words and runs (without their first U+2581) are kept in plain dictionaries, which sets are compared with at once: one of
    those met lately and one of those met before, which goes when the first is full. Frequent words never go.
    """

    def __init__(self, pieces: Pieces, known: dict[str, tuple[int, ...]]) -> None:
        self.pieces = pieces
        self.decoder = Decoder(pieces)
        #: Words and runs that their ids don't decode to.
        self.lost, self.broken = {w for w, ids in known.items() if not self._decodes(w, ids)}, set()
        self.known = {w: array("i", ids).tobytes() for w, ids in known.items()}
        self.ids, self.older_ids = dict(self.known), {}
        self.runs, self.older_runs = {}, {}
        #: Words and runs of the texts at hand that are too long to be kept.
        self.long: list[str] = []
        self.long_runs: list[str] = []
        self.costs = {p: -score for p, (_, score) in pieces.table.items() if len(p) > 1}
        self.merges, self.cuts = None if pieces.unigram else Merges(pieces), Cuts(pieces)
        self.begins = {p[:i] for p in pieces.table for i in range(1, len(p) + 1)} if pieces.unigram else set()

    def _decodes(self, word: str, ids: tuple[int, ...]) -> bool:
        return self.decoder.joined(ids) == word.encode("utf-8", "surrogatepass")

    def _prepare(self, runs: set[str]) -> None:
        """Puts all of the runs into `runs`: those that aren't known are cut together, and their new words merged together."""
        missing = runs.difference(self.runs)
        new = list(missing.difference(self.older_runs))
        missing.difference_update(new)
        self.runs.update(zip(missing, map(self.older_runs.__getitem__, missing)))  # noqa: B905
        self.long_runs = [r for r in new if len(r) >= FREQUENT_LENGTH]
        words, counts = self.cuts(new)
        self._prepare_words(set(words))
        data = list(map(self.ids.__getitem__, words))
        if len(words) == len(new):
            self.runs.update(zip(new, data))  # noqa: B905
        else:
            ends = np.cumsum(counts)
            self.runs.update((r, data[i] if i + 1 == j else b"".join(data[i:j])) for r, i, j in zip(new, (ends - counts).tolist(), ends.tolist()))  # noqa: B905
        # Parts of a word decode to themselves or to nothing, so a run comes back if each of its words does.
        if self.lost:
            of = np.repeat(np.arange(len(new)), counts)
            self.broken.update(new[of[k]] for k, w in enumerate(words) if w in self.lost)

    def _prepare_words(self, words: set[str]) -> None:
        missing = words.difference(self.ids)
        new = list(missing.difference(self.older_ids))
        missing.difference_update(new)
        self.ids.update(zip(missing, map(self.older_ids.__getitem__, missing)))  # noqa: B905
        if self.merges is not None:
            # The bytes of words whose parts are all pieces, which decode to them.
            self.ids.update(self.merges(new))
        for w in new:
            if w not in self.ids:
                self.ids[w] = self._word(w)
        self.long = [w for w in new if len(w) > FREQUENT_LENGTH]

    def _word(self, word: str) -> bytes:
        ids = self.word(word)
        if not self._decodes(word, ids):
            self.lost.add(word)
        return array("i", ids).tobytes()

    def _forget(self) -> None:
        """Bounds what is kept after a batch of texts; long runs and words stay for their own batch only."""
        for r in self.long_runs:
            del self.runs[r]
        for w in self.long:
            del self.ids[w]
        if len(self.runs) > CACHED_WORDS // 2:
            self.runs, self.older_runs = {}, self.runs
        if len(self.ids) > len(self.known) + CACHED_WORDS // 2:
            self.ids, self.older_ids = dict(self.known), self.ids

    def exact(self, text: str | None) -> bool:
        """Whether the ids decode to the text, once it is encoded: its runs make it up, so it comes back if each of them does."""
        return not self.broken or self.broken.isdisjoint(runs_of(text))

    def word(self, word: str) -> tuple[int, ...]:
        parts = self._viterbi(word) if self.pieces.unigram else self._merge(word) if len(word) <= FREQUENT_LENGTH else self._merge_long(word)
        table, out = self.pieces.table, []
        for part in parts:
            if part in table:
                out.append(table[part][0])
            elif self.pieces.byte_ids:
                out.extend(self.pieces.byte_ids[b] for b in part.encode("utf-8", "surrogatepass"))
            else:
                out.append(self.pieces.unknown_id)
        return tuple(out)

    def _viterbi(self, word: str) -> list[str]:
        table, begins, n = self.pieces.table, self.begins, len(word)
        score, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        for start in range(n):
            at, single = score[start], False
            for end in range(start + 1, min(n, start + self.pieces.longest) + 1):
                part = word[start:end]
                if part not in begins:
                    break
                hit = table.get(part)
                if hit is not None:
                    single |= end == start + 1
                    if at + hit[1] > score[end]:
                        score[end], back[end] = at + hit[1], start
            if not single and at + self.pieces.unknown_score > score[start + 1]:
                score[start + 1], back[start + 1] = at + self.pieces.unknown_score, start
        out, at = [], n
        while at:
            out.append(word[back[at] : at])
            at = back[at]
        return out[::-1]

    def _merge(self, word: str) -> list[str]:
        costs, none = self.costs, float("inf")
        parts = list(word)
        joins = list(map(costs.get, map(concat, word, word[1:]), repeat(none)))
        while joins and (least := min(joins)) < none:
            i = joins.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joins[i]
            if i:
                joins[i - 1] = costs.get(parts[i - 1] + parts[i], none)
            if i < len(joins):
                joins[i] = costs.get(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, word: str) -> list[str]:
        """The same with a heap over linked neighbours, for words of any length."""
        costs, n = self.costs, len(word)
        parts: list[str | None] = list(word)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (cost := costs.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (cost, i, j, parts[i] + parts[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j], right[i] = whole, None, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def packed_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        split = list(map(runs_of, texts))
        self._prepare(set(chain.from_iterable(split)))
        out = [b"".join(map(self.runs.__getitem__, r)) for r in split]
        self._forget()
        return out

    def packed(self, text: str | None) -> bytes:
        return self.packed_all([text])[0]

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()


class Decoder:
    def __init__(self, pieces: Pieces) -> None:
        self.parts = {i: p.encode() for p, (i, _) in pieces.table.items()} | {i: bytes([b]) for b, i in enumerate(pieces.byte_ids)}

    def joined(self, ids) -> bytes:
        return b"".join([self.parts.get(i, b"") for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Without the leading space; ids of no piece are left out, broken UTF-8 becomes U+FFFD."""
        text = self.joined(ids).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


# ---- documents


def word_counts(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, n) over all documents; words that the table of frequent words can't hold are left out. A task sends each of its words about once."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        def rows():
            words: Counter[str] = Counter()
            found, counts = cuts(list(seen))
            for w, n in zip(found, np.repeat(np.fromiter(seen.values(), np.int64, len(seen)), counts).tolist(), strict=True):
                words[w] += n
            for w in [w for w in words if len(w) > FREQUENT_LENGTH]:
                del words[w]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], schema=schema)

        seen: Counter[str] = Counter()
        cuts = Cuts(pieces)
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                seen.update(runs_of(text))
            if len(seen) >= COUNTED_RUNS:
                yield rows()
        if seen:
            yield rows()

    return small_batches(docs.select("text")).mapInArrow(released(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, pieces: Pieces, store: Store) -> DataFrame:
    """(word): the most frequent words of all documents, FREQUENT at most, equally frequent ones all or none."""
    counts = store.table(word_counts(docs, pieces))
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("level").desc())
    total, least = 0, None
    for row in levels.collect():
        total += row["words"]
        if total > FREQUENT:
            break
        least = row["level"]
    return counts.filter(F.lit(False) if least is None else level >= least).select("word")


def frequent_table(docs: DataFrame, pieces: Pieces) -> dict[str, tuple[int, ...]]:
    store = Store(docs.sparkSession)
    found = {r["word"]: tuple(r["ids"]) for r in encode_words(frequent_words(docs, pieces, store), pieces).collect()}
    store.drop()
    return found


_OWN: dict[str, Encoder] = {}


def _own(key: str, made: Callable[[], Encoder]) -> Encoder:
    """The worker's encoder for this call of `encode`, which stays for its next task; that of another call goes."""
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = made()
    return _OWN[key]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip: whether decoding the ids gives the text back (U+2581 as a space)."""
    pieces = load(model)
    shared = docs.sparkSession.sparkContext.broadcast((pieces, frequent_table(docs, pieces)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    key = str(uuid.uuid4())

    def run(batches):
        for batch in sliced(batches):
            encoder = _own(key, lambda: Encoder(*shared.value))
            texts = batch.column(1).to_pylist()
            parts = encoder.packed_all(texts)
            exact = list(map(encoder.exact, texts))
            sizes = np.array([len(p) // 4 for p in parts], dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes), ids, pa.array(exact)], schema=schema)

    return small_batches(docs.select("doc_id", "text")).mapInArrow(released(run), "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of (doc_id, ids)."""
    pieces = load(model)
    shared: SparkSession = encoded.sparkSession
    parts = shared.sparkContext.broadcast(pieces)

    def rows(batch):
        decoder = Decoder(parts.value)
        for row in batch:
            yield row["doc_id"], decoder.decode(row["ids"] or [])

    return map_rows(encoded.select("doc_id", "ids"), rows, "doc_id long, text string")
