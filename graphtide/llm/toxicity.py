"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Features are all words and word beginnings of the examples, none left out; their IDF comes from all documents. A feature
more frequent in toxic examples weighs more, by an odds ratio, so the weight means the same for few labels and for many
and at any share of toxic ones; none weighs less than its IDF. Examples are a bounded sample of labelled rows. A query's
neighbours are found exactly: features that many examples hold are multiplied out for a batch of queries at once, the
others are bounded by block, and only blocks of examples whose bound can still enter the top K are opened. Votes are
weighted by similarity; held-in examples, each voted on without itself, calibrate them.

Defined results: null and empty texts, and texts that share no word with any example, have no neighbour and get the
calibrated score of "no evidence"; ties among neighbours go to the example of the smaller place in the index; without
two classes of labels every score is the share of toxic labels (0 without labels). Repeated rows give equal results.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtide.llm.common import cut_lineage, fold, map_rows, released, sliced, small_batches

HELD_OUT = (5, 0)
#: Bound of the sample of labelled rows, half of it toxic if there are as many.
EXAMPLES = 8192
#: A feature's log odds of toxic against other examples count from this many standard errors above 0.
ERRORS = 2.0
PREFIX = 5
NEIGHBOURS = 15
#: Examples of a block, and blocks opened first.
BLOCK = 512
OPENED = 2
#: Features that a larger share of the examples holds are multiplied out.
DENSE = 1 / 8
#: Weights are whole multiples of this, so that sums of their products are exact in double precision, in any order.
UNIT = 2.0**-22
#: An example weighs similarity ** POWER.
POWER = 2
#: Distinct words that a worker counts before it adds them up by feature.
COUNTED_WORDS = 1 << 16
WORD = re.compile(r"[^\W\d_]+")
Vector = tuple[np.ndarray, np.ndarray]


class Words:
    """From a text to its vector: a word's own feature and that of its beginning, of those that the vocabulary has."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary = vocabulary
        #: For the feature of a word that of its beginning, itself where there is none.
        self.beginning = np.fromiter((vocabulary.get(w[:PREFIX] + "*", i) if len(w) > PREFIX and w[PREFIX] != "*" else i for w, i in vocabulary.items()), np.int32, len(vocabulary))

    def vector(self, text: str | None, idf: np.ndarray) -> Vector:
        """Feature numbers, ascending, and weights of unit length, in whole UNITs; empty if no feature occurs."""
        if not text:
            return np.zeros(0, np.int32), np.zeros(0)
        counts = Counter(WORD.findall(text.lower()))
        known, found = self.vocabulary, list(map(self.vocabulary.get, counts))
        times = np.fromiter(counts.values(), np.float64, len(counts))
        own = np.fromiter((-1 if f is None else f for f in found), np.int32, len(found))
        new = [(known.get(w[:PREFIX] + "*", -1), n) for (w, n), f in zip(counts.items(), found, strict=True) if f is None and len(w) > PREFIX]
        held = own >= 0
        own, times = own[held], times[held]
        begun = self.beginning[own]
        longer = begun != own
        fs = np.concatenate([own, begun[longer], np.array([f for f, _ in new], np.int32)])
        times = np.concatenate([times, times[longer], np.array([n for _, n in new], np.float64)])
        fs, of = np.unique(fs, return_inverse=True)
        totals = np.bincount(of, times, len(fs))
        if len(fs) and fs[0] < 0:
            fs, totals = fs[1:], totals[1:]
        weights = (1 + np.log(totals)) * idf[fs]
        norm = math.sqrt(weights @ weights)
        return (fs, np.round(weights / norm / UNIT) * UNIT) if norm else (fs[:0], weights[:0])


def features(words: set[str]) -> set[str]:
    """The words, and the first PREFIX letters of longer ones marked with '*'."""
    return words | {w[:PREFIX] + "*" for w in words if len(w) > PREFIX}


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + sizes[i] - 1 of all i in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def clustered(x: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the rows of `x` in which similar ones are near each other: halves along the direction of the greatest spread, until a part is no larger than `leaf`."""
    done, parts = [], [np.arange(len(x))]
    while parts:
        part = parts.pop()
        if len(part) <= leaf:
            done.append(part)
            continue
        centred = x[part] - x[part].mean(0)
        direction = centred[np.argmax((centred**2).sum(1))]
        for _ in range(8):
            direction = centred.T @ (centred @ direction)
            direction /= np.linalg.norm(direction) + 1e-30
        order = part[np.argsort(centred @ direction, kind="stable")]
        middle = leaf * (-(-len(part) // leaf) // 2)
        parts += [order[middle:], order[:middle]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


class Index:
    """Unit vectors of the examples as an inverted index: for each feature the examples with their weights, and for each block of examples the greatest weight.

    Similar examples are put into one block, so that the maxima of a block bound its members closely. `sizes`, `feature`
    and `weight` are the vectors, one after the other, features ascending; an example's place is its number there.
    """

    def __init__(self, vocabulary: dict[str, int], idf: np.ndarray, ids: list[int], labels: np.ndarray, sizes: np.ndarray, feature: np.ndarray, weight: np.ndarray) -> None:
        self.vocabulary, self.idf, self.ids, self.labels = vocabulary, idf, ids, labels
        self.sizes, self.feature, self.weight = np.asarray(sizes, np.int64), np.asarray(feature, np.int32), np.asarray(weight, np.float32)
        self.words = Words(vocabulary)

    def _lay_out(self) -> None:
        """Dense rows of the frequent features; of the others the postings by feature and block, and the runs of one feature and block with their maxima."""
        n, vocabulary = len(self.sizes), len(self.vocabulary)
        self.n_blocks = max(1, -(-n // BLOCK))
        example = np.repeat(np.arange(n, dtype=np.int32), self.sizes)
        frequent = np.bincount(self.feature, minlength=vocabulary) > n * DENSE
        self.row = np.where(frequent, np.cumsum(frequent) - 1, -1).astype(np.int32)
        dense = np.zeros((n, int(frequent.sum())), dtype=np.float32)
        held = frequent[self.feature]
        dense[example[held], self.row[self.feature[held]]] = self.weight[held]
        #: The example at each position of the blocks.
        self.at = clustered(dense, BLOCK).astype(np.int32)
        position = np.empty(n, np.int32)
        position[self.at] = np.arange(n, dtype=np.int32)
        self.dense = np.zeros((dense.shape[1], self.n_blocks * BLOCK))
        self.dense[:, :n] = dense[self.at].T
        del dense
        rest = np.flatnonzero(~held)
        example, feature = position[example[rest]], self.feature[rest]
        order = np.argsort(feature.astype(np.int64) * (self.n_blocks * BLOCK) + example)
        example, feature, weight = example[order], feature[order], self.weight[rest[order]]
        #: An example and its weight in one number, which moves as one.
        self.postings = np.stack([example, weight.view(np.int32)], axis=1).view(np.int64).ravel()
        #: A list, as single numbers are taken from it.
        self.posted_from = np.concatenate([[0], np.cumsum(np.bincount(feature, minlength=vocabulary))]).tolist()
        run = feature.astype(np.int64) * self.n_blocks + example // BLOCK
        self.run_start = np.flatnonzero(np.diff(run, prepend=-1))
        self.run_size = np.diff(self.run_start, append=len(run))
        self.run_block = (run[self.run_start] % self.n_blocks).astype(np.int32)
        self.run_most = np.maximum.reduceat(weight, self.run_start) if len(run) else np.zeros(0, np.float32)
        self.runs = np.bincount(run[self.run_start] // self.n_blocks, minlength=vocabulary)
        self.first_run = np.cumsum(self.runs) - self.runs

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("vocabulary", "idf", "ids", "labels", "sizes", "feature", "weight")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, words=Words(state["vocabulary"]))

    def vector(self, text: str | None) -> Vector:
        return self.words.vector(text, self.idf)

    def nearest(self, vector: Vector, k: int = NEIGHBOURS, without: int = -1) -> list[tuple[float, int]]:
        """The k most similar examples with a similarity over 0, as (similarity, place), by falling similarity, then place."""
        return self.nearest_of([vector], k, [without])[0]

    def nearest_of(self, vectors: list[Vector], k: int = NEIGHBOURS, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """nearest() of each vector. The blocks are laid out where this is first called, so the driver never holds them."""
        if not hasattr(self, "first_run"):
            self._lay_out()
        queries = np.zeros((len(vectors), len(self.dense)))
        for q, (fs, ws) in zip(queries, vectors, strict=True):
            rows = self.row[fs]
            q[rows[rows >= 0]] = ws[rows >= 0]
        partial = queries @ self.dense
        return [self._nearest(fs, ws, scores, k, left_out) for (fs, ws), scores, left_out in zip(vectors, partial, without or [-1] * len(vectors), strict=True)]

    def _nearest(self, fs: np.ndarray, ws: np.ndarray, scores: np.ndarray, k: int, without: int) -> list[tuple[float, int]]:
        """From what the frequent features add to the similarities, which are completed in place."""
        if not len(fs) or not len(self.sizes):
            return []
        runs, weight = _spans(self.first_run[fs], self.runs[fs]), np.repeat(ws, self.runs[fs])
        block = self.run_block[runs]
        bounds = scores.reshape(self.n_blocks, BLOCK).max(axis=1) + np.bincount(block, weight * self.run_most[runs], self.n_blocks)
        begun, full = scores.copy(), np.zeros(self.n_blocks, dtype=bool)
        full[np.argsort(-bounds, kind="stable")[:OPENED]] = True
        self._open(scores, runs, weight, full[block])
        least = self._kth(scores, full, k, without)
        rest = ~full & (bounds >= least)
        if 2 * rest.sum() > self.n_blocks:
            # Most blocks: whole postings, whose copying is cheaper than picking runs.
            scores[:] = begun
            self._open_all(scores, fs, ws)
            full[:] = True
        elif rest.any():
            self._open(scores, runs, weight, rest[block])
            full |= rest
        least = self._kth(scores, full, k, without)
        found = np.flatnonzero((scores[: len(self.at)] >= least) & (scores[: len(self.at)] > 0))
        found = found[full[found // BLOCK]]
        places, found = self.at[found], scores[found]
        order = np.lexsort((places, -found))[: k + 1]
        return [(float(found[i]), int(places[i])) for i in order if places[i] != without][:k]

    def _open(self, scores: np.ndarray, runs: np.ndarray, weight: np.ndarray, wanted: np.ndarray) -> None:
        runs = runs[wanted]
        sizes = self.run_size[runs]
        self._add(scores, self.postings[_spans(self.run_start[runs], sizes)], np.repeat(weight[wanted], sizes))

    def _open_all(self, scores: np.ndarray, fs: np.ndarray, ws: np.ndarray) -> None:
        starts, postings = self.posted_from, self.postings
        parts = [postings[starts[f] : starts[f + 1]] for f in fs.tolist()]
        self._add(scores, np.concatenate(parts), np.repeat(ws, [len(p) for p in parts]))

    def _add(self, scores: np.ndarray, postings: np.ndarray, weight: np.ndarray) -> None:
        scores += np.bincount(postings.view(np.int32)[::2], weight * postings.view(np.float32)[1::2], len(scores))

    def _kth(self, scores: np.ndarray, full: np.ndarray, k: int, without: int) -> float:
        """The k-th greatest similarity in the opened blocks, which bounds the final one from below; 0 if there are fewer over 0. One more is asked for if one is left out."""
        k += without >= 0
        found = scores.reshape(self.n_blocks, BLOCK)[full].ravel()
        return max(0.0, float(np.partition(found, len(found) - k)[-k])) if len(found) > k else 0.0

    def vote(self, found: list[tuple[float, int]]) -> float | None:
        if not found:
            return None
        weights = np.array([s**POWER for s, _ in found])
        return float(weights @ self.labels[[d for _, d in found]] / weights.sum())


class Calibration:
    """Isotonic steps from votes to the share of toxic examples, each example weighted back to its class's true number."""

    def __init__(self, votes: list[float | None], labels: np.ndarray, weights: np.ndarray) -> None:
        none = [i for i, v in enumerate(votes) if v is None]
        prior = float(weights @ labels / weights.sum()) if len(labels) else 0.0
        self.none = float((weights[none] @ labels[none] + prior) / (weights[none].sum() + 1)) if none else prior
        by_vote: dict[float, list[float]] = {}
        for v, w, y in zip(votes, weights, labels, strict=True):
            if v is not None:
                pair = by_vote.setdefault(round(v, 9), [0.0, 0.0])
                pair[0] += w
                pair[1] += w * y
        pools: list[list[float]] = []
        for v in sorted(by_vote):
            pools.append([v, *by_vote[v]])
            while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
                _, w, hits = pools.pop()
                pools[-1][1:] = [pools[-1][1] + w, pools[-1][2] + hits]
        self.steps = [(first, (hits + prior) / (w + 1)) for first, w, hits in pools]

    def score(self, vote: float | None) -> float:
        if vote is None or not self.steps:
            return self.none
        out = self.steps[0][1]
        for first, value in self.steps:
            if vote < first - 1e-8:
                break
            out = value
        return min(1.0, max(0.0, out))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """id and toxic of the rows to learn from; of contradicting labels of one id the greater."""
    rows = labels.filter(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1]))
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Broadcast, Calibration] | float:
    """The index, sent to the workers, and its calibration; the share of toxic labels where the labels hold fewer than two classes."""
    spark = docs.sparkSession
    known = _labelled(docs, labels)
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return float(next(iter(totals), 0))
    half = EXAMPLES // 2
    take = {1: min(totals[1], max(half, EXAMPLES - totals[0])), 0: min(totals[0], max(half, EXAMPLES - totals[1]))}
    place = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity"))
    picked = [r for c in (0, 1) for r in known.filter(F.col("toxic") == c).orderBy(place, "doc_id").limit(take[c]).collect()]
    chosen = spark.createDataFrame([(r["doc_id"], int(r["toxic"])) for r in picked], "doc_id long, toxic int")
    # At most EXAMPLES rows, so broadcast. One text for each id: of repeated rows the smallest.
    rows = cut_lineage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    found = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    def count(batch):
        seen: Counter = Counter()
        for row in batch:
            seen.update((f, row["toxic"]) for f in features(set(WORD.findall((row["text"] or "").lower()))))
        for (f, toxic), n in seen.items():
            yield f, toxic, n

    tally = map_rows(rows, count, "feature string, toxic int, n long").groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")).toArrow().sort_by("feature")
    vocabulary = {f: i for i, f in enumerate(tally["feature"].to_pylist())}
    shared = spark.sparkContext.broadcast(vocabulary)
    idf = _idf(docs, shared, len(vocabulary)) * strength(tally["a"].to_numpy(), found.get(1, 0), tally["b"].to_numpy(), found.get(0, 0))

    def vectors(batch):
        words = Words(shared.value)
        for row in batch:
            fs, ws = words.vector(row["text"], idf)
            yield row["doc_id"], row["toxic"], fs.tolist(), ws.tolist()

    got = map_rows(rows, vectors, "doc_id long, toxic int, f array<int>, w array<float>").toArrow().sort_by("doc_id").combine_chunks()
    shared.destroy()
    labels_of, ids = got["toxic"].to_numpy().astype(float), got["doc_id"].to_pylist()
    f, w = (pa.chunked_array([c.flatten() for c in got[name].chunks], kind).to_numpy() for name, kind in (("f", pa.int32()), ("w", pa.float32())))
    index = spark.sparkContext.broadcast(Index(vocabulary, idf, ids, labels_of, pc.list_value_length(got["f"]).to_numpy(), f, w))
    place_of = {doc_id: i for i, doc_id in enumerate(ids)}
    del got, f, w

    def votes_of(batch):
        fitted, places = index.value, [place_of[row["doc_id"]] for row in batch]
        for place, near in zip(places, fitted.nearest_of([fitted.vector(row["text"]) for row in batch], without=places), strict=True):
            yield place, fitted.vote(near)

    votes: list[float | None] = [None] * len(ids)
    for row in map_rows(rows.select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism), votes_of, "place int, vote double").collect():
        votes[row["place"]] = row["vote"]
    weights = np.where(labels_of == 1, totals[1] / max(1.0, labels_of.sum()), totals[0] / max(1.0, (1 - labels_of).sum()))
    return index, Calibration(votes, labels_of, weights)


def strength(a: np.ndarray, n1: int, b: np.ndarray, n0: int) -> np.ndarray:
    """(1 + l)^2 of features in a of n1 toxic and b of n0 other examples: l is the lower bound of the log odds ratio, 0 at least."""
    odds = np.log((a + 0.5) / (n1 - a + 0.5) * (n0 - b + 0.5) / (b + 0.5))
    error = np.sqrt(1 / (a + 0.5) + 1 / (n1 - a + 0.5) + 1 / (b + 0.5) + 1 / (n0 - b + 0.5))
    return (1 + np.maximum(0.0, odds - ERRORS * error)) ** 2


def _idf(docs: DataFrame, vocabulary: Broadcast, size: int) -> np.ndarray:
    """log((1 + N) / (1 + df)) + 1 over all documents; a task sends a feature's count once."""
    if not size:
        return np.zeros(0)

    def count(batches):
        known, seen, n = vocabulary.value, np.zeros(size, dtype=np.int64), 0
        words: Counter[str] = Counter()
        beginnings: Counter[str] = Counter()

        def add_up() -> None:
            for counter, mark in ((words, ""), (beginnings, "*")):
                for w, times in counter.items():
                    if (f := known.get(w + mark)) is not None:
                        seen[f] += times
                counter.clear()

        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                n += 1
                found = set(WORD.findall((text or "").lower()))
                words.update(found)
                beginnings.update({w[:PREFIX] for w in found if len(w) > PREFIX})
            if len(words) > COUNTED_WORDS:
                add_up()
        add_up()
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"f": pa.array(np.concatenate([[-1], held]), pa.int32()), "n": pa.array(np.concatenate([[n], seen[held]]), pa.int64())})

    totals = small_batches(docs.select("text")).mapInArrow(released(count), "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1, dtype=np.int64)
    df[totals["f"].to_numpy()] = totals["n"].to_numpy()
    return np.log((1 + df[-1]) / (1 + df[:-1])) + 1


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, vote (null without a neighbour), evidence: the ids of the nearest examples, toxic ones marked with '!', with similarities."""
    model = fit(docs, labels)

    def rows(batch):
        if isinstance(model, float):
            yield from ((row["doc_id"], model, int(model >= 0.5), None, "") for row in batch)
            return
        index, calibration = model[0].value, model[1]
        texts = list(dict.fromkeys(row["text"] for row in batch))
        nearest = dict(zip(texts, index.nearest_of([index.vector(t) for t in texts]), strict=True))
        for row in batch:
            found = nearest[row["text"]]
            vote = index.vote(found)
            value = calibration.score(vote)
            evidence = ",".join(f"{index.ids[d]}{'!' * int(index.labels[d])}:{s:.4f}" for s, d in found[:3])
            yield row["doc_id"], value, int(value >= 0.5), vote, evidence

    scored = map_rows(docs.select("doc_id", "text"), rows, "doc_id long, score double, predicted int, vote double, evidence string")
    held = F.coalesce(fold(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "vote", "evidence")
