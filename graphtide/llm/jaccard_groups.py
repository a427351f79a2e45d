"""Exact Jaccard self-join of word-shingle sets by a token-group matrix.

1. A document's set: 64-bit hashes of its distinct k-word shingles. Documents with equal sets are one class.
2. A fixed-size table of hash bucket loads, counted over all documents, orders tokens from rare to frequent. Two sets
   that link share a token among the first few of each in this order, so only these are dealt out.
3. Groups: each class is compared with the most central class that shares its tokens; verified links make groups of
   similar classes, so that a large family of near copies costs one comparison a member.
4. The matrix: for each token the groups that hold it, and for each group the union of its members' sets as a bitmap.
5. Query and group: the overlap of a class with another group's union bounds its overlap with every member. A group is
   kept in parts of members of much the same size, each with its union. Only parts whose bound reaches the least overlap
   of a link are opened, and those members that share a dealt-out token are compared, by bitmaps and then whole sets.
6. Links of both kinds give connected components.

Nothing is capped: steps 3 to 5 find, for any two classes that link, a path of verified links.

Defined results: null and empty texts have an empty set and are linked with nothing; repeated rows are equal sets; rows
of one id are one document, which links where any of its rows does; a set that only rows with a null id have names no
component. Ties (between centres, between tokens of one load) go to the smaller id or token and change no result. A very
long text is one set, and its words are hashed at once: some 60 bytes of memory for each of its own. Other columns, of
whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtide.llm.common import Store, cut_lineage, released, sliced, small_batches
from graphtide.llm.components import components

#: log2 of the fewest and most buckets of the load table, a byte each, which goes to every task. In between there is a bucket for so many bytes of documents.
LOAD_BITS = (16, 24)
LOAD_BYTES = 32
#: Buckets that a task sends in one row.
PART = 4096
#: The same for the table that tells whose whole sets are needed, a bit each, and bits for each id. A fuller table lets more rows through and changes no result.
NEEDED_BITS = (16, 27)
NEEDED_EACH = 32
#: Members of one group are apart where their sizes differ, from this size on where they differ by one part in it.
PART_SIZES = 64
#: Tokens counted at once, and bytes of text and of unions held at once.
COUNTED = 1 << 20
BYTES_AT_ONCE = 1 << 20
UNION_BYTES = 16 << 20
U64 = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _numbers(first: int, n: int) -> np.ndarray:
    """Mixed odd numbers for first, first + 1, ..."""
    return _mix(np.arange(first, first + n, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


class Shingler:
    """Distinct shingle hashes of texts, a column at a time. Words are cut at ASCII white space after A-Z are lower-cased.

    A word's hash sums up products of a number for each byte with a number for its place in the word; a shingle's sums
    up the hashes of its words times a number for each place.
    """

    def __init__(self, k: int) -> None:
        self.k, self.factors = k, _numbers(1, k)
        self.bytes = _numbers(1 << 32, 256)
        self.bytes[65:91] = self.bytes[97:123]
        self.blank = np.zeros(256, dtype=bool)
        self.blank[[32, *range(9, 14)]] = True
        self.bytes[self.blank] = 0
        self.places = _numbers(1 << 40, 64)

    def _words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words, and for each text the number of words up to its end."""
        if not len(data):
            return np.zeros(0, dtype=U64), np.zeros(len(ends), dtype=np.int64)
        blank = self.blank[data]
        begins = ~blank
        begins[1:] &= blank[:-1]
        # A text's first byte begins a word whatever stands before it.
        firsts = np.concatenate([[0], ends[:-1]])
        firsts = firsts[firsts < len(data)]
        begins[firsts] = ~blank[firsts]
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.zeros(0, dtype=U64), np.zeros(len(ends), dtype=np.int64)
        place = np.arange(len(data)) - np.repeat(starts, np.diff(starts, append=len(data)), axis=0) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))])
        place[blank] = 0
        longest = int(place.max()) + 1
        if longest > len(self.places):
            self.places = _numbers(1 << 40, 2 * longest)
        return _mix(np.add.reduceat(self.bytes[data] * self.places[place], starts)), np.searchsorted(starts, ends)

    def tokens(self, texts: pa.Array) -> list[np.ndarray]:
        """The sorted tokens of each text. Fewer than k words make one shingle, whose hash also tells their number; null texts have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, values = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(values, dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        words, ends = self._words(data, offsets[1:] - offsets[0])
        n = max(0, len(words) - self.k + 1)
        total = words[:n] * self.factors[0]
        for i in range(1, self.k):
            total = total + words[i : i + n] * self.factors[i]
        total, out, start = _mix(total), [], 0
        for end in ends.tolist():
            if end - start >= self.k:
                out.append(np.unique(total[start : end - self.k + 1]))
            elif end > start:
                few = (words[start:end] * self.factors[: end - start]).sum(keepdims=True)
                out.append(_mix(_mix(few) + U64(end - start)))
            else:
                out.append(np.zeros(0, dtype=U64))
            start = end
        return out


def _bits(n: int, bounds: tuple[int, int]) -> int:
    return max(bounds[0], min(bounds[1], (max(1, n) - 1).bit_length()))


def load_bits(docs: DataFrame) -> int:
    """From the size that Spark expects of `docs`."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return _bits(size // LOAD_BYTES, LOAD_BITS)


def loads(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """For each of 2 ** bits buckets 8 * log2(1 + n) of the number n of (document, token) pairs that fall into it, over all documents; a task counts up to 255 of a bucket. Rows of PART buckets are added up in the cluster."""
    schema = pa.schema([("part", pa.int32()), ("total", pa.binary())])

    def count(batches):
        shingler, total = Shingler(k), np.zeros(1 << bits, dtype=np.uint8)
        waiting: list[np.ndarray] = []

        def add() -> None:
            places, n = np.unique(np.concatenate(waiting) >> U64(64 - bits), return_counts=True)
            total[places] = np.minimum(255, total[places] + n)
            waiting.clear()

        for batch in sliced(batches, BYTES_AT_ONCE):
            waiting += shingler.tokens(batch.column(0))
            if sum(map(len, waiting)) >= COUNTED:
                add()
        if waiting:
            add()
        parts = total.reshape(-1, PART)
        held = np.flatnonzero(parts.any(axis=1))
        for at in range(0, len(held), 256):
            some = held[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], schema=schema)

    def add_up(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = totals.setdefault(i, np.zeros(PART, dtype=np.int64))
                found += np.frombuffer(x.as_buffer(), dtype=np.uint8)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.int32()), pa.array([np.minimum(255, np.rint(8 * np.log2(1 + x))).astype(np.uint8).tobytes() for x in totals.values()], pa.binary())], schema=schema)

    found = small_batches(docs.select("text")).mapInArrow(released(count), "part int, total binary").repartition("part").mapInArrow(add_up, "part int, total binary").toArrow()
    out = np.zeros((1 << bits) // PART * PART, dtype=np.uint8).reshape(-1, PART)
    for i, x in zip(found["part"].to_pylist(), found["total"], strict=True):
        out[i] = np.frombuffer(x.as_buffer(), dtype=np.uint8)
    return out.ravel()


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n (set size), digest (of the set; null if it is empty), prefix (the tokens to deal out, rare ones first), bits (the set as a bitmap, 4 bits or more a token, token t at t modulo the width)."""
    width_of = load_bits(docs)
    shared, shift = docs.sparkSession.sparkContext.broadcast(loads(docs, k, width_of)), U64(64 - width_of)
    schema = "doc_id long, n long, digest string, prefix array<bigint>, bits array<bigint>"
    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("prefix", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))

    def sign(batches):
        shingler, load = Shingler(k), shared.value
        none = np.zeros(0, dtype=np.int64)
        for batch in sliced(batches, BYTES_AT_ONCE):
            n, digest, prefix, bits = [], [], [], []
            for t in shingler.tokens(batch.column(1)):
                n.append(len(t))
                if not len(t):
                    digest.append(None)
                    prefix.append(none)
                    bits.append(none)
                    continue
                digest.append(hashlib.blake2b(t.tobytes(), digest_size=16).hexdigest())
                length = len(t) - (num * len(t) + den - 1) // den + 1
                by_load = np.argsort(load[t >> shift], kind="stable")
                prefix.append(t[by_load[:length]].view(np.int64))
                width = max(256, 1 << (4 * len(t) - 1).bit_length())
                flags = np.zeros(width, dtype=np.uint8)
                flags[t & U64(width - 1)] = 1
                bits.append(np.packbits(flags, bitorder="little").view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.string()), lists(prefix), lists(bits)], schema=arrow)

    return small_batches(docs.select("doc_id", "text")).mapInArrow(released(sign), schema)


def _least_overlap(a: Column, b: Column, num: int, den: int) -> Column:
    """The least intersection size of sets of sizes a and b that link."""
    return F.ceil((a + b) * num / F.lit(float(num + den)) - 1e-9)


def missing(a: np.ndarray, b: np.ndarray) -> int:
    """How many bits of bitmap `a` bitmap `b` lacks, after folding both to the narrower width: at least so many tokens of a's set are not in b's."""
    width = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(x.reshape(-1, width), axis=0) for x in (a, b))
    # Of the absolute value for signed numbers.
    return int(np.bitwise_count((a & ~b).view(U64)).sum())


def _within(rows: DataFrame, num: int, den: int, both: bool) -> DataFrame:
    """(a, b) of the rows whose overlap, bounded by the bitmaps, can reach that of a link. Takes a, b, n_a, n_b, bits_a, bits_b. `both`: b is a set as well, and not the union of a group whose members have n_b tokens or more."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def bound(batches):
        for batch in batches:
            keep = []
            lists = []
            for name in ("bits_a", "bits_b"):
                column = batch.column(name)
                lists.append((column.offsets.to_numpy(), column.values.to_numpy()))
            (at_a, all_a), (at_b, all_b) = lists
            for i, (n_a, n_b) in enumerate(zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), strict=True)):
                least = -(-(n_a + n_b) * num // (num + den))
                x, y = all_a[at_a[i] : at_a[i + 1]], all_b[at_b[i] : at_b[i + 1]]
                keep.append(n_a - missing(x, y) >= least and (not both or n_b - missing(y, x) >= least))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], schema=out)

    return rows.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(released(bound), "a long, b long")


def _needed(ids: DataFrame, bits: int) -> np.ndarray:
    """Which of 2 ** bits buckets of xxhash64(id) hold an id: a table filled by the cluster."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    rows = ids.select(place.alias("p")).selectExpr("cast(shiftright(p, 6) as int) word", "shiftleft(1L, cast(p & 63 as int)) bit")
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, dtype=np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def whole_sets(docs: DataFrame, k: int, pairs: DataFrame) -> DataFrame:
    """(doc_id, tokens) of the documents in `pairs` (a, b), a written table, and of few others. Texts aren't moved: a task passes by the rows that the table of needed ids rules out. Rows of one id give a row each."""
    bits = _bits(NEEDED_EACH * pairs.count(), NEEDED_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(_needed(pairs.select(F.explode(F.array("a", "b")).alias("id")), bits))
    arrow = pa.schema([("doc_id", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def cut(batches):
        shingler, table = Shingler(k), shared.value
        for batch in sliced(batches, BYTES_AT_ONCE):
            place = batch.column(2).to_numpy()
            keep = (table[place >> 6] >> (place & 63)) & 1 == 1
            if keep.any():
                batch = batch.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([t.view(np.int64) for t in shingler.tokens(batch.column(1))], pa.list_(pa.int64()))], schema=arrow)

    place = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(1 << bits))
    return small_batches(docs.filter("doc_id is not null").select("doc_id", "text", place.alias("place"))).mapInArrow(released(cut), "doc_id long, tokens array<bigint>")


def verified(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b), of a written table, whose whole sets link. A pair comes more than once if ids do."""
    sets = whole_sets(docs, k, pairs)
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    linked = common * den >= (F.size("x") + F.size("y") - common) * num
    return both.filter(linked).select("a", "b")


def _unions(members: DataFrame) -> DataFrame:
    """(g, n_min, bits_g): the least set size of each group, and the union of its members' bitmaps, folded to the narrowest. Takes g, n, bits. Tasks add up what they hold before anything is dealt out by group."""
    schema = "g long, n_min long, bits_g array<bigint>"
    arrow = pa.schema([("g", pa.int64()), ("n_min", pa.int64()), ("bits_g", pa.list_(pa.int64()))])

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        width = min(len(a), len(b))
        return np.bitwise_or.reduce(a.reshape(-1, width), axis=0) | np.bitwise_or.reduce(b.reshape(-1, width), axis=0)

    def rows(batches):
        for batch in batches:
            lists = batch.column(2)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, (g, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                yield g, n, values[at[i] : at[i + 1]]

    def out(found: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([x for _, x in found.values()], pa.list_(pa.int64()))], schema=arrow)

    def some(batches):
        found: dict[int, tuple[int, np.ndarray]] = {}
        held = 0
        for g, n, bits in rows(batches):
            old = found.get(g)
            found[g] = (n, bits.copy()) if old is None else (min(n, old[0]), joined(bits, old[1]))
            held += bits.nbytes if old is None else 0
            if held >= UNION_BYTES:
                yield out(found)
                found, held = {}, 0
        if found:
            yield out(found)

    def all_of(batches):
        """Rows come sorted by group."""
        found: dict[int, tuple[int, np.ndarray]] = {}
        for g, n, bits in rows(batches):
            old = found.get(g)
            if old is None and len(found) >= 256:
                yield out(found)
                found = {}
            found[g] = (n, bits.copy()) if old is None else (min(n, old[0]), joined(bits, old[1]))
        if found:
            yield out(found)

    return members.select("g", "n", "bits").mapInArrow(released(some), schema).repartition("g").sortWithinPartitions("g").mapInArrow(released(all_of), schema)


def links(docs: DataFrame, signed: DataFrame, store: Store, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Verified links between classes, named by their least doc_id, that join all classes which a chain of links joins: the groups as (node, component), and further links (a, b) between groups."""
    overlap = lambda a, b: _least_overlap(a, b, num, den)
    least = signed.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    dealt = signed.join(least, ["digest", "doc_id"], "left_semi").select("doc_id", "n", F.posexplode("prefix").alias("pos", "token"))

    # Groups. The most central class of a token has the fewest rarer tokens before it, in proportion to its size.
    centres = dealt.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct((F.col("pos") / F.col("n")).alias("p"), "doc_id")).alias("m")).filter("c > 1").select("token", F.col("m.doc_id").alias("centre"))
    held = store.table(dealt.join(centres, "token"))
    shared = held.filter("doc_id <> centre").groupBy("doc_id", "centre").agg(F.count(F.lit(1)).alias("c"))
    best = shared.groupBy("doc_id").agg(F.min(F.struct((-F.col("c")).alias("c"), "centre")).alias("m")).select(F.col("doc_id").alias("a"), F.col("m.centre").alias("b"))
    own = lambda side: signed.filter("digest is not null").select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))
    near = lambda pairs: _within(pairs.select("a", "b").join(own("a"), "a").join(own("b"), "b").filter(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num), num, den, True)
    group_of = components(verified(docs, store.table(near(best)), k, num, den))

    # The matrix: a token's groups, with what bounds the overlap of any member.
    # Members of much the same size make a part of their group; narrow sizes make narrow bounds.
    part = lambda own, n: F.xxhash64(own, F.floor(F.log(F.greatest(n, F.lit(PART_SIZES)).cast("double")) * PART_SIZES), F.least(n, F.lit(PART_SIZES)))
    own_of = F.coalesce("component", "doc_id")
    grouped = held.drop("centre").join(group_of.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("token", "doc_id", "n", "pos", own_of.alias("own"), part(own_of, F.col("n")).alias("part"), F.col("component").isNotNull().alias("several"))
    matrix = grouped.groupBy("token", "part", F.col("own").alias("g")).agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.max("several").alias("g_several"))
    reach = F.least(F.col("n") - F.col("pos"), F.col("rest")) >= overlap(F.col("n"), F.greatest(F.col("n_min"), F.ceil(F.col("n") * num / F.lit(float(den)) - 1e-9)))
    sizes = (F.col("n") * den >= F.col("n_min") * num) & (F.col("n_max") * den >= F.col("n") * num)
    hits = store.table(grouped.drop("several", "part").join(matrix, "token").filter((F.col("own") > F.col("g")) & sizes & reach).select(F.col("doc_id").alias("a"), "n", "pos", "token", "g", "part", "g_several"))

    # A group of one class is compared at once; a part of one of several is opened if the bound by its union qualifies.
    # Written, so that a task runs one Python worker at a time.
    members = group_of.join(signed.filter("digest is not null").select(F.col("doc_id").alias("node"), "n", "bits"), "node").withColumn("g", part(F.col("component"), F.col("n")))
    unions = store.table(_unions(members))
    fewest = F.greatest(F.col("n_min"), F.ceil(F.col("n_a") * num / F.lit(float(den)) - 1e-9))
    queried = hits.filter("g_several").select("a", F.col("part").alias("g")).distinct().join(own("a"), "a").join(unions, "g").select("a", F.col("g").alias("b"), "n_a", fewest.alias("n_b"), "bits_a", F.col("bits_g").alias("bits_b"))
    opened = hits.filter("g_several").join(store.table(_within(queried, num, den, False)).withColumnRenamed("b", "part"), ["a", "part"])
    # Of an opened part, the members that share a token within reach of both: two sets that link have their first common one there.
    inside = held.join(group_of.withColumnRenamed("node", "doc_id"), "doc_id").select("token", part(F.col("component"), F.col("n")).alias("part"), F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("pos").alias("b_pos"))
    close = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("b_pos")) >= overlap(F.col("n"), F.col("m"))
    found = opened.join(inside, ["part", "token"]).filter(close).select("a", "b")
    pairs = store.table(near(hits.filter("not g_several").select("a", F.col("g").alias("b")).unionByName(found).distinct()))
    return group_of, store.table(verified(docs, pairs, k, num, den))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) of each row. Two sets link when den * intersection >= num * union. All but the result, a table of three numbers a row, is removed from the shared folder."""
    store = Store(docs.sparkSession)
    signed = store.table(signatures(docs, k, num, den))
    group_of, further = links(docs, signed, store, k, num, den)
    # Groups are joined by what links them; a group is named by its least class, so the least of the groups is that of all.
    group = lambda side: group_of.select(F.col("node").alias(side), F.col("component").alias(f"g_{side}"))
    between = further.join(group("a"), "a", "left").join(group("b"), "b", "left").select(F.coalesce("g_a", "a").alias("a"), F.coalesce("g_b", "b").alias("b"))
    joined = components(between).withColumnRenamed("node", "group")
    least = signed.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("class"))
    # Written, so that the join below can be split at a set that many documents share.
    named = least.join(group("class"), "class", "left").withColumn("group", F.coalesce("g_class", "class")).join(joined, "group", "left").select("digest", F.coalesce("component", "group").alias("component_id"))
    found = signed.select("doc_id", "n", "digest").join(store.table(named), "digest", "left")
    out = cut_lineage(found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))
    store.drop()
    return out
