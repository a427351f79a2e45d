"""Secret scan with DataFrame functions only: three base patterns and sliding-window entropy spans.

Base kinds are found leftmost and non-overlapping, then dropped when too short. Candidate strings of one character
class get the Shannon entropy of every window of fixed width; the counts of the window are updated by the character
that enters and the one that leaves. From the first to the last window at or above the class's threshold is a span,
unless the candidate holds an allow-listed string. Spans are in code points, the end exclusive.

Defined results: a null text counts as empty and has no spans; repeated rows give repeated results; spans that start
together are ordered by kind. Very long texts are scanned whole, in time that grows with their length and matches. scan()
ignores other columns; redact() keeps them all, whatever their names. Redaction replaces every span, overlapping or
touching ones once, and leaves other text as it is.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtide.llm.common import unused

SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


class Base(NamedTuple):
    kind: str
    prefix: str
    #: Its length decides.
    value: str
    shortest: int
    #: A text without a match of it has no span of the kind.
    gate: str
    #: What is searched for instead of `value` where dropping short matches afterwards and asking for long ones come to the same: runs of one class of characters.
    long_value: str = ""


class EntropyClass(NamedTuple):
    kind: str
    candidate: str
    alphabet: str
    window: int
    bits: float
    #: Every one of these must match the candidate.
    needs: tuple[str, ...]
    gate: str


# The base patterns of the contract.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = (
    Base("assign", ASSIGN, "[A-Za-z0-9+/_.=-]+", 12, ASSIGN + "[A-Za-z0-9+/_.=-]{12}"),
    Base("access", "", "AKIA[A-Z0-9]+", 18, "AKIA[A-Z0-9]{14}", "AKIA[A-Z0-9]{14,}"),
    Base("hex", "", "[0-9a-f]+", 16, "[0-9a-f]{16}", "[0-9a-f]{16,}"),
)
CLASSES = (
    EntropyClass("entropy_hex", "[0-9a-fA-F]{20,}", "0123456789abcdef", 20, 3.0, ("[0-9]", "[a-fA-F]"), "[0-9a-fA-F]{20}"),
    EntropyClass("entropy_base64", "[A-Za-z0-9+/_-]{24,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 24, 3.9, ("[0-9]", "[A-Z]", "[a-z]"), "[A-Za-z0-9+/_-]{24}"),
)
#: Lower case. Digests of the empty input (SHA-256, SHA-1, MD5), running alphabets, and the word that sample keys hold.
ALLOWED = ("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "da39a3ee5e6b4b0d3255bfef95601890afd80709", "d41d8cd98f00b204e9800998ecf8427e", "0123456789abcdef", "abcdefghijklmnop", "example")


#: Put around matches. No pattern matches them; in the text that is searched other characters stand for them.
OPEN, CLOSE, INSTEAD = "\x01", "\x02", "\x03"


#: A list that grows is copied at each step, so lists grow to this length and are then joined.
CHUNK = 256
#: A place in a text is found by counting from its beginning, so texts are cut into parts of so many code points first.
PART = 4096


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _chunks(items: Column) -> Column:
    """array<array>: CHUNK items each. `items` must be a lambda's variable or a column."""
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array())


def searched(text: Column) -> Column:
    """The text to search, of the same length: null as empty, without OPEN and CLOSE."""
    body = F.coalesce(text, F.lit(""))
    return F.when(body.rlike(f"[{OPEN}{CLOSE}]"), F.translate(body, OPEN + CLOSE, INSTEAD + INSTEAD)).otherwise(body)


def _located(body: Column, prefix: str, value: str) -> Column:
    """array<struct<start, size, match, value>>: every match of prefix and value. One pass marks the matches, the marks cut the text, and the starts are running sums of the lengths."""
    marked = F.regexp_replace(body, f"({prefix})({value})", f"{OPEN}$1{CLOSE}$2{CLOSE}")
    cut = F.transform(F.split(marked, OPEN), lambda s: F.split(s, CLOSE))
    # The first part has no match; others are prefix, value and the gap behind.
    part = lambda p: F.struct(F.when(F.size(p) == 3, F.concat(p[0], p[1])).alias("match"), F.when(F.size(p) == 3, p[1]).alias("value"), F.length(F.element_at(p, -1)).alias("gap"))
    sized = lambda p: F.struct(p["match"].alias("match"), p["value"].alias("value"), F.coalesce(F.length(p["match"]), F.lit(0)).alias("size"), p["gap"].alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int,match:string,value:string>>").alias("found"))
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(s, x):
        hit = F.struct(s["at"].alias("start"), x["size"].alias("size"), x["match"].alias("match"), x["value"].alias("value"))
        return F.struct((s["at"] + x["size"] + x["gap"]).alias("at"), F.when(x["size"] > 0, F.concat(s["found"], F.array(hit))).otherwise(s["found"]).alias("found"))

    def placed(chunks):
        """Each chunk's matches, counted from its beginning, moved to where it begins."""
        starts = F.aggregate(chunks, begun, lambda s, c: F.struct((s["at"] + c["at"]).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])
        moved = lambda at: lambda x: F.struct((x["start"] + at).alias("start"), x["size"].alias("size"), x["match"].alias("match"), x["value"].alias("value"))
        return _let(starts, lambda found: F.flatten(F.transform(chunks, lambda c, i: F.transform(c["found"], moved(F.element_at(found, i + 1))))))

    return _let(F.transform(F.transform(cut, part), sized), lambda parts: _let(F.transform(_chunks(parts), lambda c: F.aggregate(c, start, step)), placed))


def _span(start: Column, rank: int, kind: str, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))


def base_spans(text: Column, base: Base, rank: int) -> Column:
    found = F.filter(_located(text, base.prefix, base.long_value or base.value), lambda x: F.length(x["value"]) >= base.shortest)
    spans = F.transform(found, lambda x: _span(x["start"], rank, base.kind, x["start"] + x["size"]))
    return F.when(text.rlike(base.gate), spans).otherwise(F.array().cast(SPANS))


def hot_window(codes: Column, symbols: int, width: int, bits: float) -> Column:
    """struct<first, last>: 0-based starts of the first and the last window of `codes` (1..symbols) whose entropy is at least `bits`; first is -1 where none is.

    The state holds the window's counts and the sum of c * log2(c) over them, from which the entropy is log2(width) - sum / width; a step changes two counts and two terms.
    """
    weight = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    start = F.struct(F.array_repeat(F.lit(0), symbols).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(s, i):
        new = F.element_at(codes, i)
        old = F.when(i > width, F.element_at(codes, F.greatest(i - width, F.lit(1)))).otherwise(F.lit(0))
        c_new = F.element_at(s["counts"], new)
        c_old = F.element_at(s["counts"], F.greatest(old, F.lit(1)))
        change = F.when(new == old, F.lit(0.0)).otherwise(weight(c_new + 1) - weight(c_new) + F.when(old > 0, weight(c_old - 1) - weight(c_old)).otherwise(F.lit(0.0)))
        counts = F.transform(s["counts"], lambda c, j: c + F.when(j + 1 == new, 1).otherwise(0) - F.when(j + 1 == old, 1).otherwise(0))
        total = s["sum"] + change
        hot = (i >= width) & (F.log2(F.lit(float(width))) - total / width >= bits - 1e-9)
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(hot & (s["first"] < 0), i - width).otherwise(s["first"]).alias("first"), F.when(hot, i - width).otherwise(s["last"]).alias("last"))

    return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def entropy_spans(text: Column, kind: EntropyClass, rank: int) -> Column:
    lowered = lambda x: F.lower(x["match"])
    fold = kind.alphabet == kind.alphabet.lower()

    def wanted(x):
        ok = F.lit(True)
        for need in kind.needs:
            ok = ok & x["match"].rlike(need)
        for word in ALLOWED:
            ok = ok & ~F.contains(lowered(x), F.lit(word))
        return ok

    def coded(x):
        chars = F.split(lowered(x) if fold else x["match"], "")
        codes = F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.instr(F.lit(kind.alphabet), c))
        return F.struct(x["start"].alias("start"), codes.alias("codes"))

    judged = lambda x: F.struct(x["start"].alias("start"), hot_window(x["codes"], len(kind.alphabet), kind.window, kind.bits).alias("hot"))
    found = F.transform(F.transform(F.filter(_located(text, "", kind.candidate), wanted), coded), judged)
    hot = F.filter(found, lambda x: x["hot"]["first"] >= 0)
    spans = F.transform(hot, lambda x: _span(x["start"] + x["hot"]["first"], rank, kind.kind, x["start"] + x["hot"]["last"] + kind.window))
    return F.when(text.rlike(kind.gate), spans).otherwise(F.array().cast(SPANS))


def with_spans(df: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """`df` with two more columns, and their names: the base and the added spans, in the order of start, then kind."""
    body, base, added = unused(df, "_body", "_base", "_added")
    base_of = F.array_sort(F.concat(*[base_spans(F.col(body), b, i) for i, b in enumerate(BASE)]))
    added_of = F.array_sort(F.concat(*[entropy_spans(F.col(body), c, len(BASE) + i) for i, c in enumerate(CLASSES)]))
    return df.withColumn(body, searched(F.col(text))).withColumns({base: base_of, added: added_of}).drop(body), base, added


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(df: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of each row."""
    number = lambda c, kind: F.size(F.filter(F.col(c), lambda s: s["kind"] == kind)).cast("long")
    found, base, added = with_spans(df.select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[number(base, b.kind).alias(f"n_{b.kind}") for b in BASE],
        F.sha2(joined(F.col(base)), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat(base, added))).alias("spans"),
        F.size(added).cast("long").alias("n_entropy"),
    )


def _gaps(spans: Column) -> Column:
    """struct<at, lists>: the ranges (from, to) before each run of spans that overlap or touch, in lists that follow each other, and the end of the last span."""
    gap = "struct<from:int,to:int>"

    def step(s, x):
        fresh = F.struct(x["end"].alias("at"), F.concat(s["list"], F.array(F.struct(F.greatest(s["at"], F.lit(0)).alias("from"), x["start"].alias("to")))).alias("list"))
        return F.when(x["start"] > s["at"], fresh).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["list"].alias("list")))

    def chunk(s, c):
        inner = F.aggregate(c, F.struct(s["at"].alias("at"), F.array().cast(f"array<{gap}>").alias("list")), step)
        return _let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(s["lists"], F.array(r["list"])).alias("lists")))

    return F.aggregate(_chunks(spans), F.struct(F.lit(-1).alias("at"), F.array().cast(f"array<array<{gap}>>").alias("lists")), chunk)


def _cut(parts: Column, start: Column, end: Column) -> Column:
    """The code points from `start` to `end` of a text in `parts` of PART code points."""
    first, last = F.floor(start / PART).cast("int"), F.floor((end - 1) / PART).cast("int")
    whole = lambda i: F.element_at(parts, i + 1)
    inside = F.substr(whole(first), start % PART + 1, end - start)
    across = F.concat(F.substr(whole(first), start % PART + 1), F.array_join(F.slice(parts, first + 2, last - first - 1), ""), F.substr(whole(last), F.lit(1), (end - 1) % PART + 1))
    return F.when(end <= start, F.lit("")).when(first == last, inside).otherwise(across)


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`df` with every span of `text` replaced by `mark`; spans that overlap or touch are replaced once. Null texts stay null."""
    found, base, added = with_spans(df, text)
    spans, gaps = unused(found, "_spans", "_gaps")
    body = F.col(text)
    found = found.withColumn(spans, F.array_sort(F.concat(base, added))).withColumn(gaps, F.when(F.size(spans) > 0, _gaps(F.col(spans))))
    kept = lambda parts: F.concat(F.transform(F.flatten(F.col(gaps)["lists"]), lambda g: _cut(parts, g["from"], g["to"])), F.array(_cut(parts, F.col(gaps)["at"], F.length(body))))
    new = F.array_join(_let(F.regexp_extract_all(body, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), kept), mark)
    return found.withColumn(text, F.when(F.col(gaps).isNotNull(), new).otherwise(body)).select(*[F.col(f"`{c}`") for c in df.columns])
