"""Language identification by compression: zstandard with one raw-content dictionary for each language.

A text is lower-cased, runs of other characters than letters become one space, and it is cut into blocks; each block is
compressed with every language's dictionary; the language with the fewest bytes in all wins. The answer is rejected when the runner-up is within a narrow margin.

Defined results: null texts and texts without a letter are `und`, score 0, rejected. A letter is what str.isalpha takes
for one, so digits of any script, "²", "½", "Ⅷ" and combining marks alone are none. Ties go to the first language in
alphabetical order and are rejected; with no learned language every text is `und`. A language whose slices come to less
than 8 bytes has no dictionary and is never found. Repeated rows give equal results; a very long text is compressed
whole, block by block. Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import math
import re

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtide.llm.common import fold, map_rows

#: Bounds of the training sample of a language: documents, and bytes of its dictionary.
SAMPLE_DOCUMENTS = 400
DICTIONARY_BYTES = 32 * 1024
#: No single document fills more of a dictionary than this.
SLICE_BYTES = 1024
BLOCK_BYTES = 2048
#: From this level on the compressor looks for the cheapest sequence of matches, which short texts need.
LEVEL = 12
#: Rejected below this: the runner-up's bytes over the winner's, less 1.
MARGIN = 0.01
HELD_OUT = (4, 2)
UNKNOWN = "und"
REST = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    return REST.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def _middle(text: Column) -> Column:
    """SLICE_BYTES characters from the middle of the whole text, as beginnings are often boilerplate."""
    return F.substr(text, F.greatest(F.lit(1), F.floor((F.length(text) - SLICE_BYTES) / 2).cast("int") + 1), F.lit(SLICE_BYTES))


def learn(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary for each lang value, from documents with lang, text and id outside the held-out fold.

    First the languages are counted over all rows; then a hash of the id picks about SAMPLE_DOCUMENTS of each, so that
    what reaches the driver depends on the number of languages only: for each about 1.5 times SAMPLE_DOCUMENTS slices.
    Each language is one dictionary and one more compression of every text, so `lang` must be a field of few values.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1])).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1 << 40))
    shares = docs.sparkSession.createDataFrame([(k, int(min(1.0, 1.5 * SAMPLE_DOCUMENTS / n) * (1 << 40))) for k, n in counts.items()], "lang string, share long")
    rows = usable.withColumn("place", place).join(F.broadcast(shares), "lang").filter(F.col("place") < F.col("share")).select("lang", "place", _middle(F.col("text")).alias("text")).collect()
    out = {}
    for lang in sorted(counts):
        filled, size = [], 0
        for row in sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["place"], r["text"]))[:SAMPLE_DOCUMENTS]:
            filled.append(plain(row["text"])[:SLICE_BYTES])
            size += len(filled[-1])
            if size >= DICTIONARY_BYTES:
                break
        content = b" ".join(filled)[:DICTIONARY_BYTES]
        if len(content) >= 8:
            out[lang] = content
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = sorted(dictionaries)
        self.compressors = []
        for lang in self.langs:
            raw = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=raw, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        """Bytes of the whole text under each dictionary, summed over blocks."""
        raw = plain(text)
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        return [sum([len(c.compress(b)) for b in blocks]) for c in self.compressors]

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected). score: the winner's share where each language weighs exp(-bytes / 1 % of the fewest)."""
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        least = sizes[best]
        others = [n for i, n in enumerate(sizes) if i != best]
        margin = (min(others) - least) / least if others else 1.0
        score = 1 / sum(math.exp(-100 * (n - least) / least) for n in sizes)
        return self.langs[best], score, margin, margin < MARGIN


def classify(docs: DataFrame, dictionaries: dict[str, bytes], keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected of each row; with `keep`, the columns of `docs` beside them (docs must be doc_id, text, lang, source, n_chars)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(dictionaries)
    own: list[Classifier] = []

    def rows(batch):
        if not own:
            own.append(Classifier(shared.value))
        for row in batch:
            first = (row["doc_id"], row["text"], row["lang"], row["source"], row["n_chars"]) if keep else (row["doc_id"],)
            yield *first, *own[0].classify(row["text"])

    names = ["doc_id", "text", "lang", "source", "n_chars"] if keep else ["doc_id", "text"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " if keep else "doc_id long, "
    return map_rows(docs.select(*names), rows, schema + "lang_pred string, score double, margin double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected."""
    found = classify(docs, learn(docs))
    held = F.coalesce(fold(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "rejected")
