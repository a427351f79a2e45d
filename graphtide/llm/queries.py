"""The operators' queries over the tables of a folder, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.llm import alignment, jaccard_groups, langid, matroska, merkle, mixture, pieces, quality, ranked, secret_scan, token_files, toxicity, warc
from graphtide.llm.common import table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_features(matroska.store_documents(table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs.select("doc_id", "text", F.col("source").alias("host"), F.concat_ws("/", F.lit(""), "lang").alias("path")), table(spark, sf_dir, "labels"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.replicate(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_toxicity, op3_sentencepiece, op4_fingerprints, op5_language, op6_secrets, op7_warc_derivatives, op8_quality, op9_jaccard, op10_mixture, op11_ranked_search, op12_token_files, op13_alignment)}

OP10_SQL = f"""
with counts as (select source, count(*) as n_rows, pow(count(*), {mixture.TEMPERATURE}) as weight from documents group by source),
     totals as (select sum(n_rows) as n, sum(weight) as w from counts),
     rates as (select source, weight * ({mixture.EPOCHS}e0 * n / w) / n_rows as rate from counts, totals),
     steps as (select source, unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 40) as bigint) + 1)) as k, rate from rates),
     terms as (select source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) as p from steps),
     cdf as (select source, k, sum(p) over (partition by source order by k) as c from terms),
     uniform as (select *, (cast(('0x' || substr(md5('{mixture.SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 13)) as bigint) + 0.5) / 4503599627370496.0 as u from documents),
     counted as (select d.doc_id, d.text, d.lang, d.source, d.n_chars, (select count(*) from cdf where cdf.source = d.source and c < d.u) as copies from uniform d)
select doc_id, text, lang, source, n_chars, cast(unnest(range(1, copies + 1)) as integer) as replica from counted where copies > 0
"""


def _op6_sql() -> str:
    located = lambda name, pattern: f"""{name}_cut as (select doc_id, regexp_extract_all(t, '(?s)(.*?)(?:({pattern})|\\z)', 1) as gaps, regexp_extract_all(t, '(?s)(.*?)(?:({pattern})|\\z)', 2) as hits, regexp_extract_all(t, '(?s)(.*?)(?:({pattern})|\\z)', 3) as vals from docs),
     {name}_flat as (select doc_id, unnest(gaps) as gap, unnest(hits) as hit, unnest(vals) as val, generate_subscripts(gaps, 1) as i from {name}_cut),
     {name} as (select doc_id, hit, val, sum(length(gap) + length(hit)) over (partition by doc_id order by i) - length(hit) as start from {name}_flat)"""  # noqa: E731
    quoted = lambda s: s.replace("'", "''")
    parts = [located(b.kind, quoted(f'{b.prefix}({b.value})')) for b in secret_scan.BASE] + [located(c.kind, f"({c.candidate})") for c in secret_scan.CLASSES]
    spans = [f"select doc_id, '{b.kind}' as kind, {i} as rank, cast(start as bigint) as s, cast(start + length(hit) as bigint) as e from {b.kind} where length(val) >= {b.shortest}" for i, b in enumerate(secret_scan.BASE)]
    for i, c in enumerate(secret_scan.CLASSES):
        chars = "lower(hit)" if c.alphabet == c.alphabet.lower() else "hit"
        needs = " and ".join([f"regexp_matches(hit, '{n}')" for n in c.needs] + [f"not contains(lower(hit), '{w}')" for w in secret_scan.ALLOWED])
        parts.append(f"""{c.kind}_win as (select doc_id, start, w, substr({chars}, w + 1, {c.window}) as part from (select *, unnest(range(0, length(hit) - {c.window} + 1)) as w from {c.kind} where length(hit) >= {c.window} and {needs})),
     {c.kind}_hot as (select doc_id, start, w from {c.kind}_win where log2({c.window}) - list_sum([len(list_filter(string_split(part, ''), lambda y: y = x)) * log2(len(list_filter(string_split(part, ''), lambda y: y = x))) for x in list_distinct(string_split(part, ''))]) / {c.window} >= {c.bits} - 1e-9)""")
        spans.append(f"select doc_id, '{c.kind}' as kind, {len(secret_scan.BASE) + i} as rank, cast(start + min(w) as bigint) as s, cast(start + max(w) + {c.window} as bigint) as e from {c.kind}_hot group by doc_id, start")
    said = "kind || ':' || s || ':' || e"
    return f"""with docs as (select doc_id, coalesce(text, '') as t from documents),
     {", ".join(parts)},
     spans as ({" union all ".join(spans)})
select d.doc_id, {", ".join(f"count(*) filter (where kind = '{b.kind}') as n_{b.kind}" for b in secret_scan.BASE)},
  sha256(coalesce(string_agg({said}, ',' order by s, rank) filter (where rank < {len(secret_scan.BASE)}), '')) as base_sha256,
  coalesce(string_agg({said}, ',' order by s, rank), '') as spans,
  count(*) filter (where rank >= {len(secret_scan.BASE)}) as n_entropy
from docs d left join spans on spans.doc_id = d.doc_id group by d.doc_id"""


#: Runs of ASCII letters and digits and of all that is beyond ASCII.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CUT = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"
OP11_SQL = f"""
with words as (select row_number() over () as r, doc_id, {_CUT} as ts from documents),
     postings as (select r, doc_id, term, count(*) as tf, any_value(n) as n from (select r, doc_id, unnest(ts) as term, len(ts) as n from words) group by r, doc_id, term),
     total as (select count(*) as n_docs, sum(len(ts))::bigint as n_terms from words where len(ts) > 0),
     held as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as w from postings, total group by term, n_docs),
     wanted as (select distinct item_id, unnest({_CUT}) as term from benchmark),
     scored as (select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::bigint as score
                from wanted join held using (term) join postings using (term), total group by item_id, r, doc_id),
     placed as (select item_id, row_number() over (partition by item_id order by score desc, doc_id, r)::integer as rank, doc_id, score from scored where score > 0)
select item_id, rank, doc_id, score from placed where rank <= 10
"""

ORACLE_SQL = {"op11_ranked_search": OP11_SQL, "op10_mixture": OP10_SQL, "op6_secrets": _op6_sql()}
