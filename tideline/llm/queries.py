"""The operators as queries on the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import byte_bpe, exact_dedup, jaccard, langid, lattice, mixing, quality
from tideline.llm import token_counts, token_links, toxicity, url_filter, vector_codes, warc
from tideline.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(documents).drop("text")


#: (verdict, host, path) of the url filter; fixed values.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    judged = url_filter.judge_urls(pages, URL_RULES, carry=["page_id"])
    return judged.select("__row.page_id", "host", "path", "rule", "verdict", "host_words", "block_score")


@query
def op3_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = lattice.near_duplicates(vectors)
    return found.select("__row.vec_id", "n_links", "component_id", "kept")


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    documents = documents.withColumn("held_out", held_out(F.col("doc_id")))
    model = langid.train(documents.where(~F.col("held_out")))
    return langid.identify(documents.select("doc_id", "held_out", "text"), model).drop("text")


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.join(documents).withColumnRenamed("id", "doc_id")


@query
def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages).select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


ORACLE["op6_warc_segments"] = """
WITH d AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS n, sha1(body) AS x,
             max(page_id) OVER (PARTITION BY body) AS last FROM d),
b AS (SELECT page_id, n, last, list_reduce([lpad(upper(to_base(CAST('0x' || substr(x, 1 + 5 * k, 5) AS BIGINT), 32)), 4, '0')
                                            FOR k IN range(8)], lambda a, c: a || c) AS digits FROM h)
SELECT page_id, n AS payload_bytes,
       translate(digits, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality.judge(documents, carry=["doc_id", "lang", "source"])
    return judged.select("__row.doc_id", *quality.BASE, "kept")


def _fences_sql(name: str, keys: str) -> str:
    """Quartile fences of the sketch per language, and source too, as CTE ``name``."""
    least = " ".join(f"WHEN '{m}' THEN {spread}" for m, (_, _, spread, _) in quality.MEASURES.items())
    return f"""
{name}_m AS (SELECT {keys}, m, v, sum(n) AS n FROM sketch GROUP BY ALL),
{name}_r AS (SELECT {keys}, m, v, sum(n) OVER (PARTITION BY {keys}, m ORDER BY v) AS upto, sum(n) OVER (PARTITION BY {keys}, m) AS docs FROM {name}_m),
{name}_q AS (SELECT {keys}, m, max(docs) AS docs, min(v) FILTER (4 * upto >= docs) AS q1, min(v) FILTER (4 * upto >= 3 * docs) AS q3 FROM {name}_r GROUP BY ALL),
{name} AS (SELECT {keys}, m, docs, q1 - {quality.REACH} * greatest(q3 - q1, CASE m {least} END) AS lo,
           q3 + {quality.REACH} * greatest(q3 - q1, CASE m {least} END) AS hi FROM {name}_q)"""


_SCALED = ", ".join(f"{{'m': '{m}', 'x': ({units} * {over}) // greatest(n_words, 1)}}" for m, (over, units, _, _) in quality.MEASURES.items())
_BELOW = ", ".join(f"'{m}'" for m, (_, _, _, below) in quality.MEASURES.items() if below)
ORACLE["op7_quality_rules"] = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM documents),
g AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
d AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
c AS (SELECT rid, sum(k) AS n FROM (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS k FROM d) GROUP BY rid),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM w),
m AS (SELECT rid, doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(t, '[ 	-
]+', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM l LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM m),
e AS (SELECT rid, lang, source, base_failed, unnest([{_SCALED}], recursive := true) FROM b),
sketch AS (SELECT lang, source, m, (x >> s) << s AS v, count(*) AS n FROM
           (SELECT *, CAST(greatest(length(bin(x)) - 6, 0) AS BIGINT) AS s FROM e WHERE NOT base_failed) GROUP BY ALL),
{_fences_sql('own', 'lang, source')},
{_fences_sql('pooled', 'lang')},
f AS (SELECT own.lang, own.source, own.m, CASE WHEN own.docs >= {quality.LEAST_GROUP} THEN own.lo ELSE pooled.lo END AS lo,
             CASE WHEN own.docs >= {quality.LEAST_GROUP} THEN own.hi ELSE pooled.hi END AS hi
      FROM own JOIN pooled ON own.m = pooled.m AND own.lang IS NOT DISTINCT FROM pooled.lang),
v AS (SELECT rid, bool_and(x <= hi AND (m NOT IN ({_BELOW}) OR x >= lo)) AS inside
      FROM (SELECT e.rid, e.m, e.x, f.lo, f.hi FROM e JOIN f ON e.m = f.m AND e.lang IS NOT DISTINCT FROM f.lang AND e.source IS NOT DISTINCT FROM f.source)
      GROUP BY rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, false) AS kept
FROM b LEFT JOIN v USING (rid)
"""


@query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(documents, carry=["doc_id"]).select("__row.doc_id", "size", "source_size", "target", "taken")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    network = toxicity.train(documents.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return toxicity.score(documents, network).drop("text")


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.round_trip(documents).drop("text")


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded, codec = vector_codes.compress(vectors, carry=["vec_id", "label"])
    books = codec.sha256 if codec else ""
    return vector_codes.with_label_error(coded, F.col("__row.label")).select(
        "__row.vec_id", "code", "error", "label_error", F.lit(books).alias("codebooks_sha256")
    )


def _round_sql(k: int) -> str:
    """CTEs ``a{k}``, each part with its nearest entry of ``e{k}``, and ``e{k + 1}``, the entries after the round."""
    return f"""
a{k} AS (SELECT rid, part, x, min({{'d': d, 'k': k}}) AS near FROM
         (SELECT p.rid, p.part, p.x, e.k, CAST(list_sum(list_transform(list_zip(p.x, e.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
          FROM p JOIN e{k} AS e ON p.part = e.part) GROUP BY rid, part, x),
m{k} AS (SELECT part, k, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM
         (SELECT part, near.k AS k, generate_subscripts(x, 1) AS i, unnest(x) AS y FROM a{k}) GROUP BY part, k, i),
e{k + 1} AS (SELECT e.part, e.k, coalesce(c.c, e.c) AS c FROM e{k} AS e LEFT JOIN
         (SELECT part, k, list((s - (s % n + n) % n) // n ORDER BY i) AS c FROM m{k} GROUP BY part, k) AS c ON e.part = c.part AND e.k = c.k)"""


ORACLE["op11_vector_codes"] = f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, label,
                  list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS w
           FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
p AS (SELECT rid, vec_id, part, list_slice(w, part * len(w) // {vector_codes.PARTS} + 1, (part + 1) * len(w) // {vector_codes.PARTS}) AS x
      FROM (SELECT *, unnest(range({vector_codes.PARTS})) AS part FROM v)),
e0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, x AS c FROM p QUALIFY k < {vector_codes.ENTRIES}),
{",".join(_round_sql(k) for k in range(vector_codes.ROUNDS + 1))},
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM e{vector_codes.ROUNDS}),
c AS (SELECT rid, string_agg(printf('%02x', near.k), '' ORDER BY part) AS code, CAST(sum(near.d) AS BIGINT) AS error FROM a{vector_codes.ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN c USING (rid), b
"""


@query
def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_links.link_counts(documents, carry=["doc_id"]).select("__row.doc_id", "*").drop("__row")


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.deduplicate(exact_dedup.two_loads(documents), exact_dedup.fresh_index(spark))


ORACLE["op13_exact_dedup"] = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d
"""
