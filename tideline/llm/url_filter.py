"""URL filter: rules first, then naive Bayes over segmented host and path tokens.

Names in hosts are often words run together.  A unigram model of the pages' own words splits them
by Viterbi: every substring of a distinct name is looked up by a join, and the best path through
the substrings found is taken per name.  The classifier learns from the urls that rules decide
and scores the rest.  Its tokens fall into a fixed number of hash buckets, so the model that every
task gets has a size that does not depend on the corpus.
"""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut

#: Longest word that a name is split into; longer unknown stretches stay whole.
LONGEST = 24
#: Token buckets of the classifier.
BUCKETS = 1 << 16
#: Rules are part of the plan; a longer list is refused.
MOST_RULES = 10_000

Rule = tuple[str, str, str]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(whole, parts, 2)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct ``(size, host_size, rule, verdict)`` of the longest fitting rule, or null.

    A rule ``(verdict, host, path)`` fits its host and all subdomains if the url's path starts
    with its path.  Of equally long rules the one with the longer host wins.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)),
            F.struct(
                F.lit(len(h + p)).alias("size"), F.lit(len(h)).alias("host_size"),
                F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"),
            ),
        )
        for verdict, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")


def unigrams(pages: DataFrame, html: str) -> DataFrame:
    """``word, n``: how often each word of at most ``LONGEST`` letters stands in the pages' text."""
    bare = F.lower(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), "(?s)<[^>]*>", " "))
    found = pages.select(F.explode(F.split(bare, "[^a-z0-9]+")).alias("word"))
    return found.where(F.length("word").between(1, LONGEST)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _best_path(name: str, found: list[tuple[int, int, int]], total: int) -> list[str]:
    """Most probable split; an unknown stretch of k letters has the chance of a word seen 10 / 10^k times."""
    steps = [[] for _ in range(len(name) + 1)]
    for start, size, n in found:
        steps[start + size].append((start, log(n / total)))
    best, origin = [0.0], [0]
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST), end):
            steps[end].append((start, log(10 / total) - (end - start) * log(10)))
        score, start = max((best[start] + gain, start) for start, gain in steps[end])
        best.append(score)
        origin.append(start)
    out, end = [], len(name)
    while end:
        out.append(name[origin[end] : end])
        end = origin[end]
    return out[::-1]


def segment(names: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """``name, parts`` for distinct non-empty ``name``; ``words`` as ``unigrams`` gives them."""
    stretches = names.select(
        "name",
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(0), F.length("name") - 1),
                    lambda i: F.transform(
                        F.sequence(F.lit(1), F.least(F.length("name") - i, F.lit(LONGEST))),
                        lambda k: F.struct(i.alias("start"), k.alias("size")),
                    ),
                )
            )
        ).alias("s"),
    ).select("name", "s.start", "s.size", F.expr("substr(name, s.start + 1, s.size)").alias("word"))
    known = (
        stretches.join(words, "word", "left")
        .groupBy("name")
        .agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("start", "size", "n"))).alias("found"))
    )

    @F.pandas_udf("array<string>")
    def run(name: pd.Series, found: pd.Series) -> pd.Series:
        rows = ([(f["start"], f["size"], f["n"]) for f in own] for own in found)
        return pd.Series([_best_path(n, sorted(own), total) for n, own in zip(name, rows, strict=True)])

    return known.select("name", run("name", "found").alias("parts"))


def host_words(hosts: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """``host, host_words`` for distinct ``host``."""
    pieces = hosts.select("host", F.posexplode(F.array_remove(F.split("host", "[^a-z0-9]+"), "")).alias("at", "name"))
    split = segment(pieces.select("name").distinct(), words, total)
    return (
        pieces.join(split, "name")
        .groupBy("host")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "parts"))), lambda x: x["parts"])).alias("host_words"))
    )


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """``__row`` with the columns to carry, ``host``, ``path``, ``rule``, ``verdict``, ``host_words`` and ``block_score``.

    Null urls and those without ``://`` have empty host and path, fit no rule and are scored on no
    tokens, that is by the share of blocked urls alone.  While rules decide no url of one of the
    verdicts, nothing can be learned and the rest is allowed.  Rows are judged one by one, so
    repeated rows agree; null texts add no words.
    """
    host, path = split_url(F.col(f"`{url}`"))
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or pages.columns]).alias("__row"), host.alias("host"), path.alias("path")
    ).withColumn("__fit", fitting_rule(F.col("host"), F.col("path"), rules))
    words = cut(unigrams(pages, html))
    total = words.agg(F.sum("n")).first()[0] or 1
    hosts = rows.select("host").where(F.col("host") != "").distinct()
    split = host_words(hosts, words, total).withColumnRenamed("host", "__host")
    path_words = F.split(F.regexp_replace(F.lower("path"), "[0-9]+", "#"), "[^\\p{L}#]+")
    tokens = F.array_remove(F.concat(F.coalesce("host_words", F.array()), F.transform(path_words, lambda w: F.concat(F.lit("/"), w))), "/")
    rows = cut(
        rows.join(split, F.col("host") == F.col("__host"), "left")
        .withColumn("__tokens", F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))
        .drop("__host")
    )
    ruled = rows.where(F.col("__fit").isNotNull()).select((F.col("__fit.verdict") == "block").alias("block"), "__tokens")
    urls = {r["block"]: r["n"] for r in ruled.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = ruled.select("block", F.explode("__tokens").alias("t")).groupBy("t").agg(
        F.count_if("block").alias("b"), F.count_if(~F.col("block")).alias("a")
    )
    counts = np.ones((2, BUCKETS))
    for t, b, a in seen.collect():  # at most BUCKETS rows
        counts[:, t] += (a, b)
    odds = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    prior = log(urls[True] / urls[False]) if len(urls) == 2 else None

    @F.pandas_udf("double")
    def score(tokens: pd.Series) -> pd.Series:
        if prior is None:
            return pd.Series(0.0, index=tokens.index)
        logits = np.array([prior + odds[t].sum() for t in tokens])
        return pd.Series(1 / (1 + np.exp(-np.clip(logits, -700, 700))), index=tokens.index)

    scored = rows.withColumn("block_score", score("__tokens"))
    own = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return scored.select(
        "__row", "host", "path", F.col("__fit.rule").alias("rule"),
        F.coalesce("__fit.verdict", own).alias("verdict"),
        F.coalesce("host_words", F.array().cast("array<string>")).alias("host_words"), "block_score",
    )
