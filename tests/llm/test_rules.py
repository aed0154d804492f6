"""Quality rules, source mix and the url filter."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tideline.llm import mixing, quality, url_filter

WORD = re.compile("[^\x20\x09-\x0d]+")


def measured(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def documents():
    rows = []
    for i in range(400):
        words = [f"w{(i * 7919 + k * k * 31 + k * 17) % 977}" for k in range(10 + i % 60)]
        rows.append((i, " ".join(words), "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, 1))
    junk = " ".join("a |" if k % 2 else "b #" for k in range(40))
    rows += [
        (None, None, None, None, None), (900, "", "en", "s0", 0), (901, junk + " x", "en", "s0", 0), (901, junk + " x", "en", "s0", 0),
        (902, "line one\nline one\n \n\nline one\r\n", "en", "s1", 0), (903, "one two three four five " * 30, "xx", "new", 0),
        (904, " ".join(f"v{k}" for k in range(30_000)), "en", "s1", 0), (905, "é𝒳 " * 12 + "\x0b\x0c z", "xx", "new", 0),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, kept long"


def test_base_measures_and_verdicts(spark):
    df = spark.createDataFrame(documents(), SCHEMA).repartition(3)
    rows = quality.judge(df).collect()
    assert len(rows) == len(documents())
    for r in rows:
        n, chars, symbols, dup, repeat = measured(r["__row"].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (r.kept and r.base_failed)
    kept = {r["__row"].doc_id for r in rows if r.kept}
    assert set(range(400)) | {904} <= kept and not kept & {None, 900, 901, 902, 903}
    assert quality.keep_good(df).columns == df.columns
    assert quality.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,expected", [("a b c d e f a b c d e", 10), ("a a a a a a a", 7), ("a b c d e", 0), (None, 0)])
def test_repeat_words(spark, text, expected):
    df = spark.createDataFrame([(text,)], "text string")
    assert quality.measure(df).first().n_repeat_words == expected


def water_fill(sizes):
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in sizes if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        share = {s: left * weights[s] / max(1, sum(weights[x] for x in rest)) for s in rest}
        over = {s for s in rest if share[s] > 2 * sizes[s]}
        if not over:
            return share | {s: 2.0 * sizes[s] for s in full}
        full |= over


def test_mix_meets_its_targets(spark):
    rows = [(i % 700, "w " * (1 + i * 37 % 90), (None, "a", "b", "c", "d", "z")[i % 6 if i % 2 else 1], "x") for i in range(3000)]
    rows += [(None, None, None, "x"), (None, "q r", "only", None), (1, "", "empty", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    found = mixing.mix(df, shard=5000, block=16)
    got = found.select("__row.source", "__row.doc_id", F.col("size").alias("n"), "source_size", "target", "taken").collect()
    again = mixing.mix(df.repartition(7), shard=5000, block=16).select("__row.source", "__row.doc_id", F.col("size").alias("n"), "taken")
    assert sorted(map(str, again.collect())) == sorted(map(str, found.select("__row.source", "__row.doc_id", F.col("size").alias("n"), "taken").collect()))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.n
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.n
    wanted = water_fill(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
    for s in sizes:
        # half a block for the source, and the last block of a shard, taken twice, can be short
        assert abs(taken[s] - wanted[s]) <= 16 * (1 + 2 * (1 + sizes[s] // 5000))
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.repeat_mixed(df).columns == df.columns


@pytest.mark.parametrize("seats,votes", [(10, [53, 24, 23]), (7, [1, 1, 1]), (100, [500, 3, 2, 1]), (0, [4, 5]), (11, [0, 9, 2])])
def test_apportionment_is_by_highest_quotients(spark, seats, votes):
    df = spark.createDataFrame([(k, v, seats, 0) for k, v in enumerate(votes)], "k int, v long, seats long, g int")
    got = {r.k: r.q for r in mixing.apportion(df, "v", "seats", ["g"], ["k"], "q").collect()}
    quotients = sorted((-v / (2 * j + 1), k) for k, v in enumerate(votes) for j in range(seats) if v)[:seats]
    given = Counter(k for _, k in quotients)
    assert got == {k: given[k] for k in range(len(votes))}


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def test_url_rules_and_scores(spark):
    urls = [
        ("http://A.Example.COM/en/x?q", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
        ("http://x.net/es/1#f", "x.net", "/es/1", "net/es/", "block"),
        ("http://com?x=/en/", "com", "", None, None),
        ("no scheme", "", "", None, None), (None, "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None),
        ("http://redbluebox.org/EN/", "redbluebox.org", "/EN/", None, None),
    ]
    html = "<p>red blue box red blue box net example</p>" * 20
    rows = [(i, u[0], html if i % 2 else None, "old") for i, u in enumerate(urls)] + [(0, urls[0][0], html, "old")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    got = url_filter.judge_urls(df, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        _, host, path, rule, verdict = urls[r["__row"].page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict
    words = {r.host: r.host_words for r in got}
    assert words["redbluebox.org"][:3] == ["red", "blue", "box"]
    assert url_filter.judge_urls(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, []).collect()} == {"allow"}


def test_segmentation_is_the_best_of_all():
    counts = {"a": 5, "ab": 9, "b": 3, "ba": 4, "bab": 1}
    name, total = "ababb", 30
    found = [(i, k, counts[name[i : i + k]]) for i in range(5) for k in range(1, 6 - i) if name[i : i + k] in counts]

    def best(rest):
        if not rest:
            return 1.0, []
        options = []
        for k in range(1, len(rest) + 1):
            head = rest[:k]
            chance = max(counts.get(head, 0) / total, 10 / total / 10**k)
            score, tail = best(rest[k:])
            options.append((chance * score, [head, *tail]))
        return max(options)

    assert url_filter._best_path(name, found, total) == best(name)[1]
