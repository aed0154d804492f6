"""The rows of each pipeline stage, and of the whole run, against plain Python on a small fixture."""

import base64
import math
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from checks.compare import duck
from tideline.llm import byte_bpe, mixing, toxicity
from tideline.llm.common import held_out, table
from tideline.llm.queries import ORACLE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)
BAD = ["zorgu", "zorgan", "blikto"]


def made():
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "ri", "su") for b in ("len", "mat", "dor") for c in range(25)]
    rows = []
    for i in range(220):
        text = [rng.choice(words) for _ in range(rng.randint(12, 90))]
        if i % 6 == 0:
            text[rng.randrange(len(text))] = BAD[i // 6 % 3]
        rows.append([i, text, "en" if i % 3 else "de", f"s{i % 3}" if i % 10 else None])
    for i in range(40):  # copies with a word changed, of smaller and larger ids
        text = list(rows[i * 5][1])
        text[rng.randrange(len(text))] = "changed"
        rows.append([1000 - i, text, "en", "s1"])
    out = [(i, " ".join(t), lang, source, len(t)) for i, t, lang, source in rows]
    out += [(300, None, "en", "s0", 0), (301, "", None, None, 0), (302, "a | " * 60, "en", "s0", 9), (None, "some words " * 3, "en", "s0", 9)]
    return out + [out[8], out[8]]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = made()
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    marks = [(i, int(any(b in (t or "") for b in BAD)), 1) for i, t, *_ in rows if i is not None and i % 5]
    spark.createDataFrame(marks, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str)


def test_quality_keeps_what_the_twin_keeps(spark, tables):
    docs = table(spark, tables, "documents")
    con = duck("/nonexistent")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet/*.parquet'")
    kept = Counter(r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLE['op7_quality_rules']}) WHERE kept").fetchall())
    found = STAGES["quality_rules"](spark, docs, tables)
    assert Counter(r.doc_id for r in found.collect()) == kept
    assert set(rows_of(found)) <= set(rows_of(docs)) and 300 not in kept and 302 not in kept


def plain_score(network, text):
    """Score of a text by loops over words and windows."""
    w = {k: v.astype(float) for k, v in network.w.items()}
    words, n = re.findall(r"[^\W_]+", (text or "").lower()), toxicity.UNITS

    def sigmoid(x):
        return 1 / (1 + math.exp(-x))

    def vector(word):
        seen = toxicity.Words.of([word])
        return np.concatenate([w["word"][seen.word[0]], np.mean([w["gram"][g] for g in seen.grams], axis=0)])

    def direction(inputs, s):
        h, out = np.zeros(n), []
        for x in inputs:
            a, u = x @ w[f"in_{s}"] + w[f"b_{s}"], w[f"u_{s}"]
            z = np.array([sigmoid(v) for v in a[:n] + h @ u[:, :n]])
            r = np.array([sigmoid(v) for v in a[n : 2 * n] + h @ u[:, n : 2 * n]])
            c = np.tanh(a[2 * n :] + (r * h) @ u[:, 2 * n :])
            h = (1 - z) * h + z * c
            out.append(h)
        return out

    best, at = -math.inf, 0
    while words:
        inputs = [vector(x) for x in words[at : at + toxicity.WINDOW]]
        back = direction(inputs[::-1], "b")[::-1]
        states = [np.concatenate(pair) for pair in zip(direction(inputs, "f"), back, strict=True)]
        weights = [math.exp(np.tanh(s @ w["look"]) @ w["ask"]) for s in states]
        pooled = sum(a * s for a, s in zip(weights, states, strict=True)) / sum(weights)
        best = max(best, float(pooled @ w["out"] + w["bias"][0]))
        if at + toxicity.WINDOW >= len(words):
            break
        at += toxicity.STRIDE
    return sigmoid(best) if words else 0.0


def test_toxicity_keeps_what_a_plain_pass_keeps(spark, tables):
    docs = table(spark, tables, "documents")
    network = toxicity.train(docs.where(~held_out(F.col("doc_id"))), table(spark, tables, "labels"))
    scores = toxicity.score(docs, network).collect()
    for r in scores[::7] + [r for r in scores if r.doc_id in (300, 301, None)]:
        assert r.score == pytest.approx(plain_score(network, r.text), abs=1e-4), r.doc_id
    want = sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in scores if r.score < 0.5), key=str)
    found = STAGES["toxicity"](spark, docs, tables)
    assert rows_of(found) == want and found.columns == docs.columns
    named = {r.doc_id: any(b in (r.text or "") for b in BAD) for r in scores}
    right = sum((r.score >= 0.5) == named[r.doc_id] for r in scores)
    assert right > 0.9 * len(scores)


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_copies_leave_the_smallest_id(spark, tables):
    docs = table(spark, tables, "documents")
    rows = [tuple(r) for r in docs.collect()]
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i) if sets[i] else ("alone", i), []).append(r)
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert any(len({r[0] for r in g}) > 1 for g in groups.values())
    assert rows_of(STAGES["jaccard_join"](spark, docs, tables)) == sorted(want, key=str)


def seats_of(votes, seats):
    """Sainte-Laguë by highest quotients; ties to the earlier entry."""
    quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v > 0 for k in range(seats)))
    got = Counter(i for _, i in quotients[:seats])
    return [got[i] for i in range(len(votes))]


def test_mix_takes_what_a_plain_selection_takes(spark, tables):
    docs = table(spark, tables, "documents")
    block = 16
    got = mixing.mix(docs, block=block, seed=5).collect()
    hashed = docs.select("*", F.xxhash64(F.lit(5), "doc_id", "text").alias("h")).collect()
    sources = sorted({r.source for r in hashed}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len((r.text or "").split()) for r in hashed if r.source == s) for s in sources}
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    left, target, open_ = 1.5 * sum(size.values()), {}, list(sources)
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        for s in over or open_:
            target[s] = 2.0 * size[s] if over else share[s]
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s in over] and [s for s in open_ if s not in over] if over else []
    quota = dict(zip(sources, seats_of([target[s] for s in sources], math.floor(sum(target.values()) / block + 0.5)), strict=True))
    starts = spark.createDataFrame([(s,) for s in sources], "source string").select("source", F.xxhash64(F.lit(5), "source", F.lit(0).cast("long")).alias("x"))
    first = {r.source: r.x for r in starts.collect()}
    want = []
    for s in sources:
        held = -(-size[s] // block)
        taken = min(quota[s], 2 * held)
        turns, run = divmod(taken, held)
        chosen = {(first[s] % held + k) % held for k in range(run)}
        at = 0
        for r in sorted((r for r in hashed if r.source == s), key=lambda r: (r.h, r.doc_id is not None, r.doc_id or 0)):
            n = len((r.text or "").split())
            want.append((r.doc_id, n, size[s], turns * n + sum((at + k) // block in chosen for k in range(n))))
            at += n
    assert sorted(((r["__row"].doc_id, r.size, r.source_size, r.taken) for r in got), key=str) == sorted(want, key=str)
    assert all(r.target == pytest.approx(target[r["__row"].source]) for r in got)
    mixed = Counter(rows_of(STAGES["source_mix"](spark, docs, tables)))
    once = Counter()
    for r in mixing.mix(docs).collect():
        once[tuple(r["__row"])] += math.floor(r.taken / r.size + 0.5) if r.size else 0
    assert mixed == +once


def test_last_stage_and_whole_run(spark, tables):
    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, tables, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
    ran = corpus_pipeline.run(spark, tables)
    rows = ran.collect()
    assert rows_of(ran) == rows_of(docs) and rows
    assert all(r.ids == coder.encode_ordinary(r.text or "") for r in rows)


def test_run_on_empty_and_null_tables(spark, tables, tmp_path):
    docs, labels = table(spark, tables, "documents"), table(spark, tables, "labels")
    none = F.lit(None)
    cases = {
        "empty": docs.limit(0),
        "null": docs.select("doc_id", none.cast("string").alias("text"), none.cast("string").alias("lang"), none.cast("string").alias("source"), "n_chars"),
        "no_ids": docs.withColumn("doc_id", none.cast("long")),
    }
    for name, rows in cases.items():
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(found) > 0) == (name == "no_ids"), name
        assert all(r.doc_id is None for r in found)
