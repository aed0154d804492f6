"""Language identification and toxicity: exact parts by enumeration, the rest on held-out rows."""

import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tideline.llm import langid, toxicity
from tideline.llm.common import held_out, table

SF = "/root/testdata/sf0.01"


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(public_tokenizers.path(langid.VOCABULARY))
    rng = np.random.default_rng(3)
    chances = np.zeros((len(pieces.hashes) + 1, 2))
    chances[:-1] = rng.random((len(pieces.hashes), 2))
    model = langid.Model(pieces, ["x", "y"], chances)

    def chance(text):
        n = len(text)
        total = np.zeros(2)
        for mask in range(1 << (n - 1)):
            ends = [0, *[i + 1 for i in range(n - 1) if mask >> i & 1], n]
            product = np.ones(2)
            for a, b in pairwise(ends):
                p = pieces.find(langid.Pieces.prefixes(np.array([[ord(c) for c in text[a:b]]], np.uint64)), 0, b - a)[0]
                product *= chances[p] if p < len(pieces.hashes) else langid.UNKNOWN if b - a == 1 else 0.0
            total += product
        return total

    for word in ("the", "hätte", "q§z", "aaaa"):
        assert model.word_scores([word])[0] == pytest.approx(np.log(chance(langid.START + word)))
    long = model.word_scores(["ab" * 400])[0]
    assert np.isfinite(long).all()


def test_languages_of_held_out_rows(spark):
    docs = table(spark, SF, "documents").withColumn("out", held_out(F.col("doc_id"))).withColumn("score", F.lit("old"))
    model = langid.train(docs.where("not out"))
    got = langid.identify(docs, model)
    assert got.where("out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "der " * 60_000), (4, "der " * 60_000), (None, "²")], "doc_id long, text string")
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert {rows[k].lang_pred for k in (1, 2, 3, None)} == {"und"} and rows[4].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in rows.values())
    empty = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


def test_held_out_is_by_checksum(spark):
    ids = [1, 25, 300, None]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select("i", held_out(F.col("i")).alias("o")).collect()
    assert {r.i: r.o for r in got} == {i: i is None or zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    network = toxicity.Network({k: v.astype(float) for k, v in toxicity.Network.fresh(rng).w.items()})
    x = rng.standard_normal((6, 5, 2 * toxicity.WIDTH))
    mask = (np.arange(6)[:, None] < np.array([6, 3, 5, 1, 6]))[:, :, None].astype(float)
    labels, weights = np.array([1, 0, 1, 0, 1.0]), np.array([1, 2, 1, 0.5, 1.0])

    def loss():
        p = 1 / (1 + np.exp(-network.logits(*network.gates(x), mask)))
        return -(weights * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).mean()

    grads, d_x = network.gradients(x, mask, labels, weights)
    places = [(network.w[k], tuple(rng.integers(0, s) for s in network.w[k].shape), grads[k]) for k in grads]
    for array, at, grad in [*places, (x, (2, 1, 3), d_x)]:
        old, step = array[at], 1e-2
        array[at] = old + step
        up = loss()
        array[at] = old - step
        down = loss()
        array[at] = old
        assert grad[at] == pytest.approx((up - down) / 2 / step, rel=0.05, abs=1e-4)


def test_windows_cover_every_word():
    sizes = np.array([0, 1, 32, 33, 100])
    owner, first = toxicity.windows(sizes)
    for k, n in enumerate(sizes):
        covered = {w for f in first[owner == k] for w in range(f, min(n, f + toxicity.WINDOW))}
        assert covered == set(range(n))


def test_toxicity_of_held_out_rows(spark):
    n = 600
    bad = ["zorgu", "zorgan", "blikto"]
    rows = []
    for i in range(n):
        words = [f"{'abcdefgh'[(i + k) % 8]}{'lmnop'[k % 5]}{'ae'[(i * k) % 2]}{k % 7}" for k in range(20 + i % 50)]
        toxic = i % 4 == 0
        if toxic:
            words[i % len(words)] = bad[i // 4 % 3] + ("x" if i % 8 else "")
        rows.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("out", held_out(F.col("doc_id")))
    network = toxicity.train(df.where("not out"), df.select("doc_id", "toxic"))
    got = toxicity.score(df.withColumn("score", F.lit("old")), network)
    right = F.avg((F.col("toxic") == F.col("predicted")).cast("int"))
    assert got.where("out").select(right).first()[0] > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "!?"), (4, ("fine words " * 20_000) + "zorgux"), (4, "a"), (4, "a")], "doc_id long, text string")
    scores = toxicity.score(odd, network).collect()
    assert len(scores) == 6 and all(0 <= r.score <= 1 for r in scores)
    assert {r.score for r in scores if r.doc_id < 4} == {0.0}
    assert toxicity.score(odd.limit(0), network).count() == 0
    blank = toxicity.train(df.limit(0), df.select("doc_id", "toxic"))
    assert toxicity.score(odd, blank).count() == 6
