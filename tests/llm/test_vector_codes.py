"""Vector codes against a full search over all entries."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, parts int"


def made(n: int, width: int = 16):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 12]], i % 5 if i % 7 else None, "old", 1) for i in range(n)]
    rows += [(n, None, 1, "", 0), (n + 1, [1.0] * (width - 1) + [float("nan")], 1, "", 0), (n + 2, [None] * width, 1, "", 0)]
    rows += [(n + 3, [float("inf")] * width, 1, "", 0), (n + 4, [-0.0001] * width, 1, None, None), (n + 4, [-0.0001] * width, 1, None, None)]
    return rows + [(None, [0.25] * width, None, "", 0), (n + 6, [3e38] * width, 2, "", 0), (n + 7, [0.5] * 3, 2, "", 0), (n + 8, [], 3, "", 0)]


def plain(rows, entries):
    def fits(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    kept = [r for r in rows if fits(r[1])]
    width = max(len(r[1]) for r in kept)
    width += -width % vc.PARTS
    whole = [[max(-vc.MOST, min(vc.MOST, math.floor(1024 * float(np.float32(x))))) for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    x = np.array(whole, object).reshape(len(kept), vc.PARTS, -1)
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))[:entries]
    books = x[order].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        codes = np.array([[min(range(d.shape[2]), key=lambda k: (row[p][k], k)) for p in range(vc.PARTS)] for row in d])
        return codes, np.array([[row[p][codes[i][p]] for p in range(vc.PARTS)] for i, row in enumerate(d)], object)

    for _ in range(vc.ROUNDS):
        codes, _ = assign()
        for p in range(vc.PARTS):
            for k in range(books.shape[1]):
                if (codes[:, p] == k).any():
                    books[p, k] = x[codes[:, p] == k, p].sum(0) // (codes[:, p] == k).sum()
    codes, d = assign()
    errors = [int(e) for e in d.sum(1)]
    by_label = {}
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    text = ",".join(str(v) for v in books.reshape(-1).tolist())
    found = [(r[0], bytes(c.tolist()).hex(), e, by_label[r[2]]) for r, c, e in zip(kept, codes, errors, strict=True)]
    return sorted(found, key=str), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("n,entries", [(300, 32), (9, 256)])
def test_codes_are_those_of_a_full_search(spark, n, entries):
    rows = made(n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    coded, codec = vc.compress(df, entries=entries)
    got = vc.with_label_error(coded, F.col("__row.label")).collect()
    want, digest = plain(rows, entries)
    assert sorted(((r["__row"].vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert codec.sha256 == digest
    assert {r["__row"].parts for r in got} == {1, 0, None}


def test_search_is_exact_and_prunes():
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, (40, 16))
    entries = centres[np.arange(256) % 40] + rng.integers(-9, 9, (256, 16))
    entries[200] = entries[3]  # ties go to the lower index
    parts = centres[rng.integers(0, 40, 2000)] + rng.integers(-9, 9, (2000, 16))
    parts[:256] = entries
    pivots = vc.spread_out(entries, 8)
    index, best, tried = vc.nearest(parts, vc.to_pivots(parts, pivots), entries, pivots)
    d = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (best == d.min(1)).all() and index[200] == 3
    assert tried < d.size / 5


def test_large_integers_stay_exact():
    entries = np.array([[vc.MOST] * 16, [-vc.MOST] * 16, [vc.MOST] * 15 + [vc.MOST - 1]])
    parts = np.array([[vc.MOST - 1] * 16, [0] * 16, [vc.MOST] * 15 + [vc.MOST - 1]])
    pivots = vc.spread_out(entries, 2)
    index, best, _ = vc.nearest(parts, vc.to_pivots(parts, pivots), entries, pivots)
    assert index.tolist() == [2, 2, 2] and best.tolist() == [15, 16 * vc.MOST**2 - 2 * vc.MOST + 1, 0]


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 2, "", 0)], SCHEMA)
    for none in (df, df.limit(0)):
        coded, codec = vc.compress(none)
        assert codec is None and vc.with_label_error(coded, F.col("__row.label")).count() == 0


def test_codes_decode_to_their_entries(spark):
    rows = made(100)[:100]
    coded, codec = vc.compress(spark.createDataFrame(rows, SCHEMA), entries=64)
    for r in coded.collect():
        back = codec.decode(np.array([list(bytes.fromhex(r.code))]))[0]
        exact = np.floor(1024 * np.array(r["__row"].embedding))
        assert ((back - exact) ** 2).sum() == r.error
