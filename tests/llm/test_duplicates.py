"""Near duplicates of vectors and texts against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tideline.llm import jaccard, lattice
from tideline.llm.components import components


def reach(nodes, linked):
    """Smallest node reachable from each."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    return {n: root(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, k) for k in range(501, 540)] + [(rng.randint(600, 900), rng.randint(600, 900)) for _ in range(150)]
    df = spark.createDataFrame(edges + [(3, 3)], "a long, b long")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == reach(nodes, edges)
    assert components(df.limit(0), "a", "b").count() == 0


def test_nearest_lattice_points():
    rng = np.random.default_rng(1)
    roots = lattice._roots()
    assert len(roots) == 240 and set((roots**2).sum(axis=1)) == {8}
    x = rng.standard_normal((200, 8)) * 2
    near = lattice.nearest(x)
    own = ((x - near / 2) ** 2).sum(axis=1)
    others = ((x[:, None] - (near[:, None] + roots) / 2) ** 2).sum(axis=2).min(axis=1)
    assert (own <= others + 1e-12).all()


def vectors():
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for label in (0, 1):
        for centre in rng.standard_normal((40, 16)):
            for _ in range(int(rng.integers(1, 25))):
                v = centre + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.09])
                rows.append((k, [float(np.float32(x)) for x in v], label, "old"))
                k += 1
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e300, 2e300]]
    for v in odd:
        rows.append((k, v, 0, "old"))
        k += 1
    rows += [(k, rows[0][1], None, "old"), (k + 1, rows[0][1], 1, "old"), (None, rows[0][1], 0, "old")]
    return rows


def test_near_vectors_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 7)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, kept string")
    got = lattice.near_duplicates(df).collect()
    assert len(got) == len(rows)

    def usable(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def unit(v):
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    good = [i for i, r in enumerate(rows) if r[2] is not None and usable(r[1])]
    links = []
    for a, i in enumerate(good):
        for j in good[:a]:
            same = rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1])
            if same and unit(rows[i][1]) @ unit(rows[j][1]) >= 0.98:
                links.append((i, j))
    keys = [r[0] if r[0] is not None else 10**9 for r in rows]
    low = reach(sorted(range(len(rows)), key=lambda i: keys[i]), links)
    # roots are by position, which follows the keys but for the null one, placed last
    degree = np.zeros(len(rows), int)
    for i, j in links:
        degree[[i, j]] += 1
    total = sum(r.n_links for r in got)
    assert 0.97 * degree.sum() <= total <= degree.sum()
    by_key = {r["__row"].vec_id: r for r in got}
    exact = [i for i, r in enumerate(rows) if by_key[r[0]].n_links == degree[i]]
    assert len(exact) > 0.97 * len(rows)
    for i in exact[:: max(1, len(exact) // 200)]:
        r = by_key[rows[i][0]]
        if rows[i][0] is not None and total == degree.sum():
            assert r.component_id == keys[low[i]] and r.kept == (keys[low[i]] == rows[i][0])
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def texts():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    rows, k = [], 0
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((k, " ".join(copy).upper() if k % 3 else "\t".join(copy)))
            k += 1
    many = [rng.choice(words) for _ in range(100)]
    for _ in range(70):
        copy = list(many)
        copy[rng.randrange(100)] = rng.choice(words)
        rows.append((k, " ".join(copy)))
        k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \n"), (k + 3, "one two"), (k + 4, "ONE  two"), (k + 5, "one two three four five"), (k + 6, "É é"), (k + 7, "é É")]
    rows += [(k + 8, " ".join(f"u{i}" for i in range(40_000))), rows[0], rows[0], (None, rows[0][1])]
    return rows


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    groups = reach(range(len(rows)), links)
    low = {}
    for i, g in groups.items():
        if rows[i][0] is not None:
            low[g] = min(low.get(g, rows[i][0]), rows[i][0])
    return sets, {i: low.get(g) for i, g in groups.items()}


def test_text_groups_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBERS", 5)
    monkeypatch.setattr(jaccard, "STEP", 2000)
    rows = texts()
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, n string").repartition(5)
    sets, low = expected(rows)
    want = sorted((str(r[0]), len(sets[i]), str(low[i])) for i, r in enumerate(rows))
    got = sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in jaccard.join(df).collect())
    assert got == want
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    alone = [i for i in range(len(rows)) if not sets[i]]
    assert kept.count() == len(alone) + len({low[i] for i in range(len(rows)) if sets[i]})
    assert jaccard.join(df.limit(0)).count() == 0 and jaccard.keep_one(df.limit(0)).count() == 0


def test_order_of_shingles_changes_no_result(spark, monkeypatch):
    rows = texts()[::3]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(str, jaccard.join(df).collect()))
    monkeypatch.setattr(jaccard, "slot_counts", lambda counted: np.arange(jaccard.SLOTS).astype(np.uint16))
    monkeypatch.setattr(jaccard, "PARTS", 2)
    monkeypatch.setattr(jaccard, "HOT", -(10**6))
    assert sorted(map(str, jaccard.join(df.select(F.col("doc_id"), "text")).collect())) == one


def test_signing_takes_one_worker_a_task(spark):
    """Class numbers came from a pandas function behind the one that signs: two workers a task, each with pandas."""
    rows = [(i, t) for i, t in enumerate(["a b c d e f g h", "a b c d e f g h", "x y", "", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for made in (jaccard.join(df), jaccard.keep_one(df)):
        assert "ArrowEvalPython" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in jaccard.keep_one(df).collect()) == [0, 2, 3, 4]


def test_another_salt_gives_other_class_numbers(spark):
    rows = spark.createDataFrame([("a b", 1), ("a b", 2), ("c", 3)], "text string, doc_id long")
    signed = jaccard.with_sets(jaccard.hashed_words(rows, "text", ["doc_id"])).where("part is null").drop("own", "part")
    first, other = ({r["__row"].doc_id: r.cid for r in x.collect()} for x in (signed, jaccard._renumbered(signed, 1)))
    plain = {r["__row"].doc_id: r.cid for r in jaccard.signed(jaccard.hashed_words(rows, "text", ["doc_id"]), 1).collect()}
    assert first[1] == first[2] != first[3] and other[1] == other[2] != other[3] and first[1] != other[1]
    assert other == plain


def test_parity_bits_differ_in_no_more_places_than_sets():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 900).astype(np.uint64)
    sets = [np.unique(rng.choice(base, n)) for n in (0, 1, 5, 130, 400, 900)]
    bits = jaccard.parities(sets)
    assert bits.shape == (len(sets), len(jaccard.MARKS))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)).sum() <= len(np.setxor1d(x, y))
    assert not len(jaccard.parities([]))


def test_variants_that_do_not_link_make_few_pairs(spark, monkeypatch):
    """Variants of one text, each out of reach of the others, were all compared with each other."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(4000)]
    base, rows = [rng.choice(words) for _ in range(130)], []
    for k in range(160):
        copy = list(base)
        for at in rng.sample(range(130), 3):
            copy[at] = f"own{k}x{at}"
        rows.append((k, " ".join(copy)))
        if k % 16 == 0:
            rows.append((1000 + k, " ".join(copy[:-1])))
    counted, whole = [], jaccard.needed_sets
    monkeypatch.setattr(jaccard, "needed_sets", lambda sets, pairs, salt: counted.append(pairs.count()) or whole(sets, pairs, salt))
    got = {r.id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    _, low = expected(rows)
    assert got == {r[0]: low[i] for i, r in enumerate(rows)}
    assert len(set(got.values())) > 50
    assert sum(counted) < 10 * len(rows), counted


def test_rows_alone_in_their_component_are_not_shuffled(spark, monkeypatch):
    """All texts were shuffled to find the rows that stay."""
    rows = [(k, " ".join(f"t{k}w{i}" for i in range(12))) for k in range(60)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + " more"), (None, rows[2][1]), (3, rows[3][1]), (104, ""), (105, None), (106, "")]
    seen, signed = [], jaccard.signed
    monkeypatch.setattr(jaccard, "signed", lambda *a: seen.append(signed(*a)) or seen[-1])
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(60), 104, 105, 106]
    assert {r["__row"].doc_id for r in seen[0].where("hit AND n > 0").collect()} == {0, 1, 2, 3, 100, 101, None}
