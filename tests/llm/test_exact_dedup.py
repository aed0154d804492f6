"""Exact dedup against plain grouping, and the index over several loads and sessions."""

import hashlib
import re
from collections import defaultdict

from tideline.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, row string, load string"
TEXTS = ["a b", "a  b", "a\tb", "a\x0bb", "a b", "", None, " ", "  ", "b a", "x" * 200_000, "é\n\né", "é é"]


def made():
    texts = TEXTS + ["hot  copy"] * 40 + ["hot copy"] * 40 + TEXTS
    rows = [(1000 - i if i % 9 else None, t, "old", None, "x") for i, t in enumerate(texts)]
    return rows + [(5, "a b", None, None, None), (5, "a b", None, None, None), (None, "none", "", "", ""), (None, "none", "", "", "")]


def plain(rows):
    """Rows as ``(id, keep_id, size, digest)`` and how many are kept of each digest."""
    groups = defaultdict(list)
    for id, text, *_ in rows:
        groups[hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", text or "").encode()).hexdigest()].append(id)
    out = []
    for digest, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), digest) for i in ids]
    return sorted(out, key=str)


def checked(found, rows):
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == plain(rows)
    kept = defaultdict(list)
    for r in found:
        if r.kept:
            kept[r.text_sha256].append(r)
    assert all(len(k) == 1 and k[0].doc_id == k[0].keep_id for k in kept.values())
    assert len(kept) == len({r.text_sha256 for r in found})


def test_rows_are_those_of_plain_grouping(spark):
    df = spark.createDataFrame(made(), SCHEMA).repartition(6)
    index = exact_dedup.fresh_index(spark)
    found = exact_dedup.deduplicate(exact_dedup.two_loads(df), index)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    checked(found.collect(), made())
    assert index.rows().count() == len({r.text_sha256 for r in found.collect()})


def test_hot_groups_and_others_are_joined_alike(spark, monkeypatch):
    from tideline.llm import common

    monkeypatch.setattr(common, "HOT", 3)  # only groups over a third of all rows are broadcast
    df = spark.createDataFrame(made(), SCHEMA)
    checked(exact_dedup.deduplicate([df], exact_dedup.fresh_index(spark)).collect(), made())


def test_index_outlives_its_session(spark, folder):
    first = spark.createDataFrame([(7, "a  b", "", "", ""), (3, "c", "", "", ""), (9, "a b", "", "", "")], SCHEMA)
    exact_dedup.deduplicate([first], exact_dedup.DigestIndex(spark, str(folder), buckets=3))
    other = spark.newSession()
    again = exact_dedup.DigestIndex(other, str(folder), buckets=8)
    assert again.buckets == 3 and again.rows().count() == 2
    more = [(1, "a\tb", "", "", ""), (2, "new", "", "", ""), (4, "new ", "", "", ""), (3, "c", "", "", "")]
    found = exact_dedup.deduplicate([other.createDataFrame(more, SCHEMA)], again).collect()
    got = {(r.doc_id, r.keep_id, r.kept, r.group_size) for r in found}
    # 1 has a text the index knows as 7; 3 is the very row that the index has, loaded again
    assert got == {(1, 7, False, 1), (2, 2, True, 1), (4, 4, True, 1), (3, 3, True, 1)}
    assert again.rows().count() == 4


def test_a_load_can_be_repeated(spark):
    df = spark.createDataFrame(made(), SCHEMA)
    index = exact_dedup.fresh_index(spark)
    index.append(exact_dedup.firsts(exact_dedup.digests(df)))
    size = index.rows().count()
    checked(exact_dedup.deduplicate([df], index).collect(), made())
    assert index.rows().count() == size


def test_index_side_is_neither_shuffled_nor_broadcast(spark):
    df = spark.createDataFrame(made(), SCHEMA)
    index = exact_dedup.fresh_index(spark)
    rows = exact_dedup.digests(df)
    index.append(exact_dedup.firsts(rows))
    plan = index.unseen(exact_dedup.firsts(rows))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Python" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    index = exact_dedup.fresh_index(spark)
    assert exact_dedup.deduplicate(exact_dedup.two_loads(df), index).count() == 0 and index.rows().count() == 0
