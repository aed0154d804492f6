"""Aligned tokens against the libraries and a plain count of all links."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tideline.llm import token_links

PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "don't", "1", "23", "é", "日本", "𝒳", "!", "<|endoftext|>", "<s>", "▁", "the", "ing", "ABC", " "]
PARTS += ["\x1c", "\x85", "ß", "\x00", "internationalisation", "<0x41>", "ﬁ", "Å", "====", "base64/QUJDREVGR0g="]
SCHEMA = "doc_id long, text string, n_a string, a int, at long"


def made(n: int):
    rng = random.Random(9)
    texts = [None, "", " ", "same words", "same words", "x y " * 500, "日本語" * 300, " " * 3000, "=" * 5000, "<|endoftext|>"]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)]
    return [(None if i % 11 == 3 else i % 50, t, "old", i, None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(token_links.FIRST))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_links.SECOND))
    with open(public_tokenizers.path(token_links.FIRST), encoding="utf-8") as file:
        shown = {i: t for t, i in json.load(file)["model"]["vocab"].items()}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}

    def encode(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        tokens_a = [(i, bytes(byte[c] for c in shown[i])) for i in ids_a]
        tokens_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids_b]
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(t for _, t in tokens) != whole for tokens in (tokens_a, tokens_b)):
            return [], []
        return tokens_a, tokens_b

    return encode


def groups(tokens_a, tokens_b):
    """Groups of ids: tokens between neighbouring offsets at which both sides have an end."""
    def ends(tokens):
        return np.cumsum([len(t) for _, t in tokens]).tolist()

    both = sorted(set(ends(tokens_a)) & set(ends(tokens_b)))
    out = [([], []) for _ in both]
    for side, tokens in enumerate((tokens_a, tokens_b)):
        for (i, _), end in zip(tokens, ends(tokens), strict=True):
            out[next(k for k, e in enumerate(both) if end <= e)][side].append(i)
    return out


def plain(rows, encode):
    cut = [groups(*encode(text)) for _, text, *_ in rows]
    links = [Counter((a, b) for left, right in g for a in left for b in right) for g in cut]
    holds = Counter(pair for found in links for pair in found)
    most = defaultdict(int)
    for (a, _), n in holds.items():
        most[a] = max(most[a], n)
    out = []
    for (id, *_), g, found in zip(rows, cut, links, strict=True):
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in g)
        out.append((
            id, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), found.total(),
            sum(n for (a, b), n in found.items() if holds[a, b] == most[a]), sum(n * holds[p] for p, n in found.items()),
            hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return sorted(out, key=str)


@pytest.mark.parametrize("listed,hot", [(1 << 12, 20_000), (1, 40)])
def test_links_are_those_of_a_plain_count(spark, libraries, monkeypatch, listed, hot):
    from tideline.llm import common

    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(token_links, "CHARS", 500 if listed == 1 else 1 << 18)
    monkeypatch.setattr(token_links, "LISTED", listed)
    rows = made(150)
    found = token_links.link_counts(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    got = [(r["__row"].doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found]
    assert sorted(got, key=str) == plain(rows, libraries)


def test_large_groups_count_like_listed_ones(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 400), rng.integers(0, 9, 300)
    a_last, b_last = np.array([0, 99, 100, 399]), np.array([0, 1, 199, 299])
    exact = Counter()
    for x0, x1, y0, y1 in zip([0, 1, 100, 101], [1, 100, 101, 400], [0, 1, 2, 200], [1, 2, 200, 300], strict=True):
        exact.update((int(x), int(y)) for x in a[x0:x1] for y in b[y0:y1])
    for listed in (1, 1 << 20):
        monkeypatch.setattr(token_links, "LISTED", listed)
        pairs, times, many = token_links.links_of(a, b, a_last, b_last, np.array([3, 3, 3, 3]), 10)
        got = {(int(p // 10 % 10), int(p % 10)): int(t) for p, t in zip(pairs, times, strict=True)}
        assert got == exact and many.sum() == exact.total() and set(pairs // 100) == {3}


def test_galloping_finds_all_common_ends():
    rng = random.Random(4)
    for n, m in [(0, 0), (0, 3), (1, 1), (3, 900), (200, 220), (900, 2), (500, 900), (999, 999)]:
        for high in (1000, 5000):
            x, y = (np.array(sorted(rng.sample(range(1, high), k)), np.int64) for k in (n, m))
            left, right = token_links.groups_of(x, y)
            assert x[left].tolist() == y[right].tolist() == sorted(set(x.tolist()) & set(y.tolist()))
    x, y = np.arange(1, 3000), np.concatenate([np.arange(5, 50), np.arange(2000, 9000, 3)])  # long leaps
    left, right = token_links.groups_of(x, y)
    assert x[left].tolist() == y[right].tolist() == sorted(set(x.tolist()) & set(y.tolist()))


def test_ranges_cover_both_sides(spark, libraries):
    rows = made(40)
    for r in token_links.align(spark.createDataFrame(rows, SCHEMA)).collect():
        a, b = libraries(r["__row"].text)
        got = [([i for i, _ in a[g.a_from : g.a_to]], [i for i, _ in b[g.b_from : g.b_to]]) for g in r.groups]
        assert got == groups(a, b) and len(got) == r.n_groups
        assert sum(x.times for x in r.links) == r.n_links


def test_empty_tables(spark):
    assert token_links.link_counts(spark.createDataFrame([], SCHEMA)).count() == 0
