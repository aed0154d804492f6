"""Token counts and byte-level BPE against the libraries they reproduce."""

import base64
import hashlib
import random
import time
from sys import getsizeof

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm import byte_bpe, token_counts
from tideline.llm.common import TextMemo

PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'re", "'ll", "'", "1", "23", "é", "日本", "𝒳", "!", "...", "<|endoftext|>", "<|end"]
PARTS += ["the", "ing", "ABC", " ", "\x1c", "\x85", "ß", "don't", "\r\n", "\x00"]
TEXTS = [None, "", " ", "word", "a" * 3000, "x y " * 2000, "日本語 " * 500, "<|endoftext|>", "same", "same"]


def made(n: int, size: int = 12):
    rng = random.Random(5)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))


@pytest.fixture(scope="module")
def coder():
    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_has_its_exact_count(library):
    own = token_counts.counter(public_tokenizers.path(token_counts.VOCABULARY))
    for text in made(200):
        table = own.table(text)
        exact = [count(library, text[:p]) for p in range(len(text) + 1)]
        assert [table.at(p) for p in range(len(text) + 1)] == exact
        for budget in range(6):
            assert table.fit(budget) == max(p for p, n in enumerate(exact) if n <= budget)


def test_counts_of_rows(spark, library):
    texts = TEXTS + made(50, 200)
    df = spark.createDataFrame([(i if i else None, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long")
    rows = token_counts.count_tokens(df, limit=20).collect()
    assert len(rows) == len(texts) and rows[0].asDict().keys() == {"doc_id", "text", "n_bytes", "n_tokens", "over_limit", "fit_chars"}
    for r in rows:
        t = r.text or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), count(library, t), count(library, t) > 20)
        assert count(library, t[: r.fit_chars]) <= 20
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_ids_are_those_of_the_library(spark, coder):
    texts = TEXTS + made(100, 300)
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    coded = byte_bpe.decode(byte_bpe.encode(df))
    for r in coded.collect():
        assert r.ids == coder.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    for r in byte_bpe.round_trip(df, ids="ids").collect():
        ids = coder.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert byte_bpe.round_trip(df.limit(0)).count() == 0
    none = df.withColumn("ids", F.lit(None).cast("array<int>"))
    assert {bytes(r.decoded) for r in byte_bpe.decode(none).collect()} == {b""}


def test_long_pieces_take_linear_steps(coder):
    own = byte_bpe.coder(public_tokenizers.path(byte_bpe.RANKS))
    rng = random.Random(1)
    for text in ("a" * 20_000, "".join(rng.choice("abe") for _ in range(5000)), "é" * 5000):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == coder.encode_ordinary(text)


def test_budgets_of_texts_without_blanks_take_linear_steps(library):
    own = token_counts.counter(public_tokenizers.path(token_counts.VOCABULARY))
    rng = random.Random(2)
    size = 100_000
    for text in (
        "".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(size)),
        base64.b64encode(rng.randbytes(size * 3 // 4)).decode(),
        " " * size,
        "ab" * (size // 2) + "<|endoftext|>",
    ):
        began = time.perf_counter()
        table = own.table(text)
        fits = {budget: table.fit(budget) for budget in (512, table.total - 1)}
        assert time.perf_counter() - began < 4
        for budget, p in fits.items():
            assert table.at(p) <= budget and p < len(text)
        for p in (*range(500), *(rng.randrange(3000) for _ in range(20))):
            assert table.at(p) == count(library, text[:p])
        assert table.total == count(library, text)


def test_texts_over_the_limit_are_read_once(library):
    """A text over the limit was cut and looked up twice, and remembered pieces held a count per character."""
    own = token_counts.PrefixCounter(public_tokenizers.path(token_counts.VOCABULARY))
    pattern, read = own.chunks, []

    class Seen:
        def findall(self, text):
            read.append(len(text))
            return pattern.findall(text)

    own.chunks = Seen()
    for text in ("some words, here. " * 500, "some words<|endoftext|> here. " * 500):
        read.clear()
        n, fit = own.measure(text, 512)
        assert n == count(library, text) and count(library, text[:fit]) <= 512 < count(library, text[: fit + 1])
        assert sum(read) < 1.1 * len(text)
    assert own.piece and all(isinstance(n, int) for n in own.piece.values())


def test_chunks_and_pieces_share_one_memo(coder):
    """Words stood in two memos, once as chunks and once as pieces, of two generations each."""
    own = byte_bpe.ByteCoder(public_tokenizers.path(byte_bpe.RANKS))
    for text in [*filter(None, TEXTS), *made(200, 40), "word. word, (word) don't ''s x''re"]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == coder.encode_ordinary(text)
    assert [type(x) for x in vars(own).values()].count(TextMemo) == 1
    assert {"word.", "word", "."} <= own.packed.keys()


def test_memos_are_bounded_by_bytes():
    made = []
    memo = TextMemo(lambda key: made.append(key) or key * 2, limit=5000)
    keys = [str(k).zfill(50) for k in range(200)]
    for key in keys:
        assert memo[key] == key * 2
        held = sum(memo.ENTRY + getsizeof(k) + getsizeof(v) for part in (memo, memo.old) for k, v in part.items())
        assert held <= 2 * 5000
    assert memo[keys[-1]] and len(made) == 200  # remembered
    assert memo["x" * 65] and memo["x" * 65] and len(made) == 202 and "x" * 65 not in memo  # long ones are not
