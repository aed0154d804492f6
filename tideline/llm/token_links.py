"""Alignment of the tokens of two tokenizers by the byte offsets where both have an end.

The end offsets of both encodings of a text are ascending lists.  The shorter drives: an
exponential search and then a binary one find each of its ends in the longer, from near where its
neighbours are.
Common ends cut both encodings into groups; the differences of their ranks tell how many tokens
of either side a group holds, so tokens that overlap are found as ranges, without comparing bytes.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.bpe import Tokens
from tideline.llm.common import join_groups, stored

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Texts and characters worked on at once, ends in a lane of the search, and links listed one by one
#: in a group; larger groups are counted per id.
ROWS, CHARS, LANE, LISTED = 256, 1 << 18, 32, 1 << 12


def common_ends(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in both ascending lists of the ends that both hold; ``short`` drives the search.

    Neighbouring ends form lanes, which are searched side by side: a lane starts where its first end
    belongs, each of its ends at as many places on, and from there steps double until they pass the
    end; the last step is halved.
    """
    k, n = np.arange(len(short)), len(long)
    lanes = np.searchsorted(long, short[::LANE])
    padded = np.concatenate([[-1], long, [np.iinfo(np.int64).max]])
    at = np.minimum(lanes[k // LANE] + k % LANE + 1, n + 1)
    low, high = at.copy(), at.copy()  # at the end, padded[low] < end <= padded[high]
    before = padded[at] < short
    moving, step = np.flatnonzero(before), 1
    high[moving] += 1
    while len(moving):
        moving, step = moving[padded[high[moving]] < short[moving]], 2 * step
        low[moving] = high[moving]
        high[moving] = np.minimum(low[moving] + step, n + 1)
    moving, step = np.flatnonzero(~before), 1
    low[moving] -= 1
    while len(moving):
        moving, step = moving[padded[low[moving]] >= short[moving]], 2 * step
        high[moving] = low[moving]
        low[moving] = np.maximum(high[moving] - step, 0)
    moving = np.flatnonzero(high - low > 1)
    while len(moving):
        middle = (low[moving] + high[moving]) >> 1
        less = padded[middle] < short[moving]
        low[moving], high[moving] = np.where(less, middle, low[moving]), np.where(less, high[moving], middle)
        moving = moving[high[moving] - low[moving] > 1]
    hit = padded[high] == short
    return k[hit], high[hit] - 1


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the last tokens of each group on both sides."""
    if len(a_ends) <= len(b_ends):
        return common_ends(a_ends, b_ends)
    return common_ends(b_ends, a_ends)[::-1]


def links_of(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, text: np.ndarray, size: int):
    """Distinct pairs of ids linked in each text, as ``(text * size + a) * size + b`` in order, how often
    each is, and the number of links of each group; ``text`` numbers the text of each group."""
    a_n, b_n = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
    many, base = a_n * b_n, text * size
    one = many == 1
    codes = [(base[one] + a[a_last[one]]) * size + b[b_last[one]]]
    some = np.flatnonzero((many > 1) & (many <= LISTED))
    if len(some):
        each = many[some]
        k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        width = np.repeat(b_n[some], each)
        left = np.repeat(a_last[some] - a_n[some] + 1, each) + k // width
        right = np.repeat(b_last[some] - b_n[some] + 1, each) + k % width
        codes.append((np.repeat(base[some], each) + a[left]) * size + b[right])
    large = np.flatnonzero(many > LISTED)
    if not len(large):
        return *np.unique(np.concatenate(codes), return_counts=True), many
    times = [np.ones(sum(map(len, codes)), np.int64)]
    for g in large:
        x, x_n = np.unique(a[a_last[g] - a_n[g] + 1 : a_last[g] + 1], return_counts=True)
        y, y_n = np.unique(b[b_last[g] - b_n[g] + 1 : b_last[g] + 1], return_counts=True)
        codes.append(((base[g] + x[:, None]) * size + y[None, :]).reshape(-1))
        times.append((x_n[:, None] * y_n[None, :]).reshape(-1))
    pairs, at = np.unique(np.concatenate(codes), return_inverse=True)
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, at, np.concatenate(times))
    return pairs, counts, many


class Aligner:
    """Encodes texts with both tokenizers, as ids and end offsets.

    The byte-level side takes ids and merges from the tokenizer's file; ids must rise in the order of
    merges, which is tested, so that merging by rank gives that tokenizer's encoding.
    """

    def __init__(self, first: str, second: str):
        tokens, _ = Tokens.from_merges(first)
        with open(first, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        self.a = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self._ranks(tokens, vocab), special_tokens={}
        )
        self.a_size = np.zeros(max(vocab.values()) + 1, np.int64)
        for text, rank in self.a._mergeable_ranks.items():
            self.a_size[rank] = len(text)
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_text = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_size = np.array(list(map(len, self.b_text)), np.int64)
        #: Ids as text with what follows: ids of one side of a group, then of the other, then of the next group.
        self.named = [f"{i}{end}" for end in ",|" for i in range(len(self.a_size))]
        self.b_named = len(self.named)
        self.named += [f"{i}{end}" for end in ",;" for i in range(len(pieces))]

    @staticmethod
    def _ranks(tokens: Tokens, vocab: dict[str, int]) -> dict[bytes, int]:
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable}
        shown |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {text: vocab["".join(map(shown.__getitem__, text))] for text in tokens.texts}
        merged = [ranks[text] for text in tokens.texts[256:]]
        if merged != sorted(merged) or min(merged, default=256) < 256:
            raise ValueError("ids do not follow the order of merges")
        return ranks

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids on both sides of every text; none where either side's bytes are not blank and text."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            whole = f" {text}".encode()
            a = self.a.encode_ordinary(f" {text}") if text else []
            if not text or b"".join(map(self.b_text.__getitem__, b)) != whole or self.a.decode_bytes(a) != whole:
                a, b = [], []
            out.append((np.array(a, np.int64), np.array(b, np.int64)))
        return out

    def align(self, texts: list[str]) -> Aligned:
        """Groups and links of some texts, worked out end to end: as both sides of a text have the same
        bytes, its last ends are common and no group crosses from one text to the next."""
        coded = self.encode(texts)
        a, b = (np.concatenate([c[side] for c in coded]) for side in (0, 1))
        a_to, b_to = (np.cumsum([len(c[side]) for c in coded]) for side in (0, 1))
        a_last, b_last = groups_of(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
        to = np.searchsorted(a_last, a_to)  # groups up to the end of each text
        text = np.repeat(np.arange(len(texts)), np.diff(to, prepend=0))
        size = max(len(self.a_size), len(self.b_size))
        pairs, times, many = links_of(a, b, a_last, b_last, text, size)
        links = np.bincount(text, weights=many, minlength=len(texts)).astype(np.int64)
        return Aligned(
            a_to, b_to, to, a_last, b_last, links, pairs // size % size, pairs % size, times,
            np.searchsorted(pairs // size // size, np.arange(len(texts)), side="right"), self.digests(a, b, a_last, b_last, a_to + b_to),
        )

    def digests(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, to: np.ndarray) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3``, the ids of all groups, of each text; '' without tokens."""
        a_n, b_n = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        laid, codes, own = np.empty(len(a) + len(b), np.int64), a.copy(), b + self.b_named
        codes[a_last] += len(self.a_size)
        own[b_last] += len(self.b_size)
        laid[np.arange(len(a)) + np.repeat(np.cumsum(b_n) - b_n, a_n)] = codes
        laid[np.arange(len(b)) + np.repeat(np.cumsum(a_n), b_n)] = own
        names = list(map(self.named.__getitem__, laid.tolist()))
        texts = ("".join(names[i:j])[:-1] for i, j in zip([0, *to[:-1].tolist()], to.tolist(), strict=True))
        return [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]


class Aligned(NamedTuple):
    """Groups and links of some texts end to end; ``a_to, b_to, to, links_to`` are the ends of each
    text's tokens, groups and distinct links."""

    a_to: np.ndarray
    b_to: np.ndarray
    to: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray
    links: np.ndarray
    a: np.ndarray
    b: np.ndarray
    times: np.ndarray
    links_to: np.ndarray
    digests: list[str]

    def columns(self, ranges: bool) -> list[pa.Array]:
        counts = [np.diff(x, prepend=0) for x in (self.a_to, self.b_to, self.to)] + [self.links]
        made = [pa.array(x, pa.int64()) for x in counts] + [pa.array(self.digests, pa.string())]
        made.append(_lists(self.links_to, [self.a, self.b, self.times], LINK))
        if ranges:
            text = np.repeat(np.arange(len(self.to)), counts[2])
            spans = []
            for last, to in ((self.a_last, self.a_to), (self.b_last, self.b_to)):
                begin = np.concatenate([[0], to])[text]
                spans += [np.concatenate([[0], last + 1])[: len(last)] - begin, last + 1 - begin]
            made.append(_lists(self.to, spans, RANGE))
        return made


@lru_cache(maxsize=1)
def aligner(first: str, second: str) -> Aligner:
    return Aligner(first, second)


RANGE = pa.struct([(n, pa.int32()) for n in ("a_from", "a_to", "b_from", "b_to")])
LINK = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int32())])


def _lists(to: np.ndarray, flat: list[np.ndarray], kind: pa.StructType) -> pa.ListArray:
    """A list of structs per row, from the ends of rows and the fields end to end."""
    ends = np.concatenate([[0], to]).astype(np.int32)
    fields = [pa.array(x.astype(np.int32)) for x in flat]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names=[f.name for f in kind]))


def _some(texts: list[str]):
    """Ranges of texts that are worked on at once: few, and not many characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and (size + len(t) > CHARS or i - begin == ROWS):
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if texts:
        yield begin, len(texts)


def align(df: DataFrame, text: str = "text", carry: list[str] | None = None, ranges: bool = True,
          first: str | None = None, second: str | None = None) -> DataFrame:
    """Align the tokens of every whole text; rows stay apart, nothing is shuffled.

    Gives ``__row`` (the columns to carry, all of ``df``), ``n_a, n_b, n_groups, n_links,
    groups_sha256`` and ``links``, the distinct pairs of linked ids with their number of links; with
    ``ranges`` also ``groups``, the ranges of token ranks of each group, ends excluded.  Null and
    empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens:
    zeros, no groups, and '' for the digest.
    """
    paths = first or public_tokenizers.path(FIRST), second or public_tokenizers.path(SECOND)
    kept = df.select(F.struct(*[F.col(f"`{c}`") for c in carry or df.columns]).alias("__row"), F.col(f"`{text}`").alias("text"))
    counted = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches):
        own = aligner(*paths)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, j in _some(texts):
                made = own.align(texts[i:j]).columns(ranges)
                names = ["__row", *counted, "groups_sha256", "links", "groups"]
                yield pa.RecordBatch.from_arrays([batch.column("__row").slice(i, j - i), *made], names=names[: 1 + len(made)])

    kinds = [f"{n} long" for n in counted] + ["groups_sha256 string", "links array<struct<a:int,b:int,times:int>>"]
    kinds += ["groups array<struct<a_from:int,a_to:int,b_from:int,b_to:int>>"] if ranges else []
    return kept.mapInArrow(run, ", ".join([f"__row {kept.schema['__row'].dataType.simpleString()}", *kinds]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, documents, best``, stored: how many rows link the pair, and whether no pair of its ``a`` has more.

    Rows list a pair once, so counting needs partial counts only.  The highest counts are one row per id
    of the first vocabulary, which bounds their broadcast."""
    listed = aligned.select(F.inline("links"))
    counted = stored(listed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("documents")), "pairs")
    highest = counted.groupBy(F.col("a").alias("__a")).agg(F.max("documents").alias("__most"))
    joined = counted.join(F.broadcast(highest), F.col("a") == F.col("__a"))
    return joined.select("a", "b", "documents", (F.col("documents") == F.col("__most")).alias("best"))


def link_counts(df: DataFrame, text: str = "text", carry: list[str] | None = None, **paths) -> DataFrame:
    """``align`` of every row (without ranges and links), with ``n_best`` and ``count_sum`` over its links.

    A pair of ids counts the rows of the table that link it.  ``n_best`` is the number of links whose
    count is the highest of their first id, ties included; ``count_sum`` sums the counts of all links;
    both are 0 without links.  Rows are told apart by their place, so repeated rows and ids count
    each.  Links of common pairs meet their counts by broadcast, the others by shuffle, and both are
    summed per row before they move on.
    """
    numbered = df.select(F.struct(*[F.col(f"`{c}`") for c in carry or df.columns]).alias("own"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("at"))
    rows = stored(align(numbered, carry=["own", "at"], ranges=False, **paths), "aligned")
    counts = stored(pair_counts(rows).withColumn("pair", F.expr("shiftleft(CAST(a AS bigint), 32) | b")).drop("a", "b"), "counts")
    links = rows.select(F.col("__row.at").alias("at"), F.inline("links"))
    links = links.select("at", F.expr("shiftleft(CAST(a AS bigint), 32) | b").alias("pair"), "times")
    total = counts.agg(F.sum("documents")).first()[0] or 0
    met = join_groups(links, counts, ["pair"], "documents", total)
    sums = met.groupBy("at").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("documents") * F.col("times")).alias("count_sum")
    )
    none = F.lit(0).cast("long")
    return rows.join(sums.withColumnRenamed("at", "__at"), F.col("__row.at") == F.col("__at"), "left").select(
        F.col("__row.own").alias("__row"), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256",
    )
