"""Vectors as short codes: one byte per part, exact integer codebooks, distances pruned by pivots.

Components become integers and each vector is cut into equal parts.  The distances of a part to a
few fixed pivots are worked out once and stored.  In every round the distances of the codebook's
entries to the same pivots give, by the triangle inequality, a lower bound for each part and entry:
the largest difference over the pivots.  Entries are tried in the order of their bounds, with exact
integer distances, until the next bound exceeds the best distance found.

Rounds read the stored parts; a task returns sums and counts per entry, so only codebooks, whose
size is fixed by the parameters, reach the driver.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import join_groups, stored

PARTS, ENTRIES, ROUNDS, PIVOTS = 4, 256, 4, 8
SCALE = 1024
#: Integers are held to this size, so that distances and their sums fit 64 bits.
MOST = 1 << 24
#: Vectors worked on at once, and entries tried at once.
ROWS, STEP = 1024, 8


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~odd


def integers(vector: Column, width: int) -> Column:
    """Components as ``floor(1024 x)``, filled up with zeros to ``width``."""
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(MOST + 0.0)), F.lit(-MOST - 0.0))).cast("int"))
    return F.concat(whole, F.array_repeat(F.lit(0), F.lit(width) - F.size(vector)))


def spread_out(entries: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the entries as pivots, each the one farthest from those before; ties to the lower index."""
    chosen, gap = [0], squared(entries, entries[0])
    while len(chosen) < min(n, len(entries)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, squared(entries, entries[chosen[-1]]))
    return entries[chosen]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def to_pivots(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(parts, p) for p in pivots], -1).astype(np.float64)).astype(np.float32)


def nearest(parts: np.ndarray, known: np.ndarray, entries: np.ndarray, pivots: np.ndarray):
    """Index and squared distance of the nearest entry of every part, ties to the lower index, and
    the number of distances worked out.  ``known`` holds the distances of the parts to the pivots."""
    across = to_pivots(entries, pivots)
    bound = np.zeros((len(parts), len(entries)), np.float32)
    for k in range(len(pivots)):
        np.maximum(bound, np.abs(known[:, k, None] - across[None, :, k]), out=bound)
    # Rounding must not lift a bound over the true distance.
    slack = 4 * np.finfo(np.float32).eps * (known.max(initial=0) + across.max(initial=0))
    order = np.argsort(bound, axis=1, kind="stable")
    floor = np.maximum(np.take_along_axis(bound, order, 1).astype(np.float64) - slack, 0) ** 2
    best, index = np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), len(entries))
    active, tried = np.arange(len(parts)), 0
    for at in range(0, len(entries), STEP):
        active = active[floor[active, at] <= best[active]]
        if not len(active):
            break
        some = order[active, at : at + STEP]
        d = squared(parts[active, None, :], entries[some])
        tried += d.size
        low = d.min(1)
        first = np.where(d == low[:, None], some, len(entries)).min(1)
        better = (low < best[active]) | ((low == best[active]) & (first < index[active]))
        won = active[better]
        best[won], index[won] = low[better], first[better]
    return index, best, tried


class Codec:
    """Codebooks ``(part, entry, component)`` with the pivots chosen from their first state."""

    def __init__(self, books: np.ndarray, pivots: np.ndarray):
        self.books, self.pivots = books, pivots

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()

    def assign(self, parts: np.ndarray, known: np.ndarray):
        """Per part position, the nearest entries and squared distances of ``(row, part, component)``."""
        found = [nearest(parts[:, p], known[:, p], self.books[p], self.pivots[p]) for p in range(len(self.books))]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors, as integers, that codes ``(row, part)`` stand for."""
        return np.concatenate([self.books[p][codes[:, p]] for p in range(len(self.books))], 1)


def _arrays(batch: pa.RecordBatch, parts: int):
    """Parts and pivot distances of slices of a batch."""
    for at in range(0, batch.num_rows, ROWS):
        piece = batch.slice(at, ROWS)
        whole = piece.column("parts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        known = piece.column("known").flatten().to_numpy(zero_copy_only=False)
        yield piece, whole.reshape(piece.num_rows, parts, -1), known.reshape(piece.num_rows, parts, -1)


def prepare(df: DataFrame, id: str, vector: str, carry: list[str], parts: int, entries: int, pivots: int):
    """Stored rows ``carry…, parts, known`` and the first codec; no codec without a usable vector."""
    usable_rows = df.where(usable(F.col(f"`{vector}`")))
    longest = usable_rows.agg(F.max(F.size(f"`{vector}`"))).first()[0]
    if longest is None:
        return None, None
    width = -(-max(longest, 1) // parts) * parts
    whole = integers(F.col(f"`{vector}`"), width)
    first = usable_rows.select(F.col(f"`{id}`").alias("id"), whole.alias("parts")).orderBy(F.col("id").asc_nulls_last(), "parts").limit(entries)
    books = np.array([r.parts for r in first.collect()], np.int64).reshape(-1, parts, width // parts).transpose(1, 0, 2)
    codec = Codec(books, np.stack([spread_out(b, pivots) for b in books]))
    fixed = codec.pivots

    def measure(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                x = piece.column("parts").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(piece.num_rows, parts, -1)
                known = np.stack([to_pivots(x[:, p], fixed[p]) for p in range(parts)], 1).reshape(piece.num_rows, -1)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(known.reshape(-1)), known.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*piece.columns, flat], names=[*piece.schema.names, "known"])

    kept = usable_rows.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__row"), whole.alias("parts"))
    rows = kept.mapInArrow(measure, f"__row {kept.schema['__row'].dataType.simpleString()}, parts array<int>, known array<float>")
    return stored(rows, "parts"), codec


def refine(rows: DataFrame, codec: Codec) -> Codec:
    """One round: parts go to their nearest entries, entries become the floored means of their parts."""
    parts, entries, width = codec.books.shape

    def totals(batches):
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, x, known in _arrays(batch, parts):
                codes, _ = codec.assign(x, known)
                for p in range(parts):
                    np.add.at(sums[p], codes[:, p], x[:, p])
                    counts[p] += np.bincount(codes[:, p], minlength=entries)
        slots = np.concatenate([sums.reshape(-1), counts.reshape(-1)])
        used = np.flatnonzero(slots)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(slots[used])], names=["slot", "total"])

    found = rows.select("parts", "known").mapInArrow(totals, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total"))
    slots = np.zeros(parts * entries * (width + 1), np.int64)
    for r in found.collect():  # one row per component of the codebooks at most
        slots[r.slot] = r.total
    sums, counts = slots[: parts * entries * width].reshape(parts, entries, width), slots[parts * entries * width :].reshape(parts, entries, 1)
    means = np.floor_divide(sums, np.maximum(counts, 1))
    return Codec(np.where(counts > 0, means, codec.books), codec.pivots)


def encode(rows: DataFrame, codec: Codec) -> DataFrame:
    """``__row, code, error`` of prepared rows: two hex digits per part, and the summed squared distances."""
    parts = len(codec.books)

    def run(batches):
        for batch in batches:
            for piece, x, known in _arrays(batch, parts):
                codes, d = codec.assign(x, known)
                text = [bytes(c).hex() for c in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([piece.column("__row"), pa.array(text, pa.string()), pa.array(d.sum(1))], names=["__row", "code", "error"])

    return rows.mapInArrow(run, f"__row {rows.schema['__row'].dataType.simpleString()}, code string, error long")


def compress(df: DataFrame, id: str = "vec_id", vector: str = "embedding", carry: list[str] | None = None,
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, Codec | None]:
    """``__row, code, error`` of every usable vector, stored, and the codec.

    ``__row`` holds the columns to carry (all of ``df``).  Vectors that are null or hold null or
    non-finite components are dropped.  Shorter vectors are filled up with zeros to the longest
    length, rounded up to a multiple of ``parts``; integers beyond ±2^24 are held there.  Codebooks
    start as the vectors of the smallest ids (nulls last, equal ids by their integers), fewer than
    ``entries`` if there are fewer.  Repeated rows count each time.  Without a usable vector the
    result is empty and there is no codec.  ``entries`` is at most 256.
    """
    carry = carry or df.columns
    rows, codec = prepare(df, id, vector, carry, parts, entries, pivots)
    if codec is None:
        none = df.limit(0).select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__row"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none, None
    codec = reduce(lambda c, _: refine(rows, c), range(rounds), codec)
    return stored(encode(rows, codec), "codes"), codec


def with_label_error(coded: DataFrame, label: Column) -> DataFrame:
    """Add ``label_error``, the error summed over rows of equal labels, nulls together.

    Sums are formed from partial sums per task; rows of very common labels are not shuffled to meet them."""
    rows = coded.withColumn("__label", label)
    sums = stored(rows.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__n")), "labels")
    total = sums.agg(F.sum("__n")).first()[0] or 0
    return join_groups(rows, sums, ["__label"], "__n", total).drop("__label", "__n")
