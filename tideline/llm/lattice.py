"""Near-duplicate vectors by lattice hashing: projections decoded to points of E8.

Each table projects unit vectors to eight dimensions at random and takes the nearest point of the
E8 lattice as a vector's home cell.  A vector is also sent to the cells around its home that lie
nearest to it, and meets there the vectors that are at home.  What meets is compared by cosine.

Cells are compared block by block as matrix products, and a block reports a number of links and a
spanning tree per vector, never pairs.  A pair that meets in several tables or cells counts only
in the first; every row carries its cells, so a block sees that for itself.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut, stored
from tideline.llm.components import components

COSINE = 0.98
#: Tables, neighbouring cells per table, and the width of a cell in units of a projected unit vector.
TABLES, PROBES, CELL, SEED = 4, 8, 1.0, 11
#: Vectors of one cell that are compared with as many others at once.
BLOCK = 512


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: two entries of size 2, or all of size 1 with an even
    number of negative signs."""
    two = [p for p in product((-2, 0, 2), repeat=8) if sum(map(abs, p)) == 4]
    one = [p for p in product((-1, 1), repeat=8) if sum(x < 0 for x in p) % 2 == 0]
    return np.array(two + one)


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, doubled so that they are whole: the nearer of the nearest points of D8
    and of D8 shifted by one half."""

    def even(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        odd = np.flatnonzero(near.sum(axis=1) % 2)
        off = y[odd] - near[odd]
        worst = np.abs(off).argmax(axis=1)
        near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
        return near

    a, b = even(x), even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return (2 * np.where(closer[:, None], a, b)).astype(np.int64)


class Hasher:
    def __init__(self, tables: int = TABLES, probes: int = PROBES, cell: float = CELL, seed: int = SEED):
        self.tables, self.probes, self.cell, self.seed = tables, probes, cell, seed
        self.roots = _roots()
        rng = np.random.default_rng(seed)
        self.mix = rng.integers(1, 1 << 62, size=(tables, 8), dtype=np.int64) | 1
        self.shift = rng.random((tables, 8))

    def _keys(self, points: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (points * self.mix[table]).sum(axis=-1)
            return (h ^ (h >> 29)) * np.int64(0x1CE4E5B9BF58476D)

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the home cells ``(rows, tables)`` and of the cells around ``(rows, tables, probes)``."""
        rng = np.random.default_rng([self.seed, unit.shape[1]])
        homes = np.zeros((len(unit), self.tables), np.int64)
        around = np.zeros((len(unit), self.tables, self.probes), np.int64)
        for t in range(self.tables):
            x = unit @ rng.standard_normal((unit.shape[1], 8)) / self.cell + self.shift[t]
            home = nearest(x)
            gain = (x - home / 2) @ self.roots.T
            near = np.argsort(-gain, axis=1, kind="stable")[:, : self.probes]
            homes[:, t] = self._keys(home, t)
            around[:, t] = self._keys(home[:, None, :] + self.roots[near], t)
        return homes, around


def hashed(classes: DataFrame, hasher: Hasher) -> DataFrame:
    """Add ``unit`` (doubles as bytes), ``homes`` and ``around`` to ``cid, label, weight, v``."""

    def run(batches):
        for batch in batches:
            values = batch.column("v")
            sizes = np.diff(values.offsets.to_numpy())
            flat = values.flatten().to_numpy(zero_copy_only=False)
            begins = np.cumsum(sizes) - sizes
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                unit = flat[begins[own][:, None] + np.arange(d)]
                unit = unit / np.sqrt((unit**2).sum(axis=1, keepdims=True))
                homes, around = hasher.cells(unit)
                part = batch.take(pa.array(own)).select(["cid", "label", "weight"])
                made = [pa.array([row.tobytes() for row in m], pa.binary()) for m in (unit, homes, around)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=["cid", "label", "weight", "unit", "homes", "around"])

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("cid", "label", "weight", "v").mapInArrow(
        run, f"cid long, label {kind}, weight long, unit binary, homes binary, around binary"
    )


def postings(vectors: DataFrame, hasher: Hasher) -> DataFrame:
    """``label, dim, t, key, cid, home``: a row for the home cell and each cell around, per table."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            homes = np.frombuffer(b"".join(batch.column("homes").to_pylist()), np.int64).reshape(n, hasher.tables, 1)
            around = np.frombuffer(b"".join(batch.column("around").to_pylist()), np.int64).reshape(n, hasher.tables, -1)
            keys = np.concatenate([homes, around], axis=2)
            each = keys.shape[1] * keys.shape[2]
            rows = pa.array(np.repeat(np.arange(n), each))
            place = np.arange(each)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label").take(rows), batch.column("dim").take(rows),
                    pa.array(np.tile((place // keys.shape[2]).astype(np.int32), n)), pa.array(keys.ravel()),
                    batch.column("cid").take(rows), pa.array(np.tile(place % keys.shape[2] == 0, n)),
                ],
                names=["label", "dim", "t", "key", "cid", "home"],
            )

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("cid", "label", F.octet_length("unit").alias("dim"), "homes", "around").mapInArrow(
        run, f"label {kind}, dim int, t int, key long, cid long, home boolean"
    )


def _compare(rows: dict[str, np.ndarray], hasher: Hasher, least: float):
    """``cid, weight of links, a linked cid`` of one block pair."""
    unit = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(len(rows["cid"]), -1)
    side, home, cid, weight, t = rows["side"], rows["home"], rows["cid"], rows["weight"], int(rows["t"][0])
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    same = right is left
    close = (unit[left] @ unit[right].T >= least) & (home[left][:, None] | home[right][None, :])
    i, j = np.nonzero(np.triu(close, 1) if same else close)
    i, j = left[i], right[j]
    if not len(i):
        return None
    # Least reachable row: take the least label across each pair, then follow labels, until nothing moves.
    label = np.arange(len(cid))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    homes = np.frombuffer(b"".join(rows["homes"]), np.int64).reshape(len(cid), hasher.tables)
    around = np.frombuffer(b"".join(rows["around"]), np.int64).reshape(len(cid), hasher.tables, -1)
    total = np.zeros(len(cid), np.int64)
    for k in range(0, len(i), 20_000):
        a, b = i[k : k + 20_000], j[k : k + 20_000]
        met = homes[a, :t] == homes[b, :t]
        met |= (around[a, :t] == homes[b, :t, None]).any(axis=2) | (around[b, :t] == homes[a, :t, None]).any(axis=2)
        # One at home and one from around: they may meet in the other's home too; the smaller id's home counts.
        other = np.where(home[a], b, a)
        host = np.where(home[a], a, b)
        twice = (~(home[a] & home[b])) & (cid[other] < cid[host]) & (around[host, t] == homes[other, t][:, None]).any(axis=1)
        new = ~(met.any(axis=1) | twice)
        np.add.at(total, a[new], weight[b[new]])
        np.add.at(total, b[new], weight[a[new]])
    hit = np.unique(np.concatenate([i, j]))
    # A row's label is the first row of its tree, of which the spanning tree keeps the link.
    return cid[hit], total[hit], cid[label[hit]]


def compare(met: DataFrame, hasher: Hasher, least: float) -> DataFrame:
    """Links within block pairs; rows of a pair stand together in sorted partitions."""
    by = ["t", "key", "cell", "b1", "b2"]
    names = [*by, "side", "home", "cid", "weight", "unit", "homes", "around"]
    raw = ("unit", "homes", "around")

    def groups(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = np.stack([held.column(c).to_numpy() for c in by], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts[:-1]], cuts, strict=False) if len(cuts) else ():
                if end - start > 1:
                    yield held.slice(start, end - start)
            held = held.slice(cuts[-1]) if len(cuts) else held
        if held is not None and held.num_rows > 1:
            yield held

    def run(batches):
        out, size = [], 0
        for group in groups(batches):
            rows = {c: group.column(c).to_pylist() if c in raw else group.column(c).to_numpy() for c in names}
            found = _compare(rows, hasher, least)
            if found is not None:
                out.append(found)
                size += len(found[0])
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["cid", "links", "with"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["cid", "links", "with"])

    dealt = met.select(*names).repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInArrow(run, "cid long, links long, with long")


def dealt(vectors: DataFrame, hasher: Hasher) -> DataFrame:
    """Rows of cells in which something can meet, dealt to pairs of blocks, with their payload.

    A cell of n rows makes ceil(n / BLOCK) blocks, so each row is sent out that often; no pair of
    blocks is larger than two blocks, however large its cell.
    """
    placed = postings(vectors, hasher)
    cells = ["label", "dim", "t", "key"]
    counts = placed.groupBy(*cells).agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("at_home"))
    met = placed.join(counts.where("n > 1 and at_home > 0"), cells)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = met.withColumn("b", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o")
    met = met.select("t", "key", F.xxhash64("label", "dim").alias("cell"), "cid", "home", "b", other)
    met = met.select(
        "t", "key", "cell", "cid", "home", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"),
        F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side"),
    )
    return met.join(vectors.select("cid", "weight", "unit", "homes", "around"), "cid")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    least: float = COSINE, hasher: Hasher | None = None) -> DataFrame:
    """``__row`` with every column of ``df``, ``n_links``, ``component_id`` and ``kept``.

    Vectors link when their labels are equal and not null, their sizes are equal, and their cosine
    in double precision is at least ``least``.  Vectors that are null, empty, zero or hold nulls or
    non-finite values, and those without a label, link with nothing.  Equal vectors (up to scale)
    form a class and are compared once; they link with one another.  ``component_id`` is the
    smallest key among all reachable rows; a null key never is the smallest unless all are null.
    """
    hasher = hasher or Hasher()
    columns = [F.col(f"`{c}`") for c in df.columns]
    doubles = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col(f"`{label}`").isNotNull() & fine & F.exists(doubles, lambda x: x != 0)
    rows = df.select(
        F.struct(*columns).alias("__row"), F.monotonically_increasing_id().alias("uid"),
        F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.when(usable, doubles).alias("v"),
    )
    rows = stored(rows, "vectors")
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    scaled = rows.where(F.col("v").isNotNull()).select(
        "uid", "id", "label", F.transform(F.array(top), lambda m: F.transform("v", lambda x: x / m + 0.0))[0].alias("v")
    )
    scaled = scaled.select("*", F.xxhash64("label", "v").alias("d1"), F.xxhash64(F.lit(1), "v", "label").alias("d2"))
    classes = cut(
        scaled.groupBy("d1", "d2").agg(
            F.min("uid").alias("cid"), F.first("label").alias("label"), F.first("v").alias("v"),
            F.count(F.lit(1)).alias("weight"), F.min("id").alias("low"),
        )
    )
    vectors = stored(hashed(classes, hasher), "hashed")
    links = cut(compare(dealt(vectors, hasher), hasher, least))
    parts = components(links, "cid", "with").withColumnRenamed("node", "cid")
    sums = links.groupBy("cid").agg(F.sum("links").alias("links"))
    whole = classes.select("d1", "d2", "cid", "weight", "low").join(sums, "cid", "left").join(parts, "cid", "left")
    whole = cut(whole.withColumn("component", F.coalesce("component", "cid")))
    lowest = whole.groupBy("component").agg(F.min("low").alias("component_id"))
    named = whole.join(lowest, "component").select(
        "d1", "d2", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    members = rows.select("__row", "uid", "id").join(
        scaled.join(named, ["d1", "d2"]).select("uid", "component_id", "n_links"), "uid", "left"
    )
    own = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    return members.select(
        "__row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own,
    ).withColumn("kept", F.col(f"__row.`{key}`").eqNullSafe(F.col("component_id")))
