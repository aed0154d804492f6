"""Exact Jaccard join of texts by word shingles, in the metric space of Jaccard distances.

The distance 1 - J is a metric, and texts that share no shingle are at distance 1 from each other.
So pivots drawn from the texts at large tell nothing apart; here every region has a pivot near to
its members instead.  Shingles are put in one order, those common to many texts last.  Two texts
that are similar enough share a shingle among the first ``n - ceil(least * n) + 1`` of each, hence
every pair to be found stands together in the region of such a shingle.

1.  Texts with equal sets are one class.
2.  A region's pivot is its smallest class.  All members are compared with the pivot, a number of
    comparisons linear in the region, however many near copies it holds.  What lies within reach of
    the pivot is one component with it and needs no comparison among itself.
3.  Members out of the pivot's reach meet a second pivot, and what is still apart then joins again,
    with each other and with the members inside the window that the triangle inequality leaves: distances to the pivot may differ by the reach at
    most.  Pairs of one component are left out.

Before two sets are compared, their sizes, the number of their first shingles in any region, and the
places of a shared shingle in both orders must leave it possible that they link.  After the first pivot the
parity bits of the sets must do so too: every shingle turns one of ``BITS`` bits, so two sets differ in at
least as many shingles as bits.  Members of one large group that do not link differ in too many bits and make
no pair.  Sets are stored once and only those that some comparison needs are sent out.  The order of shingles depends on counts, the result does not.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import cut, lower_ascii, stored, words
from tideline.llm.components import components

SHINGLE, LEAST = 5, 75
#: Slots by which shingles are counted to order them (a slot's count is at most too high), slots per
#: stored row, shingles counted at once, and the count above the mean from which regions are dealt out.
SLOTS, ROW, STEP, HOT = 1 << 22, 4096, 500_000, 256
#: Bits of the map of sets that are needed, members compared with one copy of a pivot, parts of a common region.
MAP, MEMBERS, PARTS = 1 << 22, 256, 32
#: Parity bits of a set, in columns of 64, and the count above the mean from which members of a region carry them.
BITS, CROWD = 512, 32
MARKS = [f"bits{k}" for k in range(BITS // 64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(column: pa.ListArray) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, from the hashes of its words.

    A text of fewer words than a shingle has its whole sequence as one; hashes differ by length.
    """
    offsets = column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    rolled = np.zeros(max(0, len(flat) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        rolled = _mix(rolled + flat[k : k + len(rolled)] + np.uint64(SHINGLE))
    out = []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if end - start >= SHINGLE:
            out.append(np.unique(rolled[start : end - SHINGLE + 1]))
        elif end > start:
            h = np.zeros(1, np.uint64)
            for x in flat[start:end]:
                h = _mix(h + x + np.uint64(end - start))
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and 128 bits of each set."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])

    def sums(x: np.ndarray) -> np.ndarray:
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        return (upto[ends[1:]] - upto[ends[:-1]]).view(np.int64)

    return sizes, sums(_mix(flat)), sums(_mix(flat ^ np.uint64(0x5851F42D4C957F2D)))


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """``MARKS`` of each set: bits that are turned once by each shingle, told by the hash that is compared.

    Shingles of both sets turn the same bits, so no more bits can differ than shingles do.
    """
    out = np.zeros((len(sets), BITS), np.uint8)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    turned = np.bincount(owner * BITS + (flat >> np.uint64(16) & np.uint64(BITS - 1)).astype(np.int64), minlength=out.size)
    out[:] = (turned & 1).reshape(out.shape)
    return np.packbits(out, axis=1).view(np.int64)


def class_ids(sizes: np.ndarray, s1: np.ndarray, s2: np.ndarray, salt: int) -> np.ndarray:
    x = _mix(s1.view(np.uint64) + np.uint64(salt)) + s2.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mix(x ^ sizes.astype(np.uint64)).view(np.int64)


def hashed_words(df: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """``__row`` with the columns to carry, and ``w``, the hashes of the text's words in order."""
    return df.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__row"),
        F.transform(words(lower_ascii(F.col(f"`{text}`"))), lambda x: F.xxhash64(x)).alias("w"),
    )


def bitmap(cids: DataFrame) -> np.ndarray:
    """A map of fixed size in which the bits of the given classes are set: ``MAP`` numbers at most come
    to the driver."""
    slots = cids.select(F.pmod("cid", F.lit(MAP)).cast("int").alias("k")).distinct().toPandas()["k"].to_numpy()
    marked = np.zeros(MAP, bool)
    marked[slots] = True
    return np.packbits(marked)


def signed(rows: DataFrame, salt: int, bits: np.ndarray | None = None) -> DataFrame:
    """``__row, n, cid, hit`` of every row: the size of its set, the number of its class, and whether
    the class has its bit in the map (as some others may); without a map none has."""
    kind = rows.schema["__row"].dataType.simpleString()

    def run(batches):
        marked = np.zeros(MAP, bool) if bits is None else np.unpackbits(bits).view(bool)
        for batch in batches:
            for part in _parts(batch):
                sizes, s1, s2 = _signatures(shingle_sets(part.column("w")))
                cid = class_ids(sizes, s1, s2, salt)
                columns = map(pa.array, (sizes, cid, marked[cid % MAP]))
                yield pa.RecordBatch.from_arrays([part.column("__row"), *columns], names=["__row", "n", "cid", "hit"])

    return rows.mapInArrow(run, f"__row {kind}, n long, cid long, hit boolean")


def with_sets(rows: DataFrame) -> DataFrame:
    """``__row, n, s1, s2, cid`` of every row: the size and 128 bits of its set, and the number of its
    class without salt; with the set itself in ``own`` and its ``MARKS`` for the first row of each class in a task; and
    from each task its counts of shingles by slot, in further rows ``part`` with bytes in ``own``."""
    kind = rows.schema["__row"].dataType.simpleString()
    names = ["__row", "n", "s1", "s2", "cid", *MARKS, "own", "part"]

    def run(batches):
        done, counts, held, size, row = set(), np.zeros(SLOTS, np.uint8), [], 0, None

        def count():
            slots, seen = np.unique(_slot(np.concatenate(held)), return_counts=True)
            counts[slots] = np.minimum(counts[slots] + seen, 255)

        for batch in batches:
            for part in _parts(batch):
                row = part.column("__row").type
                sets = shingle_sets(part.column("w"))
                sizes, s1, s2 = _signatures(sets)
                own = []
                for key, values in zip(zip(s1.tolist(), s2.tolist(), strict=True), sets, strict=True):
                    fresh = len(values) > 0 and key not in done
                    own.append(_packed(values) if fresh else None)
                    if fresh:
                        done.add(key)
                        held.append(values)
                        size += len(values)
                numbers = map(pa.array, (sizes, s1, s2, class_ids(sizes, s1, s2, 0)))
                none = np.array([x is None for x in own])
                marks = [pa.array(np.ascontiguousarray(x), mask=none) for x in parities(sets).T]
                made = [*numbers, *marks, pa.array(own, pa.binary()), pa.nulls(len(sets), pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column("__row"), *made], names=names)
                if size >= STEP:
                    count()
                    held, size = [], 0
        if held:
            count()
        if row is not None:
            parts = counts.reshape(-1, ROW)
            none = [pa.nulls(len(parts), row), *[pa.nulls(len(parts), pa.int64())] * (4 + len(MARKS))]
            made = [pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(np.arange(len(parts), dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*none, *made], names=names)

    marks = ", ".join(f"{c} long" for c in MARKS)
    return rows.mapInArrow(run, f"__row {kind}, n long, s1 long, s2 long, cid long, {marks}, own binary, part int")


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def slot_counts(counted: DataFrame) -> np.ndarray:
    """How often shingles of each slot occur, from the counts of all tasks.  SLOTS numbers in all,
    whatever the corpus."""

    def run(batches):
        sums = {}
        for batch in batches:
            for part, own in zip(batch.column("part").to_pylist(), batch.column("own"), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(own.as_buffer(), np.uint8).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([np.minimum(v, 65_535).astype(np.uint16).tobytes() for v in sums.values()], pa.binary())],
                names=["part", "sums"],
            )

    told = counted.where(F.col("part").isNotNull()).select("part", "own").repartition("part").mapInArrow(run, "part int, sums binary")
    out = np.zeros((SLOTS // ROW, ROW), np.uint16)
    for r in told.collect():
        out[r["part"]] = np.frombuffer(r["sums"], np.uint16)
    return out.ravel()


def _packed(values: np.ndarray) -> bytes:
    """The upper six bytes of each hash, still in order: what regions and comparisons go by."""
    return values.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpacked(raw) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _parts(batch):
    return (batch.slice(at, 500) for at in range(0, batch.num_rows, 500))


def _numbers(batch, salt: int) -> np.ndarray:
    return class_ids(*(batch.column(c).to_numpy() for c in ("n", "s1", "s2")), salt)


def first_shingles(sets: DataFrame, counts: np.ndarray, salt: int, least: int) -> DataFrame:
    """``shingle, part, cid, pos``: the first shingles of each class in the order of their slots' counts,
    then of their hashes, and their places in it.  ``part`` deals the members of shingles that are much more common than
    others to several tasks; it is -1 for all others."""
    share = sets.sparkSession.sparkContext.broadcast(counts)
    hot = min(65_535, int(counts.mean()) + HOT)

    def run(batches):
        for part in (p for batch in batches for p in _parts(batch)):
            out = []
            for cid, raw in zip(_numbers(part, salt).tolist(), part.column("own"), strict=True):
                own = _unpacked(raw.as_buffer())
                seen = share.value[_slot(own)].astype(np.uint64)
                k = len(own) - ceil(least * len(own) / 100) + 1
                order = seen << np.uint64(48) | own >> np.uint64(16)
                first = np.sort(np.partition(order, k - 1)[:k])
                deal = np.where(first >> np.uint64(48) >= hot, cid % PARTS, -1)
                out.append((first << np.uint64(16), deal.astype(np.int32), np.full(k, cid), np.arange(k, dtype=np.int32)))
            if out:
                shingle, deal, cid, pos = (np.concatenate(c) for c in zip(*out, strict=True))
                made = [pa.array(shingle.view(np.int64)), pa.array(deal), pa.array(cid), pa.array(pos)]
                yield pa.RecordBatch.from_arrays(made, names=["shingle", "part", "cid", "pos"])

    return sets.mapInArrow(run, "shingle long, part int, cid long, pos int")


def regions(first: DataFrame) -> DataFrame:
    """``shingle, cid, pos, pivot`` of all regions of two or more classes.

    Rows are sorted within partitions, so a region streams by and only its first member is held.
    Regions of common shingles come in parts; their pivot is found by a partial minimum.
    """

    def run(batches):
        last, lead, told = None, None, True  # the row before; its region's first member; whether that is out
        for batch in batches:
            s, part, c, p = (batch.column(k).to_numpy() for k in ("shingle", "part", "cid", "pos"))
            before = np.concatenate([[0], s[:-1]]), np.concatenate([[0], part[:-1]]), np.concatenate([[0], c[:-1]])
            same = (s == before[0]) & (part == before[1])
            again = same & (c == before[2])
            if last is None:
                same[0] = again[0] = False
            else:
                same[0] = (s[0], part[0]) == last[:2]
                again[0] = bool(same[0]) and c[0] == last[2]
            last = (s[-1], part[-1], c[-1])
            s, part, c, p, same = s[~again], part[~again], c[~again], p[~again], same[~again]
            if not len(s):
                continue
            at = np.maximum.accumulate(np.where(same, -1, np.arange(len(s))))
            pivot = np.where(at < 0, 0 if lead is None else lead[2], c[np.maximum(at, 0)])
            follow = np.append(same[1:], False)
            cold = part < 0
            out = cold & (same | follow)
            rows = [(s[out], c[out], p[out], pivot[out])]
            if same[0] and cold[0] and not told:
                rows.insert(0, tuple(np.array([x]) for x in (lead[0], lead[2], lead[3], lead[2])))
                told = True
            if at[-1] >= 0:
                k = at[-1]
                lead, told = (s[k], part[k], c[k], p[k]), bool(out[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names=names)
            if (~cold).any():
                k = int((~cold).sum())
                yield pa.RecordBatch.from_arrays([pa.array(s[~cold]), pa.array(c[~cold]), pa.array(p[~cold]), pa.nulls(k, pa.int64())], names=names)

    names = ["shingle", "cid", "pos", "pivot"]
    by = ["shingle", "part"]
    found = stored(
        first.repartition(*by).sortWithinPartitions(*by, "cid").mapInArrow(run, "shingle long, cid long, pos int, pivot long"), "regions"
    )
    parted = found.where(F.col("pivot").isNull()).select("shingle", "cid", "pos").dropDuplicates(["shingle", "cid"])
    leads = parted.groupBy("shingle").agg(F.min("cid").alias("pivot"), F.count(F.lit(1)).alias("m")).where("m > 1")
    return stored(found.where(F.col("pivot").isNotNull()).unionByName(parted.join(leads.drop("m"), "shingle")), "found")


def needed_sets(sets: DataFrame, pairs: DataFrame, salt: int) -> DataFrame:
    """``cid, own`` for the classes of ``pairs``.  A bitmap of fixed size keeps most others from
    being shuffled; the join that follows is exact."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    bits = bitmap(wanted)

    def run(batches):
        marked = np.unpackbits(bits).view(bool)
        for part in (p for batch in batches for p in _parts(batch)):
            cid = _numbers(part, salt)
            hit = pa.array(np.flatnonzero(marked[cid % MAP]))
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(cid).take(hit), part.column("own").take(hit)], names=["cid", "own"])

    found = sets.mapInArrow(run, "cid long, own binary")
    return stored(found.join(wanted, "cid", "left_semi").dropDuplicates(["cid"]), "needed")


def shared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, both, union`` of the given pairs.  Pairs are dealt by ``b`` in groups of a bounded
    number of members, and each group gets the set of ``b`` once."""
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    member = pairs.join(many, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    own = sets.select(F.col("cid").alias("a"), "own")
    members = member.select("a", "b", "part").join(own, "a").select("b", "part", F.lit(1).alias("kind"), "a", "own")
    lead = many.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    leads = lead.join(sets.select(F.col("cid").alias("b"), "own"), "b").select("b", "part", F.lit(0).alias("kind"), F.col("b").alias("a"), "own")

    def run(batches):
        pivot = None
        for part in (p for batch in batches for p in _parts(batch)):  # sets of a part are copied, not of a batch
            a, b, kind, own = (part.column(c).to_pylist() for c in ("a", "b", "kind", "own"))
            rows = []
            for x, y, k, raw in zip(a, b, kind, own, strict=True):
                values = _unpacked(raw)
                if not k:
                    pivot = values
                    continue
                at = np.minimum(np.searchsorted(pivot, values), len(pivot) - 1)
                both = int((pivot[at] == values).sum())
                rows.append((x, y, both, len(pivot) + len(values) - both))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["a", "b", "both", "union"])

    by = ["b", "part"]
    dealt = members.unionByName(leads).repartition(*by).sortWithinPartitions(*by, "kind")
    return dealt.mapInArrow(run, "a long, b long, both long, union long")


def _enough(common, na, nb, least: int):
    """Whether first shingles in common and all later ones of either text can make up the overlap."""
    later = F.greatest(*[F.ceil(least * n / 100) - 1 for n in (na, nb)])
    return (100 + least) * (common + later) >= least * (na + nb)


def _alike(a: list[str], b: list[str], na, nb, least: int):
    """Whether no more parity bits differ than shingles may; true where a side has none."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)])
    return F.coalesce((100 + least) * differ <= (100 - least) * (na + nb), F.lit(True))


def _plausible(pairs: DataFrame, found: DataFrame, sizes: DataFrame, least: int, marks: list[str]) -> DataFrame:
    """The pairs ``a, b`` whose sizes, whose numbers of first shingles in regions, and whose ``marks``
    leave it possible that they link: no more than these first shingles can be in common."""
    held = found.groupBy("cid").agg(F.count(F.lit(1)).alias("r")).join(sizes.select("cid", "n", *marks), "cid")
    a, b = (held.withColumnsRenamed({"cid": k} | {c: f"{c}_{k}" for c in ("n", "r", *marks)}) for k in "ab")
    na, nb = F.col("n_a"), F.col("n_b")
    sized = pairs.join(a, "a").join(b, "b").where(100 * F.least(na, nb) >= least * F.greatest(na, nb))
    sized = sized.where(_enough(F.least("r_a", "r_b"), na, nb, least))
    if marks:
        sized = sized.where(_alike([f"{c}_a" for c in marks], [f"{c}_b" for c in marks], na, nb, least))
    return cut(sized.select("a", "b"))


def _links(df: DataFrame, text: str, key: str, least: int):
    """Rows ``id, n, cid``; the component of every class, and whether several rows are in it; and the
    salt of the class numbers."""
    counted = stored(with_sets(hashed_words(df, text, [key])), "sets")
    whole = counted.where(F.col("part").isNull()).select(F.col(f"__row.`{key}`").alias("id"), "n", "s1", "s2", "cid", *MARKS)
    salt = 0
    while True:  # class numbers of 64 bits; another salt in the unlikely case that two classes meet
        numbered = _renumbered(whole, salt) if salt else whole
        classes = cut(numbered.groupBy("n", "s1", "s2", "cid").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("rows"), *[F.max(c).alias(c) for c in MARKS]))
        if classes.groupBy("cid").count().where("count > 1").isEmpty():
            break
        salt += 1
    sets = counted.where(F.col("own").isNotNull() & F.col("part").isNull()).select("n", "s1", "s2", "own")
    counts = slot_counts(counted)
    found = regions(first_shingles(sets, counts, salt, least))
    sizes = classes.where("n > 0").select("cid", "n", *MARKS)
    linked = f"100 * both >= {least} * union"

    # Compare members with their pivots; how far those out of reach are is used below.
    pairs = found.where("cid <> pivot").select(F.col("cid").alias("a"), F.col("pivot").alias("b")).distinct()
    near = _plausible(pairs, found, sizes, least, [])
    met = cut(shared(near, needed_sets(sets, near, salt)))
    part = components(met.where(linked), "a", "b")

    # Join again what lies out of a pivot's reach.
    # What is known of a class travels to its regions at once, so they are shuffled once.
    tried = met.groupBy(F.col("a").alias("cid")).agg(
        F.map_from_entries(F.collect_list(F.struct("b", F.struct(F.expr(linked).alias("inside"), (1 - F.col("both") / F.col("union")).alias("d"))))).alias("tried")
    )
    held = found.groupBy("cid").agg(F.count(F.lit(1)).alias("r"))
    facts = sizes.join(held, "cid").join(part.withColumnRenamed("node", "cid"), "cid", "left").join(tried, "cid", "left")
    # The slot's count stands before the hash of a shingle.  Only members of large regions carry their marks there.
    crowded = F.shiftrightunsigned("shingle", 48) > min(65_534, int(counts.mean()) + CROWD)
    placed = found.join(facts, "cid").withColumns({"t": F.try_element_at("tried", "pivot"), "marks": F.when(crowded, F.struct(*MARKS))})
    placed = placed.drop("tried", *MARKS)
    lead = F.col("cid") == F.col("pivot")
    placed = placed.select(
        "shingle", "cid", "pos", "n", "r", F.lag("shingle").over(Window.partitionBy("cid").orderBy("pos")).alias("prev"),
        F.coalesce("component", "cid").alias("comp"),
        (lead | F.coalesce("t.inside", F.lit(False))).alias("inside"), F.when(lead, 0.0).otherwise(F.col("t.d")).alias("d"), "marks",
    )
    placed = stored(placed, "placed")
    # A second pivot first: of the component with most members in a region, the member that a hash
    # of region and class picks, so a class meets another member in each of its regions.
    pick = F.max(F.struct(F.xxhash64("shingle", "cid").alias("h"), "cid")).alias("k")
    most = placed.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("m"), pick).groupBy("shingle").agg(
        F.max(F.struct("m", F.col("comp").alias("of"), F.col("k.cid").alias("second"))).alias("s")
    )
    tries = placed.where("not inside").join(most, "shingle").where("comp <> s.of").select(
        F.greatest("cid", "s.second").alias("a"), F.least("cid", "s.second").alias("b")
    ).distinct()
    tries = _plausible(tries.join(met.select("a", "b"), ["a", "b"], "left_anti"), found, sizes, least, MARKS)
    met = cut(met.unionByName(shared(tries, needed_sets(sets, tries, salt))))
    part = components(met.where(linked), "a", "b").toDF("comp", "joined")
    placed = placed.join(part, "comp", "left").withColumn("comp", F.coalesce("joined", "comp")).drop("joined")

    x = placed.where("not inside").select("shingle", *[F.col(c).alias(f"x_{c}") for c in ("cid", "pos", "prev", "n", "r", "comp", "d", "marks")])
    y = placed.select(F.col("shingle").alias("y_shingle"), *[F.col(c).alias(f"y_{c}") for c in ("cid", "pos", "prev", "n", "r", "comp", "d", "inside", "marks")])
    apart = (
        (F.col("shingle") == F.col("y_shingle"))
        & (F.col("x_comp") != F.col("y_comp"))
        & (F.col("y_inside") | (F.col("x_cid") < F.col("y_cid")))
        & (100 * F.least("x_n", "y_n") >= least * F.greatest("x_n", "y_n"))
        & _enough(F.least("x_r", "y_r"), F.col("x_n"), F.col("y_n"), least)
        & ((100 + least) * F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")) >= least * (F.col("x_n") + F.col("y_n")))
        & F.coalesce(F.col("x_prev") != F.col("y_prev"), F.lit(True))
        & (F.coalesce(F.abs(F.col("x_d") - F.col("y_d")), F.lit(0.0)) <= 1 - least / 100 + 1e-9)
        & _alike([f"x_marks.{c}" for c in MARKS], [f"y_marks.{c}" for c in MARKS], F.col("x_n"), F.col("y_n"), least)
    )
    # Of the shingles that two classes share, the first in order has all others behind it on both
    # sides.  A pair that links has enough there, so it has a row from that region; regions in which
    # too little is left make none, and none do those whose region before is one of both, as that is
    # a region earlier in the order where the same pair meets.
    again = x.join(y, apart).select(F.greatest("x_cid", "y_cid").alias("a"), F.least("x_cid", "y_cid").alias("b")).distinct()
    again = cut(again.join(met.select("a", "b"), ["a", "b"], "left_anti"))
    more = cut(shared(again, needed_sets(sets, again, salt)).where(linked))
    parts = components(met.where(linked).select("a", "b").unionByName(more.select("a", "b")), "a", "b").withColumnRenamed("node", "cid")
    several = (F.col("n") > 0) & (F.col("component").isNotNull() | (F.col("rows") > 1))
    named = classes.join(parts, "cid", "left").select("cid", "low", several.alias("several"), F.coalesce("component", "cid").alias("component"))
    named = cut(named)
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return numbered.select("id", "n", "cid"), named.join(lowest, "component").select("cid", "component", "component_id", "several"), salt


def _renumbered(rows: DataFrame, salt: int) -> DataFrame:
    """``rows`` with class numbers of another salt."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("cid")
            yield batch.set_column(at, "cid", pa.array(_numbers(batch, salt)))

    return rows.mapInArrow(run, rows.schema)


def join(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``id, n_shingles, component_id`` of every row.

    A-Z are lower-cased; words are runs without ASCII white space.  ``component_id`` is the
    smallest key reachable by links, the row's own included.  Null and blank texts have no shingles
    and stay alone.  Rows with equal sets are one class, so repeated rows share a component; a null
    key is never the smallest unless all in the component are null.
    """
    rows, named, _ = _links(df, text, key, least)
    named = named.select("cid", "component_id")
    return rows.join(named, "cid").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """One row of each component, that with the smallest key; rows without shingles all stay.

    Texts are read again and signed again rather than written out in between.  A row that is alone in
    its component stays where it is; the others are shuffled once, by key and class, to meet the rows that stay.
    """
    rows, named, salt = _links(df, text, key, least)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "cid")).alias("k")
    stay = rows.where("n > 0").join(named, "cid").groupBy("component").agg(first)
    stay = stored(stay.select(F.col("k.id").alias("__id"), F.col("k.cid").alias("__cid")), "stay")
    again = signed(hashed_words(df, text, df.columns), salt, bitmap(named.where("several")))
    kept = again.where("n > 0 AND hit").join(stay, (F.col("cid") == F.col("__cid")) & F.col(f"__row.`{key}`").eqNullSafe(F.col("__id")))
    once = kept.dropDuplicates(["__cid", "__id"]).select("__row.*")
    return once.unionByName(again.where("n = 0 OR NOT hit").select("__row.*"))
