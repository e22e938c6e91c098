"""All pairs of sets with a Jaccard similarity of ``least`` or more, exactly: a prefix filter whose crowded keys grow.

Elements are put in one order for all sets, crowded ones last. Two sets of sizes m <= n that are near share at
least ``need = least / (1 + least) * (m + n)`` elements, so the first of those is among the first ``size - need + 1`` of
either, and the k-th among the first ``size - need + k``. Seen from one set alone, ``need`` is at least
``2 * least / (1 + least) * m`` for the smaller one (its row is ``short``) and ``least * n`` for the larger one.

- The keys of a set are the elements among its first ones. A key of more than ``hot`` sets grows: in its place stand
  keys of it with each next element that may be the next in common. Sets so small that what the key is of may
  suffice also meet under an end key.
- Sets of one key are compared by what they can still have in common and by 256 parities of their elements, which
  differ in at most as many bits as the sets differ in elements.

All of these are bounds that no near pair exceeds, so none is lost: which keys grow, how often, the order and the
tables of fixed size (counts by slot, the bits of keys of short rows) decide about the work only. A key that would
make more work grown than whole stays whole, and so does the last growth, whatever its number of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of counters, of elements and of keys.
SLOTS = 1 << 20
#: Bits that tell which keys short rows have.
BITS = 1 << 22
#: Elements of more sets than this are put in order of their number, after all others.
FEW = 8
#: How often a key grows.
SPLITS = 2
_SLACK = 1e-6


def mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two."""
    with np.errstate(over="ignore"):
        h = (x ^ (y * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93)


def _slot(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(SLOTS - 1)).astype(np.int64)


def _bit(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(20) & np.uint64(BITS - 1)).astype(np.int64)


class Slots:
    """Counts by slot, of which only those that matter are kept and sent to the workers."""

    def __init__(self, slot: np.ndarray, n: np.ndarray):
        self.slot, self.n = slot.astype(np.int32), n.astype(np.int64)

    @classmethod
    def of(cls, found: DataFrame) -> Slots:
        table = found.toArrow()
        return cls(table["slot"].to_numpy(), table["n"].to_numpy())

    def counts(self) -> np.ndarray:
        out = np.zeros(SLOTS, np.int64)
        out[self.slot] = self.n
        return out

    def where(self, fit: np.ndarray) -> Slots:
        return Slots(self.slot[fit], self.n[fit])

    def __len__(self) -> int:
        return len(self.slot)


class Sets:
    """Some sets with their elements in order."""

    def __init__(self, node: np.ndarray, size: np.ndarray, value: np.ndarray, order: np.ndarray, least: float):
        self.node, self.size, self.least = node, size, least
        self.start = np.cumsum(size) - size
        value = value.view(np.uint64)
        self.value = value[np.lexsort((value, order[_slot(value)], np.repeat(np.arange(len(node)), size)))]
        # the least number in common with any larger and any smaller set
        self.short = np.maximum(np.ceil(2 * least / (1 + least) * size - _SLACK), 1).astype(np.int64)
        self.long = np.maximum(np.ceil(least * size - _SLACK), 1).astype(np.int64)

    @property
    def parities(self) -> np.ndarray:
        at = mix(self.value, np.uint64(13)) >> np.uint64(56)
        bits = np.zeros((len(at), 4), np.uint64)
        bits[np.arange(len(at)), (at >> np.uint64(6)).astype(np.int64)] = np.uint64(1) << (at & np.uint64(63))
        return np.bitwise_xor.reduceat(bits, self.start, axis=0)

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``key, row, place`` of the keys of one element."""
        count = self.size - self.long + 1
        row = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        return mix(self.value[self.start[row] + place], np.uint64(1)), row, place

    def grown(self, key: np.ndarray, row: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``key, row, place`` of the keys of k elements with one more, and of which key each is."""
        last = np.minimum(self.size - self.long + k, self.size - 1)[row]
        count = np.maximum(last - place, 0)
        of = np.repeat(np.arange(len(key)), count)
        at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + place[of] + 1
        return mix(key[of], self.value[self.start[row[of]] + at]), row[of], at, of

    def level(self, k: int, grow: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys of k elements, by the tables of the slots that grow at each level."""
        at = self.first()
        for j in range(1, k):
            fit = grow[j - 1][_slot(at[0])]
            at = self.grown(*(x[fit] for x in at), j)[:3]
        return at

    def rows(self, grow: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``key, row, most in common, short`` of the keys that stay."""
        at = self.first()
        for k in range(1, len(grow) + 2):
            key, row, place = at
            size = self.size[row]
            most, short = k + size - place - 1, place <= size - self.short[row] + k - 1
            if k > len(grow):
                yield key, row, most, short
                return
            fit = grow[k - 1][_slot(key)]
            yield key[~fit], row[~fit], most[~fit], short[~fit]
            # k elements are all that some pair needs only if its larger set has at most k / least, or its smaller one 2 * least / (1 + least) of that
            small = fit & (size <= k * (1 + self.least) / (2 * self.least**2) + _SLACK)
            yield mix(key[small], np.uint64(99)), row[small], most[small], size[small] <= k / self.least + _SLACK
            at = self.grown(key[fit], row[fit], place[fit], k)[:3]


def _read(batch: pa.RecordBatch, order: np.ndarray, least: float) -> Sets:
    lists = batch.column("s")
    return Sets(batch.column("node").to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy(), order, least)


def _counts(order: Slots, least: float, k: int, grow: list[Slots], held: Slots | None = None):
    """The number of sets by slot of the keys of k elements; with ``held``, instead the sum of it over all keys that those of one slot would grow to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ordered, growing = np.zeros(SLOTS, np.int64), order.counts(), [g.counts() > 0 for g in grow]
        weight = None if held is None else held.counts()
        for batch in batches:
            sets = _read(batch, ordered, least)
            key, row, place = sets.level(k, growing)
            slot = _slot(key)
            if weight is None:
                total += np.bincount(slot, minlength=SLOTS)
            else:
                fit = growing[k - 1][slot]
                more, _, _, of = sets.grown(key[fit], row[fit], place[fit], k)
                total += np.bincount(slot[fit][of], weight[_slot(more)], SLOTS).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["slot", "n"])

    return run


def _short(order: Slots, least: float, grow: list[Slots]):
    """The bits of the keys of short rows, in words of 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ordered, growing = np.zeros(BITS, bool), order.counts(), [g.counts() > 0 for g in grow]
        for batch in batches:
            for key, _, _, short in _read(batch, ordered, least).rows(growing):
                seen[_bit(key[short])] = True
        bits = np.packbits(seen).view(np.int64)
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(bits[at])], names=["id", "bits"])

    return run


def _rows(order: Slots, least: float, grow: list[Slots], bits: np.ndarray):
    """``key, node, size, most, p0, p1, p2, p3``; ``most`` is negative in rows that are not short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, ordered, growing = np.unpackbits(bits.view(np.uint8)).view(bool), order.counts(), [g.counts() > 0 for g in grow]
        for batch in batches:
            sets = _read(batch, ordered, least)
            parities = sets.parities.view(np.int64)
            for key, row, most, short in sets.rows(growing):
                fit = short | wanted[_bit(key)]
                key, row, most, short = key[fit], row[fit], most[fit], short[fit]
                columns = [key.view(np.int64), sets.node[row], sets.size[row].astype(np.int32), np.where(short, most, -most).astype(np.int32), *parities[row].T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["key", "node", "size", "most", "p0", "p1", "p2", "p3"])

    return run


def _grow(sets: DataFrame, order: Slots, least: float, hot: int, splits: int) -> list[np.ndarray]:
    """For each level of keys the slots whose keys grow: those of more than ``hot`` sets, unless they make more work grown."""
    nodes = sets.count()

    def counted(k: int, grow: list[Slots], held: Slots | None = None) -> DataFrame:
        return sets.mapInArrow(_counts(order, least, k, grow, held), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))

    # what slots hold by chance is no crowd
    crowd = max(hot, nodes * 64 // SLOTS)
    grow: list[Slots] = []
    held = Slots.of(counted(1, grow).where(F.col("n") > crowd))
    while len(grow) < splits and len(held):
        k = len(grow) + 1
        more = Slots.of(counted(k + 1, [*grow, held]).where(F.col("n") > crowd))
        if len(more):
            work = Slots.of(counted(k, [*grow, held], more)).counts()
            held = held.where(work[held.slot] < held.n.astype(float) ** 2 / 2)
            more = Slots.of(counted(k + 1, [*grow, held]).where(F.col("n") > crowd))
        grow, held = [*grow, held], more
    return grow


def candidates(sets: DataFrame, least: float, hot: int, splits: int = SPLITS) -> DataFrame:
    """``a, b`` (a < b, each once): all pairs of ``sets`` (``node, s``, no set empty, elements 64-bit hashes) at ``least`` or more among them, and few others."""
    slot = F.pmod(F.col("e"), F.lit(SLOTS)).cast("int").alias("slot")
    many = sets.agg(F.sum(F.size("s"))).first()[0] or 0
    order = Slots.of(sets.select(F.explode("s").alias("e")).groupBy(slot).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(FEW, 2 * many // SLOTS)))
    grow = _grow(sets, order, least, hot, splits)
    # all words, so that what is sent has one size for all tables
    words = sets.mapInArrow(_short(order, least, grow), "id long, bits long").union(sets.sparkSession.range(BITS // 64).select("id", F.lit(0).cast("long")))
    found = words.groupBy("id").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, np.int64)
    bits[found["id"].to_numpy()] = found["bits"].to_numpy()
    numbers = ["size", "most", "p0", "p1", "p2", "p3"]
    rows = sets.mapInArrow(_rows(order, least, grow, bits), "key long, node long, size int, most int, p0 long, p1 long, p2 long, p3 long")
    x, y = (rows.select("key", F.col("node").alias(f"{k}_node"), *(F.col(c).alias(f"{k}_{c}") for c in numbers)) for k in "xy")
    both = F.col("x_size") + F.col("y_size")
    need = F.greatest(F.ceil(both * F.lit(least / (1 + least)) - F.lit(_SLACK)), F.lit(1))
    apart = sum((F.bit_count(F.col(f"x_p{i}").bitwiseXOR(F.col(f"y_p{i}"))) for i in range(4)), F.lit(0))
    # each condition and column is of both sides, so that the sides stay one exchange; the rows are many for any table, too many to be sent round
    ordered = (F.col("x_size") < F.col("y_size")) | ((F.col("x_size") == F.col("y_size")) & (F.col("x_node") < F.col("y_node")))
    met = x.join(y.hint("merge"), "key").where((F.least("x_most", F.abs("y_most")) >= need) & ordered & (apart <= both - 2 * need))
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
