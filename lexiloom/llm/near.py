"""Near-duplicates with small edits: Golay-code fuzzy hashing of sentence fingerprints, and the sets of shingles for the rest.

Each distinct text is one node, whatever its number of copies. Its sentences (or lines) get fingerprints of
two Golay segments: signed sums over the sentence's words, weighted by the square of the corpus-wide inverse
document frequency; a word of one text alone can be shared with no other and weighs nothing. A segment is
decoded to the indices of the codewords near it. The keys of a node are, for each sentence, the own index of one of
its two segments with each index near the other, and the sentence's rarest word: few errors by the pigeonhole
principle leave one segment right and the other near. Nodes that share a key of at most ``hot`` nodes are pairs.

Texts with an edit in every sentence may share no key, and a key of more nodes makes no pairs. So all pairs are also
looked for by their shingles, by bounds that no near pair exceeds (``overlap``): the result is exact, and ``hot``
decides about the work only. All pairs are verified by the exact Jaccard similarity of their word shingles.

Defined cases: null texts and texts without words take no part; texts of fewer words than a shingle are
compared by all their words as one shingle; equal texts are one node and never a pair; very long texts are
read whole; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import golay, overlap
from .forms import skeleton
from .overlap import mix

SEGMENTS = 2
BITS = SEGMENTS * golay.LENGTH
#: A key with more nodes makes no pairs by itself: those are left to the sets.
HOT = 200
#: Counters of words: document frequencies are kept by hash, so that what is sent round has one size for all corpora.
COUNTERS = 1 << 20
PART = re.compile(r"(?<=[.!?。！？])\s*|[\n\r]+")
WORD = re.compile(r"[^\W_]+")
_FEW = np.uint64(0xFFFFFFFFFFFFFFFF)


def words(c: Column) -> Column:
    return F.filter(F.split(c, "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def shingle_set(w: Column, size: int, by=F.xxhash64) -> Column:
    """The distinct shingles of a word array as hashes; a short text is one shingle."""
    n = F.size(w)
    many = F.greatest(n - size + 1, F.lit(0))
    runs = F.slice(w, 1, many)
    for k in range(1, size):  # word by word side by side: the array is read once for each place, not for each shingle
        runs = F.zip_with(runs, F.slice(w, k + 1, many), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.array_distinct(F.transform(F.when(n >= size, runs).when(n > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")), lambda x: by(x)))


def split_parts(line: str) -> list[list[str]]:
    return [ws for p in PART.split(line) if (ws := WORD.findall(p))]


class Fingerprints:
    """Weighted bits of words, remembered up to a bound."""

    def __init__(self, seen: np.ndarray, total: int, most: int = 200_000):
        self.seen, self.total, self.most = seen, total, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.bits: list[np.ndarray] = []
        self.rare: list[int] = []
        self.table = None

    def index(self, words: list[str]) -> list[int]:
        out = []
        for w in words:
            i = self.at.get(w)
            if i is None:
                i = self.at[w] = len(self.bits)
                h = xxhash.xxh64_intdigest(w.encode(), 42)  # as the JVM hashes it
                n = int(self.seen[h & (COUNTERS - 1)])
                weight = 0 if n < 2 else round(16 * np.log(1.0 + self.total / n) ** 2)
                bits = np.unpackbits(np.frombuffer(xxhash.xxh3_128_digest(w), np.uint8))[:BITS].astype(np.int64) * 2 - 1
                self.bits.append(bits * weight)
                self.rare.append((min(n, 0x7FFFFFFF) << 32 | h >> 32) if n > 1 else int(_FEW))
                self.table = None
            out.append(i)
        return out

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        if self.table is None:
            self.table = np.array(self.bits), np.array(self.rare, np.uint64)
        return self.table


class Parts:
    """Fingerprints of the sentences of some nodes."""

    def __init__(self, prints: Fingerprints, nodes: list[int], sentences: list[list[list[str]]]):
        flat = [(n, ws) for n, own in zip(nodes, sentences) for ws in own]
        self.node = np.array([n for n, _ in flat], np.int64)
        size = np.array([len(ws) for _, ws in flat])
        at = np.array([i for _, ws in flat for i in prints.index(ws)])
        bits, rare = prints.arrays()
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        up = np.add.reduceat(bits[at], start, axis=0) > 0
        powers = 1 << np.arange(golay.LENGTH)
        self.segments = np.stack([up[:, k * golay.LENGTH : (k + 1) * golay.LENGTH] @ powers for k in range(SEGMENTS)], axis=1).astype(np.uint32)
        self.rare = np.minimum.reduceat(rare[at], start)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """``node, key``, each key once for a node."""
        a, b = (golay.keys(self.segments[:, k]) for k in range(SEGMENTS))
        own = golay.index(self.segments).astype(np.int64)
        pairs = np.concatenate([np.where(b >= 0, own[:, :1] << golay.DATA | b, -1), np.where((a >= 0) & (a != own[:, :1]), a << golay.DATA | own[:, 1:], -1)], axis=1)
        part, place = np.nonzero(pairs >= 0)
        node, key = self.node[part], mix(pairs[part, place].astype(np.uint64), self.rare[part])
        order = np.lexsort((key, node))
        node, key = node[order], key[order]
        first = np.concatenate([[True], (np.diff(node) != 0) | (np.diff(key) != 0)])
        return node[first], key[first]


def _batches(batch: pa.RecordBatch, prints: Fingerprints) -> Iterator[Parts]:
    nodes, sentences, n = [], [], 0
    for node, shown in zip(batch.column("node").to_pylist(), batch.column("shown").to_pylist()):
        if not (own := split_parts(shown)):
            continue
        nodes.append(node)
        sentences.append(own)
        n += sum(map(len, own))
        if n > 60_000:
            yield Parts(prints, nodes, sentences)
            nodes, sentences, n = [], [], 0
            if len(prints.bits) > prints.most:
                prints.clear()
    if nodes:
        yield Parts(prints, nodes, sentences)


def _keys(seen: np.ndarray, total: int):
    """Batches of ``node, shown`` to ``node, key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(seen, total)
        for batch in batches:
            for parts in _batches(batch, prints):
                node, key = parts.keys()
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(key.view(np.int64))], names=["node", "key"])

    return run


def line_of(shown: Column) -> Column:
    """The words of a comparison form, one space between them: what tells nodes apart."""
    return F.array_join(words(shown), " ")


def nodes_of(rows: DataFrame, text: str) -> DataFrame:
    """``node, shown``: a node for each distinct word sequence, with one text of it in comparison form."""
    texts = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()  # copies are brought into form once
    shown = texts.select(skeleton(F.col("text")).alias("shown"))
    lines = shown.select(line_of(F.col("shown")).alias("line"), "shown").where("line <> ''")
    return cut(lines.groupBy("line").agg(F.min("shown").alias("shown")).select(F.monotonically_increasing_id().alias("node"), "shown"))


def _met(keyed: DataFrame, hot: int) -> DataFrame:
    """Pairs of nodes that share a key held by 2 to ``hot`` nodes."""
    # one shuffle by key serves both counts and the join; most keys are held by one node and end there. The join would add
    # the filter on one side only, and the exchange would be made twice
    keyed = keyed.select("node", "key").where("key is not null").repartition("key")
    counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    pair = counted.where("n = 2").select("key", "n", "low", "high")
    more = keyed.join(counted.where(F.col("n").between(3, hot)).select("key", "n").hint("shuffle_hash"), "key").select("key", "n", F.col("node").alias("low"), F.lit(None).cast("long").alias("high"))
    held = cut(pair.unionByName(more))
    two = held.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    fair = held.where("n > 2").select("key", F.col("low").alias("node"))
    return two.unionByName(_joined(fair, fair))


def _joined(one: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs of nodes of the two tables with the same key."""
    met = one.select(F.col("node").alias("x"), "key").join(other.select(F.col("node").alias("y"), "key"), "key").where("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_pairs(rows: DataFrame, text: str, least: float = 0.8, size: int = 5, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``node, shown`` (the distinct texts) and ``a, b, similarity`` (nodes, a < b)."""
    nodes = nodes_of(rows, text)
    # words are counted once per text, over all texts
    counted = nodes.select(F.explode(F.array_distinct(words(F.col("shown")))).alias("w")).groupBy(F.pmod(F.xxhash64("w"), F.lit(COUNTERS)).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    seen = np.zeros(COUNTERS, np.int64)
    seen[counted["c"].to_numpy()] = counted["n"].to_numpy()
    total = nodes.count()
    pairs = _met(nodes.select("node", "shown").mapInArrow(_keys(seen, total), "node long, key long"), hot)
    # what shares no key, or none of few nodes, is found by the sets
    sets = cut(nodes.select("node", shingle_set(words(F.col("shown")), size).alias("s")))
    pairs = pairs.unionByName(overlap.candidates(sets, least, hot))
    x, y = (sets.select(F.col("node").alias(k), F.col("s").alias(f"s{k}")) for k in "ab")
    full = pairs.distinct().join(x, "a").join(y, "b")
    both = F.size(F.array_intersect("sa", "sb"))
    jaccard = both / (F.size("sa") + F.size("sb") - both)
    return nodes, full.select("a", "b", jaccard.alias("similarity")).where(F.col("similarity") >= least)


def near_classes(rows: DataFrame, key: str, by: str, text: str, least: float, size: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``id, by, class`` for the rows of texts that are near another, and ``x, y, similarity`` (classes, x < y).

    A class is a text but for letter case, spacing and punctuation; classes whose texts are the same letters are no pair.
    """
    nodes, pairs = near_pairs(rows.select(F.col(text).alias("text")), "text", least, size)
    lines = nodes.select("node", line_of(F.col("shown")).alias("line"))
    x, y = (lines.select(F.col("node").alias(k), F.replace("line", F.lit(" ")).alias(f"x{k}")) for k in "ab")
    pairs = cut(pairs.join(x, "a").join(y, "b").where("xa <> xb").select("a", "b", "similarity"))
    # only nodes of a pair go on; their texts are found again by their words, and rows by their texts
    used = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    kept = rows.select(F.col(key).alias("id"), F.col(by).alias("by"), F.col(text).alias("text")).where("by is not null and text is not null")
    forms = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct().select("text", line_of(skeleton(F.col("text"))).alias("line"))
    texts = forms.join(lines.join(used, "node", "left_semi"), "line").select("text", "node")
    members = cut(kept.join(texts, "text").select("id", "by", F.col("node").alias("class")))
    return members, pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "similarity")


def near_rows(rows: DataFrame, key: str, by: str, text: str, least: float, size: int) -> DataFrame:
    """``a, b, similarity``: pairs of rows with equal ``by`` and near texts that differ in more than spacing and punctuation. All copies are paired; ``near_groups`` has the same links without that."""
    members, pairs = near_classes(rows, key, by, text, least, size)
    left = members.select(F.col("id").alias("ia"), "by", F.col("class").alias("x"))
    right = members.select(F.col("id").alias("ib"), "by", F.col("class").alias("y"))
    found = pairs.join(left, "x").join(right, ["y", "by"])
    return found.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "similarity")


def near_groups(rows: DataFrame, key: str, by: str, text: str, least: float, size: int) -> DataFrame:
    """``kind, a, b, similarity``: ``link`` rows between the least keys of near classes of one ``by``, and ``member`` rows from each row of such a class to its least key."""
    members, pairs = near_classes(rows, key, by, text, least, size)
    first = members.groupBy("by", "class").agg(F.min("id").alias("first"))
    x, y = (first.select("by", F.col("class").alias(k), F.col("first").alias(f"f{k}")) for k in "xy")
    links = cut(pairs.join(x, "x").join(y, ["y", "by"]).select("by", "x", "y", F.least("fx", "fy").alias("a"), F.greatest("fx", "fy").alias("b"), "similarity"))
    linked = links.select("by", F.col("x").alias("class")).union(links.select("by", F.col("y").alias("class"))).distinct()
    belong = members.join(first.join(linked, ["by", "class"], "left_semi"), ["by", "class"])
    return links.select(F.lit("link").alias("kind"), "a", "b", "similarity").unionByName(belong.select(F.lit("member").alias("kind"), F.col("id").alias("a"), F.col("first").alias("b"), F.lit(None).cast("double").alias("similarity")))
