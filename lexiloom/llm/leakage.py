"""Held-out passages inside a corpus: SimHash of item-sized windows, multi-index Hamming search, exact check.

Each item has windows of its own size, for its whole text, and windows of ten words, for passages of it. They
are broadcast after their number was checked; more than ``MAX_WINDOWS`` are sent in blocks, and documents are
read once for all blocks. A document's windows are fingerprinted by running sums over its words' 64 bits. A
fingerprint is cut into ``radius + 1`` blocks: two within the radius agree in one block at least, so looking
up every block finds all of them. Each candidate is verified by the weighted similarity of its word shingles
(rarer shingles among the items weigh more); ``exact`` tells that the words are equal too.

An edited copy of an item at a similarity of 0.8 keeps a run of ten words or more if it is longer than some
twenty words, so the windows of ten find it although its own fingerprint may be beyond the radius.

Defined cases: null documents and items and those without words give no row; items of fewer than ten words
are searched whole; a document shorter than a window has none; repeated items or documents each give their
own rows; a script without spaces is one word from mark to mark; very long documents are read whole; other
columns are not read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: The most windows in one broadcast: about 200 bytes each.
MAX_WINDOWS = 400_000
#: Words of a passage.
PASSAGE = 10


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.casefold()) if text else []


class Hasher:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 500_000):
        self.memo: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
        out = []
        for w in words:
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def fingerprints(hashes: np.ndarray, window: int) -> np.ndarray:
    """SimHash of each run of ``window`` words; empty if there are fewer."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    # running sums may wrap round: the difference of two is below the window's length
    kind = np.uint8 if window < 256 else np.uint32
    total = np.zeros((len(bits) + 1, 64), kind)
    np.cumsum(bits, axis=0, dtype=kind, out=total[1:])
    ones = total[window:] - total[:-window]
    # an even split is settled by the first word of the window, alike on both sides
    up = ones > kind(window // 2)
    if window % 2 == 0:
        up |= (ones == kind(window // 2)) & (bits[:n] == 1)
    return np.packbits(up, axis=1).view("<u8").ravel()


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """An order-sensitive hash of each run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


class Items:
    """Fingerprints, words and shingle weights of a block of held-out items, ready for block look-ups."""

    def __init__(self, rows: list[tuple[int, str]], window: int, radius: int, size: int):
        hasher = Hasher()
        self.window, self.radius, self.size = window, radius, size
        ids, prints, hashed, starts, at = [], [], [], [], 0
        for item, text in rows:
            h = hasher(words_of(text))
            p = fingerprints(h, window)
            ids.append(np.full(len(p), item, np.int64))
            prints.append(p)
            starts.append(np.arange(len(p)) + at)
            hashed.append(h)
            at += len(h)
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        self.prints = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.words = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
        count: Counter = Counter()
        for h in hashed:
            count.update(set(shingles(h, size).tolist()))
        self.known = np.array(sorted(count) or [0], dtype=np.uint64)
        self.known_weight = np.array([math.log(1 + len(rows) / count[k]) if count else 0.0 for k in self.known.tolist()])
        self.parts = shingles(self.words, size)
        self.part_weight = self.known_weight[np.minimum(np.searchsorted(self.known, self.parts), len(self.known) - 1)]
        blocks = radius + 1
        edges = [64 * k // blocks for k in range(blocks + 1)]
        self.cuts = [(np.uint64(edges[k]), np.uint64((1 << (edges[k + 1] - edges[k])) - 1)) for k in range(blocks)]
        self.order, self.keys, self.filter = [], [], []
        for low, mask in self.cuts:
            key = (self.prints >> low) & mask
            order = np.argsort(key, kind="stable")
            self.order.append(order)
            self.keys.append(key[order])
            seen = np.zeros(1 << 16, bool)  # a first look by 16 bits
            seen[(key & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.filter.append(seen)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (document window, item window) whose fingerprints differ in ``radius`` bits at most: all of them."""
        left, right = [], []
        for (low, mask), order, keys, seen in zip(self.cuts, self.order, self.keys, self.filter):
            key = (prints >> low) & mask
            at = np.flatnonzero(seen[(key & np.uint64(0xFFFF)).astype(np.int64)])
            if not len(at):
                continue
            first = np.searchsorted(keys, key[at], "left")
            n = np.searchsorted(keys, key[at], "right") - first
            total = int(n.sum())
            if not total:
                continue
            a = np.repeat(at, n)
            b = order[np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)]
            near = np.bitwise_count(prints[a] ^ self.prints[b]) <= self.radius
            left.append(a[near])
            right.append(b[near])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(left).astype(np.int64) * (len(self.prints) + 1) + np.concatenate(right))
        return pairs // (len(self.prints) + 1), pairs % (len(self.prints) + 1)

    def similarity(self, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Weighted Jaccard of the shingle sets of pairs of windows: document windows ``a``, item windows ``b``."""
        span = np.arange(self.window - self.size + 1)
        x = shingles(doc, self.size)[a[:, None] + span]
        at = self.starts[b][:, None] + span
        y, wy = self.parts[at], self.part_weight[at]
        k = np.minimum(np.searchsorted(self.known, x), max(len(self.known) - 1, 0))
        wx = np.where(self.known[k] == x, self.known_weight[k], math.log(2))
        for m in range(1, len(span)):  # a shingle that stands twice counts once
            wx[:, m] *= (x[:, m : m + 1] != x[:, :m]).all(axis=1)
            wy = np.where((np.arange(len(span)) == m) & (y[:, m : m + 1] == y[:, :m]).any(axis=1, keepdims=True), 0.0, wy)
        both = np.zeros(len(a))
        for m in range(len(span)):
            both += wx[:, m] * (x[:, m : m + 1] == y).any(axis=1)
        return both / np.maximum(wx.sum(axis=1) + wy.sum(axis=1) - both, 1e-12)


#: One worker's search structure, by the name the driver gave its block of items.
_READY: dict[str, list[Items]] = {}


def _search(blocks: list[tuple[str, Broadcast]], radius: int, size: int, least: float):
    """Documents are read and hashed once, then looked up in each block of items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            docs, ids = [], []
            for doc, text in zip(batch["doc"].tolist(), batch["text"].tolist()):
                h = hasher(words_of(text))
                if len(h):
                    docs.append(h)
                    ids.append(doc)
            found = []
            for name, shared in blocks:
                held = _READY.get(name)
                if held is None:
                    if len(blocks) > 1:  # one block at a time
                        _READY.clear()
                    by_window: dict[int, list] = {}
                    for item, text, window in shared.value:
                        by_window.setdefault(window, []).append((item, text))
                    held = _READY[name] = [Items(rows, window, radius, min(size, window)) for window, rows in sorted(by_window.items())]
                for items in held:
                    # several documents at once; windows across a border are left out
                    group, size_now = [], 0
                    for k in range(len(docs) + 1):
                        if group and (k == len(docs) or size_now + len(docs[k]) > 60_000):
                            found += _scan(items, [docs[g] for g in group], [ids[g] for g in group], least)
                            group, size_now = [], 0
                        if k < len(docs) and len(docs[k]) >= items.window:
                            group.append(k)
                            size_now += len(docs[k])
            yield pd.DataFrame(found, columns=["doc", "item", "window", "windows", "similarity", "exact"])

    return run


def _scan(items: Items, docs: list[np.ndarray], ids: list[int], least: float) -> list[tuple]:
    joined = np.concatenate(docs)
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    prints = fingerprints(joined, items.window)
    inside = owner[: len(prints)] == owner[items.window - 1 :]
    a, b = items.candidates(prints)
    keep = inside[a]
    a, b = a[keep], b[keep]
    if not len(a):
        return []
    alike = items.similarity(joined, a, b)
    keep = alike >= least - 1e-9
    a, b, alike = a[keep], b[keep], alike[keep]
    span = np.arange(items.window)
    same = (joined[a[:, None] + span] == items.words[items.starts[b][:, None] + span]).all(axis=1)
    out: dict[tuple[int, int], list] = {}
    for x, d, item, s, equal in zip(a.tolist(), owner[a].tolist(), items.ids[b].tolist(), alike.tolist(), same.tolist()):
        seen = out.setdefault((d, item), [set(), 0.0, False])
        seen[0].add(x)
        seen[1] = max(seen[1], min(s, 1.0))
        seen[2] |= equal
    return [(ids[d], item, items.window, len(v[0]), v[1], v[2]) for (d, item), v in out.items()]


def window_sizes(words: int, passage: int = PASSAGE, whole: bool = True) -> list[int]:
    """The windows of an item of so many words: ten for passages, and one of the item's own size.

    Own sizes are exact up to ten words, above it the largest of ten times a power of two, so that documents are
    fingerprinted for few sizes; an item's windows then begin at each of its words as long as they fit.
    """
    own = []
    if whole and words:
        own = [words] if words <= passage else [passage << int(math.log2(words / passage) + 1e-9)]
    return sorted({*own, *([passage] if words >= passage else [])})


def leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    passage: int = PASSAGE,
    whole: bool = True,
    radius: int = 3,
    shingle: int = 5,
    least: float = 0.8,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """``doc, item, window, windows, similarity, exact``: which documents hold windows of which items.

    ``window`` is the window's length in words, ``windows`` counts the document's windows that match,
    ``similarity`` is the best weighted similarity, ``exact`` tells that a window is equal word by word.
    ``whole=False`` leaves out the windows of the items' own sizes.
    """
    spark = documents.sparkSession
    held = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    # windows of an item are fewer than twice its letters; the bound holds before anything is gathered
    letters = held.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(letters / 2 / max_windows))
    docs = documents.select(F.col(doc_id).cast("long").alias("doc"), F.col(doc_text).alias("text")).where("text is not null")
    shared = []
    for k in range(blocks):
        part = held.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else held
        rows = [(r["item"], r["text"], w) for r in part.collect() for w in window_sizes(len(words_of(r["text"])), passage, whole)]
        shared.append((uuid.uuid4().hex, spark.sparkContext.broadcast(rows)))
    return docs.mapInPandas(_search(shared, radius, shingle, least), "doc long, item long, window int, windows long, similarity double, exact boolean")
