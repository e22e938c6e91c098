"""Token counts under existing vocabularies: a trie with failure links for longest match, and exact byte-pair counts.

``Trie`` walks a word once: where the walk can't go on, the tokens settled so far were counted beforehand
for that node, and the failure link leads to the node from which it goes on. The count is exact for the
longest-match reading of the vocabulary and takes time linear in the bytes. ``BytePair`` counts exactly as
the byte-pair tokenizer of the same file does. Both split a text by the vocabulary's own pattern first; the
trie's counts of words are remembered up to a bound, which changes no result.

Defined cases: a null text has a null count, an empty one 0; texts are counted whole.
"""

from __future__ import annotations

import base64
import os
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Splits a text into words as byte-level vocabularies do (a fixed value of the published tokenizers).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 400_000


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def build(tokens: set[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges (key = node * 256 + byte, child), failure links, and the tokens settled at each node."""
    edges: dict[int, int] = {}
    ends = [False]
    for t in sorted(tokens | {bytes([b]) for b in range(256)}):
        node = 0
        for b in t:
            key = node << 8 | b
            child = edges.get(key)
            if child is None:
                child = edges[key] = len(ends)
                ends.append(False)
            node = child
        ends[node] = True
    children: dict[int, list[tuple[int, int]]] = {}
    for key, child in edges.items():
        children.setdefault(key >> 8, []).append((key & 255, child))
    fail, settled = [0] * len(ends), [0] * len(ends)
    queue = deque([0])
    while queue:
        node = queue.popleft()
        for b, child in children.get(node, ()):
            queue.append(child)
            if ends[child]:  # the whole string is a token: one token, and on from the root
                settled[child] = 1
                continue
            at, n = fail[node], settled[node]
            while (at << 8 | b) not in edges:
                n += settled[at]
                at = fail[at]
            fail[child], settled[child] = edges[at << 8 | b], n
    return np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32), np.array(fail, np.int32), np.array(settled, np.int32)


class Trie:
    """Longest-match counts; made from the arrays of ``build``."""

    def __init__(self, keys: np.ndarray, children: np.ndarray, fail: np.ndarray, settled: np.ndarray, pattern: str = PATTERN):
        self.edges = dict(zip(keys.tolist(), children.tolist()))
        self.fail, self.settled = fail.tolist(), settled.tolist()
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, int] = {}

    def word(self, word: bytes) -> int:
        edges, fail, settled = self.edges, self.fail, self.settled
        node = n = 0
        for b in word:
            key = node << 8 | b
            while key not in edges:
                n += settled[node]
                node = fail[node]
                key = node << 8 | b
            node = edges[key]
        while node:  # what is left at the end of the word
            n += settled[node]
            node = fail[node]
        return n

    def count(self, text: str) -> int:
        memo, n = self.memo, 0
        for w in self.split(text):
            k = memo.get(w)
            if k is None:
                if len(memo) > REMEMBERED:
                    memo.clear()
                k = memo[w] = self.word(w.encode("utf-8", "surrogatepass"))
            n += k
        return n


class BytePair:
    """Exact counts of the byte-pair tokenizer of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def count(self, text: str) -> int:
        return len(self.encode(text))


_BUILT: dict[str, tuple] = {}
_READY: dict[str, Trie | BytePair] = {}


def _path(folder: str, name: str) -> str:
    return os.path.join(folder, name)


def longest_match(spark: SparkSession, folder: str = TOKENIZERS, name: str = VOCABULARY):
    """A pandas function: the longest-match count of a text. The trie is built once and broadcast (some MB, by the vocabulary)."""
    path = _path(folder, name)
    if path not in _BUILT:
        _BUILT[path] = build(set(read_vocabulary(path)))
    shared = spark.sparkContext.broadcast(_BUILT[path])

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = "trie:" + path
        if key not in _READY:
            _READY[key] = Trie(*shared.value)
        trie = _READY[key]
        for texts in batches:
            yield texts.map(trie.count, na_action="ignore").astype("Int64")

    return count


def byte_pair(spark: SparkSession, folder: str = TOKENIZERS, name: str = VOCABULARY):
    """A pandas function: the exact byte-pair count of a text. The vocabulary is broadcast."""
    path = _path(folder, name)
    shared = spark.sparkContext.broadcast(read_vocabulary(path))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = "pairs:" + path
        if key not in _READY:
            _READY[key] = BytePair(shared.value)
        pairs = _READY[key]
        for texts in batches:
            yield texts.map(pairs.count, na_action="ignore").astype("Int64")

    return count


def section_kind(c: Column) -> Column:
    """The last word of a section's code: title, description, disclaimer, button; else ``other``."""
    kind = F.regexp_extract(F.lower(F.trim(c)), "_([a-z]+)$", 1)
    return F.when(kind.isNull() | (kind == ""), "other").otherwise(kind)


def token_totals(rows: DataFrame, text: str, count, slices: dict[str, Column]) -> DataFrame:
    """Totals of texts, characters and tokens by all slices together (``level`` = all) and by each alone (``level`` = its name).

    Texts are counted once; the finest totals are made first and the others from them. Null texts have no
    tokens and are left out of ``texts``; a null slice is a slice of its own.
    """
    names = list(slices)
    taken = rows.select(*[c.alias(f"_s{i}") for i, c in enumerate(slices.values())], F.length(text).alias("_n"), count(F.col(text)).alias("_t"))
    finest = taken.groupBy(*[f"_s{i}" for i in range(len(names))]).agg(F.count("_n").alias("texts"), F.sum(F.col("_n").cast("long")).alias("characters"), F.sum("_t").alias("tokens"))
    sets = [("all", list(range(len(names)))), *[(n, [i]) for i, n in enumerate(names)]]
    # each fine row stands once for each kind of total
    spread = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), *[(F.col(f"_s{i}") if i in kept else F.lit(None).cast("string")).alias(names[i]) for i in range(len(names))]) for level, kept in sets]))
    long = finest.select(spread.alias("_x"), "texts", "characters", "tokens").select("_x.*", "texts", "characters", "tokens")
    zero = F.lit(0).cast("long")
    return long.groupBy("level", *names).agg(F.sum("texts").alias("texts"), F.coalesce(F.sum("characters"), zero).alias("characters"), F.coalesce(F.sum("tokens"), zero).alias("tokens"))
