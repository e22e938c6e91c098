"""Document and segment languages by Bayesian fusion of four kinds of evidence.

The text's likelihood comes from a naive Bayes model over words (single characters for Han, letter
trigrams for words not seen), fitted on at most ``TRAIN_ROWS`` rows of each language whose declared label is a
canonical name, in two rounds: the second leaves out sentences that the first assigns elsewhere. It is combined with
the declared label (the sheet), the label at the end of the record's address (``file::label::row``), and a
prior of the host (the file), which is smoothed towards its story's and that towards the whole table's, all
by grouped aggregation over all rows. Segments of a text (sentences, lines, entries) get a language of
their own where their likelihood speaks against the text's by more than a prior of mixing. How much a label weighs
is fitted too: the log odds that labels and texts of the sample agree.

Defined cases: null and blank texts and placeholders get no language; a text without any word (numbers
only) gets the language of the labels and the host, with a low confidence; ties go to the language first
in alphabetical order; texts are read whole; rows without a host use the table's prior.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .forms import LOOKALIKE_FROM, LOOKALIKE_TO, blank
from .sample import least_hashed_by

TRAIN_ROWS = 1_000
#: Hosts whose priors are sent to the workers (some 200 bytes each); beyond it they are joined.
MAX_HOSTS = 50_000
TOKEN = re.compile(r"[가-힣]+|[ぁ-ゖァ-ヺー]+|[㐀-鿿]|[、，]|[^\W\d_가-힣ぁ-ゖァ-ヺー㐀-鿿]+")
SEGMENT = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|[\r\n]+|\s+[/|]\s+|;\s+")
HIDDEN = re.compile("[­​-‏⁠﻿]")
_TWIN = str.maketrans(LOOKALIKE_FROM, LOOKALIKE_TO)
#: Bounds of the fitted log odds of a label, what an address suffix has of them, and the log odds of a segment to be in the text's language.
LABEL_LEAST, LABEL_MOST, SUFFIX_SHARE, MIX_ODDS = 1.0, 4.0, 0.75, 4.5
#: A word seen this often counts by half.
RARE = 5.0
#: Weight of an unseen word's letters beside a seen word, and the strength of smoothing along the hosts.
UNSEEN, KAPPA = 0.25, 20.0


def _token(t: str) -> str:
    if not t.isascii() and re.search("[A-Za-z]", t) and re.search("[Ͱ-ӿ]", t):
        return t.translate(_TWIN)  # a Latin word with look-alike letters
    return t


def segments(text: str) -> list[list[str]]:
    """Words of each segment; segments without a word are left out."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", HIDDEN.sub("", text).replace("，", "\u0001").replace("、", "\u0002")).replace("\u0001", "，").replace("\u0002", "、")
    return [found for s in SEGMENT.split(text) if s and (found := TOKEN.findall(s))]


def _trigrams(w: str) -> list[str]:
    w = f"^{w}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


class Model:
    """Log likelihoods of words and letter trigrams for each language."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.ids: dict[str, int] = {}
        self.matrix = np.zeros((1, len(langs)), np.float32)
        self.tri: dict[str, np.ndarray] = {}
        self.extra: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.label_odds = LABEL_MOST

    def index(self, tokens: list[str]) -> list[int]:
        """Rows of the matrix; unseen words are given a row of their own and remembered up to a bound."""
        extra, out = self.extra, []
        for t in tokens:
            i = extra.get(t)
            if i is None:
                own = _token(t)
                i = self.ids.get(own.lower())
                if i is None:
                    i = len(self.ids) + len(self.rows)
                    # an unseen word with a capital is a name more often than not and says nothing
                    self.rows.append(np.zeros(len(self.langs), np.float32) if own[0].isupper() else self.unseen(own))
                extra[t] = i
            out.append(i)
        return out

    def unseen(self, t: str) -> np.ndarray:
        grams = _trigrams(t)
        zero = np.zeros(len(self.langs), np.float32)
        got = sum((self.tri.get(g, zero) for g in grams), zero)
        return (UNSEEN * got / math.sqrt(len(grams))).astype(np.float32)

    def score(self, docs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods of all segments, and the document of each."""
        flat = [seg for d in docs for seg in d]
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        if not flat:
            return np.zeros((0, len(self.langs)), np.float32), owner
        if len(self.rows) > 300_000:
            self.extra, self.rows = {}, []
        at = [self.index(s) for s in flat]
        table = np.concatenate([self.matrix, np.array(self.rows, np.float32).reshape(-1, len(self.langs))])
        starts = np.concatenate([[0], np.cumsum([len(a) for a in at])[:-1]])
        return np.add.reduceat(table[np.concatenate([np.array(a) for a in at])], starts, axis=0), owner


def fit(rows: list[tuple[str, str]]) -> Model:
    """``rows``: text and language."""
    langs = sorted({lang for _, lang in rows})
    model = Model(langs)
    docs = [(segments(t), langs.index(lang)) for t, lang in rows]
    for turn in range(2):
        words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs), np.float32))
        for segs, k in docs:
            for s in segs:
                for w in {_token(t).lower() for t in s}:
                    words[w][k] += 1
        names = [w for w, n in words.items() if n.sum() >= 2]
        counts = np.array([words[w] for w in names], np.float32).reshape(-1, len(langs))
        total = counts.sum(axis=0) + 1
        # a word's likelihood, centred so that words of all languages say nothing
        logp = np.log((counts + 0.02) / total)
        logp -= np.log(np.exp(logp).mean(axis=1, keepdims=True))
        model.ids = {w: i for i, w in enumerate(names)}
        often = counts.sum(axis=1, keepdims=True)
        model.matrix = (np.clip(logp, -9, 3) * often / (often + RARE)).astype(np.float32)
        tri: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs), np.float32))
        for w, n in words.items():
            for g in _trigrams(w):
                tri[g] += n > 0
        every = np.array([0.5 + (np.array(list(tri.values()))[:, k]).sum() if tri else 1.0 for k in range(len(langs))], np.float32)
        model.tri = {}
        for g, n in tri.items():
            p = np.log((n + 0.3) / every)
            model.tri[g] = (p - p.mean()).astype(np.float32)
        model.extra, model.rows = {}, []
        if turn == 0:
            scores, owner = model.score([d for d, _ in docs])
            kept, at, agree, apart = [], 0, 1, 1
            for segs, k in docs:
                own = scores[at : at + len(segs)]
                at += len(segs)
                if len(segs):
                    mine = own.sum(axis=0)
                    agree, apart = (agree + 1, apart) if mine[k] >= mine.max() - 1e-6 else (agree, apart + 1)
                kept.append(([s for s, x in zip(segs, own) if x[k] >= x.max() - 2.0], k))
            docs = kept
            model.label_odds = min(max(math.log(agree / apart), LABEL_LEAST), LABEL_MOST)
    return model


def assign(model: Model, texts: list[str], prior: np.ndarray) -> list[list[tuple[str, float, list[int]]]]:
    """For each text its languages with confidence and the numbers of their segments, the main one first."""
    docs = [segments(t) for t in texts]
    scores, owner = model.score(docs)
    post = prior.astype(np.float32)
    if len(scores):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        post[owner[first]] += np.add.reduceat(scores, first, axis=0)
    main = post.argmax(axis=1)
    sure = np.exp(post - post.max(axis=1, keepdims=True))
    sure = sure[np.arange(len(docs)), main] / sure.sum(axis=1)
    best = scores.argmax(axis=1) if len(scores) else np.zeros(0, np.int64)
    at = np.arange(len(scores))
    apart = (best != main[owner]) & (scores[at, best] - scores[at, main[owner]] > MIX_ODDS)
    mixed: dict[int, list[int]] = defaultdict(list)
    for k in np.flatnonzero(np.isin(owner, owner[apart])).tolist():
        mixed[int(owner[k])].append(k)
    out: list[list[tuple[str, float, list[int]]]] = []
    for i, (d, k, conf) in enumerate(zip(docs, main.tolist(), sure.tolist())):
        if i not in mixed:
            out.append([(model.langs[k], conf, list(range(len(d))))])
            continue
        found: dict[int, list] = {k: [conf, []]}
        for n, seg in enumerate(mixed[i]):
            lang = int(best[seg]) if apart[seg] else k
            q = np.exp(scores[seg] - scores[seg].max())
            found.setdefault(lang, [float(q[lang] / q.sum()), []])[1].append(n)
        if not found[k][1]:
            del found[k]
        out.append([(model.langs[x], c, segs) for x, (c, segs) in sorted(found.items(), key=lambda kv: (kv[0] != k, kv[0]))])
    return out


def host_priors(rows: DataFrame, langs: list[str], host: str, group: str, label: str) -> DataFrame:
    """``host, prior``: log priors of all languages, by counts smoothed from table to group to host."""
    counts = [F.count(F.when(F.col(label) == x, 1)).cast("double").alias(f"_c{i}") for i, x in enumerate(langs)]
    by_host = rows.where(f"{host} is not null").groupBy(host).agg(F.max(group).alias("_g"), *counts)
    sums = [F.sum(f"_c{i}").alias(f"_s{i}") for i in range(len(langs))]
    by_group = by_host.groupBy("_g").agg(*sums)
    total = rows.agg(*counts).first()
    whole = [(total[i] or 0.0) + 1.0 for i in range(len(langs))]
    whole = [x / sum(whole) for x in whole]
    n_g = sum((F.col(f"_s{i}") for i in range(len(langs))), F.lit(0.0))
    n_h = sum((F.col(f"_c{i}") for i in range(len(langs))), F.lit(0.0))
    smooth = []
    for i in range(len(langs)):
        p_g = (F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) + KAPPA * whole[i]) / (F.coalesce(n_g, F.lit(0.0)) + KAPPA)
        smooth.append(F.log((F.col(f"_c{i}") + KAPPA * p_g) / (n_h + KAPPA)))
    out = by_host.join(by_group, "_g", "left").select(F.col(host).alias("_host"), F.array(*smooth).alias("_prior"))
    return out, [math.log(x) for x in whole]


def train(rows: DataFrame, text: str, label: str, key: str, most: int = TRAIN_ROWS) -> Model:
    """Fit on the ``most`` rows of each label whose key has the least hash. A language needs rows here to be told."""
    held = rows.where(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("l"))
    return fit([(r["t"], r["l"]) for r in least_hashed_by(held, "k", "l", most, ~blank(F.col("t")))])


def _assigned(rows: DataFrame, model: Model, key: str, text: str, declared: str, suffix: str, host: str, group: str, make, schema: str) -> DataFrame:
    """Texts with their evidence, assigned batch by batch; ``make(ids, declared, found)`` shapes the rows."""
    langs = model.langs
    labels = rows.select(F.col(host).alias("_host"), F.col(group).alias("_group"), F.coalesce(F.col(declared), F.col(suffix)).alias("_label"))
    priors, whole = host_priors(labels, langs, "_host", "_group", "_label")
    priors = cut(priors)
    shared = rows.sparkSession.sparkContext.broadcast((model, np.array(whole, np.float32)))
    held = rows.where(~blank(F.col(text))).select(F.col(key).alias("id"), F.col(text).alias("t"), F.col(declared).alias("declared"), F.col(suffix).alias("suffix"), F.col(host).alias("_host"))
    if priors.count() <= MAX_HOSTS:
        joined = held.join(F.broadcast(priors), "_host", "left")
    else:  # rows without a host are spread over many keys; none of these is a host's name
        spread = F.coalesce("_host", F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("id"), F.lit(1024)).cast("string")))
        joined = held.withColumn("_host", spread).join(priors, "_host", "left")
    joined = joined.select("id", "t", "declared", "suffix", "_prior")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, table = shared.value
        place = {x: i for i, x in enumerate(own.langs)}
        for b in batches:
            if not len(b):
                continue
            prior = np.stack([table if p is None else np.asarray(p, np.float32) for p in b["_prior"]])
            for col, odds in (("declared", own.label_odds), ("suffix", SUFFIX_SHARE * own.label_odds)):
                at = np.array([place.get(x, -1) for x in b[col]], np.int64)
                hit = np.flatnonzero(at >= 0)
                prior[hit, at[hit]] += odds
            yield make(b["id"].tolist(), b["declared"].tolist(), assign(own, b["t"].tolist(), prior))

    kind = dict(rows.select(key).dtypes)[key]
    return joined.mapInPandas(run, schema.format(kind)).withColumnRenamed("id", key)


def languages(rows: DataFrame, model: Model, key: str, text: str, declared: str, suffix: str, host: str, group: str) -> DataFrame:
    """``<key>, declared, languages array<struct<iso, confidence, segments>>`` for every text that holds any.

    ``declared`` and ``suffix`` are columns with languages or null, ``host`` and ``group`` name where a row comes from.
    """

    def make(ids, labels, found):
        return pd.DataFrame({"id": ids, "declared": labels, "languages": [[{"iso": l, "confidence": c, "segments": s} for l, c, s in f] for f in found]})

    schema = "id {}, declared string, languages array<struct<iso string, confidence double, segments array<int>>>"
    return _assigned(rows, model, key, text, declared, suffix, host, group, make, schema)


def mislabelled_rows(rows: DataFrame, model: Model, key: str, text: str, declared: str, suffix: str, host: str, group: str) -> DataFrame:
    """What ``mislabelled`` makes of ``languages``, without the other texts' results on the way."""

    def make(ids, labels, found):
        out = [(i, x[0]) for i, d, f in zip(ids, labels, found) if d is None or len(f) > 1 or f[0][0] != d for x in f]
        return pd.DataFrame(out, columns=["id", "iso"])

    return _assigned(rows, model, key, text, declared, suffix, host, group, make, "id {}, iso string")


def mislabelled(found: DataFrame, key: str) -> DataFrame:
    """``<key>, iso``: one row for each language of a text that isn't wholly in the declared one, or has none declared."""
    alone = (F.size("languages") == 1) & (F.col("languages")[0]["iso"] == F.col("declared"))
    return found.where(F.col("declared").isNull() | ~alone).select(key, F.explode(F.col("languages.iso")).alias("iso"))
