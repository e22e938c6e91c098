"""Look-ups in the translation memory: browsing, exact, keyword and vector search, and their merging."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Query vectors sent to the workers at once; more are searched block by block.
QUERY_BLOCK = 8_192


def contains_text(c: Column, keyword: str) -> Column:
    """The keyword stands in the text, letter case aside; ``%`` and ``_`` are ordinary characters."""
    return F.contains(F.lower(c), F.lit(keyword.lower()))


def browse(rows: DataFrame, equal: dict[str, str | None], keyword: str | None, texts: list[str]) -> DataFrame:
    """Rows that meet all given equalities and hold the keyword in one of the texts; null conditions are left out."""
    for c, v in equal.items():
        if v is not None:
            rows = rows.where(F.col(c) == v)
    if keyword:
        found = F.lit(False)
        for t in texts:
            found = found | F.coalesce(contains_text(F.col(t), keyword), F.lit(False))
        rows = rows.where(found)
    return rows


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of ordered rows; the order must be total. Pages count from one, sizes are held within 1 and 1000."""
    size = min(max(size, 1), 1000)
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def top_per_query(hits: DataFrame, query: str, order: list[Column], n: int) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(*order))).where(F.col("rank") <= n)


def exact(queries: DataFrame, rows: DataFrame, on: list[str], key: str, n: int) -> DataFrame:
    """Up to ``n`` rows that equal each query in all of ``on``, by key; flagged rows are left out beforehand by the caller."""
    joined = queries.select("query_id", *on).join(rows, on)
    return top_per_query(joined, "query_id", [F.col(key)], n)


def tiered(tiers: list[DataFrame], query: str, same: list[str], order: list[Column], n: int) -> DataFrame:
    """Tiers united in order until each query has ``n`` rows; a row equal in ``same`` to one of an earlier tier, or earlier in its own, is left out."""
    every = None
    for i, t in enumerate(tiers):
        t = t.withColumn("tier", F.lit(i))
        every = t if every is None else every.unionByName(t)
    first = F.row_number().over(W.partitionBy(query, *same).orderBy("tier", *order))
    return top_per_query(every.withColumn("_f", first).where("_f = 1").drop("_f"), query, [F.col("tier"), *order], n)


def variants(rows: DataFrame, label: str, code: str) -> DataFrame:
    """The distinct labels whose head is the code."""
    return rows.select(label).distinct().where(T.label_head(F.col(label)) == code.upper())


def _search(ids: np.ndarray, queries: np.ndarray, k: int, skip_self: bool, most: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, v, d = (np.concatenate(x) for x in zip(*best))
            order = np.lexsort((v, d, q))
            q, v, d = q[order], v[order], d[order]
            start = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
            place = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0)) if len(q) else np.arange(0)
            keep = place < k
            return q[keep], v[keep], d[keep]

        for b in batches:
            if not len(b):
                continue
            m = np.stack([np.asarray(x, np.float64) for x in b["v"]])
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m = m / np.where(norm == 0, 1, norm)
            own = b["id"].to_numpy(np.int64)
            dist = 1.0 - queries @ m.T
            if skip_self:
                dist[ids[:, None] == own[None, :]] = np.inf
            part = np.argpartition(dist, min(k, dist.shape[1]) - 1, axis=1)[:, :k] if dist.shape[1] > 4 * k else np.broadcast_to(np.arange(dist.shape[1]), dist.shape)
            edge = np.take_along_axis(dist, part, 1).max(axis=1) if dist.shape[1] > 4 * k else np.full(len(ids), np.inf)
            at_q, at_v = np.nonzero((dist <= edge[:, None]) & (dist <= most))  # ties at the edge stay
            best.append((ids[at_q], own[at_v], dist[at_q, at_v]))
            if len(best) > 8:
                best[:] = [merged()]
        if best:
            q, v, d = merged()
            yield pd.DataFrame({"query_id": q, "id": v, "distance": d})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, most: float = math.inf, skip_self: bool = True) -> DataFrame:
    """``query_id, id, distance, rank``: the ``k`` nearest by cosine distance, ties by id, up to a distance.

    ``vectors`` and ``queries`` have ``id`` and ``v``. The search is exact: each task multiplies its vectors
    with a block of queries and keeps its own best, which are merged. The queries of a block are broadcast;
    their number is bounded, and more blocks are made of more queries, by hash. Null and empty vectors take
    no part; a zero vector is at distance one from all.
    """
    usable = (F.col("v").isNotNull()) & (F.size("v") > 0)
    asked = queries.where(usable).select(F.col("id").cast("long").alias("id"), "v")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    out = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else asked
        rows = part.collect()
        ids = np.array([r["id"] for r in rows], np.int64)
        m = np.array([r["v"] for r in rows], np.float64) if rows else np.zeros((0, 1))
        norm = np.linalg.norm(m, axis=1, keepdims=True) if len(rows) else np.ones((0, 1))
        m = m / np.where(norm == 0, 1, norm)
        held = vectors.where(usable).select(F.col("id").cast("long").alias("id"), "v")
        run = _search(ids, m, k, skip_self, most) if len(rows) else lambda it: (pd.DataFrame({"query_id": [], "id": [], "distance": []}) for _ in it)
        found = held.mapInPandas(run, "query_id long, id long, distance double")
        out = found if out is None else out.unionByName(found)
    return top_per_query(out, "query_id", [F.col("distance"), F.col("id")], k)


def attach_first(hits: DataFrame, rows: DataFrame, on: list[str], order: list[Column], hit: list[str]) -> DataFrame:
    """Each hit with the first row that equals it in ``on``; hits without one are left out."""
    joined = hits.join(rows, on)
    return joined.withColumn("_n", F.row_number().over(W.partitionBy(*hit).orderBy(*order))).where("_n = 1").drop("_n")


def similarity(distance: Column) -> Column:
    return F.bround(F.lit(1.0) - distance, 3)


def exact_then_nearest(queries: DataFrame, rows: DataFrame, hits: DataFrame, n: int, most: float = 0.8) -> DataFrame:
    """``query_id, rank, match, similarity, pair_id, source_text, target_text, section_code`` of up to ``n`` examples for each query.

    ``queries``: query_id, source_group, source_text, target_lang (null: any language). ``rows``: the memory without flagged
    rows. ``hits``: query_id, source_text, distance of the nearest texts. Rows with the query's very text come first, then
    the texts of hits up to a distance, each with its first row of the query's language, or of the first language in order;
    a text that is there already isn't taken again.
    """
    asked = queries.select("query_id", "source_group", F.col("source_text").alias("_q"), "target_lang")
    own = rows.select("source_group", "source_text", F.col("target_lang").alias("_lang"), "pair_id", "target_text", "section_code")
    same = asked.where("target_lang is not null").join(own, (asked["source_group"] == own["source_group"]) & (asked["_q"] == own["source_text"]) & (asked["target_lang"] == own["_lang"]))
    exact_rows = top_per_query(same.select("query_id", "pair_id", "source_text", "target_text", "section_code"), "query_id", [F.col("pair_id")], n).drop("rank")
    tier0 = exact_rows.select("query_id", F.lit(0).alias("tier"), F.lit(0.0).alias("distance"), "pair_id", "source_text", "target_text", "section_code")
    near = hits.where((F.col("distance") <= most) & F.col("source_text").isNotNull()).groupBy("query_id", "source_text").agg(F.min("distance").alias("distance"))
    near = near.join(exact_rows.select("query_id", "source_text").distinct(), ["query_id", "source_text"], "left_anti")
    wanted = near.join(asked.drop("_q"), "query_id")
    found = wanted.join(own, ["source_group", "source_text"]).where(F.col("target_lang").isNull() | (F.col("target_lang") == F.col("_lang")))
    first = found.groupBy("query_id", "source_text", "distance").agg(F.min_by(F.struct("pair_id", "target_text", "section_code"), F.struct("_lang", "pair_id")).alias("_r"))
    tier1 = first.select("query_id", F.lit(1).alias("tier"), "distance", F.col("_r.pair_id").alias("pair_id"), "source_text", F.col("_r.target_text").alias("target_text"), F.col("_r.section_code").alias("section_code"))
    best = top_per_query(tier0.unionByName(tier1), "query_id", [F.col("tier"), F.col("distance"), F.col("pair_id")], n)
    match = F.when(F.col("tier") == 0, "exact").otherwise("semantic")
    return best.select("query_id", "rank", match.alias("match"), similarity(F.col("distance")).alias("similarity"), "pair_id", "source_text", "target_text", "section_code")


def examples_text(found: DataFrame) -> DataFrame:
    """``query_id, examples``: the examples of each query as a block of text in order of rank."""
    told = F.when(F.col("match") == "semantic", F.concat(F.lit(", similarity: "), F.col("similarity").cast("string"))).otherwise("")
    block = F.concat(
        F.lit("Example "), F.col("rank").cast("string"), F.lit(" (match: "), F.col("match"), told, F.lit(", section: "), F.coalesce("section_code", F.lit("None")), F.lit("):\n"),
        F.lit('  Source: "'), F.col("source_text"), F.lit('"\n  Translation: "'), F.coalesce("target_text", F.lit("")), F.lit('"'),
    )
    listed = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return found.groupBy("query_id").agg(F.concat(F.lit("[Translation Memory Examples]\n"), F.array_join(F.transform(listed, lambda x: x["b"]), "\n\n")).alias("examples"))


def look_up(rows: DataFrame, group: str, query: str | None, labels: list[str], n: int, story: str | None = None, section: str | None = None, flagged: bool = False) -> DataFrame:
    """Up to ``n`` rows of a group by label, story and section: the query's very text, then texts that hold it; without a query all such rows by id."""
    held = browse(rows, {"source_group": group, "story_id": story, "section_code": section}, None, [])
    held = held if flagged else held.where("tone_flag is null")
    held = held.where(F.col("target_lang").isin(labels)) if labels else held
    held = held.withColumn("query_id", F.lit(1))
    if query is None:
        return top_per_query(held, "query_id", [F.col("pair_id")], n).withColumn("tier", F.lit(2)).drop("query_id")
    hit = browse(held, {}, query, ["source_text", "target_text"])
    return tiered([held.where(F.col("source_text") == query), hit.where(~F.coalesce(F.col("source_text") == query, F.lit(False)))], "query_id", ["source_text", "target_lang"], [F.col("pair_id")], n).drop("query_id")


def by_mode(mode: str, **tiers):
    """Which of the given look-ups a mode takes: ``offline``, ``semantic``, or ``auto`` for the first that is given."""
    if mode == "auto":
        mode = next((m for m in ("semantic", "offline") if tiers.get(m) is not None), "")
    if tiers.get(mode) is None:
        raise ValueError(f"no look-up for mode {mode or 'auto'}")
    return tiers[mode]()
