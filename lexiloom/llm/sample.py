"""Bounded samples for fitting, the same whenever they are drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

_RANGE = 1 << 40


def least_hashed_by(rows: DataFrame, key: str, by: str, most: int, wanted: Column | None = None) -> list[Row]:
    """At most ``most`` rows of each value of ``by`` (few values, not null): those whose key has the least hash.

    Each value has a threshold of its own from its count over all rows, a quarter above the share that is
    needed, so that a rare value is not lost among frequent ones and tasks send only about what is wanted.
    Rows that aren't ``wanted`` are left out of the sample; they are few and are counted, which needs no look at
    their texts.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(by).isNotNull()).groupBy(by).count().collect()}
    if not counts:
        return []
    shares = F.create_map(*[x for v, n in counts.items() for x in (F.lit(v), F.lit(int(min(1.0, 1.25 * (most + 20) / n) * _RANGE)))])
    hashed = rows.withColumn("_h", F.pmod(F.xxhash64(F.col(key)), F.lit(_RANGE))).where(F.col("_h") < shares[F.col(by)])
    if wanted is not None:
        hashed = hashed.where(wanted)
    held: dict = {}
    for r in sorted(hashed.collect(), key=lambda r: (r["_h"], r[key])):
        own = held.setdefault(r[by], [])
        if len(own) < most:
            own.append(r)
    return [r for v in sorted(held) for r in held[v]]


def least_hashed(rows: DataFrame, key: str, most: int, total: int) -> list[Row]:
    """At most ``most`` rows: those whose key has the least hash.

    ``total`` is about the number of rows. It sets a threshold a quarter above the share that is needed, so
    that tasks send only about as many rows as are wanted in all, however many tasks there are.
    """
    hashed = rows.withColumn("_h", F.pmod(F.xxhash64(F.col(key)), F.lit(_RANGE)))
    share = 1.25 * (most + 20) / max(total, 1)
    if share < 1:
        hashed = hashed.where(F.col("_h") < int(share * _RANGE))
    return hashed.orderBy("_h", *rows.columns).limit(most).collect()
