"""One surviving record per group of duplicates, built field by field from weighted votes.

Fields are unpivoted to long rows; each row votes for its normalised value with its source's trust times
a decay by age, votes are summed per value, the value with the most votes wins and its latest row gives
the field; then fields are pivoted back. Age is counted from the newest usable row of the group and field;
other rows of the same time count as a microsecond older, as the key orders them. A half-life far below a
microsecond (``STEEP``) makes the newest row outweigh any number of older ones, unless trust says otherwise
by more than ``2 ** 64``; a long one lets many trusted older rows outvote one newer.

Defined cases: a null time is the earliest; equal times are ordered by the key; equal votes go to the
value with the later row (votes are compared to twelve places, so that the order of summing decides nothing); a field without usable rows stays null, also in its ``_from`` column; groups
of fewer than ``least`` rows and rows with a null in a group column are left out. Groups may be of any
size: every step is an aggregate with a map-side combine, or a join that adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .forms import blank

#: Half-life in seconds at which a microsecond of age halves a vote 64 times.
STEEP = 1e-6 / 64
_FIRST = "timestamp_ntz'0001-01-01 00:00:00'"


def normal_value(c: Column) -> Column:
    """Values that differ only in case and spacing vote together."""
    return F.lower(F.regexp_replace(F.trim(c), "\\s+", " "))


def survivors(
    rows: DataFrame,
    group: dict[str, Column],
    fields: list[str],
    key: str,
    time: str,
    trust: Column | None = None,
    half_life_s: float = 30 * 86400.0,
    usable: Callable[[Column], Column] = lambda c: ~blank(c),
    least: int = 2,
) -> DataFrame:
    """One row per group: the group columns, ``group_id`` (least key), ``copies``, and for each field its value and ``<field>_from`` (the key of the row that gave it)."""
    g = [f"_g{i}" for i in range(len(group))]
    base = rows.select(
        *[c.alias(n) for n, c in zip(g, group.values())],
        F.col(key).alias("_id"),
        F.coalesce(F.col(time).cast("timestamp_ntz"), F.expr(_FIRST)).alias("_at"),
        (trust if trust is not None else F.lit(1.0)).cast("double").alias("_trust"),
        *[F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)],
    ).where(" and ".join(f"{n} is not null" for n in g))
    order = F.struct("_at", "_id")
    tops = [F.max(F.when(usable(F.col(f"_f{i}")), order)).alias(f"_top{i}") for i in range(len(fields))]
    groups = base.groupBy(*g).agg(F.min("_id").alias("group_id"), F.count(F.lit(1)).alias("copies"), *tops).where(F.col("copies") >= least)
    cells = F.explode(
        F.filter(
            F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"_f{i}").alias("value"), F.col(f"_top{i}").alias("top"), usable(F.col(f"_f{i}")).alias("ok")) for i in range(len(fields))]),
            lambda x: x["ok"],
        )
    )
    joined = base.join(groups.drop("copies"), g)
    long = joined.select("group_id", "_id", "_at", "_trust", cells.alias("_c")).select("group_id", "_id", "_at", "_trust", "_c.*")
    if half_life_s <= 0:
        raise ValueError("the half-life must be positive")
    newest = (F.col("_at") == F.col("top._at")) & (F.col("_id") == F.col("top._id"))
    age = F.unix_micros(F.col("top._at").cast("timestamp")) - F.unix_micros(F.col("_at").cast("timestamp"))
    age = F.when(newest, 0).otherwise(F.greatest(age, F.lit(1)))  # in microseconds
    decay = F.pow(F.lit(2.0), -age / F.lit(half_life_s * 1e6))
    voted = long.withColumn("_vote", F.col("_trust") * decay)
    by_value = voted.groupBy("group_id", "field", normal_value(F.col("value")).alias("_norm")).agg(
        F.round(F.sum("_vote"), 12).alias("_votes"), F.max(F.struct("_at", "_id", "value")).alias("_last")
    )
    rank = F.struct(F.col("_votes"), F.col("_last"))
    won = by_value.groupBy("group_id").agg(*[F.max_by("_last", F.when(F.col("field") == i, rank)).alias(f"_w{i}") for i in range(len(fields))])
    out = groups.select(*g, "group_id", "copies").join(won, "group_id", "left")
    return out.select(
        *[F.col(n).alias(name) for n, name in zip(g, group)],
        "group_id",
        "copies",
        *[F.col(f"_w{i}.value").alias(f) for i, f in enumerate(fields)],
        *[F.col(f"_w{i}._id").alias(f"{f}_from") for i, f in enumerate(fields)],
    )


def story_number(story: str = "story_id", file: str = "original_file") -> Column:
    """The last digits of the story; if that is null, blank or has none, the number after ``Contents_`` in the file name."""
    own = F.regexp_extract(F.col(story), "(\\d+)\\D*$", 1)
    other = F.regexp_extract(F.col(file), "Contents_(\\d+)", 1)
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(other, F.lit(""))).try_cast("bigint")


def cell_row(c: str = "id") -> Column:
    """The number after the last ``::`` of a record's id."""
    return F.nullif(F.regexp_extract(F.col(c), "::(\\d+)\\s*$", 1), F.lit("")).try_cast("bigint")


def file_trust(rows: DataFrame, ledger: DataFrame, file: str = "original_file", listed: str = "filename", count: str = "record_count") -> DataFrame:
    """``rows`` with ``_trust`` by what the ledger says of their file: 1 if its count is right, less the more it has drifted, 0.25 for a file that isn't listed or named."""
    held = rows.groupBy(F.col(file).alias("_file")).agg(F.count(F.lit(1)).alias("_n")).where("_file is not null")
    told = ledger.where(F.col(listed).isNotNull()).groupBy(F.col(listed).alias("_file")).agg(F.max(count).cast("double").alias("_listed"))
    books = held.join(told, "_file").select("_file", F.coalesce(F.least("_n", "_listed") / F.greatest("_n", "_listed"), F.lit(0.25)).alias("_t"))
    # rows without a file are spread over many keys; none of these is a file's name
    at = F.coalesce(F.col(file), F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*rows.columns), F.lit(1024)).cast("string")))
    return rows.withColumn("_file", at).join(books, "_file", "left").withColumn("_trust", F.coalesce("_t", F.lit(0.25))).drop("_file", "_t")
