"""Duplicates hidden by formatting: dictionary encoding of canonical field values, grouping of integer tuples.

Every distinct text is put into canonical form once. A text that is a list of ``label: value`` entries
becomes one field per entry, any other text one field. The distinct canonical fields get integer
identifiers, each text becomes the sorted tuple of its fields' identifiers, and records are grouped by
(partition columns, tuple). Copies are counted with a map-side combine, so a group of any size is one row
per task before the shuffle; rows find their group by a join that adaptive execution may split.

Defined cases: null texts and texts without any letter or digit take no part; repeated rows count as
copies; nulls in a partition column take no part; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .forms import skeleton

#: What may separate two entries of a list, and a label from its value.
ENTRY_BREAK = "[;|/\\n\\r；｜／]+"
LABELLED = "^[^:=：]{1,60}?(?:[:=：]|\\s[-–—]+\\s).*[\\p{L}\\p{N}]"


def bare(c: Column) -> Column:
    """Letters, marks and digits only."""
    return F.regexp_replace(c, "[^\\p{L}\\p{M}\\p{N}]+", "")


def canonical_fields(c: Column) -> Column:
    """The canonical fields of a text: its entries if all parts are labelled, else the text as one field."""
    shown = skeleton(c)
    parts = F.filter(F.split(shown, ENTRY_BREAK), lambda p: bare(p) != "")
    listed = (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(LABELLED))
    # without a list the text keeps its order; a leading mark keeps it apart from an entry of the same letters
    return F.when(listed, F.transform(parts, bare)).otherwise(F.filter(F.array(bare(shown)), lambda p: p != ""))


def encode(texts: DataFrame, text: str) -> DataFrame:
    """``text, class_id`` for each distinct text: texts of one class differ in dress only."""
    distinct = texts.select(F.col(text).alias("_t")).where("_t is not null").distinct()
    fields = distinct.select("_t", canonical_fields(F.col("_t")).alias("_f")).where(F.size("_f") > 0)
    held = cut(fields.withColumn("_tid", F.monotonically_increasing_id()))
    each = held.select("_tid", F.explode("_f").alias("_v"))
    book = cut(each.select("_v").distinct().withColumn("_vid", F.monotonically_increasing_id()))
    tuples = each.join(book, "_v").groupBy("_tid").agg(F.sort_array(F.collect_list("_vid")).alias("_key"))
    classes = tuples.groupBy("_key").agg(F.min("_tid").alias("class_id"))
    return held.select("_tid", "_t").join(tuples, "_tid").join(classes, "_key").select(F.col("_t").alias(text), "class_id")


def duplicate_groups(rows: DataFrame, key: str, by: list[str], text: str) -> DataFrame:
    """``key, group_id, copies`` for every row of a group of two or more; group_id is the least key."""
    kept = rows.select(F.col(key).alias("_id"), *[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col(text).alias("_t"))
    for i in range(len(by)):
        kept = kept.where(F.col(f"_b{i}").isNotNull())
    coded = kept.join(encode(kept, "_t"), "_t").drop("_t")
    on = ["class_id", *[f"_b{i}" for i in range(len(by))]]
    groups = coded.groupBy(*on).agg(F.min("_id").alias("group_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return coded.join(groups, on).select(F.col("_id").alias(key), "group_id", "copies")


def collapse(rows: DataFrame, key: str, by: list[str], text: str) -> DataFrame:
    """One record for each class: its least key, that row's text, and the number of copies (one or more)."""
    kept = rows.select(F.col(key).alias("_id"), *[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], F.col(text).alias("_t"))
    coded = kept.join(encode(kept, "_t"), "_t")
    on = ["class_id", *[f"_b{i}" for i in range(len(by))]]
    out = coded.groupBy(*on).agg(F.min(F.struct("_id", "_t")).alias("_r"), F.count(F.lit(1)).alias("copies"))
    return out.select(F.col("_r._id").alias(key), *[F.col(f"_b{i}").alias(b) for i, b in enumerate(by)], F.col("_r._t").alias(text), "copies")
