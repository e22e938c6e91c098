"""The glossary: wide tables and long rows, upserts by natural key, imports, and listing."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .memory import upsert

RULE_MARKS = "rule|규칙|비고|note"


def rule_column(header: DataFrame) -> int:
    """Position of the first header that names the rules, else 1. ``header``: pos, name."""
    row = header.where(F.lower(F.col("name")).rlike(RULE_MARKS)).agg(F.min("pos")).first()
    return 1 if row[0] is None else row[0]


def source_column(header: DataFrame, aliases: list[str]) -> int:
    """Position of the first column one of whose headers equals, holds or is held by an alias, else 0. ``header``: pos, name."""
    low = F.lower(F.trim("name"))
    hit = F.lit(False)
    for a in aliases:
        hit = hit | ((low != "") & (low.contains(a.lower()) | F.lit(a.lower()).contains(low)))
    row = header.where(hit).agg(F.min("pos")).first()
    return 0 if row[0] is None else row[0]


def wide_to_long(cells: DataFrame, header_rows: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Locales, terms and translations from the cells of a wide table (``row, pos, value``, rows from 0).

    The first rows hold display name, code and alias of each locale; column 0 holds the key of a term. Missing
    cells are empty; locale columns are those with a header; the key is trimmed and a repeated one counts at
    its first row.
    """
    value = F.trim(F.coalesce(F.col("value"), F.lit("")))
    head = cells.where(F.col("row") < header_rows).select("row", "pos", value.alias("value"))
    rule = rule_column(head.select("pos", F.col("value").alias("name")))
    locales = (
        head.where((F.col("pos") > 0) & (F.col("pos") != rule))
        .groupBy("pos")
        .agg(*[F.coalesce(F.max(F.when(F.col("row") == i, F.col("value"))), F.lit("")).alias(n) for i, n in enumerate(("header_display", "header_code", "header_alias"))])
        .where("header_display <> '' or header_code <> '' or header_alias <> ''")
    )
    body = cells.where(F.col("row") >= header_rows).select("row", "pos", value.alias("value"))
    keys = body.where((F.col("pos") == 0) & (F.col("value") != "")).groupBy("value").agg(F.min("row").alias("row"))
    rules = body.where(F.col("pos") == rule).select("row", F.col("value").alias("rule_text"))
    terms = keys.join(rules, "row", "left").select(F.col("value").alias("source_key"), F.coalesce("rule_text", F.lit("")).alias("rule_text"), F.col("row").alias("sort_order"))
    translations = body.join(keys.select("row", F.col("value").alias("source_key")), "row").join(locales.select("pos"), "pos").select("source_key", "pos", "value")
    return locales, terms, translations


def long_to_wide(terms: DataFrame, locales: DataFrame, translations: DataFrame, names: list[str]) -> DataFrame:
    """One row per term with a column for each named locale; gaps are empty. ``names`` is the checked list of locale names."""
    named = translations.join(locales.select(F.col("id").alias("locale_id"), F.col("header_display").alias("_n")), "locale_id")
    wide = named.groupBy("term_id").pivot("_n", names).agg(F.first("value"))
    out = terms.select(F.col("id").alias("term_id"), "source_key", "rule_text", "sort_order").join(wide, "term_id", "left")
    return out.na.fill("", names)


def all_to_wide(terms: DataFrame, locales: DataFrame, translations: DataFrame) -> DataFrame:
    """The wide table of every locale in column order. A locale without a name, or with one that another has too (letter case aside), has its id in the column's name."""
    listed = locales.select("id", F.trim(F.regexp_replace(F.coalesce("header_display", F.lit("")), "(?U)\\s+", " ")).alias("n")).orderBy("column_order", "id").collect()
    own = {"term_id", "source_key", "rule_text", "sort_order"}
    held = Counter(r["n"].lower() for r in listed)
    names = [r["n"] if r["n"] and held[r["n"].lower()] == 1 and r["n"].lower() not in own else f"{r['n']}#{r['id']}" for r in listed]
    ids = [str(r["id"]) for r in listed]
    wide = long_to_wide(terms, locales.select("id", F.col("id").cast("string").alias("header_display")), translations, ids)
    return wide.toDF("term_id", "source_key", "rule_text", "sort_order", *names)


def with_ids(existing: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """New rows with an ``id``: the existing one of their natural key, or the next free; ``created`` tells which."""
    known = new.join(existing.select("id", *key), key, "left")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = known.where("id is null").drop("id")
    # new entries are numbered in one order, which takes one task: a glossary has some thousand of them
    numbered = fresh.withColumn("_n", F.row_number().over(W.orderBy(*order))).join(F.broadcast(top)).withColumn("id", (F.col("_top") + F.col("_n")).cast("int")).drop("_n", "_top")
    return known.where("id is not null").withColumn("created", F.lit(False)).unionByName(numbered.withColumn("created", F.lit(True)))


def next_sort_order(terms: DataFrame) -> DataFrame:
    return terms.agg((F.coalesce(F.max("sort_order"), F.lit(-1)) + 1).alias("next_sort_order"))


def imported(existing: DataFrame, new: DataFrame, key: str, replace: bool) -> tuple[DataFrame, DataFrame]:
    """The table after an import, and the counts ``created, updated``. A replacing import starts from nothing; a merging one keeps an existing term's order."""
    base = existing.limit(0) if replace else existing
    coded = with_ids(base, new, [key], [key])
    kept = base.join(coded.select(key), key, "left_anti")
    merged = coded.join(base.select(key, F.col("sort_order").alias("_so")), key, "left").withColumn("sort_order", F.coalesce("_so", "sort_order"))
    counts = coded.agg(F.count_if("created").alias("created"), F.count_if(~F.col("created")).alias("updated"))
    return kept.select(*existing.columns).unionByName(merged.select(*existing.columns)), counts


def cascade_delete(terms: DataFrame, translations: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """Terms without the deleted ones, and translations of the remaining terms."""
    kept = terms.where(~F.coalesce(where, F.lit(False)))
    return kept, translations.join(kept.select(F.col("id").alias("term_id")), "term_id", "left_semi")


def existing_or_fail(terms: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``wanted`` if all its keys are in ``terms``, else an error that names one."""
    lost = wanted.join(terms.select(key), key, "left_anti").limit(1).collect()
    if lost:
        raise KeyError(f"no such term: {lost[0][key]}")
    return wanted


def targets(terms: DataFrame, locales: DataFrame, translations: DataFrame) -> DataFrame:
    """``source_key, rule_text, entries``: for each term its values by display name and by code, in column order, empty ones left out."""
    names = F.array(F.struct(F.lit(0).alias("o"), F.col("header_display").alias("key")), F.struct(F.lit(1).alias("o"), F.col("header_code").alias("key")))
    keyed = locales.select(F.col("id").alias("locale_id"), "column_order", F.explode(names).alias("k")).where("k.key is not null and k.key <> ''")
    values = translations.where("value is not null and trim(value) <> ''").join(keyed, "locale_id")
    listed = values.groupBy("term_id").agg(F.sort_array(F.collect_list(F.struct("column_order", "locale_id", "k.o", "k.key", "value"))).alias("x"))
    entries = F.transform("x", lambda e: F.struct(e["key"].alias("key"), F.trim(e["value"]).alias("value")))
    return terms.select(F.col("id").alias("term_id"), "source_key", "rule_text").join(listed, "term_id", "left").select("term_id", "source_key", "rule_text", F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")).alias("entries"))


def doubly_keyed(terms: DataFrame, key: str, other: str) -> DataFrame:
    """Terms keyed by their own name and again by another column; a key that is taken stays with the first, own names before others."""
    own = terms.withColumn("term", F.col(key)).withColumn("_p", F.lit(0))
    second = terms.where(F.col(other).isNotNull() & (F.trim(other) != "")).withColumn("term", F.trim(other)).withColumn("_p", F.lit(1))
    first = F.row_number().over(W.partitionBy("term").orderBy("_p", key))
    return own.unionByName(second).withColumn("_n", first).where("_n = 1").drop("_n", "_p")


def active(terms: DataFrame) -> DataFrame:
    return terms.where(~T.switched_off(F.col("rule_text")))


def upsert_translations(translations: DataFrame, new: DataFrame) -> DataFrame:
    """``term_id, locale_id, value`` with the new values written over the old ones of the same term and locale."""
    return upsert(translations.select("term_id", "locale_id", "value"), new.select("term_id", "locale_id", "value"), ["term_id", "locale_id"])


def created(terms: DataFrame, key: str, rule: str = "") -> DataFrame:
    """The terms with one more at the end of the order; a key that is there keeps its number and place and gets the rule."""
    key, rule = key.strip(), rule.strip()
    if not key:
        raise ValueError("a term needs a key")
    one = terms.sparkSession.createDataFrame([(key, rule)], "source_key string, rule_text string").join(F.broadcast(next_sort_order(terms)))  # one row each
    return imported(terms, one.withColumnRenamed("next_sort_order", "sort_order"), "source_key", replace=False)[0]


def updated(terms: DataFrame, term_id: int, key: str, rule: str = "") -> DataFrame:
    """The terms with key and rule of one replaced; a number that isn't there is an error."""
    if not key.strip():
        raise ValueError("a term needs a key")
    if not terms.where(F.col("id") == term_id).limit(1).count():
        raise KeyError(f"no such term: {term_id}")
    here = F.col("id") == term_id
    return terms.withColumn("source_key", F.when(here, key.strip()).otherwise(F.col("source_key"))).withColumn("rule_text", F.when(here, rule.strip()).otherwise(F.col("rule_text")))


def seeded(terms: DataFrame, seed: DataFrame | None) -> tuple[DataFrame, bool]:
    """The seed where the table is empty and there is one, and whether it was taken."""
    if seed is None or terms.limit(1).count():
        return terms, False
    return imported(terms, seed, "source_key", replace=True)[0], True


def in_column_order(locales: DataFrame) -> DataFrame:
    return locales.orderBy("column_order", "id")


def exported(wide: DataFrame, write, use):
    """Write a glossary to a temporary file, hand its path to ``use``, and take the file away whatever happens."""
    import os
    import tempfile

    handle, path = tempfile.mkstemp(suffix=".csv")
    os.close(handle)
    try:
        write(wide, path)
        return use(path)
    finally:
        if os.path.exists(path):
            os.remove(path)
