"""Workbook cells in long form: ranges, sheet choice, layout, differences and edits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The layout of a workbook's sheet, rows of the story and of four sections
STORY_ROWS = {7: "title", 8: "description"}
SECTION_STARTS = [10, 15, 20, 25]
SECTION_FIELDS = ["title", "description", "disclaimer", "button"]


def _number(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n


def in_ranges(ranges: str, row: Column, col: Column) -> Column:
    """True for cells of a comma list of ranges and single cells (``C7:C28,E9``); whole columns (``A:Z``) take all rows. A cell in several ranges is one cell."""
    test = F.lit(False)
    for part in filter(None, (p.strip() for p in ranges.split(","))):
        m = re.fullmatch(r"([A-Za-z]{1,3})(\d*)(?::([A-Za-z]{1,3})(\d*))?", part)
        if not m:
            raise ValueError(f"no cell range: {part}")
        c1, r1 = _number(m[1]), int(m[2] or 1)
        c2 = _number(m[3]) if m[3] else c1
        r2 = int(m[4]) if m[4] else (r1 if not m[3] and m[2] else 1_048_576)
        test = test | (row.between(min(r1, r2), max(r1, r2)) & col.between(min(c1, c2), max(c1, c2)))
    return test


def chosen_sheets(source: DataFrame, target: DataFrame, wanted: list[str] | None, known: DataFrame | None, without: str | None = None) -> DataFrame:
    """Sheets of the source workbook that the target has too, in the source's order; optionally only wanted and known ones."""
    out = source.select("sheet", "sheet_ord").distinct().join(target.select("sheet").distinct(), "sheet", "left_semi")
    if wanted is not None:
        out = out.where(F.col("sheet").isin(wanted))
    if known is not None:
        out = out.join(known.select("sheet"), "sheet", "left_semi")
    if without is not None:
        out = out.where(F.col("sheet") != without)
    return out.orderBy("sheet_ord")


def layout(spark) -> DataFrame:
    """``row, group_id, group_type, field`` of the fixed layout."""
    rows = [(r, 0, "story", f) for r, f in STORY_ROWS.items()]
    rows += [(start + i, n, "section", f) for n, start in enumerate(SECTION_STARTS, 1) for i, f in enumerate(SECTION_FIELDS)]
    return spark.createDataFrame(rows, "row int, group_id int, group_type string, field string")


def section_groups(cells: DataFrame) -> DataFrame:
    """Cells (``file, sheet, row, code, text``) gathered by group; optional fields without code and text are dropped, and groups without title and description."""
    own = cells.join(F.broadcast(layout(cells.sparkSession)), "row")
    empty = T.is_placeholder_text(F.col("text"))
    kept = own.where(~(F.col("field").isin("disclaimer", "button") & F.coalesce(F.col("code"), F.lit("")).eqNullSafe("") & empty))
    entry = F.struct("row", "field", "code", "text", empty.alias("is_empty_or_placeholder"))
    groups = kept.groupBy("file", "sheet", "group_id", "group_type").agg(F.sort_array(F.collect_list(entry)).alias("fields"))
    return groups.where(F.exists("fields", lambda f: f["field"].isin("title", "description") & ~f["is_empty_or_placeholder"]))


def zip_cells(source: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """Equal coordinates of two sheets side by side; both must hold text and neither be ``x``."""
    usable = lambda c: ~T.is_placeholder_text(F.col(c), ("x",))
    s, t = source.select(*on, F.col("text").alias("source")), target.select(*on, F.col("text").alias("target"))
    return s.where(usable("source")).join(t.where(usable("target")), on)


def differences(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Cells whose contents differ, those on one side only included."""
    a, b = before.select(*key, F.col(value).alias("old_value")), after.select(*key, F.col(value).alias("new_value"))
    return a.join(b, key, "full").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def edited(cells: DataFrame, edits: DataFrame, key: list[str], value: str = "value") -> tuple[DataFrame, DataFrame]:
    """The cells after the edits, and the change log; an edit of a cell that isn't there, or two of one cell, refuse all."""
    lost = edits.join(cells.select(*key), key, "left_anti").limit(1).collect()
    twice = edits.groupBy(*key).count().where("count > 1").limit(1).collect()
    if lost or twice:
        raise ValueError(f"{'no such cell' if lost else 'edited twice'}: {[(lost or twice)[0][k] for k in key]}")
    joined = cells.join(edits.select(*key, F.col("new_value").alias("_new")), key, "left")
    log = joined.where(F.col("_new").isNotNull()).select(*key, F.col(value).alias("old_value"), F.col("_new").alias("new_value"))
    return joined.withColumn(value, F.coalesce("_new", value)).drop("_new"), log


def verified(changed: DataFrame, approved: DataFrame, key: list[str]) -> DataFrame:
    """``missing, unexpected``: approved cells that did not change, and changed cells that were not approved."""
    a, b = changed.select(*key).distinct(), approved.select(*key).distinct()
    return b.subtract(a).agg(F.count(F.lit(1)).alias("missing")).join(a.subtract(b).agg(F.count(F.lit(1)).alias("unexpected")))


def sheets(cells: DataFrame) -> DataFrame:
    """``file, sheet, sheet_ord``: the sheets of each workbook in their order."""
    return cells.select("file", "sheet", "sheet_ord").distinct().orderBy("file", "sheet_ord")


def range_dump(cells: DataFrame, ranges: str, sheet: str | None = None) -> DataFrame:
    """Cells of a list of ranges, of one sheet or of all, in order of sheet, row and column."""
    rows = cells.where(in_ranges(ranges, F.col("row"), F.col("col")))
    if sheet is not None:
        rows = rows.where(F.col("sheet") == sheet)
    return rows.orderBy("file", "sheet_ord", "row", "col")


def keyed_texts(cells: DataFrame, by: list[str], key: str, text: str, row: str, first: int = 7, last: int = 28) -> DataFrame:
    """The text of each key within the rows of a story; of several the later row's, placeholders and keys left blank aside."""
    usable = cells.where(F.col(row).between(first, last) & ~T.is_placeholder_text(F.col(text), ("x",)) & (F.trim(F.coalesce(F.col(key), F.lit(""))) != ""))
    return usable.groupBy(*by, key).agg(F.max_by(text, F.struct(row, text)).alias(text))
