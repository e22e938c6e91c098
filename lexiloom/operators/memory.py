"""The translation memory: pairing of cells, first-seen texts, snapshots with upsert and delete, ledger, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def pair_cells(source: DataFrame, target: DataFrame) -> DataFrame:
    """Target cells joined to the source cell of the same file and row; target rows without one are left out.

    ``source``: file, row, text; ``target``: file, row, sheet, text. Placeholders on either side are left out.
    """
    s = source.where(~T.is_placeholder_text(F.col("text"))).select("file", "row", F.col("text").alias("source_text"))
    t = target.where(~T.is_placeholder_text(F.col("text"))).select("file", "row", "sheet", F.col("text").alias("target_text"))
    joined = t.join(s, ["file", "row"])
    return joined.select(
        F.concat_ws("::", "file", "sheet", F.col("row").cast("string")).alias("id"), "file", "row", "sheet", T.source_group(F.col("sheet")).alias("source_group"), "source_text", "target_text"
    )


def first_seen(rows: DataFrame, by: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each group in a stated order; the order must be total. One row of each group and task is shuffled."""
    by = [F.col(c) if isinstance(c, str) else c for c in by]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    least = rows.groupBy(*[c.alias(f"_k{i}") for i, c in enumerate(by)]).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*order)).alias("_r"))
    return least.select("_r.*")


def last_seen(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group in a stated order; the order must be total."""
    most = rows.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*order)).alias("_r"))
    return most.select("_r.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] | None = None) -> DataFrame:
    """A new snapshot: old rows without the new keys, and the new rows; ``keep`` names columns carried over from the old row where the new one has null."""
    carried = new
    if keep:
        before = old.select(*key, *[F.col(c).alias(f"_old_{c}") for c in keep])
        carried = new.join(before, key, "left")
        for c in keep:
            carried = carried.withColumn(c, F.coalesce(F.col(c), F.col(f"_old_{c}")) if c in new.columns else F.col(f"_old_{c}"))
        carried = carried.drop(*[f"_old_{c}" for c in keep])
    return old.join(new.select(*key), key, "left_anti").unionByName(carried.select(*old.columns))


def delete(rows: DataFrame, where: Column) -> DataFrame:
    """Rows for which the predicate isn't true; rows for which it is null stay."""
    return rows.where(~F.coalesce(where, F.lit(False)))


def flagged(rows: DataFrame, ids: DataFrame, key: str, flag: str, reason: str) -> DataFrame:
    """Rows whose key is on the list get the reason; the others keep theirs."""
    listed = ids.select(F.col(key)).distinct().withColumn("_on", F.lit(True))
    return rows.join(listed, key, "left").withColumn(flag, F.when(F.col("_on"), reason).otherwise(F.col(flag))).drop("_on")


def unprocessed(files: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Files that the ledger doesn't list with the same state."""
    return files.join(ledger.select(*keys), keys, "left_anti")


def superseded(rows: DataFrame, current: DataFrame, story: str, file: str) -> DataFrame:
    """Rows of a story that has a current file, from another file."""
    now = current.select(F.col(story), F.col(file).alias("_current"))
    return rows.join(now, story).where(F.col(file) != F.col("_current")).drop("_current")


def reload_story(rows: DataFrame, new: DataFrame, story: str) -> DataFrame:
    """All rows of the stories in ``new`` replaced by it."""
    return rows.join(new.select(story).distinct(), story, "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))


def with_missing_columns(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns that an older snapshot lacks are added as null."""
    for name, kind in columns.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def load_by_ledger(memory: DataFrame, ledger: DataFrame, files: DataFrame, pairs: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Memory and ledger after a load: files that the ledger lists with the same time are skipped (``force`` takes all), the others replace the rows of their file and, of their story, those of other files; flags of rows that come again are kept.

    ``files``: filename, mtime, story_id. ``pairs``: the rows read from them, with the memory's columns.
    """
    due = files if force else unprocessed(files, ledger, ["filename", "mtime"])
    due = due.select("filename", "mtime", "story_id")
    new = pairs.join(due.select(F.col("filename").alias("original_file")), "original_file", "left_semi").select(*memory.columns)
    stale = memory.join(due.select(F.col("filename").alias("original_file")), "original_file", "left_anti")
    stale = stale.join(due.where("story_id is not null").select("story_id").distinct(), "story_id", "left_anti")
    flags = memory.where("id is not null and tone_flag is not null").groupBy("id").agg(F.max("tone_flag").alias("_flag"))
    again = new.join(flags, "id", "left").withColumn("tone_flag", F.coalesce("tone_flag", "_flag")).select(*memory.columns)
    counts = new.groupBy(F.col("original_file").alias("filename")).agg(F.count(F.lit(1)).cast("int").alias("record_count"))
    listed = due.join(counts, "filename", "left").select("filename", "story_id", "mtime", F.coalesce("record_count", F.lit(0)).alias("record_count"))
    kept = ledger.select("filename", "story_id", "mtime", "record_count").join(due.select("filename"), "filename", "left_anti")
    return stale.select(*memory.columns).unionByName(again), kept.unionByName(listed)


def matching_rows(rows: DataFrame, equal: dict[str, str] | None = None, prefix: dict[str, str] | None = None) -> DataFrame:
    """Rows whose columns equal the given values and begin with the given prefixes."""
    for c, v in (equal or {}).items():
        rows = rows.where(F.col(c) == v)
    for c, v in (prefix or {}).items():
        rows = rows.where(F.startswith(F.col(c), F.lit(v)))
    return rows
