"""Text sources: wide glossary tables, reports, JSON maps, and folders of files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def glossary_cells(spark: SparkSession, path: str) -> DataFrame:
    """``row, pos, value`` of a CSV table without a header; a byte-order mark goes, ragged rows keep the cells they have.

    Rows are numbered within one file, so the file is read in one piece; glossaries are small by nature.
    """
    import csv
    import io

    def parsed(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                rows = list(csv.reader(io.StringIO(bytes(content).decode("utf-8-sig"))))
                yield pd.DataFrame([(r, c, v) for r, cells in enumerate(rows) for c, v in enumerate(cells)], columns=["row", "pos", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parsed, "row int, pos int, value string")


def write_glossary(wide: DataFrame, heads: list[list[str]], columns: list[str], path: str) -> None:
    """One CSV file with a byte-order mark and three header rows; a glossary is small by nature."""
    import csv
    import os

    rows = wide.select(*columns).limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("too many terms for one file")
    temporary = f"{path}.tmp"
    with open(temporary, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerows(heads)
        w.writerows([["" if v is None else v for v in r] for r in rows])
    os.replace(temporary, path)


def reports(spark: SparkSession, path: str) -> DataFrame:
    """``file, text``: each report whole."""
    return spark.read.option("wholetext", True).text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text"))


def listing(spark: SparkSession, folder: str, pattern: str = "*.xlsx") -> DataFrame:
    """``filename, mtime, length`` of the files in order of their names, without lock files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("modificationTime").cast("double").cast("string").alias("mtime"), "length")
    return named.where(~F.col("filename").startswith("~$")).orderBy("filename")


def sheet_map(spark: SparkSession, text: str) -> DataFrame:
    """``sheet, lang, code`` from a JSON object of objects."""
    one = spark.createDataFrame([(text,)], "j string")
    m = F.from_json("j", T.MapType(T.StringType(), T.StructType.fromDDL("lang string, code string")))
    return one.select(F.explode(m).alias("sheet", "v")).select("sheet", "v.lang", "v.code")


def denylist(spark: SparkSession, text: str) -> DataFrame:
    """``id, reason`` from a JSON object with ``reason`` and ``ids``."""
    one = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", "reason string, ids array<string>").alias("v"))
    return one.select(F.explode("v.ids").alias("id"), F.col("v.reason").alias("reason")).distinct()


def edits(spark: SparkSession, text: str) -> DataFrame:
    """``sheet, cell, col, row, new_value`` from a JSON list."""
    return spark.createDataFrame([(x.get("sheet"), x.get("cell"), None if x.get("col") is None else str(x["col"]), x.get("row"), x.get("new_value")) for x in json.loads(text)], "sheet string, cell string, col string, row int, new_value string")
