"""Workbooks (.xlsx) as a Spark data source, read and written with the standard library only.

``spark.read.format("workbook").load(folder)`` gives one row per cell that holds anything: ``file, sheet,
sheet_ord, row, col, value, formula``. One input partition is made per file, so a folder of workbooks is
read in parallel; a file that can't be read gives a row with only ``file`` and ``error``. Lock files (``~$``)
are left out. ``df.write.format("workbook").mode("append").save(folder)`` writes one workbook per partition
and file name; to one file go all its rows if the table is partitioned by ``file`` first (``write_workbooks``).
"""

from __future__ import annotations

import glob
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, sheet string, sheet_ord int, row int, col int, value string, formula string, error string"
# Namespaces of the format
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE_REL = "http://schemas.openxmlformats.org/package/2006/relationships"


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def place(name: str) -> tuple[int, int]:
    """Row and column of a cell's name."""
    m = re.fullmatch(r"([A-Z]+)(\d+)", name)
    col = 0
    for ch in m[1]:
        col = col * 26 + ord(ch) - 64
    return int(m[2]), col


def _text(node: ET.Element) -> str:
    """All text runs of an element, phonetic ones left out."""
    return "".join(t.text or "" for part in node for t in ([part] if part.tag == MAIN + "t" else part.findall(MAIN + "t") if part.tag == MAIN + "r" else []))


def read_cells(path: str) -> Iterator[tuple]:
    """Cells of a workbook in order of its sheets and rows."""
    name = os.path.basename(path)
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        shared = [_text(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ET.fromstring(z.read("xl/workbook.xml"))
        for ord_, sheet in enumerate(book.iter(MAIN + "sheet")):
            target = links[sheet.get(REL + "id")].lstrip("/")
            with z.open(target if target.startswith("xl/") else "xl/" + target) as f:
                for _, el in ET.iterparse(f):
                    if el.tag != MAIN + "c":
                        if el.tag == MAIN + "row":
                            el.clear()
                        continue
                    row, col = place(el.get("r"))
                    v, formula, inline = el.find(MAIN + "v"), el.find(MAIN + "f"), el.find(MAIN + "is")
                    kind = el.get("t")
                    value = None
                    if kind == "inlineStr" and inline is not None:
                        value = _text(inline)
                    elif v is not None and v.text is not None:
                        value = shared[int(v.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(v.text, v.text) if kind == "b" else v.text
                    text = None if formula is None or not formula.text else "=" + formula.text
                    if value is not None or text is not None:
                        yield name, sheet.get("name"), ord_, row, col, value, text, None


def write_workbook(path: str, sheets: list[tuple[str, list[tuple[int, int, str | None, str | None]]]]) -> None:
    """A workbook with inline strings; cells as (row, col, value, formula). It is written beside the target and moved there whole."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(temporary, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE_REL}"><Relationship Id="rId1" Type="{REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{REL[1:-1]}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{REL[1:-1]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{PACKAGE_REL}">{links}</Relationships>')
        for i, (_, cells) in enumerate(sheets, 1):
            rows: dict[int, list[str]] = {}
            for row, col, value, formula in sorted(cells, key=lambda c: (c[0], c[1])):
                inner = (f"<f>{escape(formula.lstrip('='))}</f>" if formula else "") + (f"<v>{escape(value)}</v>" if formula and value is not None else "")
                cell = f'<c r="{letters(col)}{row}" t="str">{inner}</c>' if formula else f'<c r="{letters(col)}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(value or "")}</t></is></c>'
                rows.setdefault(row, []).append(cell)
            body = "".join(f'<row r="{r}">{"".join(c)}</row>' for r, c in rows.items())
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    os.replace(temporary, path)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.path, "*.xlsx"))) if os.path.isdir(self.path) else [self.path]
        return [_File(p) for p in found if not os.path.basename(p).startswith("~$")]

    def read(self, partition: _File) -> Iterator[tuple]:
        try:
            yield from read_cells(partition.path)
        except (OSError, KeyError, ValueError, IndexError, ET.ParseError, zipfile.BadZipFile) as e:
            yield os.path.basename(partition.path), None, None, None, None, None, None, f"{type(e).__name__}: {e}"


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        files: dict[str, dict[tuple[int, str], list]] = {}
        for r in rows:
            files.setdefault(r["file"], {}).setdefault((r["sheet_ord"], r["sheet"]), []).append((r["row"], r["col"], r["value"], r["formula"]))
        for name, sheets in files.items():
            write_workbook(os.path.join(self.path, name), [(s, cells) for (_, s), cells in sorted(sheets.items())])
        return WriterCommitMessage()


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("workbook").option("path", path).load()


def write_workbooks(cells: DataFrame, path: str) -> None:
    """All rows of a file go to one workbook; a workbook's cells fit in memory by the format's own limits."""
    register(cells.sparkSession)
    rows = cells.select(*[F.col(c.split()[0]) if c.split()[0] in cells.columns else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in SCHEMA.split(", ")])
    rows.repartition("file").write.format("workbook").mode("append").option("path", path).save()


def texts(cells: DataFrame, first: int = 7, last: int = 28, code_col: int = 2, text_col: int = 3) -> DataFrame:
    """``file, sheet, sheet_ord, row, story, code, text`` of the fixed window; the story stands in C5 of the first sheet, else the file's name does."""
    story = cells.where((F.col("row") == 5) & (F.col("col") == 3) & (F.col("sheet_ord") == 0)).groupBy("file").agg(F.max(F.trim("value")).alias("_story"))
    window = cells.where(F.col("row").between(first, last) & F.col("col").isin(code_col, text_col))
    by_row = window.groupBy("file", "sheet", "sheet_ord", "row").agg(
        F.max(F.when(F.col("col") == code_col, F.trim(F.coalesce("formula", "value")))).alias("code"), F.max(F.when(F.col("col") == text_col, F.trim("value"))).alias("text")
    )
    named = by_row.join(story, "file", "left").withColumn("story", F.coalesce(F.nullif("_story", F.lit("")), F.regexp_replace("file", "\\.xlsx$", ""))).drop("_story")
    return named.select("file", "sheet", "sheet_ord", "row", "story", "code", "text")
