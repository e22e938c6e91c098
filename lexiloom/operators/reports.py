"""Reports: parsing of labelled text, histograms, overlaps, running figures, and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Marks of a judgment and the class each means, in the order of the tests
JUDGMENTS = [
    ("reject", ["수용 비추천", "미반영", "감수안 수용 비추천"]),
    ("partial", ["부분 수용", "부분 반영"]),
    ("no_apply", ["추가 적용 없음", "적용 대상 없음"]),
    ("accept", ["전체 수용", "수용 가능", "수용 권장", "번역사 의견 전체 반영", "반영 가능", "수용."]),
]
KEPT_AS_IS, OTHER_JUDGMENT = "유지", "conditional_or_other"
# Words that soften the tone
SOFT_WORDS = ["别让", "甚至无需", "就能", "轻松", "无需担心"]
# Labels of a grade in a report's line, by language of the report
GRADE_LABELS = ["Grade", "등급", "Niveau", "Note"]


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line, value``: the lines of each text, from one on."""
    return texts.select(key, F.posexplode(F.split(text, "\\r?\\n")).alias("line", "value")).withColumn("line", F.col("line") + 1)


def blocks(rows: DataFrame, key: str, line: str, is_mark: Column) -> DataFrame:
    """``key, first, last``: each marked line with the line before the next mark, or the last of the text."""
    end = rows.groupBy(key).agg(F.max(line).alias("_end"))
    marks = rows.where(is_mark).select(key, F.col(line).alias("first"))
    nxt = F.lead("first").over(W.partitionBy(key).orderBy("first"))
    return marks.withColumn("_next", nxt).join(end, key).select(key, "first", F.coalesce(F.col("_next") - 1, F.col("_end")).alias("last"))


def grade_of(text: Column) -> Column:
    """The first grade that stands after one of the labels; null where there is none."""
    return F.nullif(F.regexp_extract(text, "(?m)^(?:" + "|".join(GRADE_LABELS) + "):[ \\t]*([A-Z])", 1), F.lit(""))


def judgment(c: Column) -> Column:
    """The class of a judgment's text by the first rule that it meets."""
    text, out = F.coalesce(c, F.lit("")), None
    for name, marks in JUDGMENTS:
        hit = F.lit(False)
        for m in marks:
            hit = hit | text.contains(m)
        if name == "no_apply":
            hit = hit | (text == KEPT_AS_IS)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(OTHER_JUDGMENT)


def between(rows: DataFrame, key: str, line: str, begins: Column, ends: Column) -> DataFrame:
    """Lines after the first that begins a section and before the next that ends it, or up to the end."""
    first = rows.where(begins).groupBy(key).agg(F.min(line).alias("_a"))
    last = rows.where(ends).join(first, key).where(F.col(line) > F.col("_a")).groupBy(key).agg(F.min(line).alias("_z"))
    inside = rows.join(first, key).join(last, key, "left").where((F.col(line) > F.col("_a")) & (F.col("_z").isNull() | (F.col(line) < F.col("_z"))))
    return inside.drop("_a", "_z")


def review_figures(cells: DataFrame, sheet: str, current: Column, revised: Column, comment: Column) -> DataFrame:
    """Cells touched, changed and commented in each sheet; sheets without any are left out.

    A cell is touched if it is revised or has a comment, even an empty one; changed if the revision differs from
    what stood there (null as empty); commented if the comment isn't empty.
    """
    touched = revised.isNotNull() | comment.isNotNull()
    changed = revised.isNotNull() & (revised != F.coalesce(current, F.lit("")))
    said = F.coalesce(comment, F.lit("")) != ""
    told = cells.groupBy(sheet).agg(F.count_if(touched).alias("touched"), F.count_if(changed).alias("changed"), F.count_if(said).alias("comments"))
    return told.where("touched > 0 or changed > 0 or comments > 0")


def scope_counts(text: Column) -> Column:
    """``array<struct<sheet, cells>>`` of a log's lines ``] sheet | 처리 완료 셀: n``."""
    hits = F.regexp_extract_all(text, F.lit("(?m)\\] (.+?) \\| 처리 완료 셀: (\\d+)"), 0)
    return F.transform(hits, lambda h: F.struct(F.regexp_extract(h, "\\] (.+?) \\| 처리 완료 셀: (\\d+)", 1).alias("sheet"), F.regexp_extract(h, "(\\d+)$", 1).cast("int").alias("cells")))


def missing_scope(logs: DataFrame, key: str, text: str, wanted: DataFrame, sheet: str) -> DataFrame:
    """``key, sheet``: wanted sheets that a log doesn't report as done (both tables have ``key``)."""
    done = logs.select(key, F.explode(scope_counts(F.col(text))).alias("_d")).select(key, F.col("_d.sheet").alias(sheet)).distinct()
    return wanted.select(key, sheet).join(done, [key, sheet], "left_anti")


def text_report(rows: DataFrame, by: str, order: list[str], title: Column, sections: dict[str, Column]) -> DataFrame:
    """``by, report``: a block for each row, with a ruled head and ``[상세 - name]`` sections; a group is one report and is gathered as one text."""
    parts = [F.concat(F.lit("=" * 90 + "\n"), title, F.lit("\n" + "-" * 90 + "\n"))]
    parts += [F.concat(F.lit(f"\n[상세 - {n}]\n"), F.coalesce(c.cast("string"), F.lit("")), F.lit("\n")) for n, c in sections.items()]
    listed = F.sort_array(F.collect_list(F.struct(*order, F.concat(*parts).alias("_b"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["_b"]), "\n").alias("report"))


def model_costs(usage: DataFrame, prices: DataFrame, model: str, tokens: dict[str, str]) -> DataFrame:
    """``usage`` with ``cost``: tokens by direction times the model's price per million; models without a price have no cost. ``tokens`` names the price's column for each token column."""
    cost = None
    for used, price in tokens.items():
        part = F.coalesce(F.col(used), F.lit(0)) * F.col(price) / F.lit(1e6)
        cost = part if cost is None else cost + part
    return usage.join(prices.select(model, *set(tokens.values())), model, "left").withColumn("cost", cost).drop(*set(tokens.values()))


def average_tokens(total: Column, n: Column) -> Column:
    """A whole average, halves to the even number; null for no calls."""
    return F.bround(total / F.nullif(n, F.lit(0)), 0).cast("long")


def with_output_tokens(rows: DataFrame, measured: DataFrame, key: list[str], value: str) -> DataFrame:
    """``rows`` with ``value`` taken from ``measured`` where it has the key."""
    return rows.join(measured.select(*key, F.col(value).alias("_v")), key, "left").withColumn(value, F.coalesce("_v", value)).drop("_v")


def table_rows(rows: DataFrame, key: str, value: str, cells: int) -> DataFrame:
    """Lines of Markdown tables whose first cell names a cell (``C12``), split; other lines are left out."""
    parts = F.transform(F.split(F.regexp_replace(F.trim(value), "^\\||\\|$", ""), "\\|"), lambda x: F.trim(x))
    return rows.where(F.trim(value).startswith("|")).select(key, "line", parts.alias("p")).where((F.size("p") >= cells) & F.regexp_like(F.col("p")[0], F.lit("^[A-Z]{1,2}[0-9]+$")))


def status_figures(rows: DataFrame, status: str) -> DataFrame:
    """Counts of pass, warn and fail, and the health score with its band."""
    n = lambda s: F.count_if(F.col(status) == s)
    counted = rows.agg(F.count(F.lit(1)).alias("total"), n("pass").alias("passed"), n("warn").alias("warned"), n("fail").alias("failed"))
    score = F.round(F.lit(100.0) * F.col("passed") / F.greatest(F.col("total"), F.lit(1)), 0).cast("long")
    return counted.withColumn("score", score).withColumn("band", F.when(F.col("score") >= 80, "good").when(F.col("score") >= 60, "fair").otherwise("poor"))


def overlap(changed: DataFrame, suggested: DataFrame, key: list[str]) -> DataFrame:
    """``both, only_changed, only_suggested`` as counts of distinct keys."""
    a = changed.select(*key).distinct().withColumn("_a", F.lit(1))
    b = suggested.select(*key).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, key, "full")
    return j.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_changed"), F.count_if(F.col("_a").isNull()).alias("only_suggested"))


def running_progress(events: DataFrame, task: str, order: list[str]) -> DataFrame:
    """Done so far and percent of each task, rounded down, by the order of its events."""
    w = W.partitionBy(task).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.count(F.lit(1)).over(W.partitionBy(task))
    done = F.count(F.lit(1)).over(w)
    return events.withColumn("done", done).withColumn("percent", F.floor(F.lit(100) * done / total).cast("long"))


def changes_of(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before, the first of each group included."""
    before = F.lag(value).over(W.partitionBy(by).orderBy(*order))
    first = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return rows.withColumn("_b", before).withColumn("_n", first).where((F.col("_n") == 1) | ~F.col("_b").eqNullSafe(F.col(value))).drop("_b", "_n")


def task_outcomes(events: DataFrame, task: str, order: Column, kind: str, payload: str) -> DataFrame:
    """Each task's last ``complete`` payload, its number of errors and of logs, and its status: error, ok or incomplete."""
    out = events.groupBy(task).agg(
        F.max_by(payload, F.when(F.col(kind) == "complete", order)).alias("result"),
        F.count_if(F.col(kind) == "complete").alias("completed"), F.count_if(F.col(kind) == "error").alias("errors"), F.count_if(F.col(kind) == "log").alias("logs"),
    )
    return out.withColumn("status", F.when(F.col("errors") > 0, "error").when(F.col("completed") > 0, "ok").otherwise("incomplete"))


def markdown_cell(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\r\\n]+", " "), F.lit("|"), F.lit("\\|"))


def markdown_table(rows: DataFrame, by: str | None, columns: list[str], order: list[str]) -> DataFrame:
    """``by, markdown``: a table per group, rows in order. A group is one report and is gathered as one text."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c).cast("string")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    listed = F.sort_array(F.collect_list(F.struct(*order, line.alias("_l"))))
    keys = [by] if by else []
    return rows.groupBy(*keys).agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(listed, lambda s: s["_l"]), "\n")).alias("markdown"))


def usage_totals(events: DataFrame, provider: str, model: str, figures: list[str]) -> DataFrame:
    """Calls and sums of figures by provider and model; nulls count as nothing."""
    return events.groupBy(provider, model).agg(F.count(F.lit(1)).alias("calls"), *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in figures])


def rollup_totals(rows: DataFrame, by: list[str], figures: dict[str, Column]) -> DataFrame:
    """Totals, subtotals and the grand total, with the level of each."""
    return rows.rollup(*by).agg(F.grouping_id().cast("long").alias("level"), *[c.alias(n) for n, c in figures.items()])


def tone_signals(text: Column) -> tuple[Column, Column, Column, Column]:
    """Colloquial particles found, informal and formal address, and softening words."""
    particles = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("[呀啦呢哦嘛]"), 0)))
    soft = F.filter(F.array(*[F.lit(w) for w in SOFT_WORDS]), lambda w: F.coalesce(text.contains(w), F.lit(False)))
    return particles, text.contains("你"), text.contains("您"), soft


def tone_figures(rows: DataFrame, text: Column) -> DataFrame:
    """Rows, those with particles, those with softening words only, and those with either address."""
    particles, informal, formal, soft = tone_signals(text)
    high = F.size(F.coalesce(particles, F.array().cast("array<string>"))) > 0
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(high).alias("high"), F.count_if(~high & (F.size(soft) > 0)).alias("soft_only"), F.count_if(informal).alias("informal"), F.count_if(formal).alias("formal")
    )
