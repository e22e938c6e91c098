"""Queries on cells, payloads and their rendering."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions import terms as X
from ..functions import text as T
from ..operators import cells as C
from ..operators import memory as M
from ..operators import reports as R
from ..session import load
from .common import pairs

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _cells(spark, d):
    p = F.split("id", "::")
    return pairs(spark, d).select(
        "pair_id", "original_file", F.get(p, F.lit(1)).alias("sheet"), F.get(p, F.lit(2)).try_cast("int").alias("row"), F.lit(3).alias("col"), F.col("section_code").alias("code"), "source_text", "target_text", "created_at"
    )


_ROW = "try_cast(split_part(id, '::', 3) as int)"


@query(f"select pair_id, {_ROW} as row from rag_pairs where {_ROW} between 7 and 9 or {_ROW} = 20")
def cells_in_ranges(spark, d):
    """The cells of a list of ranges, each once."""
    return _cells(spark, d).where(C.in_ranges("C7:C9, c20, C8", F.col("row"), F.col("col"))).select("pair_id", "row")


@query(f"""
with c as (select original_file as file, {_ROW} as row, source_text, target_text, created_at, pair_id, split_part(id, '::', 2) as sheet from rag_pairs),
a as (select * from (select *, row_number() over (partition by file, row order by pair_id) n from c where sheet like 'DE%') where n = 1 and target_text is not null and lower(trim(target_text)) not in ('', 'x')),
b as (select * from (select *, row_number() over (partition by file, row order by pair_id) n from c where sheet like 'FR%') where n = 1 and target_text is not null and lower(trim(target_text)) not in ('', 'x'))
select a.file, a.row, a.target_text as source, b.target_text as target from a join b on a.file = b.file and a.row = b.row
""")
def zipped_cells(spark, d):
    """Equal coordinates of two sheets side by side."""
    rows = _cells(spark, d).withColumnRenamed("original_file", "file").withColumnRenamed("target_text", "text")
    one = lambda head: M.first_seen(rows.where(F.col("sheet").startswith(head)), ["file", "row"], ["pair_id"]).select("file", "row", "text")
    return C.zip_cells(one("DE"), one("FR"), ["file", "row"])


@query(f"""
with l(row, group_id, group_type, field) as (values (7, 0, 'story', 'title'), (8, 0, 'story', 'description'), {", ".join(f"({s + i}, {n}, 'section', '{f}')" for n, s in enumerate((10, 15, 20, 25), 1) for i, f in enumerate(("title", "description", "disclaimer", "button")))})
select group_id, field, count(*) as n, count(*) filter (where target_text is null or lower(trim(target_text)) in ('', 'x', 'none')) as empty from rag_pairs join l on l.row = {_ROW} group by 1, 2
""")
def layout_figures(spark, d):
    """Cells and empty ones by place in the layout."""
    own = _cells(spark, d).join(F.broadcast(C.layout(spark)), "row")
    return own.groupBy("group_id", "field").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.is_placeholder_text(F.col("target_text"))).alias("empty"))


@query("""
with v as (select term_id, locale_id, trim(value) as w, trim(regexp_replace(trim(value), '\\([^)]*\\)', '', 'g')) as b from glossary_translations where value is not null),
p as (select term_id, locale_id, unnest(list_concat([w, b], case when len(string_split_regex(b, '[,/]')) > 1 then list_transform(string_split_regex(b, '[,/]'), lambda x: trim(x)) else [] end)) as term from v)
select distinct term_id, locale_id, term from p where term <> ''
""")
def highlight_terms(spark, d):
    """The forms of a glossary value that are marked in texts."""
    x = load(spark, d, "glossary_translations").where("value is not null")
    return x.select("term_id", "locale_id", F.explode(X.highlight_terms(F.col("value"))).alias("term"))


@query("""
with t as (select term_id, max(length(trim(value))) as longest, count(distinct trim(value)) as forms from glossary_translations where value is not null and trim(value) <> '' group by 1)
select t.term_id, (select trim(x.value) from glossary_translations x where x.term_id = t.term_id and length(trim(x.value)) = t.longest order by trim(x.value) limit 1) as first_form, t.forms from t
""")
def longest_first_values(spark, d):
    """A term's forms, the longest first."""
    x = load(spark, d, "glossary_translations").where("value is not null and trim(value) <> ''").groupBy("term_id").agg(F.collect_set("value").alias("vs"))
    forms = X.longest_first(F.col("vs"))
    return x.select("term_id", F.get(forms, F.lit(0)).alias("first_form"), F.size(forms).cast("long").alias("forms"))


@query("""
select story_id, '| filename | record_count |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || replace(filename, '|', '\\|') || ' | ' || coalesce(record_count::varchar, '') || ' |', chr(10) order by filename) as markdown from processed_files group by 1
""")
def markdown_report(spark, d):
    """A table of files for each story."""
    return R.markdown_table(load(spark, d, "processed_files"), "story_id", ["filename", "record_count"], ["filename"])


@query("""select filename, '{"filename":"' || filename || '","record_count":' || record_count || '}' as manifest from processed_files where record_count is not null""")
def manifests(spark, d):
    """A delivery's JSON."""
    return load(spark, d, "processed_files").where("record_count is not null").select("filename", F.to_json(F.struct("filename", "record_count")).alias("manifest"))


@query("""
with i as (select doc_id, unnest(string_split(text, chr(10))) as v from documents where doc_kind = 'audit_report'),
s as (select doc_id, regexp_extract(trim(v, chr(13)), '^# (\\S+) (.+)$', 2) as sheet from i where regexp_matches(v, '^# \\S+ .+$'))
select doc_id, sheet, upper(trim(regexp_replace(sheet, '[(（].*$', ''))) as head from s
""")
def report_sheets(spark, d):
    """The sheets that a report's headings name."""
    rows = R.lines(load(spark, d, "documents").where("doc_kind = 'audit_report'"), "doc_id", "text").where(F.col("value").rlike("^# \\S+ .+$"))
    sheet = F.regexp_extract("value", "^# (\\S+) (.+)$", 2)
    return rows.select("doc_id", sheet.alias("sheet"), T.label_head(sheet).alias("head"))


@query("""
with n as (select pair_id, original_file, row_number() over (partition by original_file order by pair_id) as i, count(*) over (partition by original_file) as n from rag_pairs where original_file is not null)
select pair_id, '[' || i || '/' || n || '] ' || original_file as label from n
""")
def numbered_rows(spark, d):
    """Ordinal labels in order of arrival."""
    w = W.partitionBy("original_file")
    i, n = F.row_number().over(w.orderBy("pair_id")), F.count(F.lit(1)).over(w)
    return pairs(spark, d).where("original_file is not null").select("pair_id", F.concat(F.lit("["), i.cast("string"), F.lit("/"), n.cast("string"), F.lit("] "), F.col("original_file")).alias("label"))


@query("""
with e as (select event_id, event_type as g, user_id as u, event_id % 4 as k from events)
select event_id, case k when 2 then 'Needs Revision' when 3 then 'Excellent' else g end as grade, case when k < 2 then u::varchar end as fix from e
""")
def salvaged_replies(spark, d):
    """grade and fix of replies with text around the JSON, in a fence, broken, or with the older field."""
    own = F.concat(F.lit('{"grade":"'), F.col("event_type"), F.lit('","suggested_fix":"'), F.col("user_id").cast("string"), F.lit('"}'))
    k = F.col("event_id") % 4
    reply = F.when(k == 0, F.concat(F.lit("text "), own, F.lit(" end"))).when(k == 1, F.concat(F.lit("```json\n"), own, F.lit("\n```"))).when(k == 2, F.regexp_replace(own, "\\}$", "")).otherwise('{"is_excellent":true}')
    return load(spark, d, "events").select("event_id", P.reply_grade(reply).alias("grade"), P.evaluation(reply)["suggested_fix"].alias("fix"))


@query("""
select sheet, lang, code, row_number() over (order by sheet) as n from (select distinct s.sheet, s.lang, s.code from sheet_langs s join rag_pairs r on r.target_sheet = s.sheet)
""")
def known_sheets(spark, d):
    """The listed sheets in use, each once."""
    used = load(spark, d, "sheet_langs").join(pairs(spark, d).select(F.col("target_sheet").alias("sheet")).distinct(), "sheet", "left_semi")
    # the list is a fixed dimension of some dozens of rows; it is numbered in one order
    return used.select("sheet", "lang", "code", F.row_number().over(W.orderBy("sheet")).cast("long").alias("n"))


@query("""select source_group, list_aggregate(list_sort(list_distinct(list(target_lang))), 'string_agg', '|') as sheets, count(*) as n from rag_pairs where target_lang in (select sheet from sheet_langs) group by 1""")
def source_groups(spark, d):
    """Each source group with its sheets."""
    known = pairs(spark, d).join(load(spark, d, "sheet_langs").select(F.col("sheet").alias("target_lang")), "target_lang", "left_semi")
    return known.groupBy("source_group").agg(F.array_join(F.sort_array(F.collect_set("target_lang")), "|").alias("sheets"), F.count(F.lit(1)).alias("n"))
