"""Queries on texts: predicates, normal forms, estimates, and the contents of documents."""

from __future__ import annotations

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


@query("""
with p as (select pair_id, trim(coalesce(source_text, '')) as s, trim(coalesce(target_text, '')) as t from rag_pairs)
select pair_id, case when lower(s) in ('ok','on','off','ai','5g','go','up','usb','nfc') or lower(t) in ('ok','on','off','ai','5g','go','up','usb','nfc') then false
 else lower(s) = 'x' or lower(t) = 'x' or (lower(s) = lower(t) and (length(s) < 10)) or (s = '' and t = '') end as skip from p
""")
def skip_predicate(spark, d):
    """Pairs that need no check."""
    return pairs(spark, d).select("pair_id", T.skip_pair(F.col("source_text"), F.col("target_text")).alias("skip"))


@query("""
select case when k like '%disclaimer%' then 'disclaimer' when k like '%description%' then 'description' when k like '%title%' or k like '%button%' or regexp_matches(k, '[0-9]$') then 'title_button' else 'description' end as mode, count(*) as n
from (select lower(coalesce(section_code, '')) as k from rag_pairs) group by 1
""")
def context_modes(spark, d):
    """P11."""
    return pairs(spark, d).groupBy(T.context_mode(F.col("section_code")).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


@query("""select pair_id, trim(regexp_replace(replace(replace(replace(replace(source_text, '“', '"'), '”', '"'), '‘', ''''), '’', ''''), '[ \\t\\r\\n]+', ' ', 'g')) as norm from rag_pairs where regexp_full_match(source_text, '[\\x00-\\x7F]*')""")
def normalized_ascii(spark, d):
    """F1, on texts of ASCII (the SQL side has no NFKC)."""
    return pairs(spark, d).where("source_text is not null and not source_text rlike '[^\\\\x00-\\\\x7F]'").select("pair_id", T.normalize_text(F.col("source_text")).alias("norm"))


@query()
def normalized_text(spark, d):
    """F1, X-U1, over all texts."""
    return pairs(spark, d).select("pair_id", T.normalize_text(F.col("source_text")).alias("norm"))


@query("""
with c as (select doc_id, text, length(regexp_replace(text, '[^\\x{3000}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{AC00}-\\x{D7A3}]', '', 'g')) as k from documents where text is not null)
select doc_id, cast(round_even(k / 1.5::double + (length(text) - k) / 4.0::double, 0) as bigint) as tokens from c
""")
def token_estimates(spark, d):
    """F19."""
    return load(spark, d, "documents").where("text is not null").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("""
select coalesce(lang, '?') as lang, doc_kind, sum(n_chars) as chars, count(*) as docs, cast(grouping(lang, doc_kind) as bigint) as level from (select coalesce(lower(lang), '-') as lang, doc_kind, n_chars from documents) group by rollup(lang, doc_kind)
""")
def chars_rollup(spark, d):
    """Totals with subtotals."""
    rows = load(spark, d, "documents").select(F.coalesce(F.lower("lang"), F.lit("-")).alias("lang"), "doc_kind", "n_chars")
    return R.rollup_totals(rows, ["lang", "doc_kind"], {"chars": F.sum("n_chars"), "docs": F.count(F.lit(1))}).withColumn("lang", F.coalesce("lang", F.lit("?")))


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as v from documents where doc_kind = 'audit_report'),
g as (select doc_id, regexp_extract(trim(v, chr(13)), '^(?:Grade|등급|Niveau|Note):[ \\t]*([A-Z])', 1) as grade from l)
select grade, count(*) as n from g where grade <> '' group by 1
""")
def grade_histogram(spark, d):
    """Grades of all items of the reports."""
    rows = R.lines(load(spark, d, "documents").where("doc_kind = 'audit_report'"), "doc_id", "text")
    return rows.select(R.grade_of(F.col("value")).alias("grade")).where("grade is not null").groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


@query("""
with l as (select doc_id, text, string_split(text, chr(10)) as v from documents where doc_kind = 'audit_report'),
n as (select doc_id, len(v) as total, unnest(range(1, len(v) + 1)) as line, unnest(v) as value from l),
m as (select doc_id, total, line as first from n where regexp_matches(value, '^--- '))
select doc_id, cast(first as int) as first, cast(coalesce(lead(first) over (partition by doc_id order by first) - 1, total) as int) as last from m
""")
def block_ranges(spark, d):
    """From each item's mark to the line before the next."""
    rows = R.lines(load(spark, d, "documents").where("doc_kind = 'audit_report'"), "doc_id", "text")
    return R.blocks(rows, "doc_id", "line", F.col("value").startswith("--- "))


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as v from documents where doc_kind = 'review_notes'),
p as (select doc_id, list_transform(string_split(regexp_replace(trim(v), '^\\||\\|$', '', 'g'), '|'), lambda x: trim(x)) as p from l where trim(v) like '|%')
select doc_id, p[1] as cell, p[2] as before, p[3] as after, p[2] is distinct from p[3] as changed from p where len(p) >= 3 and regexp_matches(p[1], '^[A-Z]{1,2}[0-9]+$')
""")
def review_table_rows(spark, d):
    """Rows of Markdown tables."""
    rows = R.lines(load(spark, d, "documents").where("doc_kind = 'review_notes'"), "doc_id", "text")
    t = R.table_rows(rows, "doc_id", F.col("value"), 3)
    return t.select("doc_id", F.col("p")[0].alias("cell"), F.col("p")[1].alias("before"), F.col("p")[2].alias("after"), (~F.col("p")[1].eqNullSafe(F.col("p")[2])).alias("changed"))


@query("""
with a as (select distinct pair_id from rag_pairs where target_text like '%a%'), b as (select distinct pair_id from rag_pairs where tone_flag is not null)
select (select count(*) from (select * from a intersect select * from b)) as "both", (select count(*) from (select * from a except select * from b)) as only_changed, (select count(*) from (select * from b except select * from a)) as only_suggested
""")
def review_overlap(spark, d):
    """U1, A7."""
    rows = pairs(spark, d)
    return R.overlap(rows.where("target_text like '%a%'"), rows.where("tone_flag is not null"), ["pair_id"])


@query("""
with g as (select case when target_text is null or lower(trim(target_text)) in ('', 'x', 'none') then 'fail' when tone_flag is not null then 'warn' else 'pass' end as status from rag_pairs),
c as (select count(*) as total, count(*) filter (where status = 'pass') as passed, count(*) filter (where status = 'warn') as warned, count(*) filter (where status = 'fail') as failed from g)
select *, cast(round(100.0 * passed / greatest(total, 1)) as bigint) as score, case when round(100.0 * passed / greatest(total, 1)) >= 80 then 'good' when round(100.0 * passed / greatest(total, 1)) >= 60 then 'fair' else 'poor' end as band from c
""")
def status_score(spark, d):
    """A10, A11."""
    status = F.when(T.is_placeholder_text(F.col("target_text")), "fail").when(F.col("tone_flag").isNotNull(), "warn").otherwise("pass")
    return R.status_figures(pairs(spark, d).select(status.alias("status")), "status")


@query("""
with f as (select id, target_text, row_number() over (partition by id order by pair_id) a, row_number() over (partition by id order by pair_id desc) z from rag_pairs where id is not null)
select id, o.target_text as old_value, n.target_text as new_value from (select * from f where a = 1) o full join (select * from f where z = 1) n using (id) where o.target_text is distinct from n.target_text
""")
def cell_differences(spark, d):
    """Cells whose first and last load differ."""
    rows = pairs(spark, d).where("id is not null")
    before, after = M.first_seen(rows, ["id"], ["pair_id"]), M.last_seen(rows, ["id"], ["pair_id"])
    return C.differences(before, after, ["id"], "target_text")


# white space of Unicode as a pattern of the SQL side
_WHITE = "\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


@query(f"""
with w as (select pair_id, list_filter(string_split_regex(source_text, '[{_WHITE}\\x{{FEFF}}]+'), lambda w: w <> '') as s, list_filter(string_split_regex(target_text, '[{_WHITE}\\x{{FEFF}}]+'), lambda w: w <> '') as t from rag_pairs where source_text is not null and target_text is not null),
k as (select pair_id, s, t, list_transform(s, lambda x: lower(x)) as l from w)
select pair_id, len(s) as words, len(list_filter(t, lambda w: list_contains(s, w))) as same, len(list_filter(t, lambda w: not list_contains(s, w) and list_contains(l, lower(w)))) as cased from k
""")
def word_diff(spark, d):
    """words of the target that stand in the source as they are or in another letter case, over all rows with both texts."""
    changed = P.word_changes(F.col("source_text"), F.col("target_text"))
    count = lambda kind: F.size(F.filter(changed, lambda x: x["change"] == kind)).cast("long").alias({"same": "same", "case": "cased"}[kind])
    rows = pairs(spark, d).where("source_text is not null and target_text is not null")
    return rows.select("pair_id", F.size(P.words(F.col("source_text"))).cast("long").alias("words"), count("same"), count("case"))


@query("""select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as html from documents where text is not null""")
def html_escaped(spark, d):
    """F29."""
    rows = load(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", T.html_escape(F.col("text")).alias("html"))


@query("""select pair_id, array_to_string(list_sort(list_distinct(regexp_extract_all(target_text, '[呀啦呢哦嘛]'))), '') as particles, contains(target_text, '你') as informal, contains(target_text, '您') as formal from rag_pairs where upper(trim(regexp_replace(target_lang, '[(（].*$', ''))) = 'CN' and target_text is not null""")
def tone_scan(spark, d):
    """F30, A16."""
    rows = pairs(spark, d).where((T.label_head(F.col("target_lang")) == "CN") & F.col("target_text").isNotNull())
    particles, informal, formal, _ = R.tone_signals(F.col("target_text"))
    return rows.select("pair_id", F.array_join(particles, "").alias("particles"), informal.alias("informal"), formal.alias("formal"))


@query(f"""
with t as (select pair_id, regexp_replace(target_text, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g') as t from rag_pairs where target_text is not null)
select pair_id, cast(len(regexp_extract_all(t, '\\p{{Lu}}')) as bigint) as capitals, cast(len(list_filter(string_split(regexp_replace(t, '([.!?])[{_WHITE}]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) as bigint) as sentences from t where t <> ''
""")
def sentence_figures(spark, d):
    """sentences and capitals of all texts that are not blank."""
    rows = pairs(spark, d).where(F.col("target_text").rlike("(?U)\\S"))
    return rows.select("pair_id", F.regexp_count("target_text", F.lit("\\p{Lu}")).cast("long").alias("capitals"), F.size(X.sentences(F.col("target_text"))).cast("long").alias("sentences"))


@query("""
with s as (select pair_id, regexp_extract(trim(story_id), '([0-9]+)$', 1) as n from rag_pairs) select pair_id, case when n = '' then null when length(n) < 3 then lpad(n, 3, '0') else n end as code from s where n is not null
""")
def story_codes(spark, d):
    """F26, X14."""
    return pairs(spark, d).where("story_id is not null").select("pair_id", T.story_code(F.col("story_id")).alias("code"))


@query("""select source_group, contains(lower(target_lang), 'kr') as kr, regexp_matches(source_text, '[가-힣]') as korean, count(*) as n from rag_pairs group by all""")
def script_routing(spark, d):
    """P4, P16, F2."""
    return pairs(spark, d).groupBy("source_group", F.lower("target_lang").contains("kr").alias("kr"), T.has_korean(F.col("source_text")).alias("korean")).agg(F.count(F.lit(1)).alias("n"))


@query("""select pair_id, case when length(source_text) > 40 then left(source_text, 40) || '…' else source_text end as preview from rag_pairs""")
def previews(spark, d):
    """A preview of each text."""
    return pairs(spark, d).select("pair_id", T.preview(F.col("source_text"), 40).alias("preview"))
