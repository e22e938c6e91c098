"""Queries on the glossary and on terms in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms as X
from ..functions import text as T
from ..operators import glossary as G
from ..session import load
from .common import pairs

QUERIES: dict = {}
SQL: dict = {}
# A small glossary for the checks, as the terms of the tables stand in no text: term, language head, value, rule
TERMS = [("thermostat", "DE", "Thermostat", None), ("door lock", "DE", "Türschloss", None), ("robot vacuum", "DE", "Saugroboter", "no brackets"), ("fridge", "DE", "Kühlschrank", "disabled"), ("lock", "DE", "Schloss", None), ("air purifier", "DE", "Luftreiniger", None),
         ("thermostat", "FR", "thermostat", None), ("door lock", "FR", "serrure", None), ("robot vacuum", "FR", "robot aspirateur", "no brackets"), ("fridge", "FR", "réfrigérateur", None), ("lock", "FR", "verrou", None), ("air purifier", "FR", "Purificateur", None)]
_TERM_SQL = "t(term, head, value, rule) as (values " + ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" for x in row) + ")" for row in TERMS) + ")"
# the longest first; RE2 has no look-around, so the neighbours are part of the match
_ALT = "air purifier|robot vacuum|thermostat|door lock|fridge|lock"
FOUND_SQL = f"""
 {_TERM_SQL},
 p as (select pair_id, source_text, target_text, section_code, upper(trim(regexp_replace(target_lang, '[(（].*$', ''))) as head from rag_pairs where target_text is not null and source_text is not null),
 m as (select distinct pair_id, head, target_text, section_code, lower(w) as term from (
   select pair_id, head, target_text, section_code, unnest(regexp_extract_all(regexp_replace(source_text, '([a-zA-Z0-9])', '\\1', 'g'), '(?i)(?:^|[^a-zA-Z0-9])({_ALT})(?:$|[^a-zA-Z0-9])', 1)) as w from p)),
 f as (select m.pair_id, m.term, m.head, m.target_text, m.section_code, t.value, t.rule from m join t on t.term = m.term and t.head = m.head)
"""
_FOUND = FOUND_SQL


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def found_terms(spark, d, *more):
    """``pair_id, head, target_text`` and further columns with the glossary's rows whose term stands in the source, for their own language."""
    rows = pairs(spark, d).where("target_text is not null and source_text is not null").select("pair_id", "source_text", "target_text", T.label_head(F.col("target_lang")).alias("_head"), *more)
    terms = spark.createDataFrame(TERMS, "term string, head string, value string, rule string")
    return X.term_rows(rows, ["pair_id", "_head", "target_text", *more], "source_text", terms, "term").where("_head = head").drop("_head")


@query(f"""with {_FOUND} select head, term, count(*) as n, count(*) filter (where not contains(lower(target_text), lower(value))) as missing from f group by 1, 2""")
def term_compliance(spark, d):
    """For each term and language how often it stands in a source, and how often its value is missing in the target. The flagship query."""
    return found_terms(spark, d).groupBy("head", "term").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.is_missing(F.col("target_text"), F.col("value"))).alias("missing"))


@query(f"""with {_FOUND} select pair_id, term, value from f where not contains(lower(target_text), lower(value))""")
def mismatch_check(spark, d):
    """F6."""
    return found_terms(spark, d).where(X.is_missing(F.col("target_text"), F.col("value"))).select("pair_id", "term", "value")


@query(f"""with {_FOUND} select pair_id, term, value from f where contains(lower(target_text), lower(value)) and substr(target_text, strpos(lower(target_text), lower(value)), length(value)) <> value""")
def casing_check(spark, d):
    """the value stands in the target, but its first place is written differently."""
    return found_terms(spark, d).where(X.casing_differs(F.col("target_text"), F.col("value"))).select("pair_id", "term", "value")


@query(f"""select pair_id, cast(len(regexp_extract_all(source_text, '(?i){_ALT}')) as bigint) as hits from rag_pairs where source_text is not null""")
def highlight_counts(spark, d):
    """Matches to be marked in each text."""
    rows = pairs(spark, d).where("source_text is not null")
    pattern = X.term_pattern([t[0] for t in TERMS], boundary=False)
    return rows.select("pair_id", F.size(F.filter(X.text_segments(F.col("source_text"), pattern), lambda s: s["hit"])).cast("long").alias("hits"))


@query(f"""select target_lang as sheet, count(*) as cells, cast(sum(len(regexp_extract_all(source_text, '(?i){_ALT}'))) as bigint) as hits from rag_pairs where source_text is not null group by 1""")
def highlights_by_sheet(spark, d):
    """Cells and marked matches of each sheet."""
    pattern = X.term_pattern([t[0] for t in TERMS], boundary=False)
    hits = F.size(F.filter(X.text_segments(F.col("source_text"), pattern), lambda s: s["hit"])).cast("long")
    return pairs(spark, d).where("source_text is not null").groupBy(F.col("target_lang").alias("sheet")).agg(F.count(F.lit(1)).alias("cells"), F.sum(hits).alias("hits"))


@query("""
with v as (select t.term_id, t.locale_id, trim(t.value) as value, l.header_display as dis, l.header_code as code, l.column_order as o from glossary_translations t join glossary_locales l on l.id = t.locale_id where t.value is not null and trim(t.value) <> ''),
k as (select term_id, o, locale_id, 0 as p, dis as key, value from v where dis is not null and dis <> '' union all select term_id, o, locale_id, 1, code, value from v where code is not null and code <> ''),
w(wanted) as (values ('de_DE'), ('FR_fr'), ('영어'), ('pt')),
r as (select term_id, wanted, value, row_number() over (partition by term_id, wanted order by case when key = wanted then 0 when lower(key) = lower(wanted) then 1 else 2 end, o, locale_id, p, key, value) as n
 from k join w on key = wanted or lower(key) = lower(wanted) or contains(lower(key), lower(wanted)) or contains(lower(wanted), lower(key)))
select t.id as term_id, w.wanted, r.value from glossary_terms t cross join w left join r on r.term_id = t.id and r.wanted = w.wanted and r.n = 1
""")
def flexible_lookup(spark, d):
    """A term's value under a code, with fallbacks, in column order."""
    t = G.targets(load(spark, d, "glossary_terms"), load(spark, d, "glossary_locales"), load(spark, d, "glossary_translations"))
    wanted = F.explode(F.array(*[F.lit(x) for x in ("de_DE", "FR_fr", "영어", "pt")])).alias("wanted")
    return t.select("term_id", "entries", wanted).select("term_id", "wanted", X.flexible_value(F.col("entries"), F.col("wanted")).alias("value"))


@query("""
select t.source_key, l.header_display, x.value from glossary_translations x join glossary_terms t on t.id = x.term_id join glossary_locales l on l.id = x.locale_id
where t.id in (select id from glossary_terms order by sort_order nulls first, id limit 20)
""")
def glossary_page_values(spark, d):
    """The values of a page of terms."""
    terms = load(spark, d, "glossary_terms")
    page = terms.orderBy(F.asc_nulls_first("sort_order"), "id").limit(20).select(F.col("id").alias("term_id"), "source_key")
    locales = load(spark, d, "glossary_locales").select(F.col("id").alias("locale_id"), "header_display")
    return load(spark, d, "glossary_translations").join(page, "term_id").join(locales, "locale_id").select("source_key", "header_display", "value")


_WIDE = ["한국어_한국", "영어_미국", "독어_독일", "불어_프랑스"]


@query("""
select t.id as term_id, t.source_key, """ + ", ".join(f"""coalesce(max(x.value) filter (where l.id = {i}), '') as "{n}" """ for n, i in zip(_WIDE, (1, 2, 8, 5))) + """
from glossary_terms t left join glossary_translations x on x.term_id = t.id left join glossary_locales l on l.id = x.locale_id group by 1, 2
""")
def glossary_pivot(spark, d):
    """The wide table of four locales."""
    terms, locales, x = (load(spark, d, t) for t in ("glossary_terms", "glossary_locales", "glossary_translations"))
    return G.long_to_wide(terms, locales.where(F.col("id").isin(1, 2, 5, 8)), x, _WIDE).drop("rule_text", "sort_order")


@query()
def glossary_pivot_all(spark, d):
    """The wide table of all locales."""
    terms, locales, x = (load(spark, d, t) for t in ("glossary_terms", "glossary_locales", "glossary_translations"))
    return G.all_to_wide(terms, locales, x).drop("rule_text", "sort_order")


@query("""select term_id, locale_id, max(value) as value from glossary_translations where value is not null and locale_id is not null and term_id in (select id from glossary_terms) group by 1, 2""")
def glossary_unpivot(spark, d):
    """The columns of all locales to long rows."""
    terms, x = load(spark, d, "glossary_terms"), load(spark, d, "glossary_translations")
    ids = sorted(r[0] for r in x.select("locale_id").where("locale_id is not null").distinct().collect())
    if not ids:
        return x.select("term_id", "locale_id", "value").limit(0)
    wide = terms.select(F.col("id").alias("term_id")).join(x.groupBy("term_id").pivot("locale_id", ids).agg(F.max("value")), "term_id", "left")
    return wide.unpivot("term_id", [str(i) for i in ids], "locale_id", "value").where("value is not null").withColumn("locale_id", F.col("locale_id").cast("int"))


@query("""select id, source_key from glossary_terms where contains(lower(source_key), 'a') or contains(lower(rule_text), 'note')""")
def glossary_search(spark, d):
    """P8."""
    hit = F.lower("source_key").contains("a") | F.coalesce(F.lower("rule_text").contains("note"), F.lit(False))
    return load(spark, d, "glossary_terms").where(hit).select("id", "source_key")


@query("""select id, regexp_matches(replace(lower(coalesce(rule_text, '')), ' ', ''), '비활성화|deactivate|disable') as off, regexp_matches(lower(coalesce(rule_text, '')), 'no bracket|대괄호 제외|괄호 제외') as bare from glossary_terms""")
def glossary_rules(spark, d):
    """P9, P10."""
    return load(spark, d, "glossary_terms").select("id", T.switched_off(F.col("rule_text")).alias("off"), T.needs_no_brackets(F.col("rule_text")).alias("bare"))


@query("""
with e as (select * from glossary_terms where rule_text is null), n as (select source_key, rule_text, sort_order from glossary_terms),
f as (select n.*, row_number() over (order by n.source_key) + (select max(id) from e) as id from n where source_key not in (select source_key from e))
select cast(id as int) as id, source_key, rule_text, sort_order from e where source_key not in (select source_key from n)
union all select cast(e.id as int), n.source_key, n.rule_text, e.sort_order from n join e using (source_key)
union all select cast(id as int), source_key, rule_text, sort_order from f
""")
def glossary_merge_import(spark, d):
    """The whole glossary imported over the terms without a rule; new terms get the next numbers, known ones keep their order."""
    t = load(spark, d, "glossary_terms")
    return G.imported(t.where("rule_text is null"), t.drop("id"), "source_key", replace=False)[0]


@query("""
with e as (select * from glossary_terms where rule_text is null), n as (select source_key from glossary_terms)
select count(*) filter (where source_key not in (select source_key from e)) as created, count(*) filter (where source_key in (select source_key from e)) as updated from n
""")
def glossary_import_counts(spark, d):
    """A23."""
    t = load(spark, d, "glossary_terms")
    return G.imported(t.where("rule_text is null"), t.drop("id"), "source_key", replace=False)[1]


@query("""select term_id, locale_id, value from glossary_translations where term_id in (select id from glossary_terms where not coalesce(rule_text is not null and sort_order < 40, false))""")
def glossary_cascade(spark, d):
    """A delete of terms takes their translations along."""
    gone = F.col("rule_text").isNotNull() & (F.col("sort_order") < 40)
    return G.cascade_delete(load(spark, d, "glossary_terms"), load(spark, d, "glossary_translations"), gone)[1].select("term_id", "locale_id", "value")


@query("""
with k as (select t.id, t.source_key, max(x.value) as ko from glossary_terms t left join glossary_translations x on x.term_id = t.id and x.locale_id = 1 group by 1, 2),
u as (select id, source_key as term, source_key, 0 as p from k union all select id, trim(ko), source_key, 1 from k where ko is not null and trim(ko) <> '')
select id, term from (select *, row_number() over (partition by term order by p, source_key) n from u) where n = 1
""")
def doubly_keyed_terms(spark, d):
    """Terms keyed by their own name and by their Korean one."""
    ko = load(spark, d, "glossary_translations").where("locale_id = 1").groupBy(F.col("term_id").alias("id")).agg(F.max("value").alias("ko"))
    return G.doubly_keyed(load(spark, d, "glossary_terms").join(ko, "id", "left"), "source_key", "ko").select("id", "term")


@query("""select coalesce(max(sort_order), -1) + 1 as next_sort_order from glossary_terms""")
def next_sort_order(spark, d):
    """A5."""
    return G.next_sort_order(load(spark, d, "glossary_terms"))


@query("""select header_display as name, count(*) as n from glossary_locales where header_display is not null group by 1 having count(*) > 1""")
def repeated_headers(spark, d):
    """U9."""
    return load(spark, d, "glossary_locales").where("header_display is not null").groupBy(F.col("header_display").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
