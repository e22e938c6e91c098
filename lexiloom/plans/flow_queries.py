"""Queries on flows: loads by ledger, retrieval by tiers, checks by row, review figures, costs and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions import terms as X
from ..functions import text as T
from ..operators import cells as C
from ..operators import glossary as G
from ..operators import memory as M
from ..operators import prompts as B
from ..operators import reports as R
from ..operators import retrieve as V
from ..session import load
from .common import pairs
from .glossary_queries import FOUND_SQL, found_terms

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_HEADS = ", ".join(f"('{k}', '{v}')" for k, v in T.LANGUAGE_HEADS.items())
_MODE = """case when k like '%disclaimer%' then 'disclaimer' when k like '%description%' then 'description' when k like '%title%' or k like '%button%' or regexp_matches(k, '[0-9]$') then 'title_button' else 'description' end"""
_FREE = "regexp_matches(lower(coalesce(rule, '')), 'no bracket|대괄호 제외|괄호 제외')"
_OFF = "regexp_matches(replace(lower(coalesce(rule, '')), ' ', ''), '비활성화|deactivate|disable')"


@query("select sheet, regexp_matches(lang, '^(" + "|".join(T.CASED_LANGUAGES) + ")') as cased, case when contains(lower(lang), 'korea') or lower(lang) = 'ko' then 'kr' else 'us' end as collection, contains(lang, 'Japan') as corner from sheet_langs")
def language_traits(spark, d):
    """What a language's name decides."""
    lang = F.col("lang")
    return load(spark, d, "sheet_langs").select("sheet", T.writes_sentence_case(lang).alias("cased"), T.collection_of(lang).alias("collection"), (T.bracket_pair(lang)[0] == "「").alias("corner"))


@query(f"""
with h(name, code) as (values {_HEADS}), p as (select pair_id, trim(target_lang) as t, trim(regexp_replace(trim(target_lang), '[(（].*$', '')) as head from rag_pairs where target_lang is not null)
select pair_id, case when regexp_matches(head, '^[A-Za-z]{{2,3}}$') then upper(head) else h.code end as code from p left join h on h.name = replace(replace(lower(t), ' ', '_'), '-', '_')
""")
def language_codes(spark, d):
    """heads and full names as codes, over all rows."""
    return pairs(spark, d).where("target_lang is not null").select("pair_id", T.language_code(F.col("target_lang")).alias("code"))


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as v from documents where text is not null)
select case when contains(v, '수용 비추천') or contains(v, '미반영') then 'reject' when contains(v, '부분 수용') or contains(v, '부분 반영') then 'partial'
 when contains(v, '추가 적용 없음') or v = '유지' or contains(v, '적용 대상 없음') then 'no_apply'
 when contains(v, '전체 수용') or contains(v, '수용 가능') or contains(v, '수용 권장') or contains(v, '번역사 의견 전체 반영') or contains(v, '반영 가능') or contains(v, '수용.') then 'accept' else 'conditional_or_other' end as class, count(*) as n
from l group by 1
""")
def judgment_histogram(spark, d):
    """Classes of judgments, line by line."""
    rows = load(spark, d, "documents").where("text is not null").select(F.explode(F.split("text", "\\n")).alias("v"))
    return rows.groupBy(R.judgment(F.col("v")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with c as (select id, arg_min(target_text, pair_id) as current, arg_max(target_text, pair_id) as last_, min(pair_id) as a, max(pair_id) as z, arg_max(tone_flag, pair_id) as comment from (select id, pair_id, coalesce(target_text, '') as target_text, coalesce(tone_flag, chr(0)) as tone_flag from rag_pairs where id is not null) group by 1),
r as (select split_part(id, '::', 2) as sheet, current, case when a <> z then last_ end as revised, nullif(comment, chr(0)) as comment from c)
select sheet, count(*) filter (where revised is not null or comment is not null) as touched, count(*) filter (where revised is not null and revised <> current) as changed, count(*) filter (where coalesce(comment, '') <> '') as comments
from r group by 1 having count(*) filter (where revised is not null or comment is not null) > 0
""")
def review_by_sheet(spark, d):
    """Cells touched, changed and commented by sheet; a later load of a cell is its revision."""
    rows = pairs(spark, d).where("id is not null").select("id", "pair_id", F.coalesce("target_text", F.lit("")).alias("t"), "tone_flag")
    c = rows.groupBy("id").agg(F.min_by("t", "pair_id").alias("current"), F.max_by(F.struct("t", "tone_flag"), "pair_id").alias("last"), (F.min("pair_id") != F.max("pair_id")).alias("again"))
    cells = c.select(F.split("id", "::")[1].alias("sheet"), "current", F.when(F.col("again"), F.col("last.t")).alias("revised"), F.col("last.tone_flag").alias("comment"))
    return R.review_figures(cells, "sheet", F.col("current"), F.col("revised"), F.col("comment"))


@query(f"""
with {FOUND_SQL},
b as (select pair_id, term, rule, coalesce(target_text, '') as target, trim(regexp_replace(value, '\\(.*?\\)', '', 'g')) as val, lower(coalesce(section_code, '')) as k from f),
q as (select *, {_MODE} as mode, string_split_regex(target, '"[^"]*"') as rests, regexp_extract_all(target, '"[^"]*"') as runs from b where not {_OFF}),
mk as (select *, case when mode = 'disclaimer' then array_to_string(list_transform(range(1, len(rests) + 1), lambda i: rests[i] || case when i > len(runs) then '' when contains(runs[i], '>') then chr(1) else runs[i] end), '') else target end as txt from q),
s as (select *, string_split_regex(txt, '(?i)' || regexp_escape(val)) as ps from mk where val <> ''),
i as (select pair_id, term, mode = 'title_button' or {_FREE} as free, list_transform(range(1, len(ps)), lambda i: ends_with(ps[i], '[') and starts_with(ps[i + 1], ']')) as inside from s)
select pair_id, term, case when free and list_contains(inside, true) then 'forbidden' when not free and list_contains(inside, false) then 'missing' end as issue from i
""")
def bracket_issues(spark, d):
    """Brackets that are missing or undue, place by place, by row, rule and language."""
    issue = X.bracket_issue(F.col("target_text"), F.col("value"), F.col("head"), F.col("section_code"), F.col("rule"))
    off = T.switched_off(F.col("rule")) | (F.trim(F.regexp_replace("value", "\\(.*?\\)", "")) == "")
    return found_terms(spark, d, "section_code").where(~off).select("pair_id", "term", issue.alias("issue"))


_SPACE = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


@query(f"""
with t as (select pair_id, target_text, upper(trim(regexp_replace(target_lang, '[(（].*$', ''))) as head from rag_pairs where target_text is not null),
l as (select upper(trim(regexp_replace(sheet, '[(（].*$', ''))) as head, lang from sheet_langs where regexp_matches(lang, '^({"|".join(T.CASED_LANGUAGES)})')),
s as (select pair_id, list_filter(string_split(regexp_replace(regexp_replace(target_text, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '([.!?]){_SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as ss from t join l using (head)),
c as (select pair_id, list_filter(ss, lambda x: regexp_matches(x, '\\p{{L}}')) as ss from s where len(ss) > 0),
r as (select pair_id, list_transform(ss, lambda x: {{'first': regexp_extract(x, '\\p{{L}}'), 'rest': regexp_extract(x, '(?s)^[^\\p{{L}}]*\\p{{L}}(.*)$', 1)}}) as rs from c)
select pair_id, cast(len(rs) as int) as sentences, cast(len(list_filter(rs, lambda x: regexp_matches(x['first'], '\\p{{Lu}}') and x['rest'] = lower(x['rest']))) as int) as cased,
 cast(coalesce(list_sum(list_transform(rs, lambda x: len(regexp_extract_all(x['rest'], '\\p{{Lu}}')))), 0) as bigint) as extra from r
""")
def sentence_case_check(spark, d):
    """Sentences, those in sentence case and further capitals of each text in a language that has it."""
    langs = load(spark, d, "sheet_langs").select(T.label_head(F.col("sheet")).alias("head"), "lang")
    rows = pairs(spark, d).where("target_text is not null").select("pair_id", "target_text", T.label_head(F.col("target_lang")).alias("head")).join(langs, "head")
    told = rows.select("pair_id", X.sentence_case_report(F.col("target_text"), F.col("lang")).alias("r")).where("r is not null")
    return told.select("pair_id", F.size("r").alias("sentences"), F.size(F.filter("r", lambda x: x["cased"])).alias("cased"), F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["extra"]).alias("extra"))


@query()
def sentence_case_fixes(spark, d):
    """the texts that sentence case would change, with the fix; RE2 has no look-around, so it is tested on a fixture."""
    langs = load(spark, d, "sheet_langs").select(T.label_head(F.col("sheet")).alias("head"), "lang")
    rows = pairs(spark, d).where("target_text is not null").select("pair_id", "target_text", T.label_head(F.col("target_lang")).alias("head")).join(langs, "head")
    return rows.select("pair_id", X.sentence_case_fix(F.col("target_text"), F.col("lang")).alias("fix")).where("fix is not null")


_VALUES = "select t.id, t.source_key, t.rule_text as rule, l.header_code as code, trim(x.value) as value from glossary_terms t join glossary_translations x on x.term_id = t.id join glossary_locales l on l.id = x.locale_id where x.value is not null and trim(x.value) <> '' and l.header_code is not null and l.header_code <> ''"


def _values(spark, d):
    t = load(spark, d, "glossary_terms").select(F.col("id").alias("term_id"), "source_key", F.col("rule_text").alias("rule"))
    x = load(spark, d, "glossary_translations").where("value is not null and trim(value) <> ''")
    held = load(spark, d, "glossary_locales").where("header_code is not null and header_code <> ''").select(F.col("id").alias("locale_id"), F.col("header_code").alias("code"))
    return t.join(x, "term_id").join(held, "locale_id").select("term_id", "source_key", "rule", "code", F.trim("value").alias("value"))


@query(f"""
with v as ({_VALUES}) select id as term_id, code, '- ' || source_key || ' → ' || code || ': ' || value || case when coalesce(rule, '') <> '' then ' (rule: ' || rule || ')' else '' end as line,
 case when {_FREE} then value || ' (EXCEPTION: Do NOT wrap ''' || value || ''' in brackets)' else value end as entry, value as title_entry from v
""")
def glossary_lines(spark, d):
    """lines and entries of a prompt's glossary, in descriptions and in titles."""
    entry = lambda key: X.glossary_entry(F.col("value"), F.col("rule"), F.lit(key))
    return _values(spark, d).select("term_id", "code", X.glossary_line(F.col("source_key"), F.col("code"), F.col("value"), F.col("rule")).alias("line"), entry("//x_description").alias("entry"), entry("//x_title").alias("title_entry"))


@query("""
with t as (select distinct lower(source_key) as m, source_key from glossary_terms where source_key <> '')
select doc_id, source_key from documents, t where text is not null and regexp_matches(text, '(?i)(^|[^a-zA-Z0-9])' || regexp_escape(source_key) || '($|[^a-zA-Z0-9])')
""")
def glossary_hits(spark, d):
    """The glossary's terms in documents, by the table itself."""
    return X.term_rows(load(spark, d, "documents"), "doc_id", "text", load(spark, d, "glossary_terms").select("source_key"), "source_key")


@query("""
with f as (select filename, mtime, story_id from processed_files), due as (select * from f where story_id is not null and story_id like '%1'),
new as (select r.* from rag_pairs r join due on due.filename = r.original_file),
stale as (select * from rag_pairs where not (original_file is not null and original_file in (select filename from due)) and not (story_id is not null and story_id in (select story_id from due))),
g as (select id, max(tone_flag) as flag from rag_pairs where id is not null and tone_flag is not null group by 1)
select pair_id, original_file, tone_flag from stale union all select pair_id, original_file, coalesce(tone_flag, flag) from new left join g using (id)
""")
def loaded_memory(spark, d):
    """ST3, K4, U2: a load by ledger; files of stories that end in 1 have a new time, the others are skipped."""
    ledger = load(spark, d, "processed_files")
    files = ledger.select("filename", F.when(F.col("story_id").endswith("1"), F.concat("mtime", F.lit("9"))).otherwise(F.col("mtime")).alias("mtime"), "story_id")
    rows = pairs(spark, d)
    return M.load_by_ledger(rows, ledger, files, rows)[0].select("pair_id", "original_file", "tone_flag")


@query("""
with n as (select original_file as filename, cast(count(*) as int) as n from rag_pairs group by 1)
select filename, story_id, case when coalesce(story_id like '%1', false) then mtime || '9' else mtime end as mtime, case when coalesce(story_id like '%1', false) then coalesce(n, 0) else record_count end as record_count from processed_files left join n using (filename)
""")
def loaded_ledger(spark, d):
    """ST3, K4: the ledger after that load."""
    ledger = load(spark, d, "processed_files")
    files = ledger.select("filename", F.when(F.col("story_id").endswith("1"), F.concat("mtime", F.lit("9"))).otherwise(F.col("mtime")).alias("mtime"), "story_id")
    rows = pairs(spark, d)
    return M.load_by_ledger(rows, ledger, files, rows)[1]


_TIERS = """
q as (select pair_id as query_id, source_group, source_text as qt, target_lang, vec_id from rag_pairs join embeddings on vec_id = pair_id where pair_id % 100 = 0 and source_text is not null and target_lang is not null),
own as (select source_group, source_text, target_lang, pair_id, target_text, section_code from rag_pairs where tone_flag is null),
e as (select query_id, pair_id, source_text, target_text, section_code from (select q.query_id, o.*, row_number() over (partition by q.query_id order by o.pair_id) n from q join own o on o.source_group = q.source_group and o.source_text = q.qt and o.target_lang = q.target_lang) where n <= 2),
v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
h as (select query_id, id, distance from (select *, row_number() over (partition by query_id order by distance, id) n from (select q.query_id, b.vec_id as id, 1 - list_cosine_similarity(a.v, b.v) as distance from q join v a on a.vec_id = q.vec_id, v b where b.vec_id <> q.vec_id)) where n <= 10),
hs as (select query_id, source_text, min(distance) as distance from h join rag_pairs r on r.pair_id = h.id where distance <= 0.8 and source_text is not null group by 1, 2),
w as (select hs.* from hs where not exists (select 1 from e where e.query_id = hs.query_id and e.source_text = hs.source_text)),
a as (select * from (select w.query_id, w.distance, o.pair_id, w.source_text, o.target_text, o.section_code, row_number() over (partition by w.query_id, w.source_text order by o.target_lang, o.pair_id) n from w join q using (query_id) join own o on o.source_group = q.source_group and o.source_text = w.source_text and o.target_lang = q.target_lang) where n = 1),
u as (select query_id, 0 as tier, 0.0 as distance, pair_id, source_text, target_text, section_code from e union all select query_id, 1, distance, pair_id, source_text, target_text, section_code from a),
best as (select *, cast(row_number() over (partition by query_id order by tier, distance, pair_id) as int) as rank from u)
"""


def _examples(spark, d):
    rows, vectors = pairs(spark, d), load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = rows.where("pair_id % 100 = 0 and source_text is not null and target_lang is not null").select(F.col("pair_id").alias("query_id"), "source_group", "source_text", "target_lang")
    asked = asked.join(vectors.select(F.col("id").alias("query_id")), "query_id", "left_semi")
    hits = V.nearest(vectors, vectors.join(asked.select(F.col("query_id").alias("id")), "id", "left_semi"), 10)
    texts = hits.join(rows.select(F.col("pair_id").alias("id"), "source_text"), "id").select("query_id", "source_text", "distance")
    return V.exact_then_nearest(asked, rows.where("tone_flag is null"), texts, 2)


@query(f"""with {_TIERS} select query_id, rank, case when tier = 0 then 'exact' else 'semantic' end as match, round(round_even(1 - distance, 3), 3) as similarity, pair_id, source_text, target_text, section_code from best where rank <= 2""")
def example_tiers(spark, d):
    """The query's very text, then near texts re-attached by group, text and language."""
    return _examples(spark, d)


@query(f"""
with {_TIERS}, b as (select *, case when tier = 0 then 'exact' else 'semantic, similarity: ' || round_even(1 - distance, 3)::varchar end as told from best where rank <= 2)
select query_id, '[Translation Memory Examples]' || chr(10) || string_agg('Example ' || rank || ' (match: ' || told || ', section: ' || coalesce(section_code, 'None') || '):' || chr(10) || '  Source: "' || source_text || '"' || chr(10) || '  Translation: "' || coalesce(target_text, '') || '"', chr(10) || chr(10) order by rank) as examples
from b group by 1
""")
def few_shot_texts(spark, d):
    """the examples of each query as a prompt has them."""
    return V.examples_text(_examples(spark, d))


@query("""
with held as (select * from rag_pairs where source_group = 'us' and ends_with(section_code, '_description') and tone_flag is null and upper(trim(regexp_replace(target_lang, '[(（].*$', ''))) in ('DE', 'FR')),
s as (select section_code from (select section_code, count(*) n from held group by 1) order by n desc, section_code limit 1),
k as (select held.* from held join s using (section_code)),
hit as (select *, case when source_text = 'the' then 0 else 1 end as tier from k where contains(lower(source_text), 'the') or contains(lower(target_text), 'the')),
u as (select *, row_number() over (partition by source_text, target_lang order by tier, pair_id) f from hit)
select pair_id, source_text, target_lang, tier, rank from (select *, cast(row_number() over (order by tier, pair_id) as int) as rank from u where f = 1) where rank <= 20
""")
def offline_lookup(spark, d):
    """A look-up by variants of a label and by section."""
    rows = pairs(spark, d)
    labels = [r[0] for r in V.variants(rows, "target_lang", "DE").unionByName(V.variants(rows, "target_lang", "FR")).limit(10_001).collect()]
    if len(labels) > 10_000:
        raise ValueError("too many spellings of a label")
    kept = rows.where((F.col("source_group") == "us") & F.col("section_code").endswith("_description") & F.col("tone_flag").isNull() & F.col("target_lang").isin(labels))
    top = kept.groupBy("section_code").count().orderBy(F.desc("count"), "section_code").first()
    found = V.look_up(rows, "us", "the", labels, 20, section=top[0] if top else "")
    return found.select("pair_id", "source_text", "target_lang", F.col("tier").cast("int").alias("tier"), "rank").where(F.col("tier") < 2)


@query("""
with m as (select doc_id, lang, unnest(range(0, 3)) as k from documents),
a as (select doc_id, k, case k when 0 then '{"grade":"Good","suggested_fix":""}' when 1 then '{"is_excellent":true}' else coalesce(lang, '') || ' 수정 필요' end as answer, case when doc_id % 2 = 0 then '문장 1: 문장형 아님, 추가 대문자 수: 2개' else '문장형 아님, 추가 대문자 수: 0개' end as casing, case when doc_id % 3 = 0 then '[별도 지적 사항 없음]' else 'x' end as gl from m)
select doc_id, cast(k as int) as k, case k when 0 then 'warn' when 1 then 'pass' else 'fail' end as status, array_to_string(list_filter([case when doc_id % 2 = 0 then 'casing' end, case when doc_id % 3 <> 0 then 'glossary' end, case when k = 0 then 'suggestion' end], lambda x: x is not null), ',') as tags from a
""")
def payload_status(spark, d):
    """status and tags of items by JSON, with words where there is none."""
    rows = load(spark, d, "documents").select("doc_id", "lang", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    answer = F.when(F.col("k") == 0, '{"grade":"Good","suggested_fix":""}').when(F.col("k") == 1, '{"is_excellent":true}').otherwise(F.concat(F.coalesce("lang", F.lit("")), F.lit(" 수정 필요")))
    casing = F.when(F.col("doc_id") % 2 == 0, "문장 1: 문장형 아님, 추가 대문자 수: 2개").otherwise("문장형 아님, 추가 대문자 수: 0개")
    s = P.item_status(casing, F.when(F.col("doc_id") % 3 == 0, "[별도 지적 사항 없음]").otherwise("x"), answer)
    return rows.select("doc_id", "k", s["status"].alias("status"), F.array_join(s["tags"], ",").alias("tags"))


@query("""select term_id, locale_id, case when locale_id % 7 = 0 then upper(value) else value end as value from glossary_translations union all select id, 9999, source_key from glossary_terms""")
def translations_upsert(spark, d):
    """K3: values written over those of the same term and locale, and new ones added."""
    x = load(spark, d, "glossary_translations").select("term_id", "locale_id", "value")
    new = x.where("locale_id % 7 = 0").withColumn("value", F.upper("value")).unionByName(load(spark, d, "glossary_terms").select(F.col("id").alias("term_id"), F.lit(9999).alias("locale_id"), F.col("source_key").alias("value")))
    return G.upsert_translations(x, new)


@query("""
with k as (select min(id) as a, max(id) as z, max(sort_order) as s from glossary_terms)
select id, case when id = a then 'Renamed' else source_key end as source_key, case when id = a then '' else rule_text end as rule_text, sort_order from glossary_terms, k union all select z + 1, 'New term', 'rule', s + 1 from k
""")
def single_terms(spark, d):
    """One term updated and one created at the end of the order."""
    t = load(spark, d, "glossary_terms")
    first = t.agg(F.min("id")).first()[0]
    out = G.created(t if first is None else G.updated(t, first, " Renamed ", " "), " New term ", "rule")
    return out.select("id", "source_key", "rule_text", "sort_order")


@query("""select cast(row_number() over (order by source_key) as int) as id, source_key, rule_text, sort_order from glossary_terms""")
def seeded_glossary(spark, d):
    """An empty glossary takes the seed, a full one doesn't."""
    t = load(spark, d, "glossary_terms")
    full, taken = G.seeded(t, t.drop("id"))
    if taken and t.limit(1).count():
        raise AssertionError("a glossary with terms was seeded")
    return G.seeded(full.limit(0), t.drop("id"))[0].select("id", "source_key", "rule_text", "sort_order")


@query("""
with u as (select doc_kind as model, source as story, cast(sum(n_chars) as bigint) as input, count(*) as output from documents group by 1, 2),
p(model, price_in, price_out) as (values ('story_text', 0.5, 3.0), ('audit_report', 0.75, 4.5))
select u.model, u.story, u.input, u.output, round(u.input * p.price_in / 1e6 + u.output * p.price_out / 1e6, 9) as cost, cast(round_even(u.input / u.output::double, 0) as bigint) as average from u left join p using (model)
""")
def model_costs(spark, d):
    """Usage joined to prices, cost, and averages with halves to even."""
    u = load(spark, d, "documents").groupBy(F.col("doc_kind").alias("model"), F.col("source").alias("story")).agg(F.sum("n_chars").alias("input"), F.count(F.lit(1)).alias("output"))
    prices = spark.createDataFrame([("story_text", 0.5, 3.0), ("audit_report", 0.75, 4.5)], "model string, price_in double, price_out double")
    out = R.model_costs(u, prices, "model", {"input": "price_in", "output": "price_out"})
    return out.select("model", "story", "input", "output", F.round("cost", 9).alias("cost"), R.average_tokens(F.col("input"), F.col("output")).alias("average"))


@query("""
with m as (select story_id, max(record_count) as record_count from processed_files where record_count > 100 group by 1)
select filename, coalesce(m.record_count, f.record_count) as record_count from processed_files f left join m using (story_id)
""")
def measured_tokens(spark, d):
    """Figures taken over from a second table by key."""
    f = load(spark, d, "processed_files")
    m = f.where("record_count > 100").groupBy("story_id").agg(F.max("record_count").alias("record_count"))
    return R.with_output_tokens(f, m, ["story_id"], "record_count").select("filename", "record_count")


@query("""
with c as (select event_id, event_type || case event_id % 4 when 0 then ':thinking_off' when 1 then ':reasoning_high' when 2 then ':thinking_on' else '' end as m from events)
select event_id, split_part(m, ':', 1) as model, case when split_part(m, ':', 2) = 'thinking_off' then 0 end as thinking_budget, case when split_part(m, ':', 2) = 'reasoning_high' then 'high' end as reasoning_effort,
 case when regexp_matches(lower(m), 'gpt|o1|o3|o4') then 'gpt' else 'default' end as provider, case when event_id % 2 = 0 then 1 when event_id % 3 = 0 and event_id % 5 = 0 then 4 when event_id % 3 = 0 then 3 else 2 end as level from c
""")
def model_choices(spark, d):
    """A model's variant, its provider, and the level that is possible."""
    e = load(spark, d, "events").select("event_id", "event_type")
    k = F.col("event_id")
    m = F.concat("event_type", F.when(k % 4 == 0, ":thinking_off").when(k % 4 == 1, ":reasoning_high").when(k % 4 == 2, ":thinking_on").otherwise(""))
    choice, yes = T.model_choice(m), F.lit(True)
    level = T.capability_level(k % 2 != 0, yes, yes, k % 3 == 0, yes, k % 5 == 0, yes)
    return e.select("event_id", choice["model"].alias("model"), choice["thinking_budget"].alias("thinking_budget"), choice["reasoning_effort"].alias("reasoning_effort"), T.provider(m).alias("provider"), level.alias("level"))


@query("""
select pair_id, case when tone_flag is not null and trim(tone_flag) <> '' then 'tone' when trim(coalesce(section_code, '')) <> '' then 'section' when trim(coalesce(target_lang, '')) <> '' then 'lang' end as name,
 case when tone_flag is not null and trim(tone_flag) <> '' then tone_flag when trim(coalesce(section_code, '')) <> '' then section_code when trim(coalesce(target_lang, '')) <> '' then target_lang end as value,
 nullif(trim(target_text), '') as clean, coalesce(nullif(trim(section_code), ''), strftime(created_at, '%Y.%m.%d')) as dated, regexp_replace(original_file, '\\.[^.]*$', '') || '_' || strftime(created_at, '%Y%m%d_%H%M%S') || regexp_extract(original_file, '(\\.[^.]*)$', 1) as stamped
from rag_pairs
""")
def defaults(spark, d):
    """the first of several values that is given, trimmed texts, dates and stamped names."""
    first = T.first_given(tone=F.col("tone_flag"), section=F.col("section_code"), lang=F.col("target_lang"))
    return pairs(spark, d).select(
        "pair_id", first["name"].alias("name"), first["value"].alias("value"), T.clean_text(F.col("target_text")).alias("clean"), T.dated(F.col("section_code"), F.col("created_at")).alias("dated"), T.stamped(F.col("original_file"), F.col("created_at")).alias("stamped")
    )


@query(f"""
with p as (select pair_id, source_group, coalesce(target_lang, '') as lang, lower(coalesce(section_code, '')) as k, tone_flag from rag_pairs)
select pair_id, 'Translate from ' || case when source_group = 'kr' then 'Korean' else 'English' end || ' into ' || lang || '.' || case when coalesce(trim(tone_flag), '') <> '' then chr(10) || chr(10) || tone_flag else '' end || chr(10) || chr(10) ||
 case when {_MODE} = 'title_button' then 'Glossary terms stand without brackets.' when contains(lang, 'Japan') then 'Glossary terms stand in 「」.' else 'Glossary terms stand in [].' end || chr(10) || chr(10) || 'Return only a JSON object with a "translation" key.' as prompt, {_MODE} as mode, case when {_MODE} = 'title_button' then '' when contains(lang, 'Japan') then '「' else '[' end as prefix from p
""")
def prompt_texts(spark, d):
    """the prompt of each row, and what it is made of."""
    rows = pairs(spark, d).withColumn("lang", F.coalesce("target_lang", F.lit("")))
    source = F.when(F.col("source_group") == "kr", "Korean").otherwise("English")
    prompt = B.translation_prompt(source, F.col("lang"), F.col("section_code"), F.col("tone_flag"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    told = B.modules(F.col("lang"), F.col("section_code"), F.col("tone_flag"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return rows.select("pair_id", prompt.alias("prompt"), told["mode"].alias("mode"), told["prefix"].alias("prefix"))


@query("""
select pair_id, 'Judge whether the translation keeps to the voice.' || chr(10) || chr(10) || 'Source: ' || source_text || chr(10) || 'Translation: ' || target_text || chr(10) || 'Language: ' || target_lang || chr(10) || chr(10) || 'Voice: open' || chr(10) || chr(10) || 'Begin with [PASS] or [FAIL].' as prompt,
 'Review a translation from English into ' || target_lang || '.' || chr(10) || chr(10) || 'Glossary terms stand in [].' || chr(10) || chr(10) || '[Glossary Target]' || chr(10) || 'Target code: ' || target_lang || chr(10) || chr(10) || 'Return only a JSON object with the keys evaluation, grade and suggested_fix.' as audit
from rag_pairs where source_text is not null and target_text is not null and target_lang is not null and not contains(target_lang, 'Japan')
""")
def audit_prompts(spark, d):
    """prompts of reviews."""
    rows = pairs(spark, d).where("source_text is not null and target_text is not null and target_lang is not null and not contains(target_lang, 'Japan')")
    none = F.lit(None).cast("string")
    return rows.select("pair_id", B.style_prompt(F.col("source_text"), F.col("target_text"), F.col("target_lang"), F.lit("open")).alias("prompt"), B.audit_prompt(F.lit("English"), F.col("target_lang"), none, F.lit("//x_description"), none, F.lit("x")).alias("audit"))


@query("""select original_file as file, split_part(id, '::', 2) as sheet, cast(min(try_cast(split_part(id, '::', 3) as int)) as int) as first_row, count(*) as cells from rag_pairs where id is not null and original_file is not null group by 1, 2 having min(try_cast(split_part(id, '::', 3) as int)) is not null""")
def sheet_listing(spark, d):
    """The sheets of each file and the range they take."""
    p = F.split("id", "::")
    cells = pairs(spark, d).where("id is not null and original_file is not null").select(F.col("original_file").alias("file"), p[1].alias("sheet"), F.get(p, F.lit(2)).try_cast("int").alias("row"), F.lit(0).alias("sheet_ord"), F.lit(3).alias("col"))
    n = cells.groupBy("file", "sheet").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("cells")).where("first_row is not null")
    return C.sheets(cells).drop("sheet_ord").join(n, ["file", "sheet"])


@query("""
with c as (select original_file as file, section_code as key, source_text, try_cast(split_part(id, '::', 3) as int) as row from rag_pairs where original_file is not null),
u as (select * from c where row between 7 and 28 and source_text is not null and lower(trim(source_text)) not in ('', 'x') and trim(coalesce(key, '')) <> '')
select file, key, arg_max(source_text, (row, source_text)) as source_text from u group by 1, 2
""")
def cost_extract(spark, d):
    """The text of each key of a file; a later row's counts."""
    p = F.split("id", "::")
    cells = pairs(spark, d).where("original_file is not null").select(F.col("original_file").alias("file"), F.col("section_code").alias("key"), "source_text", F.get(p, F.lit(2)).try_cast("int").alias("row"))
    return C.keyed_texts(cells, ["file"], "key", "source_text", "row")


@query("""select vec_id, label from embeddings where label = 3 union all select pair_id, null from rag_pairs where story_id = 'story_006' and starts_with(id, (select min(original_file) from rag_pairs where story_id = 'story_006') || '::')""")
def metadata_scans(spark, d):
    """Rows by equality of metadata and by the beginning of their id."""
    v = M.matching_rows(load(spark, d, "embeddings"), {"label": 3}).select("vec_id", "label")
    rows = pairs(spark, d)
    first = M.matching_rows(rows, {"story_id": "story_006"}).agg(F.min("original_file")).first()[0]
    own = M.matching_rows(rows, {"story_id": "story_006"}, {"id": f"{first}::"})
    return v.unionByName(own.select(F.col("pair_id").alias("vec_id"), F.lit(None).cast("int").alias("label")))


@query("""
with l as (select filename, '[log] ' || filename || ' | 처리 완료 셀: ' || record_count as log from processed_files where record_count > 100)
select f.filename, f.filename as sheet from processed_files f where not coalesce(f.record_count > 100, false)
""")
def missing_scopes(spark, d):
    """Wanted sheets that a log doesn't report as done."""
    f = load(spark, d, "processed_files")
    logs = f.where("record_count > 100").select("filename", F.concat(F.lit("[log] "), "filename", F.lit(" | 처리 완료 셀: "), "record_count").alias("log"))
    return R.missing_scope(logs, "filename", "log", f.withColumn("sheet", F.col("filename")), "sheet")


@query("""
with r as (select filename, story_id, record_count from processed_files where story_id is not null)
select story_id, string_agg(repeat('=', 90) || chr(10) || '[시트] ' || filename || chr(10) || repeat('-', 90) || chr(10) || chr(10) || '[상세 - records]' || chr(10) || coalesce(record_count::varchar, '') || chr(10), chr(10) order by filename) as report from r group by 1
""")
def text_reports(spark, d):
    """K9: a text report with ruled heads and sections, by story."""
    rows = load(spark, d, "processed_files").where("story_id is not null")
    return R.text_report(rows, "story_id", ["filename"], F.concat(F.lit("[시트] "), "filename"), {"records": F.col("record_count")})


@query("""
with l as (select doc_id, string_split(text, chr(10)) as v from documents where doc_kind = 'audit_report' and text is not null),
n as (select doc_id, unnest(range(1, len(v) + 1)) as line, unnest(v) as value from l),
a as (select doc_id, min(line) as a from n where starts_with(value, '--- ') group by 1),
z as (select n.doc_id, min(line) as z from n join a using (doc_id) where starts_with(value, '--- ') and line > a.a group by 1)
select n.doc_id, cast(line as int) as line, rtrim(value, chr(13)) as value from n join a using (doc_id) left join z using (doc_id) where line > a.a and (z.z is null or line < z.z)
""")
def report_sections(spark, d):
    """The lines between two headings."""
    rows = R.lines(load(spark, d, "documents").where("doc_kind = 'audit_report' and text is not null"), "doc_id", "text")
    mark = F.col("value").startswith("--- ")
    return R.between(rows, "doc_id", "line", mark, mark).select("doc_id", "line", F.regexp_replace("value", "\\r+$", "").alias("value"))


@query("""
with e as (select term_id, list(struct_pack(k := header_alias, v := value, o := column_order, l := locale_id)) as es from (select x.term_id, l.header_alias, trim(x.value) as value, l.column_order, x.locale_id from glossary_translations x join glossary_locales l on l.id = x.locale_id where l.id <= 23 and x.value is not null and trim(x.value) <> '') group by 1),
s as (select e.term_id, sl.lang, unnest(es) as x from e, sheet_langs sl)
select distinct on (term_id, lang) term_id, lang, x.v as value from s where lower(x.k) = lower(lang) or contains(lower(lang), lower(x.k)) order by term_id, lang, case when lower(x.k) = lower(lang) then 0 else 1 end, -length(x.k), x.k, x.v
""")
def rule_lookup(spark, d):
    """A language's own name, else the longest name it holds."""
    held = load(spark, d, "glossary_locales").where("id <= 23").select(F.col("id").alias("locale_id"), F.col("header_alias").alias("key"), "column_order")
    x = load(spark, d, "glossary_translations").where("value is not null and trim(value) <> ''").join(held, "locale_id")
    entries = x.groupBy("term_id").agg(F.array_sort(F.collect_list(F.struct("key", F.trim("value").alias("value")))).alias("es"))
    langs = [r[0] for r in load(spark, d, "sheet_langs").select("lang").limit(5_001).collect()]
    each = entries.select("term_id", "es", F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang"))
    return each.select("term_id", "lang", X.longest_contained(F.col("es"), F.col("lang")).alias("value")).where("value is not null")


@query("""select count(*) as total, count(*) filter (where regexp_matches(t, '[呀啦呢哦嘛]')) as high, count(*) filter (where not regexp_matches(t, '[呀啦呢哦嘛]') and regexp_matches(t, '别让|甚至无需|就能|轻松|无需担心')) as soft_only, count(*) filter (where contains(t, '你')) as informal, count(*) filter (where contains(t, '您')) as formal from (select coalesce(target_text, '') as t from rag_pairs)""")
def tone_figures(spark, d):
    """The five counts of a tone scan."""
    return R.tone_figures(pairs(spark, d), F.coalesce("target_text", F.lit("")))
