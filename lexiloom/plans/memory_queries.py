"""Queries on the translation memory: building, maintaining and browsing it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import memory as M
from ..operators import retrieve as R
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


_OK = "({c} is not null and lower(trim({c})) not in ('', 'x', 'none'))"


@query(f"""
with base as (select original_file as file, split_part(id, '::', 2) as sheet, try_cast(split_part(id, '::', 3) as int) as row, source_text, target_text, pair_id from rag_pairs where original_file is not null),
s as (select file, row, source_text as text from (select *, row_number() over (partition by file, row order by pair_id) n from base where {_OK.format(c="source_text")}) where n = 1)
select t.file || '::' || t.sheet || '::' || t.row as id, t.file as file, t.row as row, t.sheet as sheet,
       case when upper(trim(regexp_replace(t.sheet, '[(（].*$', ''))) in ('JA', 'CN', 'TW', 'US') then 'kr' else 'us' end as source_group, s.text as source_text, t.target_text as target_text
from base t join s on t.file = s.file and t.row = s.row where {_OK.format(c="t.target_text")}
""")
def pair_cells(spark, d):
    """Target cells beside the source cell of their file and row."""
    p = F.split("id", "::")
    base = pairs(spark, d).where("original_file is not null").select(
        F.col("original_file").alias("file"), p[1].alias("sheet"), F.get(p, F.lit(2)).try_cast("int").alias("row"), "source_text", "target_text", "pair_id"
    )
    source = base.where(~T.is_placeholder_text(F.col("source_text"))).withColumnRenamed("source_text", "text")
    source = M.first_seen(source, ["file", "row"], ["pair_id"])
    return M.pair_cells(source, base.withColumnRenamed("target_text", "text"))


@query("""
select source_group, source_text, pair_id, original_file from
 (select *, row_number() over (partition by original_file, source_group, lower(trim(source_text)) order by pair_id) n from rag_pairs where source_text is not null) where n = 1
""")
def first_seen_texts(spark, d):
    """The first row of each text in a file and group."""
    rows = pairs(spark, d).where("source_text is not null")
    return M.first_seen(rows, ["original_file", "source_group", F.lower(F.trim("source_text"))], ["pair_id"]).select("source_group", "source_text", "pair_id", "original_file")


@query("""
select filename, story_id, mtime from processed_files f
where not exists (select 1 from (select original_file from rag_pairs where original_file is not null) p where p.original_file = f.filename)
""")
def files_without_pairs(spark, d):
    """Ledger rows of files that hold no pairs (left anti)."""
    have = pairs(spark, d).select(F.col("original_file").alias("filename")).where("filename is not null")
    return M.unprocessed(load(spark, d, "processed_files"), have, ["filename"]).select("filename", "story_id", "mtime")


@query("""
with n as (select original_file as filename, count(*) as n from rag_pairs group by 1)
select f.filename, cast(f.record_count as bigint) as listed, coalesce(n.n, 0) as counted, coalesce(n.n, 0) - f.record_count as drift
from processed_files f left join n using (filename) where coalesce(n.n, 0) is distinct from f.record_count
""")
def ledger_drift(spark, d):
    """Files whose recorded count differs from their rows."""
    n = pairs(spark, d).groupBy(F.col("original_file").alias("filename")).agg(F.count(F.lit(1)).alias("n"))
    j = load(spark, d, "processed_files").join(n, "filename", "left").withColumn("counted", F.coalesce("n", F.lit(0).cast("long")))
    listed = F.col("record_count").cast("long")
    return j.where(~F.col("counted").eqNullSafe(listed)).select("filename", listed.alias("listed"), "counted", (F.col("counted") - listed).alias("drift"))


@query("""
with latest as (select id, pair_id, story_id, target_text, tone_flag from (select *, row_number() over (partition by id order by pair_id desc) n from rag_pairs where id is not null) where n = 1),
old as (select id, pair_id, target_text, tone_flag from (select *, row_number() over (partition by id order by pair_id) n from rag_pairs where id is not null) where n = 1),
new as (select l.id, l.pair_id, l.target_text, cast(null as varchar) as tone_flag from latest l join old o using (id) where l.pair_id <> o.pair_id)
select id, pair_id, target_text, tone_flag from old where id not in (select id from new)
union all select n.id, n.pair_id, n.target_text, coalesce(n.tone_flag, o.tone_flag) from new n join old o using (id)
""")
def upsert_snapshot(spark, d):
    """The first load of each key, with later loads written over it and the flag carried along."""
    rows = pairs(spark, d).where("id is not null").select("id", "pair_id", "target_text", "tone_flag")
    old = M.first_seen(rows, ["id"], ["pair_id"])
    last = M.last_seen(rows, ["id"], ["pair_id"])
    new = last.join(old.select("id", F.col("pair_id").alias("p")), "id").where("pair_id <> p").select("id", "pair_id", "target_text").withColumn("tone_flag", F.lit(None).cast("string"))
    return M.upsert(old, new, ["id"], keep=["tone_flag"])


@query("""
with cur as (select story_id, max(original_file) as current_file from rag_pairs where story_id is not null and original_file is not null group by 1)
select pair_id, r.story_id, original_file from rag_pairs r join cur using (story_id) where original_file <> current_file
""")
def superseded_rows(spark, d):
    """Rows of a story that stand in another file than its latest."""
    rows = pairs(spark, d)
    now = rows.where("story_id is not null and original_file is not null").groupBy("story_id").agg(F.max("original_file").alias("original_file"))
    return M.superseded(rows, now, "story_id", "original_file").select("pair_id", "story_id", "original_file")


@query("""
select r.pair_id, case when l.pair_id is not null then 'listed' else tone_flag end as tone_flag
from rag_pairs r left join (select distinct pair_id from rag_pairs where target_text like '%您%') l using (pair_id)
""")
def flagged_by_list(spark, d):
    """The flag set on the rows of a list."""
    rows = pairs(spark, d)
    listed = rows.where(F.contains("target_text", F.lit("您"))).select("pair_id")
    return M.flagged(rows, listed, "pair_id", "tone_flag", "listed").select("pair_id", "tone_flag")


@query("""select pair_id, id from rag_pairs where not coalesce(story_id = 'story_006' and tone_flag is null, false)""")
def deleted_story(spark, d):
    """K4: the rows left after a delete; rows whose predicate is null stay."""
    return M.delete(pairs(spark, d), (F.col("story_id") == "story_006") & F.col("tone_flag").isNull()).select("pair_id", "id")


@query("""
with new as (select * from rag_pairs where story_id = 'story_011' and created_at >= timestamp '2025-06-01')
select pair_id, story_id from rag_pairs where story_id is null or story_id not in (select story_id from new) union all select pair_id, story_id from new
""")
def reloaded_story(spark, d):
    """ST4: the rows of a story replaced by a new load of it."""
    rows = pairs(spark, d)
    new = rows.where((F.col("story_id") == "story_011") & (F.col("created_at") >= F.expr("timestamp_ntz'2025-06-01 00:00:00'")))
    return M.reload_story(rows, new, "story_id").select("pair_id", "story_id")


@query("""
select pair_id, story_id, target_lang, section_code, source_text from rag_pairs
where source_group = 'us' and tone_flag is null and (contains(lower(source_text), 'kitchen') or contains(lower(target_text), 'kitchen'))
order by story_id nulls first, target_lang nulls first, section_code nulls first, pair_id limit 30 offset 30
""")
def browse_page(spark, d):
    """The second page of the rows that meet a filter, in a total order."""
    rows = R.browse(pairs(spark, d), {"source_group": "us", "story_id": None}, "kitchen", ["source_text", "target_text"]).where("tone_flag is null")
    order = [F.asc_nulls_first(c) for c in ("story_id", "target_lang", "section_code")] + [F.col("pair_id")]
    return R.page(rows, order, 2, 30).select("pair_id", "story_id", "target_lang", "section_code", "source_text")


@query("""select count(*) as total, count(distinct story_id) as stories, count(*) filter (where tone_flag is not null) as flagged, coalesce(max(pair_id), -1) + 1 as next_id from rag_pairs""")
def memory_status(spark, d):
    """A1, A3, A5: counts of the memory, and the next free number."""
    return pairs(spark, d).agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("story_id").alias("stories"), F.count("tone_flag").alias("flagged"), (F.coalesce(F.max("pair_id"), F.lit(-1)) + 1).alias("next_id")
    )


@query("""select story_id, count(*) as n from rag_pairs group by 1""")
def rows_by_story(spark, d):
    """A2."""
    return pairs(spark, d).groupBy("story_id").agg(F.count(F.lit(1)).alias("n"))


@query("""select distinct 'story' as list, story_id as value from rag_pairs where story_id is not null union all select distinct 'language', target_lang from rag_pairs where target_lang is not null""")
def distinct_lists(spark, d):
    """A4, A22."""
    rows = pairs(spark, d)
    one = lambda c, n: rows.where(F.col(c).isNotNull()).select(F.lit(n).alias("list"), F.col(c).alias("value")).distinct()
    return one("story_id", "story").unionByName(one("target_lang", "language"))


@query("""
with q as (select pair_id as query_id, source_group, source_text, target_lang from rag_pairs where pair_id % 100 = 0 and source_text is not null and target_lang is not null)
select query_id, pair_id, target_text, rank from (
 select q.query_id, r.pair_id, r.target_text, cast(row_number() over (partition by q.query_id order by r.pair_id) as int) as rank
 from q join rag_pairs r using (source_group, source_text, target_lang) where r.tone_flag is null and r.pair_id <> q.query_id) where rank <= 3
""")
def exact_lookup(spark, d):
    """Up to three earlier or later rows with the same source, group and language."""
    rows = pairs(spark, d)
    q = rows.where("pair_id % 100 = 0 and source_text is not null and target_lang is not null").select(F.col("pair_id").alias("query_id"), "source_group", "source_text", "target_lang")
    held = rows.where("tone_flag is null").select("source_group", "source_text", "target_lang", "pair_id", "target_text")
    # one more than wanted, as a query may find itself
    found = R.exact(q, held, ["source_group", "source_text", "target_lang"], "pair_id", 4).where("pair_id <> query_id").drop("rank")
    return R.top_per_query(found, "query_id", [F.col("pair_id")], 3).select("query_id", "pair_id", "target_text", "rank")


@query("""
with kw(query_id, keyword) as (values (1, 'thermostat'), (2, 'open'), (3, '온도'), (4, '100%_')),
r as (select pair_id, source_text, target_text from rag_pairs where source_text is not null and tone_flag is null),
t as (select query_id, 0 as tier, pair_id, source_text, target_text from kw join r on lower(source_text) = lower(keyword)
      union all select query_id, 1, pair_id, source_text, target_text from kw join r on contains(lower(source_text), lower(keyword)) and lower(source_text) <> lower(keyword)),
u as (select *, row_number() over (partition by query_id, source_text, target_text order by tier, pair_id) f from t)
select query_id, tier, pair_id, source_text, rank from (select *, cast(row_number() over (partition by query_id order by tier, pair_id) as int) as rank from u where f = 1) where rank <= 5
""")
def keyword_tiers(spark, d):
    """Exact hits, then keyword hits, without repeats; ``%`` and ``_`` in a keyword are ordinary."""
    rows = pairs(spark, d).where("source_text is not null and tone_flag is null").select("pair_id", "source_text", "target_text")
    # a stated list of keywords; the table is read once, each row with the keywords it holds
    asked = [F.struct(F.lit(i).alias("query_id"), F.lit(k).alias("k")) for i, k in enumerate(["thermostat", "open", "온도", "100%_"], 1)]
    held = F.explode(F.filter(F.array(*asked), lambda x: F.contains(F.lower("source_text"), F.lower(x["k"]))))
    hit = rows.select("*", held.alias("q")).select("pair_id", "source_text", "target_text", "q.query_id", (F.lower("source_text") == F.lower("q.k")).alias("same"))
    exact, keyword = hit.where("same").drop("same"), hit.where("not same").drop("same")
    return R.tiered([exact, keyword], "query_id", ["source_text", "target_text"], [F.col("pair_id")], 5).select("query_id", "tier", "pair_id", "source_text", "rank")


@query("""select distinct target_lang as label, upper(trim(regexp_replace(target_lang, '[(（].*$', ''))) as head from rag_pairs where upper(trim(regexp_replace(target_lang, '[(（].*$', ''))) in ('DE', 'FR')""")
def label_variants(spark, d):
    """The spellings under which a language's rows stand."""
    rows = pairs(spark, d)
    out = R.variants(rows, "target_lang", "DE").unionByName(R.variants(rows, "target_lang", "FR"))
    return out.select(F.col("target_lang").alias("label"), T.label_head(F.col("target_lang")).alias("head"))


@query("""
with q as (select vec_id as query_id, list_transform(embedding, lambda x: x::double) as q from embeddings where vec_id % 100 = 0),
v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings)
select query_id, vec_id as id, rank, round(distance, 6) as distance from (
 select query_id, vec_id, distance, cast(row_number() over (partition by query_id order by distance, vec_id) as int) as rank
 from (select query_id, vec_id, 1 - list_cosine_similarity(q, v) as distance from q, v where vec_id <> query_id)) where rank <= 10
""")
def vector_topk(spark, d):
    """The ten nearest vectors of every hundredth one, by cosine distance."""
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return R.nearest(v, v.where("id % 100 = 0"), 10).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


@query("""
with q as (select vec_id as query_id, list_transform(embedding, lambda x: x::double) as q from embeddings where vec_id % 100 = 0),
v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
h as (select *, row_number() over (partition by query_id order by distance, vec_id) n from (select query_id, vec_id, 1 - list_cosine_similarity(q, v) as distance from q, v where vec_id <> query_id)),
k as (select query_id, vec_id as id, distance from h where n <= 20 and distance <= 0.8)
select query_id, id, round(1 - distance, 2) as similarity, pair_id, target_lang from (
 select k.query_id, k.id, k.distance, r.pair_id, r.target_lang, row_number() over (partition by k.query_id, k.id order by r.target_lang, r.pair_id) f from k join rag_pairs r on r.pair_id = k.id where target_lang is not null) where f = 1
""")
def vector_hits_attached(spark, d):
    """Hits within a distance, each with the first row of its text."""
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    hits = R.nearest(v, v.where("id % 100 = 0"), 20, most=0.8)
    rows = pairs(spark, d).where("target_lang is not null").select(F.col("pair_id").alias("id"), "pair_id", "target_lang")
    out = R.attach_first(hits, rows, ["id"], [F.col("target_lang"), F.col("pair_id")], ["query_id", "id"])
    return out.select("query_id", "id", F.round(1 - F.col("distance"), 2).alias("similarity"), "pair_id", "target_lang")


@query("""
with q as (select distinct source_text from rag_pairs where pair_id % 100 = 0 and source_text is not null),
h as (select source_text, target_text, target_lang, count(*) as score, min(pair_id) as first_id from rag_pairs join q using (source_text) where target_text is not null group by 1, 2, 3)
select source_text, target_lang, target_text, score, rank from (select *, cast(row_number() over (partition by source_text order by score desc, first_id) as int) as rank from h) where rank <= 3
""")
def merged_variants(spark, d):
    """Hits of all variants merged, equal ones once, the best first."""
    rows = pairs(spark, d)
    q = rows.where("pair_id % 100 = 0 and source_text is not null").select("source_text").distinct()
    h = rows.where("target_text is not null").join(q, "source_text").groupBy("source_text", "target_text", "target_lang").agg(F.count(F.lit(1)).alias("score"), F.min("pair_id").alias("first_id"))
    return R.top_per_query(h, "source_text", [F.desc("score"), F.col("first_id")], 3).select("source_text", "target_lang", "target_text", "score", "rank")
