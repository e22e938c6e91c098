"""Queries on events: windows, running figures, outcomes; and joins of small dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import reports as R
from ..session import load
from ..streaming import windows as S

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _events(spark, d):
    return S.at_utc(load(spark, d, "events"))


def _plain(df):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@query("""select time_bucket(interval 1 hour, ts) as start, time_bucket(interval 1 hour, ts) + interval 1 hour as "end", event_type, count(*) as n, round(sum(value), 4) as total, max(value) as most from events group by 1, 2, 3""")
def tumbling_windows(spark, d):
    """ST6 and windows of a fixed size."""
    return _plain(S.tumbling(_events(spark, d), "1 hour", ["event_type"]))


@query("""
with s as (select *, unnest([time_bucket(interval 30 minutes, ts), time_bucket(interval 30 minutes, ts) - interval 30 minutes]) as start from events)
select start, start + interval 1 hour as "end", event_type, count(*) as n, round(sum(value), 4) as total, max(value) as most from s group by 1, 2, 3
""")
def sliding_windows(spark, d):
    """Windows that overlap."""
    return _plain(S.sliding(_events(spark, d), "1 hour", "30 minutes", ["event_type"]))


@query("""
with g as (select *, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 5 minutes or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g)
select min(ts) as start, max(ts) + interval 5 minutes as "end", user_id, count(*) as n, round(sum(value), 4) as total, max(value) as most from s group by user_id, k
""")
def session_windows(spark, d):
    """Sessions that end after a gap."""
    return _plain(S.sessions(_events(spark, d), "5 minutes", ["user_id"]))


@query("""
select event_id, user_id, count(*) over (partition by user_id order by ts, event_id rows unbounded preceding) as done,
 cast(floor(100 * count(*) over (partition by user_id order by ts, event_id rows unbounded preceding) / count(*) over (partition by user_id)) as bigint) as percent from events
""")
def running_progress(spark, d):
    """W3, A17."""
    return R.running_progress(load(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "done", "percent")


@query("""select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) b, row_number() over (partition by user_id order by ts, event_id) n from events) where n = 1 or b is distinct from event_type""")
def section_changes(spark, d):
    """W4."""
    return R.changes_of(load(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("""
with k as (select min(event_type) as a, max(event_type) as z from events),
e as (select user_id, ts, event_id, props, case when event_type = a then 'complete' when event_type = z then 'error' else 'log' end as kind from events, k)
select user_id, arg_max(props, (ts, event_id)) filter (where kind = 'complete') as result, count(*) filter (where kind = 'complete') as completed, count(*) filter (where kind = 'error') as errors, count(*) filter (where kind = 'log') as logs,
 case when count(*) filter (where kind = 'error') > 0 then 'error' when count(*) filter (where kind = 'complete') > 0 then 'ok' else 'incomplete' end as status from e group by 1
""")
def task_outcomes(spark, d):
    """A18, ST1, ST2: each task's last result and status."""
    e = load(spark, d, "events")
    ends = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("z"))
    kind = F.when(F.col("event_type") == F.col("a"), "complete").when(F.col("event_type") == F.col("z"), "error").otherwise("log")
    rows = e.join(F.broadcast(ends)).withColumn("kind", kind)  # one row of two values
    return R.task_outcomes(rows, "user_id", F.struct("ts", "event_id"), "kind", "props")


@query("""select event_type, user_id % 10 as grp, count(*) as calls, round(coalesce(sum(value), 0), 4) as value from events group by 1, 2""")
def usage_by_model(spark, d):
    """A13."""
    e = load(spark, d, "events").withColumn("grp", F.pmod("user_id", F.lit(10)))
    return R.usage_totals(e, "event_type", "grp", ["value"]).withColumn("value", F.round("value", 4))


@query("""
with s as (select user_id, min(ts) as a, min(ts) + interval 1 day as z from events group by 1)
select e.event_id, e.user_id from events e join s using (user_id) where e.ts between s.a and s.z
""")
def span_containment(spark, d):
    """Events within a span of their own task."""
    e = load(spark, d, "events")
    spans = e.groupBy("user_id").agg(F.min("ts").alias("a")).withColumn("z", F.col("a") + F.expr("interval 1 day"))
    return e.join(spans, "user_id").where(F.col("ts").between(F.col("a"), F.col("z"))).select("event_id", "user_id")


@query("""select n.n_name, r.r_name, case when n_name in ('JAPAN', 'CHINA') then 'kr' else 'us' end as grp from nation n, region r""")
def cells_by_sheets(spark, d):
    """Each cell with each sheet; the sheets are a small list."""
    n = load(spark, d, "nation").select("n_name", F.when(F.col("n_name").isin("JAPAN", "CHINA"), "kr").otherwise("us").alias("grp"))
    sheets = [r[0] for r in load(spark, d, "region").select("r_name").orderBy("r_name").limit(1_001).collect()]
    if len(sheets) > 1_000:
        raise ValueError("more sheets than a workbook has")
    return n.select("n_name", F.explode(F.array(*[F.lit(s) for s in sheets])).alias("r_name"), "grp")


@query("""
select o_orderstatus, l_returnflag, sum(l_quantity) as quantity, count(*) as n, cast(grouping(o_orderstatus, l_returnflag) as bigint) as level
from lineitem join orders on l_orderkey = o_orderkey group by rollup(o_orderstatus, l_returnflag)
""")
def usage_rollup(spark, d):
    """Figures of a fact table with subtotals."""
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity").join(load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    return R.rollup_totals(rows, ["o_orderstatus", "l_returnflag"], {"quantity": F.sum("l_quantity"), "n": F.count(F.lit(1))})


@query("""select c.c_custkey, coalesce(n.n_name, 'unknown') as lang from customer c left join (select * from nation where n_nationkey < 10) n on n.n_nationkey = c.c_nationkey""")
def map_with_default(spark, d):
    """A small map looked up with a default."""
    n = load(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return load(spark, d, "customer").select("c_custkey", "c_nationkey").join(n, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("lang"))


@query("""
with c as (select split_part(id, '::', 2) as sheet, story_id from rag_pairs where id is not null)
select distinct sheet from c where story_id = 'story_006' and sheet in (select sheet from c where story_id <> 'story_006') and sheet in (select sheet from sheet_langs) and sheet <> 'JA(일본)'
""")
def chosen_sheets(spark, d):
    """Sheets that two workbooks share, on the list, without the source's."""
    cells = load(spark, d, "rag_pairs").where("id is not null").select(F.split("id", "::")[1].alias("sheet"), "story_id")
    source = cells.where("story_id = 'story_006'").select("sheet", F.hash("sheet").alias("sheet_ord"))
    return C.chosen_sheets(source, cells.where("story_id <> 'story_006'"), None, load(spark, d, "sheet_langs"), without="JA(일본)").select("sheet")
