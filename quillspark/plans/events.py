"""Event, job, trace and conversation queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import events, joins
from .registry import query, table


@query("""select event_id, user_id, event_type from events e
where exists (select 1 from events a where a.user_id = e.user_id and a.event_type = 'click') and exists (select 1 from events b where b.user_id = e.user_id and b.value > 90)""")
def event_filters_semi(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return events.linked(e, {"clicked": e.where("event_type = 'click'"), "high": e.where("value > 90")}, "user_id").select("event_id", "user_id", "event_type")


@query("select event_id, user_id, event_type, value from events where user_id in (3, 5, 8) order by ts desc, event_id desc limit 200")
def event_history(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("user_id").isin(3, 5, 8)).orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "user_id", "event_type", "value")


@query("select event_id, event_type from events where event_id > 500 and event_type <> 'view' order by event_id limit 100")
def event_replay(spark, sf_dir):
    return events.replay(table(spark, sf_dir, "events"), 500, 100, F.col("event_type") != "view", "event_id").select("event_id", "event_type")


@query("select coalesce(max(event_id), 0) as latest, min(event_id) as oldest from events")
def event_bounds(spark, sf_dir):
    return events.bounds(table(spark, sf_dir, "events"), "event_id")


@query("""with f as (select * from events where ts >= timestamp '2024-01-10'), n as (select min(event_id) as m from (select event_id from f order by event_id desc limit 1000))
select event_id from f, n where event_id >= m""")
def event_retention(spark, sf_dir):
    return events.retained(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-10").cast("timestamp_ntz"), 1000, "event_id").select("event_id")


_TERMINAL = "event_type in ('purchase', 'click')"
_PRUNED = f"""with r as (select event_id, ts, row_number() over (order by ts desc, event_id desc) as n from events where {_TERMINAL}),
p as (select e.event_id, e.event_type, coalesce(r.ts < timestamp '2024-01-05' or r.n > 500, false) as pruned from events e left join r using (event_id))"""


@query(_PRUNED + " select event_id, pruned from p")
def job_prune(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return events.pruned(e, F.expr(_TERMINAL), "ts", F.lit("2024-01-05").cast("timestamp_ntz"), 500, "event_id").select("event_id", "pruned")


@query(_PRUNED + f" select sum(pruned::int)::bigint as deleted_runs, sum(({_TERMINAL} and not pruned)::int)::bigint as retained_terminal, count(*) as all_runs from p")
def job_prune_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = events.pruned(e, F.expr(_TERMINAL), "ts", F.lit("2024-01-05").cast("timestamp_ntz"), 500, "event_id")
    return p.agg(F.sum(F.col("pruned").cast("long")).alias("deleted_runs"), F.sum((F.expr(_TERMINAL) & ~F.col("pruned")).cast("long")).alias("retained_terminal"), F.count(F.lit(1)).alias("all_runs"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def latest_state_per_key(spark, sf_dir):
    return events.latest(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""with l as (select user_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1)
select event_type, count(*) as users, sum((event_type = 'purchase')::int)::bigint as closed from l group by event_type""")
def work_states(spark, sf_dir):
    last = events.latest(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id")
    return last.groupBy("event_type").agg(F.count(F.lit(1)).alias("users"), F.sum((F.col("event_type") == "purchase").cast("long")).alias("closed"))


@query("select event_id, user_id, row_number() over (partition by user_id order by ts, event_id)::integer as sequence from events")
def sequence_allocation(spark, sf_dir):
    return events.numbered(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "sequence")


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn, role, text)::integer - 1 as ordinal from conversations")
def ordinals(spark, sf_dir):
    return events.numbered(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], 0, "ordinal").select("conv_id", "turn", "ordinal")


@query("""with a as (select count(*) as n from events where event_type = 'click'), b as (select event_id from events where event_type = 'signup')
select event_id, (select n from a) + (select count(*) from b) <= 100000 as admitted from b""")
def admission_capacity(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return events.admitted(e.where("event_type = 'signup'").select("event_id"), e.where("event_type = 'click'"), 100000)


@query("""with a as (select event_id, ts, value, 0 as l from events where event_id % 2 = 0 union all select event_id, ts, -value, 1 from events where event_id % 3 = 0)
select event_id, value from (select *, row_number() over (partition by event_id order by l desc) as n from a) where n = 1 order by ts desc, event_id desc limit 300""")
def merge_events_by_id(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return events.merged([e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0").withColumn("value", -F.col("value"))], "event_id", "ts", 300).select("event_id", "value")


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as s from events),
i as (select *, sum(s) over (partition by user_id order by ts rows between unbounded preceding and current row) as n from g)
select user_id, (epoch_us(min(ts)) // 1000000)::bigint as started, count(*) as n_events from i group by user_id, n""")
def debounce_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.sessions(e, "user_id", "ts", "30 minutes", "event_type").select("user_id", F.unix_timestamp("session_start").alias("started"), "n_events")


@query("""with r as (select user_id, ts, max(event_id) as event_id from events where event_type = 'purchase' group by user_id, ts)
select l.event_id, r.event_id as prior_purchase from events l asof left join r on l.user_id = r.user_id and l.ts >= r.ts where l.event_type = 'click'""")
def asof_prior(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return joins.nearest(e.where("event_type = 'click'"), right, "user_id", "ts", "event_id", out="prior_purchase").select("event_id", "prior_purchase")


@query("""with r as (select user_id, ts, min(event_id) as event_id from events where event_type = 'purchase' group by user_id, ts)
select l.event_id, r.event_id as next_purchase from events l asof left join r on l.user_id = r.user_id and l.ts <= r.ts where l.event_type = 'click'""")
def asof_next(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return joins.nearest(e.where("event_type = 'click'"), right, "user_id", "ts", "event_id", True, "next_purchase").select("event_id", "next_purchase")


@query("select event_id, md5(event_id::varchar) as trace_id from events where ('0x' || right(md5(event_id::varchar), 14))::bigint < 18014398509481984")
def trace_sampling(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.md5(F.col("event_id").cast("string").cast("binary")).alias("trace_id"))
    return e.where(text.trace_sampled(F.col("trace_id"), 0.25))


@query("select event_id, user_id from events order by coalesce(case when event_type = 'click' then null else ts end, ts) desc, event_id limit 100")
def trace_list(spark, sf_dir):
    ended = F.when(F.col("event_type") != "click", F.col("ts"))
    return table(spark, sf_dir, "events").orderBy(F.coalesce(ended, F.col("ts")).desc(), "event_id").limit(100).select("event_id", "user_id")


@query("""with a as (select o_orderkey, o_custkey, o_orderstatus, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as before from orders)
select a.o_orderkey, b.o_orderkey as blocker, coalesce(b.o_orderstatus <> 'F', false) as blocked, a.o_orderstatus = 'O' and not coalesce(b.o_orderstatus <> 'F', false) as ready
from a left join orders b on a.before = b.o_orderkey""")
def work_queue(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    before = o.withColumn("blocker", F.lag("o_orderkey").over(w)).withColumn("bs", F.lag("o_orderstatus").over(w))
    blocked = F.coalesce(F.col("bs") != "F", F.lit(False))
    return before.select("o_orderkey", "blocker", blocked.alias("blocked"), ((F.col("o_orderstatus") == "O") & ~blocked).alias("ready"))


_CASCADE = """r as (select o_orderkey, o_orderdate, row_number() over (order by o_orderdate desc, o_orderkey desc) as n from orders where o_orderstatus <> 'P'),
k as (select o.o_orderkey, o.o_orderstatus from orders o left join r using (o_orderkey) where not coalesce(r.o_orderdate < timestamp '1997-01-01' or r.n > 4000, false)),
c as (select (select count(*) from orders) - (select count(*) from k) as deleted_runs, (select count(*) from lineitem where l_orderkey not in (select o_orderkey from k)) as deleted_children, (select count(*) from k where o_orderstatus <> 'P') as retained_terminal)"""


@query(f"""with {_CASCADE} select 'run' as part, o_orderkey as id, count(*) as n, deleted_runs, deleted_children, retained_terminal from k, c group by all
union all select 'child', l_orderkey, count(*), deleted_runs, deleted_children, retained_terminal from lineitem join k on l_orderkey = o_orderkey, c group by all""")
def prune_cascade(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    runs, children, counts = events.pruned_pair(o, li, F.col("o_orderstatus") != "P", "o_orderdate", F.lit("1997-01-01").cast("timestamp_ntz"), 4000, "o_orderkey", "l_orderkey")
    part = lambda name, df, key: df.groupBy(F.lit(name).alias("part"), F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return part("run", runs, "o_orderkey").union(part("child", children, "l_orderkey")).join(F.broadcast(counts))
