"""The catalogue's operators applied to the driver's tables, with DuckDB SQL for the same rows.

orders stand for backups (host: customer, number: order, size: price in cents), events for jobs and
progress (host: user, state: type), page addresses for paths, document texts for logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .functions import numbers, states, text
from .operators import backups as b, jobs as j, quotas as q

QUERIES, ORACLES = {}, {}
#: The instant at which schedules are judged.
NOW_MS = 915_148_800_000


def bound(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _cents(c: str) -> str:
    return f"cast(round({c} * 100) as bigint)"


def _ms(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


def _backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as backups: a host's list is in the order of number."""
    rows = _t(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("host"), F.col("o_orderkey").alias("number"), (F.col("o_orderstatus") == "F").alias("complete"),
        _ms("o_orderdate").alias("startDate"), F.expr(_cents("o_totalprice")).alias("fileSize"),
        F.expr(f"map('total', struct({_cents('o_totalprice')} as diskUsage, 2 * {_cents('o_totalprice')} as uncompressed))").alias("diskUsageStatistics"),
    )
    return rows.withColumn("pos", (F.row_number().over(W.partitionBy("host").orderBy("number")) - 1).cast("int"))


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("pos"), F.col("c_custkey").cast("string").alias("host"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "element_at(map('signup', 'waiting', 'purchase', 'completed', 'error', 'failed', 'view', 'active', 'click', 'delayed'), event_type)"
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("backup").alias("name"), F.expr(name).alias("state"), _ms("ts").alias("timestamp"), F.struct(F.col("user_id").cast("string").alias("host"), F.col("event_id").alias("number")).alias("data"))


_STATE = "case event_type when 'signup' then 'waiting' when 'purchase' then 'completed' when 'error' then 'failed' when 'view' then 'active' when 'click' then 'delayed' end"


@bound("select o_orderkey as number, cast(sum(cast(round(o_totalprice * 100) as bigint)) over (order by o_orderdate, o_custkey, o_orderkey rows unbounded preceding) as bigint) as diskUsage, cast(2 * sum(cast(round(o_totalprice * 100) as bigint)) over (order by o_orderdate, o_custkey, o_orderkey rows unbounded preceding) as bigint) as uncompressed from orders")
def b01_running_total(spark, sf_dir):
    return b.compression_history(_hosts(spark, sf_dir), _backups(spark, sf_dir)).select("number", "diskUsage", "uncompressed")


@bound("select cast(o_custkey as varchar) as host, max(o_orderkey) as number, cast(arg_max(cast(round(o_totalprice * 100) as bigint), o_orderkey) as bigint) as fileSize from orders group by o_custkey")
def b02_last_backup(spark, sf_dir):
    return b.last_of_each(_backups(spark, sf_dir)).select("host", "number", "fileSize")


@bound(f"select cast(user_id as varchar) as host, arg_max({_STATE}, row(epoch_us(ts) // 1000, event_id)) as state from events where user_id is not null group by 1")
def b03_latest_state(spark, sf_dir):
    return j.latest_state(_jobs(spark, sf_dir))


@bound("select cast(c_custkey as varchar) as host from customer anti join (select * from orders where o_orderstatus = 'F') on c_custkey = o_custkey")
def b04_idle_hosts(spark, sf_dir):
    busy = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.lit("active").alias("state"), F.struct(F.col("o_custkey").cast("string").alias("host")).alias("data"))
    return j.to_enqueue(_hosts(spark, sf_dir), busy).select("host")


_SNAPSHOT_SQL = """
with l as (select l_orderkey, cast(round(l_extendedprice * 100) as bigint) as refr, cast(round(l_tax * l_extendedprice * 100) as bigint) as excl, l_linenumber from lineitem),
s as (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as used, coalesce(sum(excl) filter (where l_linenumber <> 1), 0) as e, coalesce(sum(excl + refr) filter (where l_linenumber <> 1), 0) as t from orders left join l on o_orderkey = l_orderkey group by all)
select o_orderkey as pos, cast(used - e as bigint) as refr, cast(e as bigint) as excl, cast(t as bigint) as total from s"""


@bound(_SNAPSHOT_SQL)
def b06_snapshot_total(spark, sf_dir):
    volumes = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.expr(f"struct('h' as host, if(l_linenumber = 1, -1L, cast(l_linenumber as bigint)) as number, {_cents('l_extendedprice')} as refr, {_cents('l_tax * l_extendedprice')} as excl)")).alias("v"))
    rows = _t(spark, sf_dir, "orders").join(volumes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    empty = F.filter(F.array(F.expr("struct('h' as host, -1L as number, 0L as refr, 0L as excl)")), lambda x: F.lit(False))
    quotas = rows.select(F.col("o_orderkey").alias("pos"), _ms("o_orderdate").alias("timestamp"), F.coalesce("v", empty).alias("volumes"), F.struct(F.expr(_cents("o_totalprice")).alias("used")).alias("space"))
    return q.totals(quotas).drop("timestamp")


@bound("select " + ", ".join(f"count(*) filter (where {_STATE} = '{s}') as {s}" for s in ("waiting", "active", "failed", "delayed", "completed")) + " from events")
def b07_state_counts(spark, sf_dir):
    return j.counts(_jobs(spark, sf_dir))


_TASK_SQL = """
with s as (select user_id, cast(date_trunc('day', ts) as date) as day, case event_type when 'signup' then 'WAITING' when 'error' then 'FAILED' when 'view' then 'RUNNING' else 'SUCCESS' end as state from events),
g as (select user_id, day, bool_or(state in ('RUNNING', 'WAITING')) as o, bool_or(state = 'RUNNING') as r, bool_or(state in ('FAILED', 'ABORTED')) as b from s group by user_id, day)
select user_id, strftime(day, '%Y-%m-%d') as day, case when o and b then 'ABORTED' when r then 'RUNNING' when o then 'WAITING' when b then 'FAILED' else 'SUCCESS' end as state from g"""


@bound(_TASK_SQL)
def b08_task_state(spark, sf_dir):
    state = "case event_type when 'signup' then 'WAITING' when 'error' then 'FAILED' when 'view' then 'RUNNING' else 'SUCCESS' end"
    # a user's day is a task, its events are the steps
    tasks = _t(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_list(F.expr(f"struct({state} as state)")).alias("subtasks"))
    return tasks.select("user_id", "day", states.task_state(F.col("subtasks")).alias("state"))


@bound("select cast(user_id as varchar) as task, cast(epoch_us(time_bucket(interval '5 seconds', ts)) // 1000 as bigint) as at_ms, arg_max(event_id, row(ts, event_id)) as event_id from events group by all")
def b10_progress_sample(spark, sf_dir):
    from .streaming.progress import sampled

    rows = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("task"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return sampled(rows, order="event_id").select("task", F.unix_millis("at").alias("at_ms"), "event_id")


@bound("select event_id, format('{:o}', event_id & 4095) as mode from events")
def b11_octal_mode(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", text.octal_mode(F.col("event_id")).alias("mode"))


@bound("select page_id, replace(replace(url_encode(url), '%7E', '~'), '+', '%20') as component, url as decoded from pages")
def b12_url_component(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select("page_id", text.mangle(F.col("url")).alias("component"))
    return rows.withColumn("decoded", text.unmangle(F.col("component")))


@bound("select page_id, string_split(url, '.')[-1] as extension from pages")
def b13_extension(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.extension(F.col("url")).alias("extension"))


@bound(r"select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) as pos, line from (select doc_id, unnest(regexp_split_to_array(text, '[\n\r]')) as line, unnest(range(len(regexp_split_to_array(text, '[\n\r]')))) as i from documents) where line <> ''")
def b14_log_lines(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.log_lines(F.col("text"))).alias("pos", "line"))


@bound("""
with p as (select page_id, list_filter(string_split('/' || regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '') as p from pages)
select page_id, cast(i - 1 as int) as pos, '/' || array_to_string(p[1:i], '/') as prefix from (select page_id, p, unnest(range(1, greatest(len(p), 1) + 1)) as i from p)""")
def b15_path_prefixes(spark, sf_dir):
    path = F.expr("regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '')")
    return _t(spark, sf_dir, "pages").select("page_id", F.posexplode(text.path_prefixes(path)).alias("pos", "prefix"))


@bound("select event_id, strftime(ts, '%m/%d/%Y %H:%M') as shown from events")
def b16_format_date(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", numbers.date_text(_ms("ts")).alias("shown"))


@bound("select p_partkey, upper(p_type[1]) || p_type[2:] as name from part")
def b17_capitalize(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.capitalize(F.col("p_type")).alias("name"))


@bound("select o_orderkey, cast(1000 * date_diff('second', o_orderdate, max(l_shipdate)) as bigint) as duration from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey, o_orderdate")
def b20_duration(spark, sf_dir):
    ends = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("end"))
    rows = _t(spark, sf_dir, "orders").join(ends, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", b.duration(_ms("o_orderdate"), _ms("end")).alias("duration"))


@bound("select o_orderkey as number, cast(round(o_totalprice * 100) as bigint) * case when o_orderstatus = 'F' then 2 else 1 end as fileSize from orders where o_totalprice >= 50000")
def b24_upsert(spark, sf_dir):
    have = _backups(spark, sf_dir)
    changes = have.filter("complete").withColumn("fileSize", 2 * F.col("fileSize")).drop("pos")
    return b.removed(b.upserted(have, changes), have.filter("fileSize < 5000000")).select("number", "fileSize")


@bound(f"""
with l as (select o_custkey, max(o_orderkey) as k, arg_max(o_orderstatus = 'F', o_orderkey) as complete, arg_max(o_orderdate, o_orderkey) as d from orders group by o_custkey)
select cast(c_custkey as varchar) as host, coalesce(not complete, true) or ({NOW_MS} - coalesce(epoch_us(d) // 1000, 0)) / 1000.0 > 200 * 86400 as due from customer left join l on c_custkey = o_custkey""")
def b25_due_predicate(spark, sf_dir):
    configs = _hosts(spark, sf_dir).select("host", F.expr("named_struct('activated', cast(null as boolean), 'backupPerdiod', 200 * 86400L)").alias("schedule"))
    return j.due(j.merged_schedule(configs), b.last_of_each(_backups(spark, sf_dir)), NOW_MS)


@bound("select cast(c_custkey as varchar) as host, c_custkey as pos from customer semi join (select * from orders where o_orderstatus = 'F') on c_custkey = o_custkey")
def b26_known_hosts(spark, sf_dir):
    listed = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("host"))
    return b.known(_hosts(spark, sf_dir), listed).select("host", F.col("pos").cast("bigint").alias("pos"))


@bound("select o_orderkey as number, cast(round(o_totalprice * 100) as bigint) as fileSize from orders order by o_orderkey desc limit 10 offset 10")
def b28_page(spark, sf_dir):
    return b.page(_backups(spark, sf_dir), 1).select("number", "fileSize")


@bound("select p_partkey, case when p_size = 1 then null else p_size / (p_size - 1) end as ratio from part")
def b29_ratio(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", numbers.compression_ratio(F.col("p_size"), F.col("p_size") - 1).alias("ratio"))


@bound(f"select {_STATE} as state, list_sort(list(event_id)) as ids, count(*) as n from events group by 1")
def b30_group_list(spark, sf_dir):
    return j.by_state(_jobs(spark, sf_dir))
