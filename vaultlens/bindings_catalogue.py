"""More of the catalogue's operators applied to the driver's tables, with DuckDB SQL for the same rows.

customer and supplier stand for hosts, orders for backups and volumes, part for operations and files, events for jobs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import schemas
from .bindings import NOW_MS, ORACLES, QUERIES, _backups, _cents, _hosts, _jobs, _ms, _t, bound
from .functions import numbers, states, templates, text
from .operators import backups as b, checks, files, jobs as j, network, quotas as q, tasks as t
from .sources import reports

__all__ = ["ORACLES", "QUERIES"]

_JOB_STATE = "case event_type when 'signup' then 'waiting' when 'purchase' then 'completed' when 'error' then 'failed' when 'view' then 'active' when 'click' then 'delayed' end"
_C = "cast(round(o_totalprice * 100) as bigint)"


@bound(f"""
with s as (select '0/' || o_orderkey as key, cast(o_custkey as varchar) as host, o_orderkey as number, 0 as kind, o_orderkey as place from orders where o_orderkey % 7 <> 0
  union all select '1/' || c_custkey, cast(c_custkey as varchar), -1, 1, c_custkey from customer where c_custkey % 5 <> 0),
z as (select '0/' || l_orderkey as id, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as refr, count(*) as excl from lineitem group by 1
  union all select '1/' || o_custkey, cast(sum({_C}) as bigint), count(*) from orders group by 1)
select host, number, refr, excl, cast(kind as int) as kind, place from s left join z on key = id""")
def b05_volume_quota(spark, sf_dir):
    subvolumes = _t(spark, sf_dir, "orders").selectExpr("if(o_orderkey % 7 = 0, -1L, o_orderkey) as id", "cast(o_custkey as string) as host", "o_orderkey as number")
    hosts = _hosts(spark, sf_dir)
    groups = hosts.selectExpr("host", "if(pos % 5 = 0, -1L, cast(pos as bigint)) as qgroup_id")
    sizes = _t(spark, sf_dir, "lineitem").groupBy(F.expr("concat('0/', l_orderkey)").alias("id")).agg(F.sum(F.expr(_cents("l_extendedprice"))).alias("refr"), F.count("*").alias("excl"))
    sizes = sizes.unionByName(_t(spark, sf_dir, "orders").groupBy(F.expr("concat('1/', o_custkey)").alias("id")).agg(F.sum(F.expr(_cents("o_totalprice"))).alias("refr"), F.count("*").alias("excl")))
    return q.volume_sizes(subvolumes, hosts, groups, sizes)


@bound("select user_id, cast(sum(event_id) as bigint) as size, count(*) as files, coalesce(arg_max(value, row(ts, event_id)) filter (where value <> 0), 0) as speed, cast(sum(event_id % 100) as double) / count(*) as percent from events group by user_id")
def b09_progression(spark, sf_dir):
    step = "struct(ts, event_id, true as progress, struct(event_id as fileSize, event_id as newFileSize, 1L as newFileCount, 1L as fileCount, cast(value as double) as speed, cast(event_id % 100 as double) as percent) as progression)"
    rows = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.expr(step))).alias("s"))
    return rows.select("user_id", t.progression(F.col("s")).alias("p")).selectExpr("user_id", "p.fileSize as size", "p.fileCount as files", "p.speed", "p.percent")


@bound("""
with r as (select 's' || s_suppkey as host, k as pos, '10.0.' || ((s_suppkey + k) % 10) as address, 50 * k as lo, 100 * (k + 1) as hi from supplier, (select unnest([0, 1]) as k)),
n as (select '10.0.' || (c_custkey // 100 % 10) as address, c_custkey % 250 as n, 's' || (c_custkey % 100) as name from customer)
select host, arg_min(r.address || '.' || n, row(pos, n)) as ip from r join n on r.address = n.address and n between lo and hi and host = name group by host""")
def b18_address_ranges(spark, sf_dir):
    ranges = _t(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) as host", "explode(array(0, 1)) as pos", "s_suppkey").selectExpr("host", "pos", "concat('10.0.', (s_suppkey + pos) % 10) as address", "50 * pos as start", "100 * (pos + 1) as end")
    names = _t(spark, sf_dir, "customer").selectExpr("concat('10.0.', c_custkey div 100 % 10, '.', c_custkey % 250) as ip", "concat('S', c_custkey % 100) as hostname")
    return network.in_ranges(ranges, names)


@bound("select cast(event_id as varchar) as host, event_id as id, event_type as name from events")
def b19_lock_content(spark, sf_dir):
    locks = _t(spark, sf_dir, "events").selectExpr("cast(event_id as string) as host", "event_id as id", "event_type as name")
    return j.lock_content(j.lock_text(locks))


@bound("select event_id, epoch_us(ts) // 1000 / 1000.0 as seconds, epoch_us(ts) // 1000 / 60000.0 as minutes, event_id / 3600.0 as hours from events")
def b21_time_units(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", numbers.seconds(_ms("ts")).alias("seconds"), numbers.minutes(_ms("ts")).alias("minutes"), numbers.hours(F.col("event_id")).alias("hours"))


@bound("select p_partkey, cast(p_size as double) * power(1024.0, p_partkey % 4) as bytes, p_size * 1000 + p_partkey % 1000 as labelled, try_cast(regexp_extract(p_name, '^\\s*([+-]?[0-9]+)', 1) as bigint) as lead from part")
def b22_sizes_with_units(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").withColumn("unit", F.expr("element_at(array('bytes', 'KB', 'MB', 'GB'), cast(p_partkey % 4 + 1 as int))"))
    line = F.concat(F.lit("Total file size: "), F.format_number(F.expr("p_size * 1000 + p_partkey % 1000"), 0), F.lit(" bytes"))
    return rows.select("p_partkey", numbers.sized(F.col("p_size").cast("string"), F.col("unit")).alias("bytes"), numbers.value_after(line, "Total file size").alias("labelled"), numbers.parse_int(F.col("p_name")).alias("lead"))


@bound("""
with s as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, event_type,
  coalesce(max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as failed from events)
select user_id, cast(pos as int) as pos, case when failed = 1 and event_type <> 'click' then 'ABORTED' when event_type = 'error' then 'FAILED' else 'SUCCESS' end as state from s""")
def b23_abort_propagation(spark, sf_dir):
    # clicks stand for steps that run whatever failed
    step = "struct(ts, event_id, if(event_type = 'error', 'FAILED', 'SUCCESS') as state, event_type <> 'click' as failable)"
    rows = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.expr(step))).alias("s"))
    return rows.select("user_id", F.posexplode(t.propagated(F.col("s"))).alias("pos", "state"))


@bound("select cast(o_custkey as varchar) as host, o_orderkey as number, cast(o_custkey as int) as host_pos from orders")
def b27_flattened(spark, sf_dir):
    return b.flattened(_hosts(spark, sf_dir), _backups(spark, sf_dir)).select("host", "number", "host_pos")


def _configs(spark, sf_dir):
    """Parts as hosts with operations: a command, a copy of two shares, and for some a closing command."""
    share = "named_struct('name', {n}, 'includes', array(concat('/', p_brand), '/a/b'), 'excludes', array('*.tmp'), 'checksum', false, 'pathPrefix', cast(null as string))"
    op = "named_struct('name', {name}, 'command', {command}, 'share', {share}, 'includes', array('/all'), 'excludes', array('x'), 'timeout', 1, 'authentification', {auth}, 'username', 'u', 'password', 'p')"
    shares = f"array({share.format(n='p_brand')}, {share.format(n='p_name')})"
    none = "cast(null as string)"
    tasks = f"array({op.format(name=chr(39) + 'ExecuteCommand' + chr(39), command='p_type', share=f'filter({shares}, x -> false)', auth='false')}, {op.format(name='if(p_partkey % 2 = 0, ' + chr(39) + 'RSyncBackup' + chr(39) + ', ' + chr(39) + 'RSyncdBackup' + chr(39) + ')', command=none, share=shares, auth='p_partkey % 2 = 1')})"
    last = f"filter(array({op.format(name=chr(39) + 'ExecuteCommand' + chr(39), command=chr(39) + 'end' + chr(39), share=f'filter({shares}, x -> false)', auth='false')}), x -> p_partkey % 3 = 0)"
    return _t(spark, sf_dir, "part").selectExpr("cast(p_partkey as string) as host", f"named_struct('tasks', {tasks}, 'finalizeTasks', {last}) as operations", "p_partkey % 2 = 0 as isLocal")


@bound("""
with p as (select *, [p_type, p_brand, p_name] as names from part),
s as (
  select p_partkey, 0 as ord, 'storage' as context, 'Create the destination directory' as description, true as failable, false as progress from p
  union all select p_partkey, 1, p_type, 'Execute command ' || p_type, true, false from p
  union all select p_partkey, 2, p_brand, 'Execute backup for share ' || p_brand, true, true from p
  union all select p_partkey, 3, p_name, 'Execute backup for share ' || p_name, true, true from p
  union all select p_partkey, 4, 'end', 'Execute command end', false, false from p where p_partkey % 3 = 0
  union all select p_partkey, 5, 'storage', 'Mark as readonly', true, false from p)
select cast(p_partkey as varchar) as host, cast(row_number() over (partition by p_partkey order by ord) - 1 as int) as pos, context, description, failable, progress from s""")
def b31_subtasks(spark, sf_dir):
    return t.subtasks(_configs(spark, sf_dir))


@bound("""
with d as (select o_orderdate as d, count(*) as n, max(o_orderkey) as k from orders group by o_orderdate),
l as (select d from d order by d desc limit 1)
select cast(o_custkey as varchar) as host, sum({c}) as refr, count(*) as excl, sum({c}) as total from orders where o_orderdate = (select d from l) group by o_custkey""".replace("{c}", _C).replace(f"sum({_C})", f"cast(sum({_C}) as bigint)"))
def b32_current_repartition(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").groupBy("o_orderdate", "o_custkey").agg(F.sum(F.expr(_cents("o_totalprice"))).alias("refr"), F.count("*").alias("excl"))
    volumes = F.collect_list(F.expr("struct(cast(o_custkey as string) as host, -1L as number, refr, excl)"))
    quotas = rows.groupBy("o_orderdate").agg(volumes.alias("volumes")).select(F.unix_date(F.to_date("o_orderdate")).alias("pos"), "volumes")
    return q.current_repartition(quotas)


@bound("""
with l as (select o_custkey, max(o_orderkey) as number, arg_max(o_orderstatus = 'F', o_orderkey) as complete from orders group by o_custkey)
select cast(c_custkey as varchar) as host, number as last, case when complete then number + 1 else coalesce(number, 0) end as next, case when complete then number end as previous from customer left join l on o_custkey = c_custkey""")
def b33_last_and_next(spark, sf_dir):
    hosts, backups = _hosts(spark, sf_dir), _backups(spark, sf_dir)
    following = b.next_numbers(hosts, backups).selectExpr("host", "number as next", "previousNumber as previous")
    return b.with_last(hosts, backups).selectExpr("host", "lastBackup.number as last").join(following, "host")


@bound("select cast(c_custkey as varchar) as host, s_name as config from customer left join supplier on s_suppkey = c_custkey")
def b34_with_config(spark, sf_dir):
    configs = _t(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as string) as host", "s_name as config")
    return b.with_config(_hosts(spark, sf_dir), configs).select("host", "config")


@bound("""
with s as (select user_id, bool_or(event_type in ('view', 'signup')) as o, bool_or(event_type = 'error') as f from events group by user_id)
select user_id, not o and not f as complete from s""")
def b36_complete(spark, sf_dir):
    state = "case event_type when 'signup' then 'WAITING' when 'error' then 'FAILED' when 'view' then 'RUNNING' else 'SUCCESS' end"
    rows = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.expr(f"struct({state} as state)")).alias("s"))
    return rows.select("user_id", states.complete(F.col("s")).alias("complete"))


@bound("select '0/' || (l_orderkey % 500) as id, arg_max(l_orderkey, row(l_orderkey, l_linenumber)) as refr, cast(arg_max(l_linenumber, row(l_orderkey, l_linenumber)) as bigint) as excl from lineitem where l_orderkey * 8 + l_linenumber >= 2 group by 1")
def b37_quota_report(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey * 8 + l_linenumber as bigint) as line_no", "concat(' 0/', l_orderkey % 500, '   ', l_orderkey, ' ', l_linenumber, ' ') as line")
    return reports.quotas(lines)


@bound("select o_orderkey as id, case when o_orderkey % 3 = 0 then 'h' || o_custkey else cast(o_custkey as varchar) end as host, case when o_orderkey % 3 = 0 then null else o_orderkey % 100 end as number from orders where o_orderkey >= 2")
def b38_subvolume_report(spark, sf_dir):
    lines = _t(spark, sf_dir, "orders").selectExpr("o_orderkey as line_no", "concat_ws(' ', o_orderkey, 'gen', 'top', if(o_orderkey % 3 = 0, concat('h', o_custkey), concat('@backups/', o_custkey, '/', o_orderkey % 100))) as line")
    return reports.subvolumes(lines)


@bound("select user_id as report, lower(event_type) as kind, cast(arg_max(event_id, event_id) as bigint) as disk, cast(2 * arg_max(event_id, event_id) as bigint) as plain from events where event_id >= 2 group by 1, 2")
def b39_compression_report(spark, sf_dir):
    lines = _t(spark, sf_dir, "events").selectExpr("user_id as report", "event_id as line_no", "concat_ws('  ', upper(event_type), '50%', event_id, 2 * event_id) as line")
    return reports.compression(lines, "report").select("report", F.explode("diskUsageStatistics").alias("kind", "v")).selectExpr("report", "kind", "v.diskUsage as disk", "v.uncompressed as plain")


_ENDED = 4


@bound(f"""
with e as (select event_id, user_id, {_JOB_STATE} as state from events)
select event_id as id, user_id as host, 'cancelled' as what from e where event_id <> {_ENDED} and state <> 'active' and user_id = (select user_id from e where event_id = {_ENDED})
union all select event_id, user_id, 'left' from e where event_id = {_ENDED} or state = 'active' or user_id <> (select user_id from e where event_id = {_ENDED})
union all select event_id, user_id, 'pending' from e where state <> 'completed'
union all select event_id, user_id, 'removable' from e""")
def b40_job_sets(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    rows = lambda df, what: df.select("id", F.col("data.host").cast("bigint").alias("host"), F.lit(what).alias("what"))
    pending = j.pending_data(jobs).select(F.col("number").alias("id"), F.col("host").cast("bigint").alias("host"), F.lit("pending").alias("what"))
    return rows(j.cancelled_by(jobs, _ENDED), "cancelled").unionByName(rows(j.without_cancelled(jobs, _ENDED), "left")).unionByName(pending).unionByName(rows(j.removable(jobs), "removable"))


@bound(f"select cast(o_custkey as varchar) as host, o_orderkey as number, part, case part when 'new' then {_C} else o_orderkey end as size from orders, (select unnest(['existing', 'new']) as part)")
def b41_size_split(spark, sf_dir):
    return b.size_split(_backups(spark, sf_dir).selectExpr("*", "number as existingFileSize", "fileSize as newFileSize"))


_UNIT = "case when n >= 1073741824 then 3 when n >= 1048576 then 2 when n >= 1024 then 1 else 0 end"


@bound(f"""
with s as (select o_orderkey, {_C} * (o_orderkey % 50) as n from orders), u as (select *, {_UNIT} as k, cast(power(1024, {_UNIT}) as bigint) as d from s),
h as (select *, (n * 200 + d) // (2 * d) as h from u)
select o_orderkey, case when n = 0 then '0 B' else regexp_replace((h // 100) || '.' || lpad(cast(h % 100 as varchar), 2, '0'), '\\.?0+$', '') || ' ' || ['B', 'KB', 'MB', 'GB'][k + 1] end as shown from h""")
def b42_file_size(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", numbers.file_size(F.expr(f"{_cents('o_totalprice')} * (o_orderkey % 50)")).alias("shown"))


@bound("""
select o_orderkey, ((o_orderkey * 1000000 * 200 + 86400000) // 172800000 // 100) || '.' || lpad(cast((o_orderkey * 1000000 * 200 + 86400000) // 172800000 % 100 as varchar), 2, '0') as days,
  printf('%.2f %%', o_orderkey / 4.0) as percent, format('{:,}', o_orderkey * 1000) as grouped, o_orderkey || ' / ' || o_custkey || ' files' as progress from orders""")
def b43_shown_numbers(spark, sf_dir):
    o = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select("o_orderkey", numbers.age_days(o * 1000000).alias("days"), numbers.percent_text(o / 4.0).alias("percent"), numbers.number_text(o * 1000).alias("grouped"), text.progress_text(o, F.col("o_custkey")).alias("progress"))


_EXTS = ["html", "tsx", "yaml", "md", "pdf", "png", "ods", "doc", "zip", "exe"]


@bound("select p_partkey, case p_partkey % 10 when 0 then 'mdi-language-html5' when 1 then 'mdi-nodejs' when 2 then 'mdi-json' when 3 then 'mdi-markdown' when 4 then 'mdi-file-pdf' when 5 then 'mdi-file-image' when 6 then 'mdi-file-excel' when 7 then 'mdi-file-word' when 8 then 'mdi-zip-box' else 'mdi-file-document-outline' end as icon from part")
def b44_icons(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", text.icon(ext).alias("icon"))


@bound(f"""
with e as (select event_id, {_JOB_STATE} as s from events)
select event_id, case s when 'waiting' then 'blue' when 'active' then 'blue' when 'failed' then 'red' when 'completed' then 'green' else 'yellow' end as host,
  case s when 'active' then 'primary' when 'completed' then 'green' when 'failed' then 'red' else 'yellow' end as jobs, s = 'active' as running, s = 'failed' as failed,
  case s when 'active' then 'progress' else 'mdi-alert-circle-outline' end as step from e""")
def b45_state_display(spark, sf_dir):
    s = F.col("state")
    return _jobs(spark, sf_dir).select(F.col("id").alias("event_id"), states.state_colour(s).alias("host"), states.job_colour(s).alias("jobs"), states.running(s).alias("running"), states.failed(s).alias("failed"), states.subtask_icon(F.lit("RUNNING"), s).alias("step"))


@bound("""
with o as (select o_orderkey, cast(o_custkey as varchar) as host, case when o_orderkey % 4 = 0 then 'notes' else strftime(o_orderdate, '%Y-%m-%d') || ' 1:2:3' end as name, epoch_us(o_orderdate) // 1000 + 3723000 as ms from orders)
select host, list_sort(list(ms || ' ' || host || '/' || name)) as backups from o join customer on c_custkey % 2 = 0 and host = cast(c_custkey as varchar) where name <> 'notes' group by host""")
def b46_foreign_backups(spark, sf_dir):
    entries = _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("host"), F.expr("if(o_orderkey % 4 = 0, 'notes', concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' 1:2:3'))").alias("name"), F.lit(None).cast("string").alias("target"))
    found = files.foreign_backups(entries, _hosts(spark, sf_dir).filter("pos % 2 = 0"))
    return found.select("host", F.sort_array(F.transform("backups", lambda x: F.concat_ws(" ", x["date"].cast("string"), x["path"]))).alias("backups"))


@bound("select s_suppkey, n between 1 and 3 and s_suppkey >= 0 as prefix, s_suppkey * 3 between 0 and 255 as bound from (select s_suppkey, 3 - cast(s_suppkey % 5 = 0 as int) * 3 as n from supplier)")
def b47_address_checks(spark, sf_dir):
    prefix = F.expr("concat('10.', s_suppkey % 100, if(s_suppkey % 5 = 0, '', '.7'))")
    return _t(spark, sf_dir, "supplier").select("s_suppkey", numbers.valid_prefix(prefix).alias("prefix"), numbers.valid_bound(F.col("s_suppkey") * 3).alias("bound"))


@bound("select event_id, strftime(ts, '%Y-%m-%d') || ' [' || rpad(event_type, 25, ' ') || '] info: ' || user_id as line, strftime(ts, '%Y-%m-%d') || ' warn: ' || event_type as own from events")
def b48_log_format(spark, sf_dir):
    day = F.date_format("ts", "yyyy-MM-dd")
    return _t(spark, sf_dir, "events").select("event_id", text.log_line(day, F.lit("info"), F.col("event_type"), F.col("user_id").cast("string")).alias("line"), text.backup_log_line(day, F.lit("warn"), F.col("event_type")).alias("own"))


@bound("select cast(p_partkey as varchar) as host, p_brand as share, ['/' || p_brand, '/a/b', '/all'] as includes, ['*.tmp', 'x'] as excludes from part union all select cast(p_partkey as varchar), p_name, ['/' || p_brand, '/a/b', '/all'], ['*.tmp', 'x'] from part")
def b49_copy_rules(spark, sf_dir):
    return t.copy_rules(_configs(spark, sf_dir))


@bound("select p_partkey, ['/' || p_brand, '/' || p_brand || '/' || p_size, '/a', '/a/b'] as inc, ['x', '/*', '/' || p_brand || '/*', '/a/*'] as exc from part")
def b50_include_rules(spark, sf_dir):
    inc, exc = text.include_rules(F.expr("array(concat('/', p_brand, '//', p_size, '/'), 'a/b')"), F.array(F.lit("x")))
    return _t(spark, sf_dir, "part").select("p_partkey", inc.alias("inc"), exc.alias("exc"))


@bound("select event_id, case (event_id * 4096) & 61440 when 24576 then 'BLOCK_DEVICE' when 8192 then 'CHARACTER_DEVICE' when 16384 then 'DIRECTORY' when 4096 then 'FIFO' when 32768 then 'REGULAR_FILE' when 49152 then 'SOCKET' when 40960 then 'SYMBOLIC_LINK' else 'UNKNOWN' end as kind from events")
def b51_file_type(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", text.file_type(F.expr("event_id * 4096")).alias("kind"))


@bound("select p_partkey, 'part ' || p_brand || ' of ' || p_type || ' ${ other } ' || p_brand as text from part")
def b52_rendered(spark, sf_dir):
    values = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type.name"), F.col("p_type"))
    return _t(spark, sf_dir, "part").select("p_partkey", templates.render(F.lit("part ${brand} of ${ type.name } ${ other } ${brand}"), values).alias("text"))


@bound("""
with c as (select p_partkey, p_brand as b, p_type as t, p_name as c from part)
select b || ' -v /h/' || t as text, 'command' as kind, p_partkey from c union all select '/h/' || t, 'path', p_partkey from c""")
def b53_commands(spark, sf_dir):
    m = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    tools = _t(spark, sf_dir, "part").select(m(tool=F.col("p_brand"), kind=F.col("p_type"), key=F.col("p_partkey").cast("string")).alias("tools"), F.create_map(F.concat(F.lit("run "), F.col("p_partkey").cast("string")), F.lit("${tool} -v ${path}")).alias("command"), F.create_map(F.lit("path"), F.lit("${root}/${kind}")).alias("paths"), "p_partkey")
    made = templates.commands(tools.drop("p_partkey").withColumn("paths", F.map_concat("paths", F.create_map(F.concat(F.lit("of "), F.element_at("tools", "key")), F.lit("${root}/${kind}")))), {"root": "/none"}, {"root": "/h"})
    return made.filter("name <> 'path'").selectExpr("text", "kind", "cast(substring_index(name, ' ', -1) as bigint) as p_partkey")


_VOLUMES = "array(struct('a' as host, 1L as number, o_orderkey as refr, o_custkey as excl), struct('b' as host, -1L as number, o_custkey as refr, 2L as excl), struct('b' as host, cast(null as bigint) as number, 5L as refr, 6L as excl))"


@bound("select o_orderkey, [o_orderkey + o_custkey, 11] as volumes, [11] as of_b, [o_custkey] as hosts from orders")
def b54_volumes(spark, sf_dir):
    total = lambda c: F.transform(c, lambda v: v["total"])
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.expr(_VOLUMES).alias("v"))
    return rows.select("o_orderkey", total(q.volumes_of(F.col("v"))).alias("volumes"), total(q.volumes_of(F.col("v"), "b")).alias("of_b"), total(q.hosts_of(F.col("v"), "")).alias("hosts"))


@bound(f"""
with l as (select o_custkey, max(o_orderkey) as k, arg_max(o_orderstatus = 'F', o_orderkey) as complete, arg_max(epoch_us(o_orderdate) // 1000, o_orderkey) as d, arg_max({_C}, o_orderkey) as size from orders group by o_custkey),
s as (select user_id, arg_max({_JOB_STATE}, row(epoch_us(ts) // 1000, event_id)) as state from events group by user_id)
select cast(c_custkey as varchar) as host, k as "lastBackupNumber", {NOW_MS} - d as "lastBackupAge", size as "lastBackupSize", coalesce(state, case when not complete then 'failed' when complete then 'idle' end) as state
from customer left join l on o_custkey = c_custkey left join s on user_id = c_custkey""")
def b55_host_rows(spark, sf_dir):
    return b.host_rows(_hosts(spark, sf_dir), _backups(spark, sf_dir), j.latest_state(_jobs(spark, sf_dir)), NOW_MS)


@bound("select p_partkey, case when p_partkey <> 0 then 100.0 * p_size / p_partkey end as used, 'DIRECTORY' as kind, '/root/' || p_partkey || '/' || p_size as dest, '/root/' || p_partkey || '/logs/backup.' || p_size || '.error.log' as log, '/api/hosts/' || p_partkey || '/backups/' || p_size || '/log/xferLog.error' as url, 'zip' as action, p_brand || '.zip' as file from part")
def b56_paths(spark, sf_dir):
    host = F.col("p_partkey").cast("string")
    action, name = files.download_action(F.lit(True), F.lit(None).cast("string"), F.col("p_brand"))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", numbers.used_percent(F.col("p_size"), F.col("p_partkey")).alias("used"), text.file_type(F.lit(16895)).alias("kind"), files.destination(F.lit("/root"), host, F.col("p_size")).alias("dest"),
        files.log_file(F.lit("/root"), host, F.col("p_size"), errors=True).alias("log"), files.log_url(host, F.col("p_size"), F.lit("error")).alias("url"), action.alias("action"), name.alias("file"),
    )


def _files(spark, sf_dir):
    return _t(spark, sf_dir, "part").selectExpr("concat('h', p_partkey % 3) as host", "1L as backup", "if(p_partkey % 2 = 0, null, 'docs') as sharePath", "if(p_partkey % 4 = 1, '/sub', '/') as path", "concat('p%20', p_partkey, '.txt') as name", "if(p_partkey % 5 = 0, 'DIRECTORY', 'REGULAR_FILE') as type")


@bound("""
with f as (select 'h' || (p_partkey % 3) as host, case when p_partkey % 2 = 0 then null else 'docs' end as s, case when p_partkey % 4 = 1 then '/sub' else '/' end as path, p_partkey as k, p_partkey % 5 = 0 as dir from part)
select 'share' as what, 'p ' || k || '.txt' as name, null as "fullPath", null as ext from f where host = 'h1' and s is null and path = '/'
union all select 'entry', 'p%20' || k || '.txt', '/sub/p%20' || k || '.txt', case when dir then null else 'txt' end from f where host = 'h1' and s = 'docs' and path = '/sub'
union all select 'one', 'p%20' || k || '.txt', null, null from f where host = 'h1' and s = 'docs' and path = '/sub' and k = 13""")
def b57_files(spark, sf_dir):
    rows, none = _files(spark, sf_dir), F.lit(None).cast("string")
    shares = files.shares(rows, "h1", 1).select(F.lit("share").alias("what"), "name", none.alias("fullPath"), none.alias("ext"))
    slashed = rows.withColumn("sharePath", F.concat(F.lit("/"), "sharePath"))
    items = files.tree_items(files.listing(slashed, "h1", 1, "/docs", "/sub"), "/sub", "docs").select(F.lit("entry").alias("what"), "name", "fullPath", F.col("file").alias("ext"))
    one = files.entry(slashed, "h1", 1, "/docs", "/sub/p%2013.txt").select(F.lit("one").alias("what"), "name", none.alias("fullPath"), none.alias("ext"))
    return shares.unionByName(items).unionByName(one)


@bound(f"""
with e as (select event_id, {_JOB_STATE} as s, user_id from events)
select event_id as id, 'live' as state, case when event_id % 2 = 0 then 100.0 * (event_id % 2 + 0.5) else event_id % 100 end as progress from e""")
def b58_live_jobs(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).withColumns({"progress": F.lit(0.0), "name": F.expr("if(id % 2 = 0, 'stats', 'backup')")})
    live = jobs.select("id", F.lit("live").alias("state"), F.expr("if(id % 2 = 0, 0.5D, cast(id % 100 as double))").alias("progress"))
    return j.normal_progress(j.with_live(jobs, live)).select("id", "state", "progress")


@bound(f"select cast(c_custkey as varchar) as host, coalesce({_JOB_STATE} = 'active', false) as locked from customer left join events on event_id = c_custkey * 3 and c_custkey % 2 = 0")
def b59_lock_active(spark, sf_dir):
    locks = _hosts(spark, sf_dir).selectExpr("host", "if(pos % 2 = 0, cast(pos * 3 as bigint), null) as locked_by")
    return j.lock_active(locks, _jobs(spark, sf_dir))


@bound("select 's' || s_suppkey as host, case when s_suppkey % 3 = 0 then null when s_suppkey % 3 = 1 then '1.' || s_suppkey else '2.' || s_suppkey end as ip from supplier")
def b60_names_and_aliases(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    hosts = s.selectExpr("concat('s', s_suppkey) as host", "array(concat('t', s_suppkey), concat('u', s_suppkey)) as addresses")
    resolved = s.selectExpr("concat('s', s_suppkey) as name", "if(s_suppkey % 3 = 1, concat('1.', s_suppkey), null) as ip").unionByName(s.selectExpr("concat('u', s_suppkey) as name", "if(s_suppkey % 3 > 0, concat('2.', s_suppkey), null) as ip"))
    return network.by_names(hosts, resolved)


@bound("select cast(c_custkey as varchar) as host, case when s_suppkey is null then -1 else s_suppkey * 2 end as qgroup_id from customer left join supplier on s_suppkey = c_custkey")
def b61_host_groups(spark, sf_dir):
    return reports.host_groups(_hosts(spark, sf_dir), _t(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as string) as host", "s_suppkey * 2 as qgroup_id")).select("host", "qgroup_id")


@bound("select event_id, event_type in ('click', 'view') as copied, case event_id % 3 when 0 then event_type = 'btrfs' when 1 then event_type <> 'error' else event_type = 'view' end as valid from events")
def b62_checks(spark, sf_dir):
    rows = _t(spark, sf_dir, "events")
    name = F.expr("element_at(array('getFilesystem', 'resolveNetbiosFromIP', 'ping'), cast(event_id % 3 + 1 as int))")
    code = F.expr("case event_type when 'view' then 0 when 'error' then 127 else 1 end")
    table = rows.select(F.col("event_id").alias("pos"), name.alias("name"), F.lit("x").alias("command"), F.col("event_type").alias("output"), code.alias("code"), F.lit("").alias("error"), F.expr("case event_type when 'view' then 0 when 'click' then 24 else 1 end").alias("copy"))
    judged = checks.judged(table).select(F.col("pos").alias("event_id"), F.col("isValid").alias("valid"))
    return judged.join(table.select(F.col("pos").alias("event_id"), states.copy_succeeded(F.col("copy")).alias("copied")), "event_id")


@bound(f"""
with m as (select o_orderkey as number, row_number() over (order by o_orderkey) as i, count(*) over () as n from orders where o_custkey = 7)
select number, i / n as progress from m""")
def b63_stats_progress(spark, sf_dir):
    return b.stats_progress(_backups(spark, sf_dir), "7")


@bound("select o_orderkey as number, case when o_orderkey % 2 = 0 then 1 else cast(round(o_totalprice * 100) as bigint) end as disk from orders")
def b64_with_usage(spark, sf_dir):
    have = _backups(spark, sf_dir)
    usage = have.filter("number % 2 = 0").selectExpr("host", "number", "map('total', struct(1L as diskUsage, 2L as uncompressed)) as diskUsageStatistics")
    return b.with_usage(have, usage).select("number", F.col("diskUsageStatistics")["total"]["diskUsage"].alias("disk"))


@bound(f"""
select o_orderkey as number, o_orderstatus = 'F' as complete, coalesce(case when o_orderkey % 2 = 0 then 1000 end, o_orderkey) as start,
  case when o_orderstatus = 'F' then 5000000 + case when o_orderkey % 2 = 0 then 1000 - o_orderkey else 0 end end as "end", o_custkey as files, o_custkey - 1 as existing, {_C} / (5000000 - o_orderkey) as speed from orders where o_orderkey <> 5000000""")
def b65_backup_of_task(spark, sf_dir):
    step = f"array(named_struct('state', if(o_orderstatus = 'F', 'SUCCESS', 'FAILED'), 'progress', true, 'progression', named_struct('fileSize', o_orderkey, 'newFileSize', {_cents('o_totalprice')}, 'newFileCount', 1L, 'fileCount', o_custkey, 'speed', 0.0D, 'percent', 100.0D)))"
    tasks = _t(spark, sf_dir, "orders").filter("o_orderkey <> 5000000").selectExpr("cast(o_custkey as string) as host", "o_orderkey as number", "o_orderkey as startDate", "if(o_orderkey % 2 = 0, 1000L, null) as originalStartDate", "5000000L as now", f"{step} as subtasks")
    return b.from_task(tasks).selectExpr("number", "complete", "startDate as start", "endDate as end", "fileCount as files", "existingFileCount as existing", "speed")


@bound("select cast(o_custkey as varchar) as host, min(o_orderkey) as id, o_orderkey % 3 as number from orders group by o_custkey, o_orderkey % 3 union all select 'none', null, 1")
def b66_subvolume_ids(spark, sf_dir):
    subvolumes = _t(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "cast(o_custkey as string) as host", "o_orderkey % 3 as number", "o_orderkey as place")
    wanted = subvolumes.select("host", "number").distinct().unionByName(spark.sql("select 'none' as host, 1L as number"))
    return b.subvolume_ids(wanted, subvolumes)


@bound("select o_orderkey as number, '7' as hostname, 'all' as what from orders where o_custkey = 7 union all (select o_orderkey, '7', 'one' from orders where o_custkey = 7 order by o_orderkey limit 1)")
def b67_backups_of_host(spark, sf_dir):
    have = _backups(spark, sf_dir)
    first = have.filter("host = '7'").agg(F.min("number")).first()[0]  # an argument of the lookup
    rows = lambda df, what: df.select("number", F.lit("7").alias("hostname"), F.lit(what).alias("what"))
    return rows(b.of_host(have, "7"), "all").unionByName(rows(b.by_number(have, "7", first or 0), "one"))


@bound("select p_partkey, case p_partkey % 3 when 0 then 'ExecuteCommandOperation' when 1 then 'RSyncdBackupOperation' else 'RSyncBackupOperation' end as kind from part")
def b68_operation_kind(spark, sf_dir):
    op = F.expr("named_struct('command', if(p_partkey % 3 = 0, p_type, ''), 'authentification', p_partkey % 3 = 1, 'share', if(p_partkey % 3 = 0, null, array(p_brand)))")
    return _t(spark, sf_dir, "part").select("p_partkey", states.operation_kind(op).alias("kind"))


@bound("select cast(p_partkey as varchar) as host, 1 as n_tasks, 'RSyncBackup' as name, '/import' as prefix, true as local from part")
def b69_imported_config(spark, sf_dir):
    made = t.imported_config(_configs(spark, sf_dir), "/import")
    return made.select("host", F.size("operations.tasks").alias("n_tasks"), F.expr("operations.tasks[0].name").alias("name"), F.expr("operations.tasks[0].share[1].pathPrefix").alias("prefix"), F.col("isLocal").alias("local"))


@bound("select 's' || s_suppkey as host, case when s_suppkey % 2 = 0 then '10.1.0.' || (s_suppkey % 200) else '10.2.0.9' end as ip from supplier")
def b70_netbios_address(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    line = lambda k, x: s.selectExpr("concat('s', s_suppkey) as host", f"{k} as line_no", f"{x} as line")
    lines = line(0, "concat('querying s', s_suppkey, ' on 10.1.0.255')").unionByName(line(1, "concat('10.2.0.9 s', s_suppkey, '<00>')"))
    return network.netbios_address(lines.unionByName(line(2, "concat(if(s_suppkey % 2 = 0, concat('10.1.0.', s_suppkey % 200), '10.3.0.1'), ' s', s_suppkey, '<00>')")))


@bound("select '1.' || s_suppkey as ip, 'pc' || s_suppkey as hostname, case when s_suppkey % 2 = 0 then 'user' || s_suppkey else '' end as username from supplier")
def b71_netbios_names(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    line = lambda k, x: s.selectExpr("concat('1.', s_suppkey) as ip", f"{k} as line_no", f"{x} as line")
    lines = line(0, "concat('WORK <00> - <GROUP> B <ACTIVE>')").unionByName(line(1, "concat(' PC', s_suppkey, '  <00> -   B <ACTIVE>')"))
    return network.netbios_names(lines.unionByName(line(2, "if(s_suppkey % 2 = 0, concat('USER', s_suppkey, ' <03> -  B <ACTIVE>'), 'x')")))


@bound("select cast(c_custkey as varchar) as host, 100 + row_number() over (order by cast(c_custkey as varchar)) - 1 as id, 'waiting' as state from customer")
def b72_enqueued(spark, sf_dir):
    return j.enqueued(_hosts(spark, sf_dir), "backup", 100, NOW_MS).selectExpr("data.host as host", "id", "state")


@bound("select p_partkey, p_partkey % 3 = 0 and p_partkey % 4 <> 0 as formed from part where p_partkey % 3 = 0 and p_partkey % 4 <> 0")
def b73_well_formed(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").selectExpr("p_partkey", "if(p_partkey % 3 = 0, p_partkey, null) as number", "if(p_partkey % 2 = 0, '', '1.2.3.4') as ip", "named_struct('isLocal', p_partkey % 4 = 2) as config")
    return t.well_formed(rows).select("p_partkey", F.lit(True).alias("formed"))


@bound("select p_partkey, p_brand as tool, 'd' as other from part")
def b74_overridden(spark, sf_dir):
    default = F.create_map(F.lit("tool"), F.lit("d"), F.lit("other"), F.lit("d"))
    return _t(spark, sf_dir, "part").select("p_partkey", templates.overridden(default, F.create_map(F.lit("tool"), F.col("p_brand"))).alias("m")).selectExpr("p_partkey", "m['tool'] as tool", "m['other'] as other")


@bound("select c_custkey as key, 'ext4' as fstype, c_custkey * 1024 as size, 2048 as used, 3072 as free, 5 as timestamp from customer where c_custkey = 9")
def b75_space(spark, sf_dir):
    lines = _t(spark, sf_dir, "customer").filter("c_custkey = 9").selectExpr("explode(array(struct(0 as line_no, 'Filesystem Type 1K-blocks' as line), struct(1 as line_no, concat('/dev/sda ext4 ', c_custkey, ' 2 3 40% /') as line))) as l").select("l.*")
    return q.current_space(reports.space(lines), 5).selectExpr("size div 1024 as key", "fstype", "size", "used", "free", "timestamp")
