from pyspark.sql import functions as F

from vaultlens import schemas
from vaultlens.operators import backups as b, checks, files, jobs as j, network, quotas as q, tasks as t
from vaultlens.plans import dashboard, schedule
from vaultlens.sources import changes, reports

QUOTA = "qgroupid rfer excl\n-------- ---- ----\n0/257 100 10\n0/258 200 20\n0/999 7 7\n1/42 250 30\n"
SUBVOLUMES = "ID gen toplevel path\n-- --- -------- ----\n257 9 5 hosts/pc-a/0\n258 9 5 hosts/pc-a/1\n260 9 5 hosts/pc-b/0\n261 9 5 single\n"
SPACE = "Filesystem Type 1K-blocks Used Available Use% Mounted on\n/dev/sdb1 btrfs 1000 600 400 60% /b\n"
COMPRESSION = "Processed 3 files, 2 regular extents\nType Perc Disk Usage Uncompressed Referenced\nTOTAL 50% 500 1000 1000\nnone 100% 200 200 200\nzstd 37% 300 800 800\n"


def lines(spark, text):
    return reports.lines_of(spark.createDataFrame([(text,)], "value string"))


def hosts(spark, *names):
    return spark.createDataFrame(list(enumerate(names)), "pos int, host string")


def backups(spark, rows):
    """(host, pos, number, start, disk, uncompressed, complete)"""
    made = [(h, p, n, s, None if d is None else {"total": (d, u)}, c) for h, p, n, s, d, u, c in rows]
    return spark.createDataFrame(made, "host string, pos int, number long, startDate long, diskUsageStatistics map<string, struct<diskUsage: long, uncompressed: long>>, complete boolean")


ROWS = [("pc-a", 0, 0, 10, 5, 10, True), ("pc-a", 1, 1, 30, None, None, False), ("pc-b", 0, 0, 10, 7, 20, True)]


def test_reports(spark):
    assert reports.space(lines(spark, SPACE)).collect() == [("btrfs", 1024000, 614400, 409600)]
    assert {tuple(r) for r in reports.quotas(lines(spark, QUOTA + "0/257 1 2\n")).collect()} == {("0/257", 1, 2), ("0/258", 200, 20), ("0/999", 7, 7), ("1/42", 250, 30)}
    assert {tuple(r) for r in reports.subvolumes(lines(spark, SUBVOLUMES)).collect()} == {(257, "pc-a", 0), (258, "pc-a", 1), (260, "pc-b", 0), (261, "single", None)}
    found = reports.compression(lines(spark, COMPRESSION)).first()[0]
    assert {k: tuple(v) for k, v in found.items()} == {"total": (500, 1000), "none": (200, 200), "zstd": (300, 800)}


def test_snapshot_and_totals(spark):
    h, groups = hosts(spark, "pc-a", "pc-b"), spark.createDataFrame([("pc-a", 42)], "host string, qgroup_id long")
    sizes = q.volume_sizes(reports.subvolumes(lines(spark, SUBVOLUMES)), h, groups, reports.quotas(lines(spark, QUOTA)))
    row = q.snapshot(sizes, reports.space(lines(spark, SPACE)), 5)
    volumes = [tuple(v) for v in row.first().volumes]
    assert volumes == [("pc-a", 0, 100, 10), ("pc-a", 1, 200, 20), ("pc-b", 0, None, None), ("single", None, None, None), ("pc-a", -1, 250, 30)]
    series = q.appended(spark.createDataFrame([], schemas.QUOTAS), row)
    assert q.totals(series).collect() == [(0, 5, 614370, 30, 330)]
    strict = q.totals(series, strict=True).first()
    assert strict.excl != strict.excl and strict.total != strict.total
    assert q.current_repartition(series).collect() == [("pc-a", 250, 30, 250)]
    seen = series.select(F.transform(q.volumes_of(F.col("volumes"), "pc-a"), lambda v: v["total"])).first()[0]
    assert seen == [110, 220]
    assert series.select(F.size(q.volumes_of(F.col("volumes"), "")), F.size(q.hosts_of(F.col("volumes"), "pc-b"))).first() == (4, 0)
    empty = series.withColumn("volumes", F.slice("volumes", 1, 0))
    assert q.totals(empty).collect() == [(0, 5, 614400, 0, 0)]


def test_running_sum_and_last(spark):
    h, have = hosts(spark, "pc-a", "pc-b"), backups(spark, ROWS)
    found = b.compression_history(h, have, chunk_ms=15).orderBy("timestamp", "host_pos", "pos").collect()
    assert [(r.timestamp, r.diskUsage, r.uncompressed) for r in found] == [(10, 5, 10), (10, 12, 30), (30, 12, 30)]
    assert {(r.host, r.number) for r in b.last_of_each(have).collect()} == {("pc-a", 1), ("pc-b", 0)}
    numbers = {r.host: (r.number, r.previousNumber) for r in b.next_numbers(hosts(spark, "pc-a", "pc-b", "new"), have).collect()}
    assert numbers == {"pc-a": (1, None), "pc-b": (1, 0), "new": (0, None)}
    assert b.with_last(hosts(spark, "new"), have).first().lastBackup is None
    assert [r.number for r in b.flattened(h, have).collect()] == [0, 1, 0]


def test_mutations(spark):
    have = backups(spark, ROWS)
    new = backups(spark, [("pc-a", 0, 0, 11, 1, 1, True), ("pc-a", 0, 9, 40, 1, 1, True), ("pc-c", 0, 0, 1, 1, 1, True)]).drop("pos")
    merged = b.upserted(have, new)
    assert sorted((r.host, r.pos, r.number, r.startDate) for r in merged.collect()) == [("pc-a", 0, 0, 11), ("pc-a", 1, 1, 30), ("pc-a", 2, 9, 40), ("pc-b", 0, 0, 10), ("pc-c", 0, 0, 1)]
    twice = have.unionByName(backups(spark, [("pc-a", 2, 0, 50, 1, 1, True)]))
    left = b.removed(twice, spark.createDataFrame([("pc-a", 0)], "host string, number long"))
    assert sorted((r.host, r.pos) for r in left.collect()) == [("pc-a", 1), ("pc-a", 2), ("pc-b", 0)]
    assert changes.with_host(hosts(spark, "a"), "b").count() == 2 and changes.with_host(hosts(spark, "a"), "a").count() == 1
    assert [r.progress for r in b.stats_progress(have, "pc-a").orderBy("progress").collect()] == [0.5, 1.0]


SUB = schemas.SUBTASK


def test_tasks(spark):
    steps = [("s", "", "SUCCESS", True, True, (10, 1, 2, 3, 0.0, 100.0)), ("s", "", "SUCCESS", True, True, (10, 1, 2, 3, 5.0, 50.0)), ("s", "", "SUCCESS", True, True, (None, None, None, None, 0.0, 0.0)), ("x", "", "SUCCESS", True, False, None)]
    df = spark.createDataFrame([("h", 3, 100, None, steps, 1100), ("h", 4, 100, 50, [], 1100)], f"host string, number long, startDate long, originalStartDate long, subtasks array<{SUB}>, now long")
    found = df.select(t.progression(F.col("subtasks")).alias("p")).collect()
    assert tuple(found[0].p) == (20, 2, 4, 6, 5.0, 50.0) and found[1].p.percent is None
    records = {r.number: r for r in b.from_task(df).collect()}
    assert (records[3].fileCount, records[3].existingFileCount, records[3].endDate, records[3].speed) == (6, 2, 1100, 2 / 1000)
    assert (records[4].startDate, records[4].endDate) == (50, 1050)
    outcome = [("a", "SUCCESS", True), ("b", "FAILED", True), ("c", "SUCCESS", True), ("d", "SUCCESS", False), ("e", "SUCCESS", True)]
    one = spark.createDataFrame([([(c, "", s, f, False, None) for c, s, f in outcome],)], f"subtasks array<{SUB}>")
    assert one.select(t.propagated(F.col("subtasks"))).first()[0] == ["SUCCESS", "FAILED", "ABORTED", "SUCCESS", "ABORTED"]


def test_steps_of_a_configuration(spark):
    op = lambda name, command=None, share=None: (name, command, share, ["op"], None, None, None, None, None)
    share = lambda n: (n, ["sh"], None, None, None)
    ops = ([op("ExecuteCommand", "pre.sh"), op("RSyncdBackup", share=[share("/home"), share("/etc")])], [op("ExecuteCommand", "post.sh")])
    df = spark.createDataFrame([("h", False, ops)], f"host string, isLocal boolean, operations struct<tasks: array<{schemas.OPERATION}>, finalizeTasks: array<{schemas.OPERATION}>>")
    assert [(r.pos, r.context, r.failable, r.progress) for r in t.subtasks(df).orderBy("pos").collect()] == [
        (0, "storage", True, False), (1, "pre.sh", True, False), (2, "/home", True, True), (3, "/etc", True, True), (4, "post.sh", False, False), (5, "storage", True, False),
    ]
    assert t.copy_rules(df).collect()[0][1:3] == ("/home", ["sh", "op"])
    imported = t.imported_config(df, "/old").first()
    assert imported.isLocal and imported.operations.finalizeTasks == [] and [o.name for o in imported.operations.tasks] == ["RSyncBackup"]
    assert imported.operations.tasks[0].share[0].pathPrefix == "/old"


def jobs(spark, rows):
    return spark.createDataFrame([(i, n, s, ts, (h, 1)) for i, n, s, ts, h in rows], "id long, name string, state string, timestamp long, data struct<host: string, number: long>")


JOBS = [(1, "backup", "waiting", 10, "a"), (2, "backup", "completed", 20, "b"), (3, "stats", "failed", 30, "b"), (4, "remove_backup", "waiting", 5, "b"), (5, "backup", "active", 6, "c"), (6, "backup", "delayed", 7, "b")]


def test_jobs(spark):
    have = jobs(spark, JOBS)
    assert tuple(j.counts(have).first()) == (2, 1, 1, 1, 1)
    assert {r.host: r.state for r in j.latest_state(have).collect()} == {"a": "waiting", "b": "failed", "c": "active"}
    assert [r.host for r in j.to_enqueue(hosts(spark, "a", "b", "d", "d"), jobs(spark, JOBS[:3])).collect()] in (["b", "d"], ["d", "b"])
    assert sorted(r.id for r in j.cancelled_by(have, 2).collect()) == [3, 6]
    assert j.without_cancelled(have, 2).count() == 4 and j.in_states(have).count() == 6 and j.pending_data(have).count() == 5
    assert {r.host: r.locked for r in j.lock_active(spark.createDataFrame([("a", 1), ("c", 5), ("d", None)], "host string, locked_by long"), have).collect()} == {"a": False, "c": True, "d": False}
    assert tuple(dashboard.queue(have, 1_700_000_000_000).first())[5:] == (1_699_999_200_000, 1_700_002_800_000)


def test_due(spark):
    day = 86_400_000
    have = backups(spark, [("old", 0, 0, 0, 1, 1, True), ("new", 0, 0, 10 * day, 1, 1, True), ("bad", 0, 0, 10 * day, 1, 1, False)])
    configs = spark.createDataFrame([("old", None), ("off", (False, None, None)), ("new", (None, 60, None))], f"host string, schedule {schemas.SCHEDULE}")
    found = schedule.due_hosts(hosts(spark, "old", "new", "bad", "none", "off"), configs, have, jobs(spark, []), 10 * day + 30_000)
    assert sorted(r.host for r in found.collect()) == ["bad", "none", "old"]


def test_files(spark):
    rows = [("h", 1, None, "/", "%2Fhome", "DIRECTORY"), ("h", 1, "/home", "/", "user", "DIRECTORY"), ("h", 1, "/home", "/user", "a.txt", "REGULAR_FILE")]
    df = spark.createDataFrame(rows, "host string, backup long, sharePath string, path string, name string, type string")
    assert [r.name for r in files.shares(df, "h", 1).collect()] == ["/home"]
    assert [r.name for r in files.listing(df, "h", 1, "/home").collect()] == ["user"]
    assert [r.type for r in files.entry(df, "h", 1, "/home", "/user/a.txt").collect()] == ["REGULAR_FILE"]
    item = files.tree_items(files.listing(df, "h", 1, "/home", "/user"), "/user", "/home").first()
    assert (item.path, item.fullPath, item.file, item.children) == ("/user/a.txt", "/user/a.txt", "txt", None)
    try:
        files.listing(df, "h", 1, "/home", "user")
        raise AssertionError
    except ValueError as e:
        assert str(e) == "Only absolute path can be used to serach for directory"
    action = spark.createDataFrame([(False, None), (False, "application/zip"), (True, None)], "d boolean, c string").select(*files.download_action(F.col("d"), F.col("c"), F.lit("p")))
    assert [tuple(r) for r in action.collect()] == [("download", "p"), ("zip", "p.zip"), ("zip", "p.zip")]
    entries = spark.createDataFrame([("h", "2020-01-02 00:00:00", None), ("h", "2020-01-03 00:00:00", "0"), ("h", "x", None), ("zz", "2020-01-02 00:00:00", None)], "host string, name string, target string")
    (found,) = files.foreign_backups(entries, hosts(spark, "h")).collect()
    assert [tuple(s) for s in found.backups] == [(1577923200000, "h/2020-01-02 00:00:00"), (1578009600000, "h/0")]
    assert files.foreign_backups(entries, hosts(spark, "h"), start_ms=1578009600001).count() == 0


def test_network(spark):
    ranges = spark.createDataFrame([("pc", 0, "10.0.0", 5, 9), ("pc", 1, "10.0.1", 1, 3)], "host string, pos int, address string, start int, end int")
    names = spark.createDataFrame([("10.0.1.2", "pc"), ("10.0.0.7", "PC"), ("10.0.0.9", "pc"), ("10.0.0.5", "other")], "ip string, hostname string")
    assert network.in_ranges(ranges, names).collect() == [("pc", "10.0.0.7")]
    aliases = spark.createDataFrame([("a", ["x", "y"]), ("b", None)], "host string, addresses array<string>")
    assert {r.host: r.ip for r in network.by_names(aliases, spark.createDataFrame([("a", None), ("y", "2"), ("x", "1")], "name string, ip string")).collect()} == {"a": "1", "b": None}
    report = ["querying pc on 10.0.0.255", "192.168.0.1 pc<00>", "10.0.0.4 pc<00>", "10.0.0.5 pc<00>"]
    df = spark.createDataFrame([("pc", k, x) for k, x in enumerate(report)], "host string, line_no int, line string")
    assert network.netbios_address(df).collect() == [("pc", "10.0.0.4")]
    assert network.netbios_address(df.filter("line_no in (1, 3)")).collect() == [("pc", "192.168.0.1")]
    entries = ["  PC-ONE  <00> -         B <ACTIVE>", "  WORK    <00> - <GROUP> B <ACTIVE>", "  JANE    <03> -         B <ACTIVE>", "  JOHN    <03> -         B <ACTIVE>"]
    assert network.netbios_names(spark.createDataFrame([("1", k, x) for k, x in enumerate(entries)], "ip string, line_no int, line string")).collect() == [("1", "pc-one", "john")]


def test_checks(spark):
    df = spark.createDataFrame([(0, "getFilesystem", "stat", "btrfs", 0, ""), (1, "ping", "ping", "", 0, "")], "pos int, name string, command string, output string, code int, error string")
    assert checks.all_valid(df).first()[0] is True and [r.isValid for r in checks.judged(df).collect()] == [True, True]
