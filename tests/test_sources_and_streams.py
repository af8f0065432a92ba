import time

import pytest
from pyspark.sql import functions as F

from vaultlens.sources import catalogue, logs
from vaultlens.streaming import progress, queue

OUTPUT = "  1,234  45%  12.34MB/s 0:00:10 (xfr#3, to-chk=7/10)\nlog: recv >f\nNumber of files: 1,234 (reg: 3)\nTotal file size: 9,000 bytes\n"


def parsed(spark, text=OUTPUT, fixed=False):
    chunks = spark.createDataFrame([("t", text)], "task string, value string")
    return progress.parsed(progress.lines(chunks, "task").withColumnRenamed("part", "seq"), fixed)


def test_progress_of_recorded_output(spark):
    rows = parsed(spark)
    assert [r.line for r in rows.filter("kept").orderBy("seq").collect()] == OUTPUT.split("\n")[1:4]
    (first,) = progress.batch(rows).collect()
    assert (first.newFileCount, first.fileCount, first.newFileSize, first.percent, first.speed) == (3, 10, 1234, 45.0, 12 * 1024**2)
    (last,) = progress.final(rows).collect()
    assert (last.fileCount, last.fileSize, last.newFileSize, last.newFileCount) == (1234, 9000, 1234, 3)
    odd = OUTPUT.split("\n")[0].replace("12.34MB", "12.34kB")
    assert progress.batch(parsed(spark, odd)).first().speed == 12 / 1024
    assert progress.batch(parsed(spark, odd, fixed=True)).first().speed == 12 * 1024


def test_progress_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(OUTPUT)
    text = spark.readStream.text(str(tmp_path / "in")).select(F.lit("t").alias("task"), "value")
    rows = progress.parsed(text.select("task", F.lit(0).cast("long").alias("seq"), F.col("value").alias("line")))
    query = progress.stream(rows).writeStream.format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    (row,) = spark.table("progress").collect()
    assert (row.percent, row.speed) == (45.0, 12 * 1024**2)


def test_ended_tasks_are_forgotten(spark, tmp_path):
    source = tmp_path / "in"
    line = OUTPUT.split("\n")[0]
    schema = "task string, seq long, line string, ended boolean"
    for rows in ([("t", 0, line, False), ("u", 0, line, True)], [("t", 1, "Number of files: 5 (reg: 5)", False), ("t", 2, line.replace("45%", "50%"), False), ("u", 1, "(xfr#9, to-chk=1/20)", False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = progress.stream(progress.parsed(lines)).writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    found = {(r.task, r.seq): (r.newFileCount, r.percent) for r in spark.table("ended").collect()}
    assert found == {("t", 0): (3, 45.0), ("t", 2): (3, 50.0), ("u", 0): (3, 45.0), ("u", 1): (9, None)}


def test_sampled(spark):
    df = spark.createDataFrame([("t", 0, 1, 10.0), ("t", 4, 2, 20.0), ("t", 6, 3, 30.0)], "task string, s long, seq long, percent double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    assert [(r.seq, r.percent) for r in progress.sampled(df).orderBy("seq").collect()] == [(2, 20.0), (3, 30.0)]


def test_topics_and_view(spark):
    schema = "seq long, id long, event string, state string"
    events = spark.createDataFrame([(1, 1, "waiting", "waiting"), (2, 2, "failed", "failed")], schema)
    assert sorted((r.id, r.topic, r.state) for r in queue.topics(events).collect()) == [(1, "jobWaiting", None), (2, "jobFailed", "failed"), (2, "jobUpdated", "failed")]
    now = spark.createDataFrame([(1, "active"), (2, "active")], "id long, state string")
    updates = spark.createDataFrame([(1, 1, "completed", "completed"), (2, 3, "active", "active"), (3, 2, "removed", "active"), (4, 2, "active", "active"), (5, 4, "waiting", "waiting")], schema)
    assert sorted(r.id for r in queue.view(now, updates, ("active",)).collect()) == [2, 3]
    assert sorted(r.id for r in queue.view(now, updates).collect()) == [1, 2, 3, 4]


def test_view_kept_by_a_stream(spark, tmp_path):
    state = {"rows": spark.createDataFrame([], "id long, state string")}
    source = tmp_path / "events"
    spark.createDataFrame([(1, 7, "active", "active")], "seq long, id long, event string, state string").write.parquet(str(source))
    updates = spark.readStream.schema("seq long, id long, event string, state string").parquet(str(source))

    def save(df):
        state["rows"] = spark.createDataFrame(df.collect(), "id long, state string")

    query = queue.maintained(updates, lambda: state["rows"], save, str(tmp_path / "c"), ("active",))
    query.processAllAvailable()
    query.stop()
    assert [r.id for r in state["rows"].collect()] == [7]


def test_throttled(spark, tmp_path):
    got = []
    rows = spark.readStream.format("rate").option("rowsPerSecond", 20).load().select(F.lit("t").alias("task"), F.col("value").alias("seq"))
    query = progress.throttled(rows, lambda df, _: got.extend(r.seq for r in df.collect()), str(tmp_path / "c"), every="1 seconds")
    end = time.time() + 60
    while len(got) < 2 and time.time() < end:
        time.sleep(0.5)
    query.stop()
    assert len(got) >= 2 and got == sorted(got)


def test_yaml_catalogue(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "hosts.yml").write_text("- no\n- pc-a\n")
    (tmp_path / "pc-a.yml").write_text("isLocal: true\noperations:\n  tasks:\n    - name: ExecuteCommand\n      command: x\nschedule:\n  activated: false\n")
    (tmp_path / "pc-a").mkdir()
    (tmp_path / "pc-a" / "backup.yml").write_text("- number: 0\n  complete: true\n  startDate: 2020-01-01T00:00:00Z\n- number: 1\n  complete: no\n  startDate: 5\n")
    (tmp_path / "statistics.yml").write_text("quotas:\n  - timestamp: 5\n    volumes: [{host: pc-a, number: 0, refr: 1}]\n    space: {fstype: btrfs, size: 3, used: 2, free: 1}\n")
    (tmp_path / "tools.yml").write_text("tools: {df: /bin/df, ssh: /usr/bin/ssh}\ncommand: {a: x}\npaths: {p: y}\n")
    (tmp_path / "over.yml").write_text("tools: {ssh: /opt/ssh}\n")
    root = str(tmp_path)
    assert [tuple(r) for r in catalogue.hosts(spark, root).orderBy("pos").collect()] == [(0, "no"), (1, "pc-a")]
    config = catalogue.host_config(spark, root, "pc-a").first()
    assert config.isLocal and config.operations.tasks[0].command == "x" and config.schedule.activated is False
    with pytest.raises(LookupError):
        catalogue.host_config(spark, root, "other")
    rows = [(r.host, r.pos, r.number, r.complete, r.startDate) for r in catalogue.backups(spark, root).orderBy("pos").collect()]
    assert rows == [("pc-a", 0, 0, True, 1577836800000), ("pc-a", 1, 1, None, 5)]
    snap = catalogue.statistics(spark, root).first()
    assert (snap.pos, snap.volumes[0].excl, snap.space.free) == (0, None, 1)
    assert catalogue.scheduler(spark, root).first().wakeupSchedule == "0 * * * *"
    merged = catalogue.tools(spark, f"{root}/tools.yml", f"{root}/over.yml").first()
    assert merged.tools == {"df": "/bin/df", "ssh": "/opt/ssh"} and merged.command == {"a": "x"}


def test_logs(spark, tmp_path):
    df = spark.createDataFrame([("info", "ctx", "hello"), ("error", "ctx", "bad")], "level string, context string, message string").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    logs.write(df, str(tmp_path / "app"))
    logs.write_backup(df, str(tmp_path / "b"))
    assert logs.read(spark, str(tmp_path / "app" / "day=1970-01-01")).count() == 2
    assert [r.value for r in logs.read(spark, str(tmp_path / "b" / "error.log")).collect()] == ["1970-01-01 00:00:00 error: bad"]
