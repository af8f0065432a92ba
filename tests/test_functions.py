import pytest
from pyspark.sql import functions as F

from vaultlens.functions import cron, numbers, states, templates, text


def values(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_url_components(spark):
    rows = [("a b/c+d~!()'é",), (None,), ("",)]
    assert values(spark, text.mangle(F.col("p")), rows, "p string") == ["a%20b%2Fc%2Bd~!()'%C3%A9", "", ""]
    assert values(spark, text.unmangle(text.mangle(F.col("p"))), rows, "p string") == [rows[0][0], "", ""]
    assert values(spark, text.unmangle(F.col("p")), [("a+b",)], "p string") == ["a+b"]
    assert values(spark, text.try_unmangle(F.col("p")), [("%zz",)], "p string") == [None]


def test_numbers(spark):
    rows = [("12.34", "MB"), ("12abc", "GB"), ("abc", "MB"), ("1,234", "bytes"), ("12.34", "kB")]
    assert values(spark, numbers.parse_int(F.col("v")), rows, "v string, u string") == [12, 12, None, 1, 12]
    assert values(spark, numbers.sized(F.col("v"), F.col("u")), rows, "v string, u string") == [12 * 1024**2, 12 * 1024**3, None, 1234, 12 / 1024]
    assert values(spark, numbers.sized(F.col("v"), F.col("u"), fixed=True), rows[-1:], "v string, u string") == [12 * 1024]
    assert values(spark, numbers.ratio(F.col("a"), F.col("b")), [(1, 2), (1, 0), (0, 0)], "a int, b int") == [0.5, None, None]
    strict = values(spark, numbers.ratio(F.col("a"), F.col("b"), strict=True), [(1, 0), (0, 0), (-1, 0)], "a int, b int")
    assert strict[0] == float("inf") and strict[1] != strict[1] and strict[2] == float("-inf")
    assert values(spark, numbers.or_zero(F.col("x")), [(None,), (float("nan"),), (2.0,)], "x double") == [0, 0, 2]
    assert values(spark, numbers.age_days(F.col("x")), [(129_600_000,)], "x long") == ["1.50"]
    assert values(spark, numbers.number_text(F.col("x")), [(1234567,)], "x long") == ["1,234,567"]
    assert values(spark, numbers.percent_text(F.col("x")), [(12.345,)], "x double") in (["12.35 %"], ["12.34 %"])
    assert values(spark, numbers.file_size(F.col("x")), [(0,), (1,), (1536,), (3 * 1024**3,), (None,)], "x long") == ["0 B", "1 B", "1.5 KB", "3 GB", None]
    assert values(spark, numbers.date_text(F.col("x")), [(0,), (None,)], "x long") == ["01/01/1970 00:00", ""]
    assert values(spark, numbers.valid_prefix(F.col("x")), [("10.0.0",), ("10.0",)], "x string") == [True, False]


def test_text(spark):
    assert values(spark, text.capitalize(F.col("x")), [("heLLO wORLD",), (None,), ("é",)], "x string") == ["HeLLO wORLD", "", "É"]
    assert values(spark, text.extension(F.col("x")), [("a.tar.gz",), ("none",)], "x string") == ["gz", "none"]
    assert values(spark, text.icon(F.col("x")), [("htm",), ("HTM",), (None,), ("zip",)], "x string") == ["mdi-language-html5", "mdi-file-document-outline", "", "mdi-zip-box"]
    assert values(spark, text.octal_mode(F.col("m")), [(16895,), (33206,)], "m int") == ["777", "666"]
    assert values(spark, text.file_type(F.col("m")), [(16895,), (33206,), (0xA1FF,), (0x2000,), (0,)], "m int") == ["DIRECTORY", "REGULAR_FILE", "SYMBOLIC_LINK", "CHARACTER_DEVICE", "UNKNOWN"]
    assert values(spark, text.log_lines(F.col("x")), [(" 5% log: recv\nlog: a\r\n\nb",)], "x string") == [[" 5% ", "log: recv", "log: a", "b"]]
    assert values(spark, text.dated(F.col("x")), [("x2020-1-2 3:4:5y",), ("2020-01-02",)], "x string") == [True, False]
    assert values(spark, text.date_ms(F.col("x")), [("1970-1-1 0:0:1",), ("no",)], "x string") == [1000, None]
    assert values(spark, text.log_line(F.lit("t"), F.lit("info"), F.lit("ctx"), F.col("x")), [("m",)], "x string") == ["t [ctx                      ] info: m"]
    assert values(spark, text.progress_text(F.col("a"), F.col("b")), [(1, 2)], "a int, b int") == ["1 / 2 files"]


def test_include_rules(spark):
    inc, exc = text.include_rules(F.col("i"), F.col("e"))
    df = spark.createDataFrame([(["/home//user/"], None), (["/"], ["x"]), (None, None)], "i array<string>, e array<string>")
    assert [tuple(r) for r in df.select(inc, exc).collect()] == [(["/home", "/home/user"], ["/*", "/home/*"]), (["/"], ["x"]), ([], [])]


def test_states(spark):
    cases = {("WAITING", "WAITING"): "WAITING", ("SUCCESS", "RUNNING"): "RUNNING", ("FAILED", "WAITING"): "ABORTED", ("FAILED", "ABORTED", "SUCCESS"): "FAILED", ("SUCCESS",): "SUCCESS", (): "SUCCESS"}
    rows = [([(s,) for s in k],) for k in cases]
    assert values(spark, states.task_state(F.col("s")), rows, "s array<struct<state: string>>") == list(cases.values())
    assert values(spark, states.copy_succeeded(F.col("c")), [(0,), (24,), (1,), (None,)], "c int") == [True, True, False, True]
    assert values(spark, states.host_state(F.col("a"), F.col("b")), [("active", True), (None, False), (None, True), (None, None)], "a string, b boolean") == ["active", "failed", "idle", None]
    assert values(spark, states.subtask_icon(F.col("a"), F.col("b")), [("RUNNING", "active"), ("RUNNING", "failed")], "a string, b string") == ["progress", "mdi-alert-circle-outline"]
    assert values(spark, states.state_colour(F.col("a")), [("waiting",), ("x",)], "a string") == ["blue", None]
    assert values(spark, states.job_colour(F.col("a")), [("waiting",), ("x",)], "a string") == ["yellow", "secondary"]
    checks = [("getFilesystem", "btrfs\n", 0), ("ping", "", 1), ("resolveNetbiosFromIP", "", 1), ("resolveNetbiosFromIP", "", 127)]
    assert values(spark, states.check_valid(F.col("a"), F.regexp_replace("b", "\n", ""), F.col("c")), checks, "a string, b string, c int") == [True, False, True, False]


def test_templates(spark):
    tools = spark.createDataFrame(
        [({"btrfs": "/bin/btrfs", "df": "/bin/df"}, {"snap": "${btrfs} snapshot -i 1/${qGroupId} ${srcBackupPath} ${destBackupPath}", "odd": "${ unknown } ${ df }"}, {"srcBackupPath": "${hostPath}/${hostname}/${src}", "destBackupPath": "${hostPath}/${hostname}/${dest}"})],
        "tools map<string,string>, command map<string,string>, paths map<string,string>",
    )
    rows = {r.name: r.text for r in templates.commands(tools, {"hostname": "pc-test", "src": "17", "dest": "20", "qGroupId": "2"}, {"hostPath": "hostPath"}).collect()}
    assert rows["snap"] == "/bin/btrfs snapshot -i 1/2 hostPath/pc-test/17 hostPath/pc-test/20"
    assert rows["odd"] == "${ unknown } /bin/df" and rows["srcBackupPath"] == "hostPath/pc-test/17"
    df = spark.createDataFrame([("${a} ${b}", {"a": "c:\\x $1", "b": None})], "t string, v map<string,string>")
    assert df.select(templates.render(F.col("t"), F.col("v"), ["a", "b"])).first()[0] == "c:\\x $1 undefined"


def test_each_map_of_the_commands_is_worked_out_once(spark):
    tools = spark.createDataFrame([({"t": "x"}, {"c": "${t} ${p}"}, {"p": "/${t}"}), (None, {"c": "${t} ${p}"}, None), ({"t": "x"}, None, {"p": "${\tt }"})], "tools map<string,string>, command map<string,string>, paths map<string,string>")
    made = templates.commands(tools, {}, {"t": "y"})
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_concat") == 2 and plan.count("regexp_replace") == 2
    want = [("c", "command", "x /x"), ("p", "path", "/x"), ("c", "command", "y ${p}"), ("p", "path", "x")]
    assert sorted((r.name, r.kind, r.text) for r in made.collect()) == sorted(want)


def test_tokens_with_and_without_spaces(spark):
    df = spark.createDataFrame([("${a}${ a }${a\n}", {"a": "${ a }", "b": "1"}), ("${a}", {"a": "${b} ${ b}", "b": "\\1$0"}), ("a }", {"a": "x"}), (None, {"a": "x"})], "t string, v map<string,string>")
    want = ["${ a }" * 3, "\\1$0 \\1$0", "a }", None]
    assert [r[0] for r in df.select(templates.render(F.col("t"), F.col("v"))).collect()] == want


@pytest.mark.parametrize(
    ("rule", "now", "after", "before"),
    [
        ("0 * * * *", 1_700_000_000_000, 1_700_002_800_000, 1_699_999_200_000),
        ("0 0 * * *", 1_700_000_000_000, 1_700_006_400_000, 1_699_920_000_000),
        ("*/15 8-9 1,15 * *", 1_700_000_000_000, 1_700_035_200_000, 1_698_831_900_000),
        ("0 12 * * 0", 1_700_000_000_000, 1_700_395_200_000, 1_699_790_400_000),
    ],
)
def test_cron(rule, now, after, before):
    assert cron.around(rule, now, True) == after and cron.around(rule, now, False) == before


def test_cron_column(spark):
    df = spark.createDataFrame([("0 * * * *", 1_700_000_000_000), (None, 1)], "r string, n long")
    assert [r[0] for r in df.select(cron.next_run(F.col("r"), F.col("n"))).collect()] == [1_700_002_800_000, None]
