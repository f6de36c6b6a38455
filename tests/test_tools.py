"""Tools: arguments, filters over odd rows, pages, and process trees."""

from datetime import UTC, datetime, timedelta

import pytest

from emberlog.operators import tools
from emberlog.operators.tools import ToolError

AT = datetime(2024, 5, 1, tzinfo=UTC)
WHEN = {"host": "web-1", "start_time": "2024-05-01T00:00:00Z", "end_time": "2024-05-01T01:00:00+00:00"}
LD = "struct<method:string,path:string,status:bigint,event:string,result:string,user:string,key:string,syscall:string,exe:string,comm:string,session_type:string,serial:bigint,record_types:array<string>,transport_src_ip:string,dest_ip:string,src_port:bigint,dest_port:bigint,proto:string,event_type:string>"
FIELDS = [f.split(":")[0] for f in LD[7:-1].split(",")]


def row(n, layer, machine="web-1", src_ip=None, pid=None, ppid=None, **ld):
    return (AT + timedelta(seconds=n) if n is not None else None, layer, f"{layer}:{n}", machine, src_ip, pid, ppid, tuple(ld.get(f) for f in FIELDS))


@pytest.fixture(scope="module")
def view(spark):
    rows = [
        row(1, "web", src_ip="10.0.0.9", method="GET", path="/a?x=1", status=200), row(2, "web", src_ip="10.0.0.1", method="post", path="/login", status=401), row(3, "web", method="POST", path=None), row(4, "web", "web-2", method="POST", path="/login"),
        row(5, "web", None, method="POST"), row(7200, "web", method="POST"), row(6, "auth", event="ssh_failed", result="failure", user="x' OR '1'='1"),
        row(10, "system", pid=30, ppid=20, comm="sh", key="Exec", session_type="interactive", record_types=["SYSCALL", "USER_CMD"]), row(11, "system", pid=20, ppid=10, comm="php"), row(12, "system", pid=10, ppid=0, comm="init", record_types=["EXECVE"]),
        row(13, "system", pid=20, ppid=99, comm="reused"), row(14, "system", pid=30, ppid=20, comm="bash"), row(15, "system", pid=41, ppid=42), row(16, "system", pid=42, ppid=41), row(17, "system", "web-2", pid=99, ppid=0),
        row(20, "network", transport_src_ip="10.0.0.1", dest_ip="9.9.9.9", proto="tcp", event_type="alert", dest_port=443), row(21, "network", src_ip="9.9.9.9", dest_ip="10.0.0.9", proto="UDP", event_type="http"),
    ]
    spark.createDataFrame(rows, f"ts timestamp, layer string, raw_ref string, machine string, src_ip string, pid bigint, ppid bigint, ld {LD}").createOrReplaceTempView("tool_rows")
    tools.register(spark, "tool_rows", own_ip="10.0.0.9")
    return "tool_rows"


def refs(spark, name, view, **args):
    return [r["raw_ref"] for r in tools.call(spark, name, WHEN | args, view)[0].collect()]


@pytest.mark.parametrize(
    ("name", "args", "want"),
    [
        ("fetch_web_log", {}, ["web:1", "web:2", "web:3"]), ("fetch_web_log", {"method": "post"}, ["web:2", "web:3"]), ("fetch_web_log", {"path": "log"}, ["web:2"]), ("fetch_web_log", {"exclude_self": True}, ["web:2", "web:3"]), ("fetch_web_log", {"exclude_self": False, "status_code": "200"}, ["web:1"]),
        ("fetch_web_log", {"src_ip": None}, ["web:1", "web:2", "web:3"]), ("fetch_auth_log", {"user": "x' OR '1'='1"}, ["auth:6"]), ("fetch_auth_log", {"user": "' OR 1=1 --"}, []),
        ("fetch_audit_log", {"event_type": "exec"}, ["system:10"]), ("fetch_audit_log", {"event_type": "EXECVE"}, ["system:12"]), ("fetch_audit_log", {"exclude_interactive": True}, []), ("fetch_audit_log", {"include_user_cmd": False, "pid": 30}, ["system:14"]),
        ("fetch_network_log", {"ip": "9.9.9.9"}, ["network:20", "network:21"]), ("fetch_network_log", {"src_ip": "10.0.0.1"}, ["network:20"]), ("fetch_network_log", {"protocol": "udp"}, ["network:21"]), ("fetch_network_log", {"alert_only": True}, ["network:20"]),
    ],
)
def test_filters(spark, view, name, args, want):
    assert refs(spark, name, view, **args) == want


@pytest.mark.parametrize(
    ("name", "args", "code", "names"),
    [
        ("drop_table", {}, "unknown_tool", ("drop_table",)), ("fetch_web_log", {"host": "a"}, "missing", ("end_time", "start_time")), ("fetch_web_log", WHEN | {"port": 1, "and": 2}, "unknown", ("and", "port")), ("fetch_web_log", WHEN | {"src_ip": "example.org"}, "value", ("src_ip",)),
        ("fetch_web_log", WHEN | {"status_code": "many", "limit": 0}, "value", ("limit", "status_code")), ("fetch_web_log", WHEN | {"host": " "}, "value", ("host",)), ("fetch_web_log", WHEN | {"start_time": "noon"}, "value", ("start_time",)),
        ("fetch_web_log", WHEN | {"end_time": "2023-01-01"}, "value", ("end_time", "start_time")), ("fetch_network_log", WHEN | {"alert_only": "yes"}, "value", ("alert_only",)), ("get_process_tree", {"host": "a"}, "missing", ("pid",)), ("get_process_tree", {"host": "a", "pid": None}, "value", ("pid",)),
        ("fetch_event_logs", {"host": "a"}, "value", ("event",)), ("fetch_event_logs", {"host": "a", "window": ["2024-01-01"]}, "value", ("window",)), ("fetch_event_logs", {"host": "a", "window": ["2024-01-01", "2024-01-02"], "layers": ["mail"]}, "value", ("layers",)),
        ("fetch_event_logs", {"host": "a", "window": ["2024-01-01", "2024-01-02"], "filters": {"web": {"user": "x"}}}, "unknown", ("user",)),
    ],
)
def test_arguments_are_checked(spark, view, name, args, code, names):
    with pytest.raises(ToolError) as e:
        tools.call(spark, name, args, view)
    assert (e.value.code, e.value.names) == (code, names)


def test_pages_and_layers(spark, view):
    event = {"timestamp": "2024-05-01T00:00:05Z"}
    rows, about = tools.call(spark, "fetch_event_logs", {"host": "web-1", "event": event, "before_seconds": 3, "after_seconds": 6, "limit": 2, "offset": 1, "filters": {"audit": {"pid": 20}}}, view)
    assert [r["raw_ref"] for r in rows.collect()] == ["web:3", "auth:6"]
    assert about.first().asDict() == {"total": 4, "returned": 2, "has_more": True, "next_offset": 3}
    rows, _ = tools.call(spark, "fetch_event_logs", {"host": "web-1", "event": event | {"layer": "auth"}}, view)
    assert [r["raw_ref"] for r in rows.collect()] == ["auth:6"]


def test_process_tree(spark, view):
    def tree(pid, **args):
        return [(r["raw_ref"], r["stop_reason"], r["status"]) for r in tools.call(spark, "get_process_tree", {"host": "web-1", "pid": pid} | args, view)[0].collect()]

    # the latest record of 30 has the reused 20 as its parent; 99 is another machine's
    assert tree(30, **WHEN) == [("system:14", "parent_not_observed", "partial"), ("system:13", "parent_not_observed", "partial")]
    # 10 was seen only later: its first record stands
    assert tree("30", timestamp="2024-05-01T00:00:12Z") == [(r, "parent_pid_zero", "inferred") for r in ("system:10", "system:11", "system:12")]
    assert [r[:2] for r in tree(41, **WHEN)] == [("system:15", "cycle_detected"), ("system:16", "cycle_detected")]
    assert tree(7, **WHEN) == []


def test_functions_are_part_of_the_plan(spark, view, tmp_path, capsys):
    spark.table(view).write.parquet(str(tmp_path / "rows"))
    spark.read.parquet(str(tmp_path / "rows")).createOrReplaceTempView("tool_files")
    tools.register(spark, "tool_files")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    spark.sql("SELECT raw_ref FROM fetch_web_log(host => 'web-1', start_time => TIMESTAMP '2024-05-01', end_time => TIMESTAMP '2024-05-02', src_ip => '10.0.0.1')").explain()
    plan = capsys.readouterr().out
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(machine,web-1)" in plan and "EqualTo(src_ip,10.0.0.1)" in plan and "GreaterThanOrEqual(ts" in plan and "user_agent" not in plan
    tools.register(spark, view, own_ip="10.0.0.9")
