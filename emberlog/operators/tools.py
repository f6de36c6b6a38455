"""Investigation tools as SQL table functions, behind a registry that checks their arguments.

`register()` makes a SQL table function of each log tool over a view of events. Their bodies are plain SELECTs, so Spark puts
them into the calling query and its filters reach the scan:

    SELECT * FROM fetch_web_log(host => 'web-1', start_time => TIMESTAMP '2024-01-01', end_time => TIMESTAMP '2024-01-02', method => 'post')

An argument that is null or left out filters nothing; a row whose field is null passes no filter on it, but for exclude_self,
which takes out the own address alone. `call()` takes arguments by name from outside, as a model gives them: it names a tool, arguments
that are missing, unknown or of a wrong form as a ToolError, fills in the values as SQL parameters, and gives one page and a row
about it. fetch_event_logs goes over several layers, each with its own filters, and get_process_tree follows one process
upwards; the latter reads the chains of all processes of the machine and window, and is a call only.
"""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import lineage
from emberlog.operators.reports import PAGE, page
from emberlog.session import cut

#: Names of tools and arguments, seconds around an event, hours to look back for parents.
AROUND, LOOK_BACK = 300, 24
LAYERS = {"web": "fetch_web_log", "auth": "fetch_auth_log", "audit": "fetch_audit_log", "system": "fetch_audit_log", "network": "fetch_network_log"}
NEEDED = {"host": "STRING", "start_time": "TIMESTAMP", "end_time": "TIMESTAMP"}
PAGING = ("limit", "offset")


class ToolError(ValueError):
    """A call that can't be run: code (unknown_tool, missing, unknown, value) and the names it is about."""

    def __init__(self, code: str, *names: str):
        super().__init__(f"{code}: {', '.join(names)}")
        self.code, self.names = code, names


@dataclass(frozen=True)
class Tool:
    """A tool's arguments with their SQL types; tests: what a filter asks of a row, where {} is the argument."""

    required: dict[str, str]
    tests: dict[str, tuple[str, str]] = field(default_factory=dict)
    layer: str | None = None
    order: tuple[str, ...] = ("ts", "raw_ref")
    optional: tuple[str, ...] = ()

    def allowed(self) -> set[str]:
        return {*self.required, *self.tests, *self.optional, *PAGING}


TOOLS = {
    "fetch_web_log": Tool(NEEDED, {
        "path": ("STRING", "contains(ld.path, {})"), "src_ip": ("STRING", "src_ip = {}"), "method": ("STRING", "upper(ld.method) = upper({})"), "status_code": ("BIGINT", "ld.status = {}"),
        "exclude_self": ("BOOLEAN", "NOT {} OR src_ip IS DISTINCT FROM '<own>'"),
    }, "web"),
    "fetch_auth_log": Tool(NEEDED, {"user": ("STRING", "ld.user = {}"), "src_ip": ("STRING", "src_ip = {}"), "event_type": ("STRING", "ld.event = {}"), "result": ("STRING", "ld.result = {}")}, "auth"),
    "fetch_audit_log": Tool(NEEDED, {
        "event_type": ("STRING", "lower(ld.key) = lower({0}) OR lower(ld.syscall) = lower({0}) OR exists(ld.record_types, t -> lower(t) = lower({0}))"), "pid": ("BIGINT", "pid = {}"), "ppid": ("BIGINT", "ppid = {}"), "user": ("STRING", "ld.user = {}"),
        "serial": ("BIGINT", "ld.serial = {}"), "exclude_interactive": ("BOOLEAN", "NOT {} OR ld.session_type = 'non_interactive'"), "include_user_cmd": ("BOOLEAN", "{} OR NOT coalesce(array_contains(ld.record_types, 'USER_CMD'), FALSE)"),
    }, "system", ("ts", "ld.serial", "raw_ref")),
    "fetch_network_log": Tool(NEEDED, {
        "ip": ("STRING", "src_ip = {0} OR ld.transport_src_ip = {0} OR ld.dest_ip = {0}"), "src_ip": ("STRING", "src_ip = {0} OR ld.transport_src_ip = {0}"), "dst_ip": ("STRING", "ld.dest_ip = {}"), "src_port": ("BIGINT", "ld.src_port = {}"),
        "dst_port": ("BIGINT", "ld.dest_port = {}"), "protocol": ("STRING", "upper(ld.proto) = upper({})"), "alert_only": ("BOOLEAN", "NOT {} OR ld.event_type = 'alert'"),
    }, "network"),
    "fetch_event_logs": Tool({"host": "STRING"}, order=("ts", "layer", "raw_ref"), optional=("event", "window", "layers", "filters", "before_seconds", "after_seconds")),
    "get_process_tree": Tool({"host": "STRING", "pid": "BIGINT"}, order=("depth",), optional=("timestamp", "start_time", "end_time")),
}
ADDRESSES = ("ip", "src_ip", "dst_ip")


def register(spark: SparkSession, view: str = "events", own_ip: str | None = None) -> None:
    """Temporary SQL table functions of the log tools over a view of events (ts, layer, raw_ref, machine, src_ip, pid, ppid, ld)."""
    own = str(ipaddress.ip_address(own_ip)) if own_ip else ""
    columns = spark.table(view).schema.toDDL().replace(" NOT NULL", "")
    for name, tool in TOOLS.items():
        if tool.layer is None:
            continue
        given = [f"{a} {t}" for a, t in tool.required.items()] + [f"{a} {t} DEFAULT NULL" for a, (t, _) in tool.tests.items()]
        tests = [f"({name}.{a} IS NULL OR {test.format(f'{name}.{a}').replace('<own>', own)})" for a, (_, test) in tool.tests.items()]
        where = " AND ".join([f"layer = '{tool.layer}'", f"machine = {name}.host", f"ts >= {name}.start_time", f"ts <= {name}.end_time", *tests])
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(given)}) RETURNS TABLE ({columns}) RETURN SELECT * FROM {view} WHERE {where}")
    given = ", ".join(f"{a} {t}" for a, t in NEEDED.items())
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION fetch_event_logs({given}, layers ARRAY<STRING> DEFAULT NULL) RETURNS TABLE ({columns}) RETURN SELECT * FROM {view} WHERE machine = fetch_event_logs.host AND ts >= fetch_event_logs.start_time"
        " AND ts <= fetch_event_logs.end_time AND (fetch_event_logs.layers IS NULL OR array_contains(transform(fetch_event_logs.layers, l -> CASE WHEN l = 'audit' THEN 'system' ELSE l END), layer))"
    )


def checked(name: str, args: dict) -> Tool:
    """The tool, if the arguments are its own, all there and of the right form."""
    if name not in TOOLS:
        raise ToolError("unknown_tool", name)
    tool = TOOLS[name]
    if missing := sorted(a for a in tool.required if a not in args):
        raise ToolError("missing", *missing)
    if unknown := sorted(set(args) - tool.allowed()):
        raise ToolError("unknown", *unknown)
    types = tool.required | {a: t for a, (t, _) in tool.tests.items()}
    wrong = [a for a, t in types.items() if args.get(a) is not None and not fits(a, t, args[a])]
    wrong += [a for a in tool.required if args[a] is None or (a == "host" and not str(args[a]).strip())]
    wrong += [a for a, least in (("limit", 1), ("offset", 0), ("before_seconds", 0), ("after_seconds", 0)) if a in args and not (type(args[a]) is int and args[a] >= least)]
    if not wrong and "start_time" in args and "end_time" in args and moment(args["start_time"]) > moment(args["end_time"]):
        wrong = ["start_time", "end_time"]
    if wrong:
        raise ToolError("value", *sorted(set(wrong)))
    return tool


def fits(name: str, kind: str, value: object) -> bool:
    try:
        if kind == "TIMESTAMP":
            moment(value)
        elif name in ADDRESSES:
            ipaddress.ip_address(value)
        elif kind == "BIGINT":
            return not isinstance(value, bool) and -(2**63) <= int(value) < 2**63
    except (ValueError, TypeError):
        return False
    return kind in ("TIMESTAMP", "BIGINT") or isinstance(value, bool if kind == "BOOLEAN" else str)


def moment(value: str | datetime) -> datetime:
    """A time, in UTC where it names no zone."""
    t = value if isinstance(value, datetime) else datetime.fromisoformat(value)
    return t if t.tzinfo else t.replace(tzinfo=UTC)


def rows_of(spark: SparkSession, name: str, args: dict) -> DataFrame:
    """All rows of a log tool; values go in as parameters, never as text."""
    tool, given = TOOLS[name], {a: v for a, v in args.items() if a not in PAGING and v is not None}
    types = tool.required | {a: t for a, (t, _) in tool.tests.items()}
    values = {a: moment(v) if types[a] == "TIMESTAMP" else int(v) if types[a] == "BIGINT" else v for a, v in given.items()}
    return spark.sql(f"SELECT * FROM {name}({', '.join(f'{a} => :{a}' for a in values)})", args=values)


def window(args: dict) -> tuple[datetime, datetime]:
    """The stated window, else the event's, else seconds before and after the event's time."""
    event = args.get("event") or {}
    if not isinstance(event, dict):
        raise ToolError("value", "event")
    stated = args.get("window", event.get("window"))
    try:
        if stated is not None:
            start, end = (moment(t) for t in stated)
        else:
            at = moment(event.get("timestamp") or event.get("trigger_time"))
            start, end = at - timedelta(seconds=args.get("before_seconds", AROUND)), at + timedelta(seconds=args.get("after_seconds", AROUND))
    except (TypeError, ValueError):
        raise ToolError("value", "window" if stated is not None else "event") from None
    if start > end:
        raise ToolError("value", "window")
    return start, end


def event_rows(spark: SparkSession, args: dict) -> DataFrame:
    start, end = window(args)
    layers = args.get("layers") or ([args["event"]["layer"]] if (args.get("event") or {}).get("layer") else ["web", "auth", "audit", "network"])
    if not isinstance(layers, list) or any(l not in LAYERS for l in layers):
        raise ToolError("value", "layers")
    names, filters = list(dict.fromkeys(LAYERS[l] for l in layers)), args.get("filters") or {}
    if not isinstance(filters, dict) or any(l not in LAYERS or LAYERS[l] not in names or not isinstance(f, dict) for l, f in filters.items()):
        raise ToolError("value", "filters")
    own = {LAYERS[l]: f for l, f in filters.items()}
    calls = {n: {"host": args["host"], "start_time": start, "end_time": end} | own.get(n, {}) for n in names}
    for n, f in own.items():
        if paging := sorted({*PAGING, *NEEDED} & {*f}):
            raise ToolError("unknown", *paging)
        checked(n, calls[n])
    return reduce(DataFrame.unionByName, (rows_of(spark, n, a) for n, a in calls.items()))


def process_tree(events: DataFrame, host: str, pid: int, start: datetime, end: datetime) -> DataFrame:
    """(depth, raw_ref, pid, ppid, ts, exe, comm, user, stop_reason, status): from the latest record of a process up to its last known parent."""
    seen = events.where((F.col("layer") == "system") & (F.col("machine") == host) & (F.col("ts") >= start) & (F.col("ts") <= end) & F.col("pid").isNotNull())
    records = cut(seen.select("raw_ref", F.col("machine").alias("host"), "pid", "ppid", "ts", F.unix_micros("ts").alias("at"), "ld.exe", "ld.comm", "ld.user"), "records")
    leaf = records.where(F.col("pid") == pid).agg(F.max(F.struct("at", "raw_ref"))["raw_ref"].alias("raw_ref"))
    chain = lineage.process_chains(records.select("raw_ref", "host", "pid", "ppid", "at")).join(leaf, "raw_ref", "left_semi")
    nodes = chain.select(F.posexplode("chain").alias("depth", "raw_ref"), "stop_reason")
    return nodes.join(records, "raw_ref").select(F.col("depth").cast("long").alias("depth"), "raw_ref", "pid", "ppid", "ts", "exe", "comm", "user", "stop_reason", lineage.lineage_status(F.col("stop_reason")).alias("status"))


def call(spark: SparkSession, name: str, args: dict, view: str = "events") -> tuple[DataFrame, DataFrame]:
    """One page of a tool's rows and one row (total, returned, has_more, next_offset) about it, after register()."""
    tool = checked(name, args)
    if tool.layer:
        rows = rows_of(spark, name, args)
    elif name == "fetch_event_logs":
        rows = event_rows(spark, args)
    else:
        if "start_time" in args and "end_time" in args:
            times = args["start_time"], args["end_time"]
        else:
            times = (args.get("timestamp") or datetime.now(UTC),) * 2
        try:
            start, end = (moment(t) for t in times)
        except (TypeError, ValueError):
            raise ToolError("value", "start_time" if "start_time" in args else "timestamp") from None
        rows = process_tree(spark.table(view), args["host"], int(args["pid"]), start if "start_time" in args and "end_time" in args else start - timedelta(hours=LOOK_BACK), end)
    return page(rows, *tool.order, limit=args.get("limit", PAGE), offset=args.get("offset", 0))
