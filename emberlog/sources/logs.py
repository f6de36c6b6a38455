"""Log readers: web access, auth syslog, audit bundles and network sensor records as one events table.

events: ts, layer, raw_ref (file:line), machine, src_ip, pid, ppid, ld (struct). The machine is that of the syslog header or
of an audit record's node, else the one named to the reader, else null. Lines that do not parse are left out.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions.net import canonical_ip, canonical_ips, dash_null, key_values, path_and_query, unhex_text, utc
from emberlog.sources.auth import TOLD, classified, pam_values

#: Fields of ld and their types.
FIELDS = {
    "method": "string", "path": "string", "status": "bigint", "bytes": "bigint", "duration_us": "bigint", "user_agent": "string", "referer": "string", "host": "string",
    "program": "string", "event": "string", "result": "string", "user": "string", "target_user": "string", "auth_method": "string", "src_user": "string", "src_uid": "bigint", "group": "string", "gid": "bigint", "changed_attr": "string", "old_value": "string", "new_value": "string", "key_type": "string", "key_fingerprint": "string", "pam_service": "string", "reason": "string", "shell": "string", "command": "string", "tty": "string", "repeat": "bigint", "port": "bigint", "uid": "bigint", "euid": "bigint", "auid": "bigint", "ses": "bigint",
    "syscall": "string", "key": "string", "exe": "string", "comm": "string", "cwd": "string", "exec_args": "string", "success": "string", "session_type": "string", "proctitle": "string", "paths": "array<struct<name:string,nametype:string,item:bigint>>", "serial": "bigint", "record_types": "array<string>", "raw_lines": "array<bigint>",
    "event_type": "string", "flow_id": "string", "tx_id": "string", "sensor_id": "string", "transport_src_ip": "string", "src_port": "bigint", "dest_ip": "string", "dest_port": "bigint", "proto": "string", "xff_status": "string",
    "signature": "string", "signature_id": "string", "severity": "string", "category": "string", "action": "string",
}
#: A quoted field. Possessive, so that a long one makes Java go no deeper.
_QUOTED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
WEB = rf'^(\S+) (\S+) (\S+) (\S+) (\S+) (\S+) {_QUOTED} (\d{{3}}|-) (\d+|-) (\d+|-) (\d+|-) {_QUOTED} {_QUOTED}(?: xff={_QUOTED})?\s*$'
AUTH_RFC = r"^(\d{4}-\d\d-\d\dT\S+) (\S+) ([^\s:\[]+)(?:\[(\d+)\])?: (.*)$"
AUTH_BSD = r"^([A-Z][a-z]{2}) +(\d+) (\d\d:\d\d:\d\d) (\S+) ([^\s:\[]+)(?:\[(\d+)\])?: (.*)$"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
UNSET_ID = 4294967295

#: Numbers of system calls on x86_64 (fixed values).
SYSCALLS = {"2": "open", "42": "connect", "59": "execve", "82": "rename", "87": "unlink", "257": "openat", "263": "unlinkat", "322": "execveat"}
NETWORK = "timestamp string, event_type string, flow_id string, tx_id string, in_iface string, host string, src_ip string, src_port bigint, dest_ip string, dest_port bigint, proto string, xff string, http struct<hostname:string,url:string,http_method:string,status:bigint,http_user_agent:string,xff:string>, alert struct<signature:string,signature_id:string,category:string,severity:string,action:string>"


def lines(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """(file, line_no, line) of a log and its rotated siblings (path.1, path.2.gz, path-20240501), not modified before `since`.

    Plain files are read in splits. Lines are numbered inside each split, and the lines of the splits before it are added
    from a table of one row a split; both scans read the same splits. A gz file is one split. Lines end at line feeds
    only; a trailing carriage return goes. A log that is not there has no lines.
    """
    reader = spark.read.option("lineSep", "\n")
    try:
        raw = (reader.option("modifiedAfter", since) if since else reader).text(f"{path}{{,.[0-9]*,-[0-9]*}}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, line_no bigint, line string")
    raw = raw.where(F.col("_metadata.file_name").rlike(r"^[^/]*?" + re.escape(path.rsplit("/", 1)[-1]) + r"(?:\.\d{1,4}|-\d{8})?(?:\.gz)?$"))  # not x.log.1.bak
    raw = raw.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.regexp_replace("_metadata.file_name", r"\.gz$", "").alias("file"), "value", F.monotonically_increasing_id().alias("_id"))
    splits = raw.groupBy(F.col("_path").alias("_p"), F.col("_block").alias("_b")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_p").orderBy("_b")) - F.col("_n")
    splits = splits.withColumn("_before", before)
    numbered = raw.join(splits, (F.col("_path") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    return numbered.select("file", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("line")).where("line <> ''")


def as_events(rows: DataFrame, layer: str) -> DataFrame:
    have = set(rows.columns)
    col = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
    ref = F.concat_ws(":", "file", "line_no").alias("raw_ref")
    return rows.select("ts", F.lit(layer).alias("layer"), ref, col("machine", "string"), col("src_ip", "string"), col("pid", "bigint"), col("ppid", "bigint"), F.struct(*(col(c, t) for c, t in FIELDS.items())).alias("ld")).where("ts is not null")


def _on(rows: DataFrame, machine: str | None) -> DataFrame:
    return rows.withColumn("machine", F.lit(machine).cast("string"))


def web_events(src: DataFrame, machine: str | None = None) -> DataFrame:
    # the pattern is asked once for all its groups: the ten without white space, then the quoted ones, whose quotes end them
    plain, quoted = ("time", "request_id", "client", "peer", "scheme", "host", "status", "bytes", "duration_us", "worker"), ("request", "referer", "user_agent", "xff")
    groups = F.split(F.regexp_replace("line", WEB, '$1 $2 $3 $4 $5 $6 $8 $9 $10 $11 "$7""$12""$13""$14"'), " ", len(plain) + 1)
    rows = src.where(F.col("line").rlike(WEB)).select("file", "line_no", F.substring_index("line", " ", 1).alias("time"), groups.alias("_p"))
    rows = rows.withColumn("_q", F.regexp_extract_all(F.get("_p", F.lit(len(plain))), F.lit(_QUOTED), F.lit(1)))
    part = {k: F.get(c, F.lit(i)) for c, names in (("_p", plain), ("_q", quoted)) for i, k in enumerate(names)} 
    rows = rows.select("file", "line_no", "time", *(dash_null(c).alias(k) for k, c in part.items() if k != "time"))
    rows = rows.withColumns({"ts": utc(F.col("time")), "src_ip": canonical_ip(F.col("client")), "method": F.upper(F.get(F.split("request", " "), F.lit(0))), "path": path_and_query(F.get(F.split("request", " "), F.lit(1)))})
    return as_events(_on(rows, machine), "web")


def auth_events(src: DataFrame, year: int, month: int = 12) -> DataFrame:
    """Syslog lines; headers without a year get `year`, those of months more than six after `month` the year before."""
    l = F.col("line")
    rfc = l.rlike(AUTH_RFC)
    m = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(l, AUTH_BSD, 1))
    y = F.when(m - month > 6, year - 1).when(m - month < -6, year + 1).otherwise(year)
    bsd = F.concat(y, F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(F.regexp_extract(l, AUTH_BSD, 2), 2, "0"), F.lit("T"), F.regexp_extract(l, AUTH_BSD, 3), F.lit("Z"))
    # each pattern is asked once for all its groups: only the message may hold blanks, and nothing behind it stays
    end = r"[\n\r\u0085\u2028\u2029]*"
    groups = F.when(rfc, F.regexp_replace(l, AUTH_RFC + end, "$2 $3 $4 $5")).otherwise(F.regexp_replace(l, AUTH_BSD + end, "$4 $5 $6 $7"))
    rows = src.where(rfc | l.rlike(AUTH_BSD)).select("file", "line_no", F.when(rfc, utc(F.substring_index(l, " ", 1))).otherwise(utc(bsd)).alias("ts"), F.split(groups, " ", 4).alias("_p"))
    rows = rows.select("file", "line_no", "ts", *(F.get("_p", F.lit(i)).alias(c) for i, c in ((0, "host"), (1, "program"))), F.nullif(F.get("_p", F.lit(2)), F.lit("")).alias("pid"), F.get("_p", F.lit(3)).alias("msg"))
    again = r"^message repeated (\d+) times: \[ ?(.*)\]$"
    rows = rows.withColumns({"repeat": F.regexp_extract("msg", again, 1).try_cast("bigint"), "msg": F.when(F.col("msg").rlike(again), F.regexp_extract("msg", again, 2)).otherwise(F.col("msg"))})
    rows = rows.withColumn("_kv", pam_values(F.col("msg"))).withColumn("c", classified(F.col("program"), F.col("msg"), F.col("_kv")))
    told = (F.col(f"c.{c}").alias(c) for c in ("event", "result", *TOLD) if c != "repeat")
    rows = rows.select("file", "line_no", "ts", "host", "program", "pid", F.coalesce("repeat", F.col("c.repeat").try_cast("bigint")).alias("repeat"), *told).withColumn("src_ip", canonical_ip(F.col("address")))
    rows = rows.withColumns({c: F.col(c).try_cast("bigint") for c in ("port", "uid", "gid", "src_uid")})
    rows = rows.withColumn("session_type", F.when(F.col("tty").rlike("^(?:/dev/)?(?:pts|tty)"), "interactive").when(F.col("tty").isNotNull(), "non_interactive"))
    return as_events(rows.withColumn("machine", F.col("host")), "auth")


def audit_events(src: DataFrame, machine: str | None = None) -> DataFrame:
    """Records of one (file, machine, epoch, serial) make one event, which the line of its first record stands for.

    The names that the daemon adds behind a group separator (UID, SYSCALL and so on, in capitals) are read with the rest.
    The path is the first by item that is not the folder of another one, else the first.
    """
    l = F.translate("line", "\x1d", " ")
    head = r"^(?:node=(\S+) )?type=(\S+) msg=audit\((\d+\.\d+):(\d+)\):(.*)$"
    rec = src.where(l.rlike(head)).select("file", "line_no", F.coalesce(F.nullif(F.regexp_extract(l, head, 1), F.lit("")), F.lit(machine)).alias("machine"), F.regexp_extract(l, head, 2).alias("type"), F.regexp_extract(l, head, 3).alias("epoch"), F.regexp_extract(l, head, 4).cast("bigint").alias("serial"), key_values(F.regexp_extract(l, head, 5)).alias("kv"), F.regexp_extract(l, head, 5).alias("body"))
    g = rec.withColumn("one", F.struct("line_no", "type", F.to_json("kv").alias("kv"), "body")).groupBy("file", "machine", "epoch", "serial").agg(F.array_sort(F.collect_list("one")).alias("r"))
    of = lambda t: F.from_json(F.get(F.filter("r", lambda x: x["type"] == t), F.lit(0))["kv"], "map<string,string>")
    entry = lambda x: F.from_json(x["kv"], "map<string,string>")
    paths = F.transform(F.filter("r", lambda x: x["type"] == "PATH"), lambda x: F.struct(unhex_text(entry(x)["name"]).alias("name"), entry(x)["nametype"].alias("nametype"), entry(x)["item"].try_cast("bigint").alias("item")))
    g = g.select("file", "machine", F.col("r")[0]["line_no"].alias("line_no"), "epoch", "serial", "r", of("SYSCALL").alias("s"), of("EXECVE").alias("x"), of("CWD").alias("d"), of("PROCTITLE").alias("t"), paths.alias("paths"))
    number = lambda c: F.nullif(F.nullif(F.col("s")[c], F.lit("(null)")).try_cast("bigint"), F.lit(UNSET_ID))
    args = F.transform(F.sequence(F.lit(0), F.greatest(F.coalesce(F.col("x")["argc"].try_cast("int"), F.lit(0)) - 1, F.lit(0))), lambda i: unhex_text(F.col("x")[F.concat(F.lit("a"), i.cast("string"))]))
    calls = F.create_map(*(F.lit(v) for kv in SYSCALLS.items() for v in kv))
    tty = F.col("s")["tty"]
    ordered = F.array_sort("paths", lambda a, b: F.signum(F.coalesce(a["item"], F.lit(0)) - F.coalesce(b["item"], F.lit(0))).cast("int"))
    path = F.coalesce(F.get(F.filter(ordered, lambda x: F.coalesce(x["nametype"] != "PARENT", F.lit(True))), F.lit(0))["name"], F.get(ordered, F.lit(0))["name"])
    rows = g.select(
        "file", "machine", "line_no", F.timestamp_micros((F.col("epoch").cast("decimal(20,6)") * 1_000_000).cast("bigint")).alias("ts"), "serial", number("pid").alias("pid"), number("ppid").alias("ppid"),
        *(number(c).alias(c) for c in ("uid", "euid", "auid", "ses")), F.coalesce(F.col("s")["SYSCALL"], calls[F.col("s")["syscall"]], F.col("s")["syscall"]).alias("syscall"), F.col("s")["UID"].alias("user"), F.nullif(tty, F.lit("(none)")).alias("tty"), unhex_text(F.col("t")["proctitle"]).alias("proctitle"), "paths", path.alias("path"), F.nullif(F.col("s")["key"], F.lit("(null)")).alias("key"),
        F.col("s")["exe"].alias("exe"), F.col("s")["comm"].alias("comm"), F.col("s")["success"].alias("success"), F.col("d")["cwd"].alias("cwd"), F.when(F.col("x").isNotNull(), F.array_join(args, " ")).alias("exec_args"),
        F.when(F.col("s").isNull(), None).when(F.coalesce(tty, F.lit("(none)")) == "(none)", "non_interactive").otherwise("interactive").alias("session_type"),
        F.transform("r", lambda x: x["type"]).alias("record_types"), F.transform("r", lambda x: x["line_no"]).alias("raw_lines"),
    )
    return as_events(rows, "system")


def network_events(src: DataFrame, machine: str | None = None) -> DataFrame:
    """http and alert records with their forwarded client.

    A single address at the top is trusted if the nested chain is missing or holds it, else that is a conflict; without
    one the nested chain's last hop is. A chain with any part that is no address, or several at the top, is invalid.
    """
    j = src.select("file", "line_no", F.from_json("line", NETWORK).alias("j")).where("j.event_type in ('http', 'alert')").select("file", "line_no", "j.*")
    chain = lambda c: F.transform(F.split(F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("-")), ",", -1), lambda x: F.trim(x))
    j = j.withColumn("top", canonical_ips(chain(F.col("xff")))).withColumn("nested", canonical_ips(chain(F.col("http.xff"))))
    bad = lambda c: F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(False))
    top = F.get("top", F.lit(0))
    invalid = bad("top") | bad("nested") | F.coalesce(F.size("top") > 1, F.lit(False))
    conflict = F.col("top").isNotNull() & F.col("nested").isNotNull() & ~F.array_contains("nested", top)
    status = F.when(invalid, "invalid").when(conflict, "conflict").when(F.col("top").isNull() & F.col("nested").isNull(), "missing").otherwise("valid")
    j = j.withColumn("first", F.coalesce(top, F.element_at("nested", -1)))
    rows = j.select(
        "file", "line_no", utc(F.col("timestamp")).alias("ts"), status.alias("xff_status"), F.when(status == "valid", F.col("first")).alias("src_ip"), canonical_ip(F.col("src_ip")).alias("transport_src_ip"),
        "event_type", "flow_id", "tx_id", F.col("in_iface").alias("sensor_id"), "src_port", canonical_ip(F.col("dest_ip")).alias("dest_ip"), "dest_port", "proto", F.upper("http.http_method").alias("method"),
        path_and_query(F.col("http.url")).alias("path"), "http.status", F.col("http.hostname").alias("host"), F.col("http.http_user_agent").alias("user_agent"), "alert.signature", "alert.signature_id", "alert.severity", "alert.category", "alert.action",
    )
    return as_events(_on(rows, machine), "network")


def all_events(*layers: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, layers)


def rejected(events: DataFrame) -> DataFrame:
    """Events that break the contract, with a reason."""
    known: Column = F.col("layer").isin("web", "network", "system", "auth")
    reason = F.when(F.col("raw_ref").isNull() | (F.col("raw_ref") == ""), "missing_raw_ref").when(F.col("ts").isNull(), "invalid_timestamp").when(~known | F.col("layer").isNull(), "unknown_layer")
    return events.withColumn("reject_reason", reason).where("reject_reason is not null")
