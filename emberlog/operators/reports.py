"""Investigation queries: filters, pages and statistics of each layer.

The statistics take any number of groups at once (`by`: columns, such as an incident's id), so one pass serves all incidents.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.incidents import top_per

#: Rows of a page, entries of a counter, characters of a user agent, accounts that are listed.
PAGE, TOP, AGENT, ACCOUNTS = 200, 5, 80, 20
#: Paths that log in or call from afar, and the limits of the check on requests of one address (fixed values).
AUTH_PATHS = ("xmlrpc.php", "wp-login.php", "/login", "/signin", "/user/login", "/admin/login")
POSTS, PATHS = 10, 20
ORDER = {"web": ("ts", "raw_ref"), "network": ("ts", "raw_ref"), "system": ("ts", "ld.serial", "raw_ref"), "auth": ("ts", "raw_ref")}


def filtered(
    events: DataFrame, layer: str | None = None, start: Column | None = None, end: Column | None = None, *, src_ip: str | None = None, any_ip: str | None = None, not_ip: str | None = None,
    method: str | None = None, path: str | None = None, path_regex: str | None = None, signature: str | None = None, record: str | None = None, interactive: bool = True, **equal,
) -> DataFrame:
    """Events of a layer from start to end that pass all given filters.

    equal: columns of events or fields of ld and their values. path and signature are parts; method is compared without
    case; any_ip is either end of a flow or the client; not_ip is the own server's address, whose rows go, but not rows
    without address; record is an audit key, system call or record type; with interactive=False only rows that are
    known to be non-interactive stay. An address that is none is an error.
    """
    for a in (src_ip, any_ip, not_ip):
        if a is not None:
            ipaddress.ip_address(a)
    tests: list[Column] = []
    add = lambda given, test: tests.append(test) if given is not None else None
    add(layer, F.col("layer") == layer)
    add(start, F.col("ts") >= start)
    add(end, F.col("ts") <= end)
    add(src_ip, F.col("src_ip") == src_ip)
    if any_ip is not None:
        tests.append(reduce(Column.__or__, (F.coalesce(F.col(c) == any_ip, F.lit(False)) for c in ("src_ip", "ld.transport_src_ip", "ld.dest_ip"))))
    add(not_ip, F.col("src_ip").isNull() | (F.col("src_ip") != not_ip))
    add(method, F.upper("ld.method") == (method or "").upper())
    add(path, F.contains("ld.path", F.lit(path)))
    add(path_regex, F.col("ld.path").rlike(path_regex or ""))
    add(signature, F.contains("ld.signature", F.lit(signature)))
    if record is not None:
        low = F.lit(record.lower())
        named = [F.coalesce(F.lower(f"ld.{c}") == low, F.lit(False)) for c in ("key", "syscall")]
        tests.append(named[0] | named[1] | F.coalesce(F.exists("ld.record_types", lambda x: F.lower(x) == low), F.lit(False)))
    if not interactive:
        tests.append(F.col("ld.session_type") == "non_interactive")
    for name, value in equal.items():
        tests.append(F.col(name if name in events.columns else f"ld.{name}") == value)
    return events.where(reduce(Column.__and__, tests)) if tests else events


def page(rows: DataFrame, *order: str, limit: int = PAGE, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """One page of rows in order, and one row (total, returned, has_more, next_offset) about it."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset at least 0")
    total = rows.agg(F.count("*").alias("total"))
    more = F.col("total") > offset + limit
    about = total.select("total", F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total") - offset)).cast("long").alias("returned"), more.alias("has_more"), F.when(more, F.lit(offset + limit).cast("long")).alias("next_offset"))
    return rows.orderBy(*(F.col(c).asc_nulls_first() for c in order)).offset(offset).limit(limit), about


def query(events: DataFrame, layer: str, limit: int = PAGE, offset: int = 0, **filters) -> tuple[DataFrame, DataFrame]:
    """page() of one layer in its own order: web, auth, system (audit) or network."""
    return page(filtered(events, layer, **filters), *ORDER[layer], limit=limit, offset=offset)


def event_logs(events: DataFrame, layers: tuple[str, ...], limit: int = PAGE, offset: int = 0, **filters) -> tuple[DataFrame, DataFrame]:
    """page() over several layers by time; one sort, of which each task keeps offset + limit rows."""
    return page(filtered(events.where(F.col("layer").isin(*layers)), **filters), "ts", "layer", "raw_ref", limit=limit, offset=offset)


def counters(rows: DataFrame, by: tuple[str, ...], k: int = TOP, **values: Column) -> DataFrame:
    """(by, counter, value, n, rank): the k most frequent values of each counter, of equals the smallest; null counts as -."""
    named = [F.struct(F.lit(name).alias("counter"), F.coalesce(c.cast("string"), F.lit("-")).alias("value")) for name, c in values.items()]
    each = rows.select(*by, F.inline(F.array(*named))).groupBy(*by, "counter", "value").agg(F.count("*").alias("n"))
    return top_per(each, (*by, "counter"), F.desc("n"), F.col("value"), k=k)


def status_class(status: Column) -> Column:
    return F.coalesce(F.concat(F.floor(status / 100).cast("string"), F.lit("xx")), F.lit("unknown"))


def web_counters(rows: DataFrame, *by: str) -> DataFrame:
    return counters(rows, by, method=F.col("ld.method"), status=status_class(F.col("ld.status")), path=F.col("ld.path"), agent=F.substring("ld.user_agent", 1, AGENT))


def web_stats(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n, n_ips, n_paths, first_ts, last_ts, auth_posts, n_4xx, brute_force, path_scan); the last four for groups of one address only."""
    one = F.col("n_ips") == 1
    post = (F.upper("ld.method") == "POST") & reduce(Column.__or__, (F.contains(F.lower("ld.path"), F.lit(p)) for p in AUTH_PATHS))
    s = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_distinct("src_ip").alias("n_ips"), F.count_distinct(F.coalesce("ld.path", F.lit("-"))).alias("n_paths"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_if(post).alias("auth_posts"), F.count_if(F.floor(F.col("ld.status") / 100) == 4).alias("n_4xx"),
    )
    s = s.withColumns({"brute_force": F.col("auth_posts") >= POSTS, "path_scan": (F.col("n_paths") >= PATHS) & (F.col("n_4xx") * 2 > F.col("n"))})
    return s.withColumns({c: F.when(one, F.col(c)) for c in ("auth_posts", "n_4xx", "brute_force", "path_scan")})


def login_stats(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n, failures, successes, n_failed_accounts, failed_accounts): of the accounts the first 20 by name."""
    failed = F.when(F.col("ld.result") == "failure", F.coalesce("ld.user", F.lit("-")))
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("ld.result") == "failure").alias("failures"), F.count_if(F.col("ld.result") == "success").alias("successes"), F.count_distinct(failed).alias("n_failed_accounts"))
    names = top_per(rows.select(*by, failed.alias("_user")).where("_user is not null").distinct(), by, F.col("_user"), k=ACCOUNTS).groupBy(*by).agg(F.array_sort(F.collect_list("_user")).alias("failed_accounts"))
    return s.join(names, list(by), "left").withColumn("failed_accounts", F.coalesce("failed_accounts", F.array().cast("array<string>")))


def login_counters(rows: DataFrame, *by: str) -> DataFrame:
    return counters(rows, by, event=F.col("ld.event"), user=F.col("ld.user"))


def audit_counters(rows: DataFrame, *by: str) -> DataFrame:
    return counters(rows, by, user=F.col("ld.user"), comm=F.col("ld.comm"))


def network_counters(rows: DataFrame, *by: str) -> DataFrame:
    kind = F.col("ld.event_type")
    of = lambda name: rows.where(kind == name)
    peer = F.concat_ws(":", "ld.dest_ip", "ld.dest_port")
    parts = (counters(rows, by, event_type=kind), counters(of("alert"), by, signature=F.col("ld.signature")), counters(of("http"), by, status=status_class(F.col("ld.status")), path=F.col("ld.path")), counters(rows.where("ld.dest_ip is not null"), by, peer=peer))
    return reduce(DataFrame.unionByName, parts)


def kind_counts(edges: DataFrame, by: str) -> DataFrame:
    """(by, kinds): how many edges of each kind a path has."""
    n = edges.groupBy(by, "kind").agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))


def zero_hint(window_total: Column, matched: Column, ip_only: bool) -> Column:
    """Why a query has no rows: no_log (nothing was recorded at all), ip_absent (only an address was asked for), or too_narrow."""
    return F.when(matched > 0, None).when(window_total == 0, "no_log").when(F.lit(ip_only), "ip_absent").otherwise("too_narrow")
