"""Queries over the driver's tables, by name, with their DuckDB SQL.

user_id stands for an entity, event_type for a layer or kind, event_id for a line reference, k of props for a process id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.operators import burst, incidents, lineage, links, queue, retrieval
from emberlog.operators.components import connected_components
from emberlog.operators.range_join import as_of, followed, micros, range_join, unique_only
from emberlog.plans.rules import detect
from emberlog.session import table

SECOND, HOUR = 1_000_000, 3_600_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("at"), k.alias("k"))


def kind(e: DataFrame, name: str, suffix: str) -> DataFrame:
    return e.where(F.col("event_type") == name).select(*(F.col(c).alias(f"{c}_{suffix}") for c in ("event_id", "user_id", "at", "k")))


E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, CAST(props->>'k' AS BIGINT) AS k FROM events)"
ERRORS = "h AS (SELECT * FROM e WHERE event_type = 'error')"
BURST = f"""
WITH {E}, {ERRORS}, n AS (
  SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 86400000000 FOLLOWING)
            - row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) + 1 AS ahead FROM h
), c AS (
  SELECT *, coalesce(us - last_value(CASE WHEN ahead >= 3 THEN us END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) <= 86400000000, FALSE) AS covered FROM n
), g AS (
  SELECT *, CASE WHEN covered AND (NOT coalesce(lag(covered) OVER w, FALSE) OR us - lag(us) OVER w > 86400000000) THEN 1 ELSE 0 END AS fresh FROM c WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)
), b AS (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g
), s AS (
  SELECT user_id, burst::BIGINT AS burst, min(us) AS first_at, max(us) AS last_at, count(*) AS n_hits, string_agg(event_id::VARCHAR, ',' ORDER BY us, event_id) AS refs FROM b WHERE covered GROUP BY user_id, burst
)
"""


def _bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burst.bursts(events(spark, sf_dir).where("event_type = 'error'"), ("user_id",), "at", "event_id", 24 * HOUR, 3)


@query(BURST + "SELECT * FROM s")
def burst_timed(spark, sf_dir):
    return _bursts(spark, sf_dir).withColumn("refs", F.array_join(F.col("refs").cast("array<string>"), ","))


FLAGSHIP = """, i AS (SELECT user_id, burst, first_at, last_at, n_hits, CASE WHEN n_hits >= 5 THEN 'high' ELSE 'medium' END AS severity, string_split(refs, ',') AS m FROM s),
t AS (SELECT *, CASE severity WHEN 'high' THEN 30 ELSE 12 END AS triage_score FROM i)
SELECT user_id, burst, first_at, last_at, n_hits, substr(sha1(array_to_string(list_sort(m), '|')), 1, 8) AS incident_id, severity, triage_score,
       CASE WHEN triage_score >= 50 THEN 'P1' WHEN triage_score >= 30 THEN 'P2' WHEN triage_score >= 12 THEN 'P3' ELSE 'P4' END AS priority FROM t
"""


@query(BURST + FLAGSHIP)
def burst_incidents(spark, sf_dir):
    b = _bursts(spark, sf_dir).withColumn("severity", F.when(F.col("n_hits") >= 5, "high").otherwise("medium"))
    score = incidents.triage_score(F.col("severity"), F.lit(1), F.lit(0), F.lit(1))
    b = b.withColumn("incident_id", incidents.incident_id(F.col("refs").cast("array<string>"))).withColumn("triage_score", score)
    return b.select("user_id", "burst", "first_at", "last_at", "n_hits", "incident_id", "severity", "triage_score", incidents.priority(F.col("triage_score")).alias("priority"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burst_incidents(spark, sf_dir)


SESSIONS = f"""
WITH {E}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us, event_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS burst FROM g)
"""


@query(SESSIONS + "SELECT user_id, event_type, burst, min(us) AS first_at, max(us) AS last_at, count(*) AS n_hits FROM b GROUP BY ALL")
def burst_session(spark, sf_dir):
    return burst.sessions(events(spark, sf_dir), ("user_id", "event_type"), "at", "event_id", 6 * HOUR).drop("refs")


@query(f"WITH {E}, s AS (SELECT user_id, event_type AS kind, CASE event_type WHEN 'error' THEN 'high' WHEN 'click' THEN 'low' WHEN 'view' THEN 'medium' END AS level, count(*) AS n_hits FROM e GROUP BY ALL) SELECT * FROM s WHERE level IS NULL OR level = 'high' OR n_hits >= 15")
def seed_threshold(spark, sf_dir):
    level = F.when(F.col("kind") == "error", "high").when(F.col("kind") == "click", "low").when(F.col("kind") == "view", "medium")
    return burst.over_threshold(events(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("kind")).agg(F.count("*").alias("n_hits")).withColumn("level", level), least=15)


RULES = [
    {"id": "web_org", "level": "high", "layer": "page", "detection": {"host": {"url|contains": ["example.org", "example.net"]}, "plain": {"url|startswith": "http://"}, "condition": "host and not plain"}},
    {"id": "paged", "level": "medium", "layer": "page", "detection": {"sel_query": {"url|re": r"[?&]page=\d+"}, "sel_frag": {"url|endswith": "#top"}, "condition": "1 of sel*"}},
    {"id": "deep", "level": "low", "layer": "page", "detection": {"a": {"url": "https://*/en/*"}, "b": {"url|contains|all": ["m.", "example"]}, "condition": "all of them"}},
    {"id": "no_fragment", "level": "low", "layer": "page", "detection": {"missing": {"no_such_field": None}, "top": {"url|contains": "#"}, "condition": "missing and not (top or not missing)"}},
]


@query("""
SELECT page_id, rule_id, level FROM (
  SELECT page_id, url, 'web_org' AS rule_id, 'high' AS level FROM pages WHERE (contains(lower(url), 'example.org') OR contains(lower(url), 'example.net')) AND NOT starts_with(lower(url), 'http://')
  UNION ALL SELECT page_id, url, 'paged', 'medium' FROM pages WHERE regexp_matches(url, '[?&]page=[0-9]+') OR ends_with(lower(url), '#top')
  UNION ALL SELECT page_id, url, 'deep', 'low' FROM pages WHERE lower(url) LIKE 'https://%/en/%' AND contains(lower(url), 'm.') AND contains(lower(url), 'example')
  UNION ALL SELECT page_id, url, 'no_fragment', 'low' FROM pages WHERE NOT coalesce(contains(url, '#'), FALSE))
""")
def rule_multi_hit(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.lit("page").alias("layer"))
    return detect(pages, RULES).select("page_id", "rule_id", "level")


@query(f"WITH {E} SELECT user_id, event_type, us // 60000000 AS minute, count(*) AS n, arg_min(event_id, (us, event_id)) AS first_event, CASE WHEN min(k) = 1 THEN 'high' WHEN min(k) = 2 THEN 'medium' ELSE 'low' END AS severity FROM e GROUP BY ALL")
def alert_dedupe_minute(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id", "event_type", F.floor(F.col("at") / 60_000_000).alias("minute"))
    return e.agg(F.count("*").alias("n"), F.min_by("event_id", F.struct("at", "event_id")).alias("first_event"), burst.alert_severity(F.min("k").cast("string"), F.lit("")).alias("severity"))


RANGE = f"WITH {E}, p AS (SELECT a.event_id AS a, b.event_id AS b, a.user_id AS user_a, b.us - a.us AS gap FROM e a JOIN e b ON b.us BETWEEN a.us - 60000000 AND a.us + 60000000 WHERE a.event_type = 'click' AND b.event_type = 'purchase')"


def _clicks_and_purchases(spark: SparkSession, sf_dir: str, width: int, keys: tuple = ()) -> DataFrame:
    e = events(spark, sf_dir)
    return range_join(kind(e, "click", "a"), kind(e, "purchase", "b"), "at_a", "at_b", width, keys)


@query(RANGE + " SELECT a, b, gap FROM p")
def link_range(spark, sf_dir):
    return _clicks_and_purchases(spark, sf_dir, 60 * SECOND).select(F.col("event_id_a").alias("a"), F.col("event_id_b").alias("b"), (F.col("at_b") - F.col("at_a")).alias("gap"))


@query(RANGE + " SELECT a, b FROM p QUALIFY count(*) OVER (PARTITION BY b) = 1")
def link_unique_candidate(spark, sf_dir):
    return unique_only(_clicks_and_purchases(spark, sf_dir, 60 * SECOND), "event_id_b").select(F.col("event_id_a").alias("a"), F.col("event_id_b").alias("b"))


@query("SELECT l_orderkey, l_linenumber, o_custkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def link_equi(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem").where("l_quantity > 45"), table(spark, sf_dir, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "o_custkey", "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, o_custkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def link_equi_whole(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "o_custkey", "o_orderpriority")


@query(f"WITH {E} SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.k = b.k WHERE a.event_type = 'error' AND b.event_type = 'view'")
def link_flow_exact(spark, sf_dir):
    e = events(spark, sf_dir)
    a, b = kind(e, "error", "a"), kind(e, "view", "b")
    return a.join(b, (a.user_id_a == b.user_id_b) & (a.k_a == b.k_b)).select(F.col("event_id_a").alias("a"), F.col("event_id_b").alias("b"))


@query(f"WITH {E}, p AS (SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.us - b.us) <= 7200000000 WHERE a.event_type = 'error' AND b.event_type = 'view') SELECT a, b FROM p QUALIFY count(*) OVER (PARTITION BY a) = 1")
def link_flow_fallback(spark, sf_dir):
    e = events(spark, sf_dir)
    pairs = range_join(kind(e, "error", "a"), kind(e, "view", "b"), "at_a", "at_b", 2 * HOUR, (("user_id_a", "user_id_b"),))
    return unique_only(pairs, "event_id_a").select(F.col("event_id_a").alias("a"), F.col("event_id_b").alias("b"))


CHAIN = f"{E}, c AS (SELECT lag(event_id) OVER w AS a, event_id AS b, us - lag(us) OVER w AS gap FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us, event_id))"


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.session_chain(events(spark, sf_dir), ("user_id", "event_type"), "at", "event_id", 6 * HOUR)


@query(f"WITH {CHAIN} SELECT a, b FROM c WHERE gap <= 21600000000")
def link_session_chain(spark, sf_dir):
    return _chain(spark, sf_dir)


@query(f"WITH {E}, l AS (SELECT * FROM e WHERE event_type = 'purchase'), r AS (SELECT * FROM e WHERE event_type = 'view') SELECT l.event_id, r.event_id AS parent, r.us AS parent_at FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.us >= r.us")
def link_asof_parent(spark, sf_dir):
    e = events(spark, sf_dir)
    right = e.where("event_type = 'view'").select(F.col("user_id").alias("u"), F.col("event_id").alias("parent"), F.col("at").alias("parent_at"))
    return as_of(e.where("event_type = 'purchase'"), right, "event_id", "at", "parent_at", (("user_id", "u"),), "parent").select("event_id", "parent", "parent_at")


@query(f"WITH {E} SELECT DISTINCT a.event_id FROM e a WHERE a.event_type = 'click' AND EXISTS (SELECT 1 FROM e b WHERE b.event_type = 'error' AND b.user_id = a.user_id AND b.us BETWEEN a.us AND a.us + 43200000000)")
def link_interval_after(spark, sf_dir):
    e = events(spark, sf_dir)
    return followed(kind(e, "click", "a"), kind(e, "error", "b"), "at_a", "at_b", 12 * HOUR, (("user_id_a", "user_id_b"),), "event_id_a").withColumnRenamed("event_id_a", "event_id")


@query(f"""WITH {E}, p AS (SELECT a.event_id, abs(b.us - a.us) AS gap FROM e a JOIN e b ON abs(b.us - a.us) <= 900000000 WHERE a.event_type = 'click' AND b.event_type = 'purchase'),
n AS (SELECT event_id, count(*) FILTER (gap <= 1000000) AS n_1s, count(*) FILTER (gap <= 2000000) AS n_2s, count(*) FILTER (gap <= 900000000) AS n_900s FROM p GROUP BY event_id)
SELECT *, CASE WHEN n_1s = 1 THEN 'strong' WHEN n_1s > 1 THEN 'ambiguous' WHEN n_2s > 0 THEN 'fallback' WHEN n_900s > 0 THEN 'context' ELSE 'unmatched' END AS grade FROM n""")
def correlation_grades(spark, sf_dir):
    return links.graded(_clicks_and_purchases(spark, sf_dir, 900 * SECOND), "event_id_a", F.col("at_b") - F.col("at_a")).withColumnRenamed("event_id_a", "event_id")


@query(f"WITH {CHAIN}, r AS (SELECT b AS a, a AS b FROM c WHERE gap <= 21600000000 UNION ALL SELECT a, b FROM c WHERE gap <= 21600000000 UNION ALL SELECT b, b FROM c) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, 'chain' AS kind FROM r WHERE a <> b")
def edge_guards(spark, sf_dir):
    c = _chain(spark, sf_dir)
    e = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(c.select(F.col("b").alias("a"), "b"))
    return links.guarded(e.withColumn("kind", F.lit("chain")))


@query(SESSIONS + ", m AS (SELECT event_id AS vertex, min(event_id) OVER (PARTITION BY user_id, event_type, burst) AS component, count(*) OVER (PARTITION BY user_id, event_type, burst) AS n FROM b) SELECT vertex, component FROM m WHERE n > 1")
def components_session(spark, sf_dir):
    return connected_components(_chain(spark, sf_dir))


@query("""WITH RECURSIVE g AS (SELECT DISTINCT l_suppkey AS s, -l_partkey AS p FROM lineitem WHERE l_quantity = 50 AND l_discount >= 0.09), n AS (SELECT s AS x, p AS y FROM g UNION SELECT p, s FROM g),
r AS (SELECT x AS v, x AS c FROM n UNION SELECT n.y, r.c FROM r JOIN n ON n.x = r.v) SELECT v AS vertex, min(c) AS component FROM r GROUP BY v""")
def components_general(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").where("l_quantity = 50 and l_discount >= 0.09").select(F.col("l_suppkey").alias("a"), (-F.col("l_partkey")).alias("b"))
    return connected_components(g)


@query()  # recursive SQL takes the square of the vertices; the tests hold it against brute force
def components_whole(spark, sf_dir):
    return connected_components(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (-F.col("l_partkey")).alias("b")))


@query(SESSIONS + "SELECT min(event_id) AS component, substr(sha1(string_agg(event_id::VARCHAR, '|' ORDER BY event_id::VARCHAR)), 1, 8) AS incident_id, count(*) AS member_count FROM b GROUP BY user_id, event_type, burst HAVING count(*) > 1")
def incident_build(spark, sf_dir):
    m = incidents.members_of(_chain(spark, sf_dir))
    return m.groupBy("component").agg(incidents.incident_id(F.collect_list(F.col("ref").cast("string"))).alias("incident_id"), F.count("*").alias("member_count"))


@query(f"WITH {E}, n AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL) SELECT user_id, event_type FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def incident_entity_mode(spark, sf_dir):
    return incidents.mode_of(events(spark, sf_dir), "user_id", "event_type")


@query(f"WITH {E}, n AS (SELECT user_id, k, list_sort(list_distinct(list(event_type))) AS reasons FROM e GROUP BY user_id, k) SELECT user_id, substr(sha1(user_id::VARCHAR || '|' || array_to_string(reasons, chr(31))), 1, 16) AS incident_key, count(*) AS n_merged FROM n GROUP BY user_id, reasons")
def incident_key(spark, sf_dir):
    n = events(spark, sf_dir).groupBy("user_id", "k").agg(F.array_sort(F.collect_set("event_type")).alias("reasons"))
    return n.groupBy("user_id", incidents.incident_key(F.col("user_id").cast("string"), F.col("reasons"), F.lit("")).alias("incident_key")).agg(F.count("*").alias("n_merged"))


@query(f"""WITH {CHAIN}, x AS (SELECT a AS v FROM c WHERE gap <= 21600000000 UNION SELECT b FROM c WHERE gap <= 21600000000) SELECT e.event_id AS seed_id, x.v IS NULL AS alone FROM e LEFT JOIN x ON e.event_id = x.v WHERE e.event_type = 'error'""")
def seed_attach(spark, sf_dir):
    members = incidents.members_of(_chain(spark, sf_dir))
    seeds = events(spark, sf_dir).where("event_type = 'error'").select(F.col("event_id").alias("seed_id"), F.array("event_id").alias("refs"))
    return incidents.attach_seeds(seeds, members).select("seed_id", F.startswith("component", F.lit("seed:")).alias("alone"))


@query(f"""WITH {E}, u AS (SELECT user_id, count(DISTINCT event_type) AS layers, count(DISTINCT k) % 4 AS kinds, count(*) FILTER (event_type = 'error') AS seeds, CASE WHEN max(value) > 485 THEN 'high' ELSE 'medium' END AS severity FROM e GROUP BY user_id),
t AS (SELECT *, CASE severity WHEN 'high' THEN 30 ELSE 12 END + 6 * greatest(layers - 1, 0) + 3 * kinds + least(2 * greatest(seeds - 1, 0), 8) AS score FROM u)
SELECT user_id, score, CASE WHEN score >= 50 THEN 'P1' WHEN score >= 30 THEN 'P2' WHEN score >= 12 THEN 'P3' ELSE 'P4' END AS priority, CASE WHEN score >= 30 THEN 'investigate' WHEN score >= 12 THEN 'dashboard' ELSE 'hold' END AS route FROM t""")
def triage(spark, sf_dir):
    u = events(spark, sf_dir).groupBy("user_id").agg(F.count_distinct("event_type").alias("layers"), (F.count_distinct("k") % 4).alias("kinds"), F.count_if(F.col("event_type") == "error").alias("seeds"), F.when(F.max("value") > 485, "high").otherwise("medium").alias("severity"))
    u = u.withColumn("score", incidents.triage_score(F.col("severity"), F.col("layers"), F.col("kinds"), F.col("seeds")))
    return u.select("user_id", "score", incidents.priority(F.col("score")).alias("priority"), incidents.route(F.col("score")).alias("route"))


CUTS = ("2024-01-15 00:00:00", "2024-01-20 00:00:00")


@query(f"""WITH {E}, s AS (SELECT user_id AS key, max(us) AS end_at, count(*) AS n FROM e WHERE us < epoch_us(TIMESTAMP '{CUTS[0]}') AND user_id % 3 <> 0 GROUP BY 1), w AS (SELECT user_id AS key, max(us) AS end_at, count(*) AS n FROM e WHERE us < epoch_us(TIMESTAMP '{CUTS[1]}') AND user_id % 5 <> 0 GROUP BY 1)
SELECT coalesce(w.key, s.key)::VARCHAR AS incident_key, CASE WHEN w.key IS NULL THEN NULL WHEN s.key IS NULL THEN 'new' WHEN w.end_at > s.end_at OR w.n > s.n THEN 'update' ELSE 'silent' END AS emit, greatest(w.n, s.n) AS max_member_count FROM w FULL JOIN s ON w.key = s.key""")
def state_diff(spark, sf_dir):
    e = events(spark, sf_dir)
    before, now = (F.unix_micros(F.lit(c).cast("timestamp")) for c in CUTS)
    found = lambda rows: rows.groupBy(F.col("user_id").cast("string").alias("incident_key")).agg(F.timestamp_micros(F.max("at")).alias("window_end"), F.count("*").alias("member_count"))
    at = F.lit(CUTS[0]).cast("timestamp")
    state = found(e.where((F.col("at") < before) & (F.col("user_id") % 3 != 0))).withColumnRenamed("member_count", "max_member_count").withColumn("last_seen", at)
    return queue.state_diff(found(e.where((F.col("at") < now) & (F.col("user_id") % 5 != 0))), state, at).select("incident_key", "emit", "max_member_count")


#: Incidents by entity and process, of all events: those before the second cut are known, those since the first are news.
STAGED = f"""{E}, i AS (SELECT *, concat_ws(':', user_id, k) AS incident_key FROM e), s AS (SELECT incident_key, max(us) AS end_at, count(*) AS n, min(user_id) AS u FROM i WHERE us < epoch_us(TIMESTAMP '{CUTS[1]}') GROUP BY 1),
w AS (SELECT incident_key, max(us) AS end_at, count(*) AS n, min(user_id) AS u FROM i WHERE us >= epoch_us(TIMESTAMP '{CUTS[0]}') GROUP BY 1)"""


def _staged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf_dir).withColumn("incident_key", F.concat_ws(":", F.col("user_id").cast("string"), F.col("k").cast("string")))
    first, second = (F.unix_micros(F.lit(c).cast("timestamp")) for c in CUTS)
    found = lambda rows: rows.groupBy("incident_key").agg(F.timestamp_micros(F.max("at")).alias("window_end"), F.count("*").alias("member_count"), F.min("user_id").alias("u"))
    return found(e.where(F.col("at") < second)), found(e.where(F.col("at") >= first))


@query(f"""WITH {STAGED} SELECT coalesce(w.incident_key, s.incident_key) AS incident_key, CASE WHEN w.n IS NULL THEN NULL WHEN s.n IS NULL THEN 'new' WHEN w.end_at > s.end_at OR w.n > s.n THEN 'update' ELSE 'silent' END AS emit, greatest(w.n, s.n) AS max_member_count FROM w FULL JOIN s ON w.incident_key = s.incident_key""")
def state_diff_whole(spark, sf_dir):
    known, news = _staged(spark, sf_dir)
    at = F.lit(CUTS[1]).cast("timestamp")
    return queue.state_diff(news, known.withColumnRenamed("member_count", "max_member_count").withColumn("last_seen", at), at).select("incident_key", "emit", "max_member_count")


@query(f"""WITH {STAGED}, q AS (SELECT incident_key, CASE u % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'investigating' ELSE 'done' END AS status, n FROM s)
SELECT coalesce(q.incident_key, w.incident_key) AS incident_key, CASE WHEN q.n IS NULL OR (w.n IS NOT NULL AND q.status = 'done') THEN 'pending' ELSE q.status END AS status, coalesce(w.n IS NOT NULL AND q.status = 'investigating', FALSE) AS has_update,
coalesce(w.n, q.n) AS triage_score, CASE WHEN w.u % 5 = 0 THEN 'hold' ELSE 'investigate' END AS route FROM q FULL JOIN w ON q.incident_key = w.incident_key""")
def queue_upsert_whole(spark, sf_dir):
    (known, news), at = _staged(spark, sf_dir), F.lit("2024-02-01 00:00:00").cast("timestamp")
    status = F.when(F.col("u") % 3 == 0, "pending").when(F.col("u") % 3 == 1, "investigating").otherwise("done")
    q = known.select("incident_key", status.alias("status"), F.lit(False).alias("has_update"), F.col("member_count").alias("triage_score"), F.lit("investigate").alias("route"), at.alias("updated_at"))
    c = news.select("incident_key", F.col("member_count").alias("triage_score"), F.when(F.col("u") % 5 == 0, "hold").otherwise("investigate").alias("route"))
    return queue.upsert(q, c, at).drop("updated_at")


QUEUE = "q AS (SELECT user_id::VARCHAR AS incident_key, CASE user_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'investigating' ELSE 'done' END AS status, FALSE AS has_update, count(*) AS triage_score, 'investigate' AS route FROM e WHERE user_id % 2 = 0 GROUP BY user_id), c AS (SELECT user_id::VARCHAR AS incident_key, count(*) FILTER (event_type = 'error') AS score, CASE WHEN user_id % 5 = 0 THEN 'hold' ELSE 'investigate' END AS route FROM e WHERE user_id % 7 < 4 GROUP BY user_id)"
UPSERT = f"""{E}, {QUEUE}, n AS (SELECT coalesce(q.incident_key, c.incident_key) AS incident_key, CASE WHEN q.status IS NULL OR (c.score IS NOT NULL AND q.status = 'done') THEN 'pending' ELSE q.status END AS status,
coalesce(c.score IS NOT NULL AND q.status = 'investigating', FALSE) AS has_update, coalesce(c.score, q.triage_score) AS triage_score, coalesce(c.route, q.route) AS route FROM q FULL JOIN c ON q.incident_key = c.incident_key)"""


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, at = events(spark, sf_dir), F.lit("2024-02-01 00:00:00").cast("timestamp")
    status = F.when(F.col("user_id") % 3 == 0, "pending").when(F.col("user_id") % 3 == 1, "investigating").otherwise("done")
    q = e.where("user_id % 2 = 0").groupBy("user_id").agg(F.count("*").alias("triage_score")).select(F.col("user_id").cast("string").alias("incident_key"), status.alias("status"), F.lit(False).alias("has_update"), "triage_score", F.lit("investigate").alias("route"), at.alias("updated_at"))
    c = e.where("user_id % 7 < 4").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("triage_score")).select(F.col("user_id").cast("string").alias("incident_key"), "triage_score", F.when(F.col("user_id") % 5 == 0, "hold").otherwise("investigate").alias("route"))
    return queue.upsert(q, c, at)


@query(f"WITH {UPSERT} SELECT * FROM n")
def queue_upsert(spark, sf_dir):
    return _queue(spark, sf_dir).drop("updated_at")


@query(f"WITH {UPSERT} SELECT incident_key, triage_score FROM n WHERE route = 'investigate' AND status = 'pending' ORDER BY triage_score DESC, incident_key LIMIT 20")
def queue_top(spark, sf_dir):
    return queue.waiting(_queue(spark, sf_dir)).select("incident_key", "triage_score")


@query(f"WITH {UPSERT} SELECT status, route, grouping(status, route) AS level, count(*) AS n FROM n GROUP BY GROUPING SETS ((status), (route), ())")
def queue_stats(spark, sf_dir):
    return queue.queue_stats(_queue(spark, sf_dir))


@query(f"WITH {E}, w AS (SELECT event_type, unnest(generate_series(us // 21600000000 - 3, us // 21600000000)) AS slot FROM e) SELECT event_type, slot * 21600000000 AS start_at, count(*) AS n FROM w GROUP BY ALL")
def sliding_window_counts(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("event_type", F.window(F.timestamp_micros("at"), "24 hours", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("event_type", F.unix_micros("w.start").alias("start_at"), "n")


@query(f"WITH {E} SELECT user_id, count(*) FILTER (event_type = 'error') AS n_failed, count(DISTINCT k) AS n_paths, CASE WHEN count(*) FILTER (event_type = 'error') >= 20 THEN 'brute_force' WHEN count(DISTINCT k) >= 40 AND 4 * count(*) FILTER (event_type = 'error') > count(*) THEN 'scan' ELSE 'none' END AS verdict FROM e GROUP BY user_id")
def scan_check(spark, sf_dir):
    from emberlog.operators.investigate import scan_verdict

    return scan_verdict(events(spark, sf_dir), "user_id", F.col("event_type") == "error", "k", posts=20, paths=40, factor=4)


@query(f"WITH {E}, n AS (SELECT user_id, event_type AS k, count(*) AS n FROM e GROUP BY ALL) SELECT user_id, k, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, k) AS rank FROM n QUALIFY rank <= 3")
def top_counters(spark, sf_dir):
    n = events(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("k")).agg(F.count("*").alias("n"))
    return incidents.top_per(n, ("user_id",), F.desc("n"), F.asc("k"), k=3)


@query(f"WITH {E} SELECT event_id, us FROM e ORDER BY us, event_id LIMIT 200 OFFSET 400")
def page_slice(spark, sf_dir):
    return events(spark, sf_dir).orderBy("at", "event_id").offset(400).limit(200).select("event_id", F.col("at").alias("us"))


@query("SELECT x AS ip, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[0-9]{1,3}(?:[.][0-9]{1,3}){3}')) AS x FROM documents) GROUP BY x ORDER BY n DESC, ip LIMIT 3")
def address_topk(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}(?:[.][0-9]{1,3}){3}"), F.lit(0))).alias("ip"))
    return found.groupBy("ip").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ip").limit(3)


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages")
def url_split(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"), F.regexp_extract("url", "[?]([^#]*)", 1).alias("query"))


@query(f"WITH {E} SELECT k, count(*) AS n, min(event_id) AS first_id FROM e GROUP BY k")
def json_props(spark, sf_dir):
    return events(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT conv_id, turn, role, substr(text, 1, 160) AS line FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) <= 6")
def evidence_digest(spark, sf_dir):
    c = incidents.top_per(table(spark, sf_dir, "conversations"), ("conv_id",), F.asc("turn"), F.asc("text"), k=6)
    return c.select("conv_id", "turn", "role", F.substring("text", 1, 160).alias("line"))


@query("""WITH RECURSIVE n AS (SELECT DISTINCT conv_id * 100000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 100000 + turn - 1 END AS parent FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
r AS (SELECT id, parent AS ancestor, 1::BIGINT AS depth FROM n WHERE parent IS NOT NULL UNION ALL SELECT r.id, n.parent, depth + 1 FROM r JOIN n ON r.ancestor = n.id WHERE n.parent IS NOT NULL AND depth < 32) SELECT id, ancestor, depth FROM r""")
def ancestor_chain(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    n = c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 100000 + F.col("turn") - 1).alias("parent")).distinct()
    return lineage.ancestors(n)


BM25 = """q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM benchmark WHERE item_id % 10 = 0),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), st AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM d),
p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS score FROM p JOIN f USING (term) JOIN q USING (term), st GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 50)"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").where("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(table(spark, sf_dir, "documents"), q)


@query(f"WITH {BM25} SELECT query_id, doc_id, rank FROM bm")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir).select("query_id", "doc_id", "rank")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_dot_product(v.v, q.v) / sqrt(list_dot_product(v.v, v.v) * list_dot_product(q.v, q.v)), 6) AS score FROM v JOIN v q ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))).select("query_id", "doc_id", "rank")


@query(f"""WITH {BM25}, b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rank FROM bm WHERE rank <= 20), u AS (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM b),
z AS (SELECT query_id, doc_id, round(sum(1::DOUBLE / (20 + rank)), 9) AS score, min(rank) AS best FROM u GROUP BY ALL) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, doc_id) AS rank FROM z QUALIFY rank <= 10""")
def rrf_fusion(spark, sf_dir):
    a = _bm25(spark, sf_dir)
    b = a.where("rank <= 20").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("doc_id"))).cast("long"))
    return retrieval.fused([a, b]).select("query_id", "doc_id", "rank")


@query("""SELECT documents.doc_id, CASE WHEN toxic = 1 THEN 'excluded' WHEN quality = 1 THEN 'target' WHEN quality = 0 THEN 'context' ELSE 'unlabelled' END AS eligibility FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id""")
def eligibility_reasons(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left").select("doc_id", F.when(F.col("toxic") == 1, "excluded").when(F.col("quality") == 1, "target").when(F.col("quality") == 0, "context").otherwise("unlabelled").alias("eligibility"))


@query(f"WITH {E} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END, event_id) AS step FROM e")
def kill_chain_steps(spark, sf_dir):
    from emberlog.operators.investigate import kill_chain

    order = F.element_at(F.create_map(*(F.lit(x) for kv in (("view", 0), ("click", 1), ("signup", 2), ("purchase", 3), ("error", 4)) for x in kv)), F.col("event_type"))
    return kill_chain(events(spark, sf_dir), ("user_id",), F.col("at"), order, F.col("event_id")).select("user_id", "event_id", "step")


@query("""SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand, CASE WHEN p_size > 40 THEN 'high' ELSE 'low' END ORDER BY p_retailprice DESC, p_partkey) AS nth, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE nth <= CASE WHEN p_size > 40 THEN 1 ELSE 7 END""")
def action_caps(spark, sf_dir):
    from emberlog.operators.investigate import capped

    p = table(spark, sf_dir, "part").withColumn("risk", F.when(F.col("p_size") > 40, "high").otherwise("low"))
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")).cast("long")
    return capped(p.withColumn("rank", rank), ("p_brand",), "risk", {"high": 1, "low": 7}, F.desc("p_retailprice"), F.asc("p_partkey")).select("p_brand", "p_partkey", "rank")


@query("SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).intersect(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).subtract(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("""
WITH c AS (SELECT l_orderkey AS incident_id, l_linenumber AS evidence_id, l_discount, unnest(list_distinct([l_partkey, l_suppkey])) AS ref FROM lineitem),
o AS (SELECT l_orderkey AS incident_id, l_partkey AS ref, count(DISTINCT l_shipdate) AS places FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT incident_id, evidence_id, count(places) AS n_known, count(*) - count(places) AS n_unknown, count(*) FILTER (places > 1) AS n_ambiguous,
  CASE WHEN count(*) > count(places) OR max(places) > 1 THEN 0.0::DOUBLE ELSE max(l_discount) END AS contribution
FROM c LEFT JOIN o USING (incident_id, ref) GROUP BY incident_id, evidence_id""")
def citation_check(spark, sf_dir):
    """Lines cite their part and supplier; the parts of an order's settled lines were observed."""
    from emberlog.operators.decisions import citations

    lines = table(spark, sf_dir, "lineitem")
    cited = lines.select(F.col("l_orderkey").alias("incident_id"), F.col("l_linenumber").alias("evidence_id"), F.array("l_partkey", "l_suppkey").alias("refs"), F.col("l_discount").alias("contribution"))
    return citations(cited, lines.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("incident_id"), F.col("l_partkey").alias("ref"), F.col("l_shipdate").alias("location")))


@query("""
WITH RECURSIVE c AS (SELECT p_brand, p_partkey, p_size, p_retailprice > 950 AS high, p_partkey > 100 AS undo, p_size = 1 AS must FROM part),
q AS (SELECT p_partkey, p_partkey + 1 AS required FROM part WHERE p_size >= 40),
h AS (SELECT p_brand, p_partkey, false AS req FROM c WHERE p_size > 30 OR must UNION SELECT h.p_brand, q.required, true FROM h JOIN q ON h.p_partkey = q.p_partkey JOIN c ON c.p_brand = h.p_brand AND c.p_partkey = q.required),
k AS (SELECT p_brand, p_partkey, bool_and(req) AS req FROM h GROUP BY ALL),
a0 AS (SELECT c.*, CASE WHEN must THEN 'mandatory' WHEN req THEN 'required' ELSE 'selected' END AS why, NOT must AND NOT req AS free FROM c JOIN k USING (p_brand, p_partkey)),
a1 AS (SELECT * FROM a0 QUALIFY NOT (high AND free AND row_number() OVER (PARTITION BY p_brand ORDER BY high AND free DESC, p_size DESC, p_partkey) <= count(*) FILTER (high) OVER (PARTITION BY p_brand) - 1)),
a2 AS (SELECT * FROM a1 QUALIFY NOT (NOT undo AND free AND row_number() OVER (PARTITION BY p_brand ORDER BY NOT undo AND free DESC, p_size DESC, p_partkey) <= count(*) FILTER (NOT undo) OVER (PARTITION BY p_brand) - 2))
SELECT p_brand, p_partkey, why FROM a2 QUALIFY NOT (free AND row_number() OVER (PARTITION BY p_brand ORDER BY free DESC, p_size DESC, p_partkey) <= count(*) OVER (PARTITION BY p_brand) - 8)""")
def action_selection(spark, sf_dir):
    """Parts of a brand as actions: large ones selected, the smallest mandatory, the next key required by the largest."""
    from emberlog.operators.decisions import chosen_actions

    p = table(spark, sf_dir, "part")
    candidates = p.select(
        F.col("p_brand").alias("incident_id"), F.col("p_partkey").alias("template_id"), F.col("p_size").alias("priority"), F.when(F.col("p_retailprice") > 950, "HIGH").otherwise("LOW").alias("risk"),
        (F.col("p_partkey") > 100).alias("reversible"), (F.col("p_size") == 1).alias("mandatory"),
    )
    selected = candidates.where("priority > 30").select("incident_id", "template_id")
    requires = p.where("p_size >= 40").select(F.col("p_partkey").alias("template_id"), (F.col("p_partkey") + 1).alias("required"))
    return chosen_actions(candidates, selected, requires).select(F.col("incident_id").alias("p_brand"), F.col("template_id").alias("p_partkey"), "why")


@query()
def keyword_techniques(spark, sf_dir):
    """Documents as evidence: what they name in clauses that deny nothing."""
    from emberlog.plans.keywords import evidence_hits

    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("incident_id"), F.col("doc_id").alias("evidence_id"), F.lit("").alias("event_type"), F.col("text").alias("description"))
    rules = [{"id": "licence", "words": ["license", "copyright"]}, {"id": "secret", "words": ["password", "secret", "token"], "commands": ["api_key"]}]
    return evidence_hits(docs, rules).select("incident_id", "evidence_id", "technique_id", F.array_join("keywords", ",").alias("keywords"))
