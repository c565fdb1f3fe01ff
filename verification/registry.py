"""Every query of the engine on the given tables, with the SQL it is compared with."""

import functools
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden import fixed_values as fixed
from logwarden import schema
from logwarden.functions import clock, net, severity, text
from logwarden.operators import clean, correlate, detect, enrich, rulefile, rules, signatures
from logwarden.operators.parse import fields_from_json, fields_json, parse, response_bytes
from logwarden.plans import jobs, reports
from logwarden.sources import fastlog, snapshots, store
from logwarden.sources import logs as sources
from logwarden.sources.runs import RunTables
from logwarden.staging import new_path, stage
from logwarden.streaming import jobs as streams
from logwarden.streaming import landing
from logwarden.streaming.counted import CountedAdmission
from logwarden.streaming.upserts import KeyedCounts
from verification import constants, derived, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ALL_FIELDS = [f.name for f in schema.FIELDS.fields]


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(spark, folder, sql=derived.LOGS, ts=derived.SPARK_TS) -> DataFrame:
    given = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    return spark.sql(derived.for_spark(sql, ts), events=sources.spread(given))


def events(spark, folder) -> DataFrame:
    return parse(lines(spark, folder))


def alerts(spark, folder, mode=detect.REFERENCE, only=None) -> DataFrame:
    return detect.detect(events(spark, folder), mode=mode, only=only)


def ranges(spark, folder) -> DataFrame:
    sql = oracle.RANGES.replace(" nation ", " {nation} ").replace(" region ", " {region} ")
    return spark.sql(
        sql.replace('"end"', "`end`"), nation=table(spark, folder, "nation"), region=table(spark, folder, "region")
    )


EV = oracle.base(upto="ev")
AL = oracle.base()
ALERT_COLUMNS = "alert_id, event_id, ts, rule_id, rule_name, severity, mitre, source_ip, geo_ip"
ALERT_LIST = ALERT_COLUMNS.split(", ")

# --- Parsing -----------------------------------------------------------------------------


@query("parse_events", EV + f"SELECT event_id, ts, source, category, raw, {', '.join(ALL_FIELDS)} FROM ev")
def _(spark, folder):
    return events(spark, folder)


def _fields_of(category: str, columns: str) -> None:
    sql = EV + f"SELECT event_id, {columns} FROM ev WHERE category = '{category}'"

    @query(f"{category}_fields", sql)
    def _(spark, folder):
        return events(spark, folder).filter(F.col("category") == category).select("event_id", *columns.split(", "))


_fields_of("auth", "process, pid, message, src_ip")
_fields_of("web", "src_ip, method, path, query, full_uri, status, size")
_fields_of("kernel", "message")
_fields_of("suricata", "signature, signature_id, src_ip, dest_ip, proto, http_method, http_uri")
_fields_of("syslog", "priority, message")
_fields_of("generic", "message")


_EVE = oracle.base(upto="ev", logs=derived.for_duckdb(derived.EVE)) + """SELECT event_id, signature_id,
 coalesce(json_extract_string(raw, '$.alert.http.http_method'), json_extract_string(raw, '$.http.http_method'), '') AS http_method,
 coalesce(json_extract_string(raw, '$.alert.http.http_uri'), json_extract_string(raw, '$.http.http_uri'), '') AS http_uri
FROM ev WHERE category = 'suricata'"""


@query("suricata_fields_documented", _EVE)
def _(spark, folder):
    parsed = parse(lines(spark, folder, derived.EVE), documented_http=True)
    return parsed.filter(F.col("category") == "suricata").select("event_id", "signature_id", "http_method", "http_uri")


@query("url_decode_query", EV + "SELECT event_id, split_part(full_uri, '?', 2) AS encoded, query FROM ev WHERE category = 'web'")
def _(spark, folder):
    web = events(spark, folder).filter(F.col("category") == "web")
    encoded = F.split_part("full_uri", F.lit("?"), F.lit(2))
    return web.select("event_id", encoded.alias("encoded"), "query")


@query("response_bytes", EV + "SELECT event_id, CAST(nullif(trim(regexp_extract(raw, "
       f"{oracle.quote(constants.WEB_LINE)}, 6)), '') AS BIGINT) AS bytes FROM ev WHERE category = 'web'")
def _(spark, folder):
    web = events(spark, folder).filter(F.col("category") == "web")
    return web.select("event_id", response_bytes().alias("bytes"))


@query("tls_fields", EV + f"SELECT event_id, ja3, sni, tls_version FROM ({oracle.TLS}) t")
def _(spark, folder):
    raw = F.col("raw")
    tls = lines(spark, folder).filter(F.contains(raw, F.lit(fixed.TLS_MARKER)))
    return tls.select(
        "event_id", text.ja3(raw).alias("ja3"), text.sni(raw).alias("sni"),
        text.tls_version(raw).alias("tls_version"),
    )


@query("sni_entropy", EV + f"SELECT event_id, label, round({oracle.entropy('label')}, 6) AS entropy FROM "
       f"(SELECT event_id, split_part(sni, '.', 1) AS label FROM ({oracle.TLS}) t) l")
def _(spark, folder):
    raw = F.col("raw")
    tls = lines(spark, folder).filter(F.contains(raw, F.lit(fixed.TLS_MARKER)))
    label = tls.select("event_id", text.first_label(text.sni(raw)).alias("label"))
    return label.select("event_id", "label", F.round(text.entropy(F.col("label")), 6).alias("entropy"))


@query("fields_json_roundtrip", EV + "SELECT event_id, message, src_ip, status FROM ev")
def _(spark, folder):
    stored = events(spark, folder).select("event_id", fields_json().alias("fields"))
    back = stored.withColumn("fields", fields_from_json(F.col("fields")))
    return back.select("event_id", "fields.message", "fields.src_ip", "fields.status")


# --- Sources and tables ------------------------------------------------------------------


def _by_source(rows: DataFrame) -> DataFrame:
    """Lines as ``value`` with their source as a folder name."""
    return rows.withColumns({"folder": F.translate("source", ":", "_"), "value": F.col("raw")})


def _watched(rows: DataFrame, root: str, below: str = "") -> list[tuple[str, str]]:
    """Folder and name of every source of the derived lines."""
    sources_seen = [r[0] for r in rows.select("source").distinct().collect()]  # eight names
    return [(f"{root}/folder={name.replace(':', '_')}{below}", name) for name in sorted(sources_seen)]


@query("watched_files", f"SELECT source, raw, count(*) AS n FROM ({oracle.LOGS}) l GROUP BY ALL")
def _(spark, folder):
    written = new_path(spark, "watched")
    _by_source(lines(spark, folder)).select("folder", "value").write.partitionBy("folder").text(written)
    return sources.read_watched(spark, _watched(lines(spark, folder), written)).groupBy("source", "raw").agg(F.count("*").alias("n"))


@query("syslog_records", "SELECT event_id, 'syslog:10.1.0.' || CAST(user_id % 250 AS STRING) AS source, "
       "'<' || CAST(user_id % 192 AS STRING) || '>job ' || event_type AS raw FROM events")
def _(spark, folder):
    records = table(spark, folder, "events").selectExpr(
        "event_id", "'10.1.0.' || CAST(user_id % 250 AS STRING) AS sender_ip",
        "' <' || CAST(user_id % 192 AS STRING) || '>job ' || event_type || '\\n' AS line",
    )
    return sources.syslog_records(records)


@query("eve_alert_lines", f"SELECT event_id, raw FROM ({oracle.LOGS}) l WHERE raw LIKE '%\"event_type\":\"alert\"%'")
def _(spark, folder):
    feed = lines(spark, folder).filter(F.col("source") == "suricata")
    return sources.eve_alerts(feed).select("event_id", "raw")


FAST = f"WITH fl AS ({derived.for_duckdb(derived.FASTLOG)}), " \
       r"fa AS (SELECT event_id, raw, regexp_extract(raw, '\[1:(\d+):(\d+)\] (.*?) \[\*\*\]', ['sid', 'rev', 'msg']) AS p, " \
       r"regexp_extract(raw, 'Classification: ([^\]]*)', 1) AS class, regexp_extract(raw, '\} (\S+) ->', 1) AS src " \
       r"FROM fl WHERE contains(raw, '[**]')) "


def _fastlog(spark, folder):
    return spark.sql(derived.for_spark(derived.FASTLOG), events=table(spark, folder, "events"))


@query("fastlog_alerts", FAST + "SELECT event_id, CAST(p.sid AS INT) AS sid, CAST(p.rev AS INT) AS rev, p.msg AS msg, class, src, "
       "strptime(split_part(raw, ' ', 1), '%m/%d/%Y-%H:%M:%S.%f') AS seen_at FROM fa")
def _(spark, folder):
    return fastlog.parse_fastlog(_fastlog(spark, folder)).select("event_id", "sid", "rev", "msg", "class", "src", "seen_at")


@query("fastlog_counts", FAST + "SELECT CAST(1 AS INT) AS gid, CAST(p.sid AS INT) AS sid, CAST(p.rev AS INT) AS rev, p.msg AS msg, count(*) AS hits "
       "FROM fa GROUP BY ALL")
def _(spark, folder):
    return fastlog.counts_by_signature(fastlog.parse_fastlog(_fastlog(spark, folder)))


@query("fastlog_word", FAST + "SELECT event_id, raw FROM fl WHERE raw ILIKE '%scan%'")
def _(spark, folder):
    return fastlog.with_word(_fastlog(spark, folder), "SCAN")


@query("stored_events", AL + "SELECT event_id, source, lower(source) AS source_lc, category, CAST(ts AS DATE) AS dt, "
       "CASE WHEN event_id IN (SELECT event_id FROM alerts) THEN 1 ELSE 0 END AS has_alert FROM ev")
def _(spark, folder):
    found = stage(enrich.unlocated(alerts(spark, folder)), "alerts")
    path = new_path(spark, "events")
    store.append_events(detect.flag_events(events(spark, folder), found), path)
    return store.read_events(spark, path).select("event_id", "source", "source_lc", "category", "dt", "has_alert")


@query("stored_alerts", AL + "SELECT alert_id, event_id, ts, rule_id, severity, source_ip FROM alerts")
def _(spark, folder):
    path = new_path(spark, "alerts")
    store.append_alerts(enrich.unlocated(alerts(spark, folder)), path)
    return store.read_alerts(spark, path).select("alert_id", "event_id", "ts", "rule_id", "severity", "source_ip")


@query("alerts_older_layout", AL + "SELECT alert_id, rule_id, CASE WHEN alert_id % 2 = 0 THEN source_ip END AS source_ip, "
       "CAST(NULL AS VARCHAR) AS country FROM alerts")
def _(spark, folder):
    """Half of the alerts from a table written before address and location existed."""
    path = new_path(spark, "alerts")
    found = stage(alerts(spark, folder), "alerts")
    even = F.col("alert_id") % 2 == 0
    found.filter(~even).select("alert_id", "event_id", "ts", "rule_id", F.col("ts").cast("date").alias("dt")).write.partitionBy("dt").parquet(path)
    store.append_alerts(found.filter(even), path)
    return store.read_alerts(spark, path).select("alert_id", "rule_id", "source_ip", F.col("geo.country").alias("country"))


def _grown(spark, folder, rows: DataFrame, append, column: str, root: str) -> list[str]:
    """A table that grows by thirds, with a snapshot after each, twelve days apart."""
    rows, taken = stage(rows, "rows"), []
    for k in range(3):
        append(rows.filter(F.pmod(F.col(column), F.lit(3)) == k), f"{root}/table")
        taken.append(snapshots.make_snapshot(spark, f"{root}/table", f"{root}/saved", datetime(2024, 5, 1 + 12 * k, tzinfo=timezone.utc)))
    return taken


@query("snapshot_restored", AL + f"SELECT {ALERT_COLUMNS.replace('geo_ip', 'description')}, CAST(ts AS DATE) AS dt, "
       "CASE WHEN alert_id % 3 < 2 THEN 'second' ELSE 'last' END AS snapshot FROM alerts")
def _(spark, folder):
    """The second snapshot over the table as it is now, then the last one over that."""
    root = new_path(spark, "snapshots")
    taken = _grown(spark, folder, enrich.unlocated(alerts(spark, folder)), store.append_alerts, "alert_id", root)
    now = datetime(2024, 6, 1, tzinfo=timezone.utc)
    snapshots.restore_snapshot(spark, taken[1], f"{root}/table", force=True, now=now)
    second = stage(store.read_alerts(spark, f"{root}/table"), "second")
    saved = snapshots.restore_snapshot(spark, taken[2], f"{root}/table", force=True, now=now + timedelta(days=1))
    if snapshots.read_snapshot(spark, saved).count() != second.count():
        raise RuntimeError("what a restore replaces must be saved")
    rest = store.read_alerts(spark, f"{root}/table").join(second, "alert_id", "left_anti").withColumn("snapshot", F.lit("last"))
    return second.withColumn("snapshot", F.lit("second")).unionByName(rest).select(*ALERT_LIST[:-1], "description", "dt", "snapshot")


@query("snapshots_expired", AL + f"SELECT event_id, ts, source, lower(source) AS source_lc, category, raw, {', '.join(ALL_FIELDS)}, "
       "CASE WHEN event_id IN (SELECT event_id FROM alerts) THEN 1 ELSE 0 END AS has_alert, 2 AS kept FROM ev WHERE event_id % 3 < 2")
def _(spark, folder):
    """Events as the middle snapshot holds them, after the one it shares data with has expired."""
    root = new_path(spark, "snapshots")
    found = stage(enrich.unlocated(alerts(spark, folder)), "alerts")
    taken = _grown(spark, folder, detect.flag_events(events(spark, folder), found), store.append_events, "event_id", root)
    snapshots.expire_snapshots(spark, f"{root}/saved", 14, datetime(2024, 5, 26, tzinfo=timezone.utc))
    kept = len(snapshots.list_snapshots(spark, f"{root}/saved"))
    snapshots.restore_snapshot(spark, taken[1], f"{root}/again")
    return store.read_events(spark, f"{root}/again").select("event_id", "ts", "source", "source_lc", "category", "raw", *ALL_FIELDS, "has_alert", F.lit(kept).alias("kept"))


# A third of the lines a run; the second is broken off after its alerts were written, and repeated last.
THIRD = "event_id * 3 // (SELECT max(event_id) + 1 FROM events)"
_RUNS = [oracle.base(logs=f"SELECT * FROM ({oracle.LOGS}) l WHERE {THIRD} = {k}") for k in range(3)]


class BrokenOff(Exception):
    pass


class Breaking(RunTables):
    """Tables whose runs end between the writing of alerts and that of events."""

    def write(self, claim, events, alerts):
        store.append_alerts(alerts, self.path("alerts", f"run={claim.number}"), "overwrite")
        raise BrokenOff


@query("committed_runs", "SELECT what, ts, name, n FROM (" + " UNION ALL ".join(
    f"SELECT * FROM ({run} SELECT 'alert' AS what, ts, rule_id AS name, 1 AS n FROM alerts UNION ALL "
    "SELECT 'event', ts, category, CASE WHEN event_id IN (SELECT event_id FROM alerts) THEN 1 ELSE 0 END FROM ev) r" for run in _RUNS)
    + ") a UNION ALL SELECT 'ids', NULL, 'distinct, first, last and alerted without event', count(*) FROM events")
def _(spark, folder):
    tables, root = [], new_path(spark, "runs")
    logs = stage(lines(spark, folder), "lines")
    last = logs.agg(F.max("event_id")).first()[0]
    part = [logs.filter(F.call_function("div", F.col("event_id") * 3, F.lit(last + 1)) == k) for k in range(3)]
    good = RunTables(spark, root)
    jobs.run_batch(part[0], good, "first")
    try:
        jobs.run_batch(part[1], Breaking(spark, root), "second")
    except BrokenOff:
        tables.append(good.alerts().count() + good.events().count())
    _, alerts_seen = jobs.run_batch(part[2], good, "third")
    if tables[0] + alerts_seen.filter(F.col("event_id").isNull()).count() >= jobs.run_batch(part[1], good, "second")[0].count() * 3:
        raise RuntimeError("a run that was not committed could be read")
    stored, found = jobs.run_batch(part[0], good, "first")  # committed before: nothing changes
    unknown = found.join(stored, "event_id", "left_anti").count()
    ids = stored.agg(F.countDistinct("event_id").alias("d"), F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    whole = (F.col("a") == 0) & (F.col("b") == F.col("d") - 1) & F.lit(unknown == 0)
    none = F.lit(None).cast("timestamp_ntz").alias("ts")
    return (found.select(F.lit("alert").alias("what"), "ts", F.col("rule_id").alias("name"), F.lit(1).cast("bigint").alias("n"))
            .unionByName(stored.select(F.lit("event").alias("what"), "ts", F.col("category").alias("name"), F.col("has_alert").cast("bigint").alias("n")))
            .unionByName(ids.select(F.lit("ids").alias("what"), none, F.lit("distinct, first, last and alerted without event").alias("name"),
                                    F.when(whole, F.col("d")).otherwise(-1).alias("n"))))


@query("submit_result", f"WITH logs AS (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'api' ELSE source END AS source, raw FROM ({oracle.LOGS}) l "
       "WHERE event_id % 7 <> 0), " + AL[AL.index("ev AS ("):] + "SELECT e.event_id, count(rule_id) AS alerts FROM ev e "
       "LEFT JOIN alerts a ON a.event_id = e.event_id GROUP BY 1")
def _(spark, folder):
    records = lines(spark, folder).withColumns({
        "source": F.when(F.col("event_id") % 3 != 0, F.col("source")),
        "raw": F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("raw")),
    })
    return jobs.submit(records)


# --- Cleaning ----------------------------------------------------------------------------

_TRIMMED = "trim(raw, ' ' || chr(9))"


@query("clean_lines", f"SELECT event_id, source, length(raw) AS n_chars, md5(raw) AS digest FROM (SELECT event_id, source, "
       f"regexp_replace(substr({_TRIMMED}, 1, 16384), chr(27) || '\\[[0-9;]*m', '', 'g') AS raw "
       f"FROM ({derived.for_duckdb(derived.DIRTY)}) d WHERE {_TRIMMED} <> '') c")
def _(spark, folder):
    cleaned = clean.clean(lines(spark, folder, derived.DIRTY), limited=False)
    return cleaned.select("event_id", "source", F.length("raw").cast("bigint").alias("n_chars"), F.md5("raw").alias("digest"))


@query("rate_limit", oracle.RATE_LIMIT)
def _(spark, folder):
    return clean.rate_limit(lines(spark, folder, ts=derived.SPARK_FAST_TS)).select("source", "event_id")


# --- Rules -------------------------------------------------------------------------------


def _rule_queries() -> None:
    wanted = [(r.id, detect.REFERENCE) for r in rules.BUILT_IN]
    wanted += [(r.id, detect.DOCUMENTED) for r in rules.BUILT_IN if r.threshold is not None]
    for rule_id, mode in wanted:
        name = "rule_" + rule_id.lower().replace("-", "") + ("_documented" if mode == detect.DOCUMENTED else "")
        sql = oracle.base(mode) + f"SELECT {ALERT_COLUMNS} FROM alerts WHERE rule_id = '{rule_id}'"

        @query(name, sql)
        def _(spark, folder, rule_id=rule_id, mode=mode):
            return alerts(spark, folder, mode, (rule_id,)).select(ALERT_LIST)


_rule_queries()

for _mode, _name in ((detect.REFERENCE, "alerts_all"), (detect.DOCUMENTED, "alerts_all_documented")):
    @query(_name, oracle.base(_mode) + f"SELECT {ALERT_COLUMNS}, description FROM alerts")
    def _(spark, folder, mode=_mode):
        return alerts(spark, folder, mode).select(*ALERT_LIST, "description")


def _path_rules() -> tuple[rules.Rule, ...]:
    """Two rules with matches of their own that feed one counter by path."""
    def path():
        return F.col("path")

    missing = rules.Rule("WEB-201", "Missing page", "d", "LOW", "web", None, lambda: (F.col("category") == "web") & (F.col("status") == 404),
                         rules.WindowCount("path_errors", 5, 40), path)
    failing = rules.Rule("WEB-202", "Failing page", "d", "MEDIUM", "web", None, lambda: (F.col("category") == "web") & F.col("status").isin(403, 404, 500),
                         rules.WindowCount("path_errors", 8, 40), path)
    return rules.with_rule(failing, rules.with_rule(missing))


# Both rules record into the counter, the first one first; a row sees the records up to its own.
RULE_CUSTOM_KEY = AL.rstrip() + ", recs AS (SELECT event_id, ts, path, 1 AS p, 'WEB-201' AS rule_id FROM ev WHERE category = 'web' AND status = 404 " \
    "UNION ALL SELECT event_id, ts, path, 2, 'WEB-202' FROM ev WHERE category = 'web' AND status IN (403, 404, 500)), " \
    "seen AS (SELECT a.event_id, a.rule_id, count(*) AS n FROM recs a JOIN recs b ON b.path = a.path AND b.ts >= a.ts - INTERVAL 40 SECONDS " \
    "AND (b.ts < a.ts OR (b.event_id = a.event_id AND b.p <= a.p)) GROUP BY 1, 2) " \
    "SELECT event_id, rule_id FROM seen WHERE n >= CASE rule_id WHEN 'WEB-201' THEN 5 ELSE 8 END"


@query("rule_custom_key", RULE_CUSTOM_KEY)
def _(spark, folder):
    return detect.detect(events(spark, folder), _path_rules(), only=("WEB-201", "WEB-202")).select("event_id", "rule_id")


@query("rule_custom", AL + "SELECT event_id, source_ip, severity FROM (SELECT event_id, src_ip AS source_ip, 'LOW' AS severity, "
       "count(*) OVER (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN INTERVAL 30 SECONDS PRECEDING AND CURRENT ROW) AS n "
       "FROM ev WHERE status >= 500) x WHERE n >= 3")
def _(spark, folder):
    rule = rules.Rule(
        "WEB-100", "Server Errors", "Many server errors for one address.", "LOW", "web", None,
        lambda: (F.col("category") == "web") & (F.col("status") >= 500), rules.WindowCount("web_5xx", 3, 30),
    )
    found = detect.detect(events(spark, folder), rules.with_rule(rule), only=("WEB-100",))
    return found.select("event_id", "source_ip", "severity")


# Rules are switched off and edited by what they did on the data: noisy ones off, rare ones raised.
_OVERRIDES = "SELECT rule_id AS id, count(*) <= 700 AS enabled, CAST(NULL AS STRING) AS name, " \
             "'rare: ' || rule_id AS description, CASE WHEN count(*) <= 100 THEN 'CRITICAL' END AS severity FROM {0} GROUP BY rule_id"


def _overrides(spark, folder):
    return stage(spark.sql(_OVERRIDES.format("{alerts}"), alerts=alerts(spark, folder)), "overrides")


OV = AL.rstrip() + f", overrides AS ({_OVERRIDES.format('alerts')}) "


@query("rules_overridden", OV + "SELECT a.alert_id, a.rule_id, coalesce(o.description, a.description) AS description, "
       "coalesce(o.severity, a.severity) AS severity FROM alerts a JOIN overrides o ON o.id = a.rule_id WHERE o.enabled")
def _(spark, folder):
    edited = rules.with_overrides(_overrides(spark, folder))
    # positions in the edited set differ: number alerts as in the whole set
    place = {r.id: n for n, r in enumerate(rules.BUILT_IN, 1)}
    number = F.create_map(*[F.lit(v) for pair in place.items() for v in pair])
    found = detect.detect(events(spark, folder), edited, mode=detect.REFERENCE)
    alert_id = F.col("event_id") * detect.RULE_SLOTS + F.try_element_at(number, F.col("rule_id"))
    return found.select(alert_id.alias("alert_id"), "rule_id", "description", "severity")


@query("rule_catalogue_edited", OV + "SELECT r.id, r.name, coalesce(o.description, r.description) AS description, "
       "coalesce(o.severity, r.severity) AS severity, r.category, r.mitre FROM rules r LEFT JOIN overrides o ON o.id = r.id "
       "WHERE coalesce(o.enabled, TRUE)")
def _(spark, folder):
    edited = rules.edited_catalogue(rules.catalogue(spark), _overrides(spark, folder))
    return edited.drop("position")


@query("rule_catalogue_counts", OV + "SELECT count(*) AS total, count(*) FILTER (coalesce(o.enabled, TRUE)) AS active, "
       "count(*) FILTER (r.severity = 'CRITICAL') AS critical, count(*) FILTER (r.severity = 'HIGH') AS high "
       "FROM rules r LEFT JOIN overrides o ON o.id = r.id")
def _(spark, folder):
    return rules.catalogue_counts(rules.catalogue(spark), _overrides(spark, folder))


@query("rule_search", AL + "SELECT r.id, r.name, count(a.alert_id) AS alerts FROM rules r LEFT JOIN alerts a ON a.rule_id = r.id "
       "WHERE r.category = 'auth' AND (lower(r.id) LIKE '%brute%' OR lower(r.name) LIKE '%brute%' OR lower(r.description) LIKE '%brute%') "
       "GROUP BY 1, 2")
def _(spark, folder):
    found = rules.search(rules.catalogue(spark), "auth", "BRUTE")
    counts = alerts(spark, folder).groupBy(F.col("rule_id").alias("id")).agg(F.count("*").alias("n"))
    return found.join(counts, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("alerts"))


# --- Signatures --------------------------------------------------------------------------

_SIGS = oracle.rows([(s[0], s[1], s[8]) for s in fixed.SIGNATURES])


def _signature_test(s: tuple) -> str:
    sid, _, proto, port, field, pattern, nocase, negated, _ = s
    if field == "icmp_type":
        test = f"icmp_type = {pattern}"
    elif field == "tcp_flags":
        test = {"S": "tcp_flags = 2", "F,12": "(tcp_flags & 63) = 1", "FPU": "tcp_flags = 41"}[pattern]
    else:
        test = f"contains({f'lower({field})' if nocase else field}, {oracle.quote(pattern.lower() if nocase else pattern)})"
    at = f" AND dest_port = {port}" if port else ""
    return f"SELECT flow_id, src_ip, dest_ip, CAST({sid} AS INT) AS sid FROM flows WHERE proto = '{proto}'{at} AND {'NOT ' if negated else ''}{test}"


SIG = f"WITH flows AS ({derived.for_duckdb(derived.FLOWS)}), sigs(sid, msg, class) AS ({_SIGS}), " \
      f"hits AS ({' UNION ALL '.join(_signature_test(s) for s in fixed.SIGNATURES)}) "


def _hits(spark, folder):
    return signatures.match_signatures(lines(spark, folder, derived.FLOWS))


@query("signature_hits", SIG + "SELECT flow_id, src_ip, dest_ip, sid FROM hits")
def _(spark, folder):
    return _hits(spark, folder).select("flow_id", "src_ip", "dest_ip", "sid")


@query("signature_counts", SIG + "SELECT CAST(s.sid AS INT) AS sid, msg, class, count(*) AS hits FROM hits h JOIN sigs s ON s.sid = h.sid GROUP BY ALL")
def _(spark, folder):
    return signatures.signature_counts(_hits(spark, folder))


@query("signature_classes", SIG + "SELECT class, count(*) AS hits FROM hits h JOIN sigs s ON s.sid = h.sid GROUP BY class")
def _(spark, folder):
    return signatures.class_counts(_hits(spark, folder))


def _rule_line(s: tuple) -> str:
    """A signature in the language of rule files."""
    sid, msg, proto, port, field, pattern, nocase, negated, class_ = s
    if field in ("icmp_type", "tcp_flags"):
        test = f"itype:{pattern};" if field == "icmp_type" else f"flags:{pattern};"
    else:
        shown = "".join(f"|{ord(c):02x}|" if c in "|;\"\\" else c for c in pattern)
        place = {"http_uri": " http_uri;", "user_agent": " http_user_agent;", "payload": ""}[field]
        test = f"content:{'!' if negated else ''}\"{shown}\";{place}{' nocase;' if nocase else ''}"
    return f"alert {proto} any any -> any {port or 'any'} (msg:\"{msg}\"; {test} classtype:{class_}; sid:{sid}; rev:1;)"


@query("signature_rules_from_text", SIG + "SELECT flow_id, src_ip, dest_ip, sid FROM hits")
def _(spark, folder):
    text = ["# web", "", *[_rule_line(s) for s in fixed.SIGNATURES]]
    found = rulefile.match_rules(lines(spark, folder, derived.FLOWS), rulefile.parse_rules(text))
    return found.select("flow_id", "src_ip", "dest_ip", "sid")


# A thousand contents: pages by number, every third one in any case and at one port only.
@query("signature_many_contents", f"WITH flows AS ({derived.for_duckdb(derived.FLOWS)}), k AS (SELECT unnest(range(1000)) AS k) "
       "SELECT flow_id, CAST(9000 + k AS INT) AS sid FROM flows JOIN k ON proto = 'http' AND CASE WHEN k % 3 = 0 THEN dest_port = 5000 AND "
       "contains(lower(http_uri), 'page/' || k) ELSE contains(http_uri, 'page/' || k) END "
       "AND NOT (k % 5 = 0 AND contains(user_agent, 'Mozilla'))")
def _(spark, folder):
    text = []
    for k in range(1000):
        content = f'content:"PAGE/{k}"; http_uri; nocase;' if k % 3 == 0 else f'content:"page|2f|{k}"; http_uri;'
        not_for = 'content:!"Mozilla"; http_user_agent;' if k % 5 == 0 else ""
        text.append(f'alert http any any -> any {5000 if k % 3 == 0 else "any"} (msg:"Page \\"{k}\\""; {content} {not_for} classtype:web; sid:{9000 + k}; rev:2;)')
    return rulefile.match_rules(lines(spark, folder, derived.FLOWS), rulefile.parse_rules(text)).select("flow_id", "sid")


# --- Windows -----------------------------------------------------------------------------


@query("trailing_count", EV + "SELECT event_id, key, count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS "
       "PRECEDING AND CURRENT ROW) AS recent FROM (SELECT event_id, ts, coalesce(src_ip, 'unknown') AS key FROM ev) e")
def _(spark, folder):
    key = F.coalesce("src_ip", F.lit(fixed.UNKNOWN_KEY)).alias("key")
    seen = stage(events(spark, folder).select("event_id", "ts", key), "seen")
    counts = correlate.trailing_count(seen, "key", clock.micros(F.col("ts")), fixed.WINDOW_SECONDS)
    return seen.select("event_id", "key").join(counts, "event_id")


# --- Enrichment and notification ---------------------------------------------------------


@query("lookup_keys", EV + f"SELECT event_id, nullif(regexp_extract(coalesce(nullif(src_ip, ''), raw), '{oracle.IP}', 1), '') AS geo_ip FROM ev")
def _(spark, folder):
    return events(spark, folder).select("event_id", net.lookup_key(F.col("src_ip"), F.col("raw")).alias("geo_ip"))


@query("private_addresses", EV + f"SELECT src_ip, regexp_matches(src_ip, '{oracle.PRIVATE}') AS private, count(*) AS n FROM ev "
       "WHERE src_ip IS NOT NULL GROUP BY ALL")
def _(spark, folder):
    seen = events(spark, folder).filter(F.col("src_ip").isNotNull())
    return seen.groupBy("src_ip").agg(F.count("*").alias("n")).withColumn("private", net.is_private(F.col("src_ip")))


def _located(spark, folder):
    return jobs.located(alerts(spark, folder), ranges(spark, folder))


GEO = oracle.with_geo()


@query("geo_enrich", GEO + "SELECT alert_id, rule_id, source_ip, country, region, city, isp, org FROM geo")
def _(spark, folder):
    return _located(spark, folder).select("alert_id", "rule_id", "source_ip", "geo.*")


@query("alerts_by_location", GEO + "SELECT coalesce(nullif(concat_ws(', ', nullif(city, ''), nullif(region, ''), nullif(country, '')), ''), "
       "'Unknown') AS location, count(*) AS n FROM geo GROUP BY 1")
def _(spark, folder):
    place = severity.location(F.col("geo")).alias("location")
    return _located(spark, folder).groupBy(place).agg(F.count("*").alias("n"))


@query("geo_nested", f"WITH ranges AS ({oracle.NESTED}), v AS (SELECT host, CAST(3325256704 + host AS BIGINT) AS number FROM ({oracle.VISITORS}) h) "
       "SELECT '198.51.' || CAST(100 + host // 256 AS VARCHAR) || '.' || CAST(host % 256 AS VARCHAR) AS geo_ip, arg_max(country, start * 1000000 - (\"end\" - start)) AS country, "
       "arg_max(city, start * 1000000 - (\"end\" - start)) AS city FROM v JOIN ranges ON number BETWEEN start AND \"end\" GROUP BY host")
def _(spark, folder):
    sql = oracle.NESTED.replace("FROM region", "FROM {region}").replace("FROM nation JOIN region", "FROM {nation} JOIN {region}")
    known = spark.sql(sql.replace('"end"', "`end`"), nation=table(spark, folder, "nation"), region=table(spark, folder, "region"))
    host = F.col("c_custkey") % 400
    address = F.concat(F.lit("198.51."), (F.lit(100) + F.call_function("div", host, F.lit(256))).cast("string"), F.lit("."), (host % 256).cast("string"))
    found = enrich.locate(table(spark, folder, "customer").select(address.alias("geo_ip")), known)
    return found.select("geo_ip", "geo.country", "geo.city")


_FAMILIES = oracle.rows(constants.BAD_JA3)


@query("ja3_blocklist", EV + f"SELECT event_id, b.ja3, family FROM ({oracle.TLS}) t JOIN ({_FAMILIES}) b(ja3, family) ON b.ja3 = t.ja3")
def _(spark, folder):
    listed = spark.createDataFrame(fixed.BAD_JA3, "ja3 string, family string")
    return enrich.known_clients(lines(spark, folder), listed).select("event_id", "ja3", "family")


@query("min_severity_filter", AL + "SELECT alert_id, severity FROM alerts WHERE severity IN ('HIGH', 'CRITICAL')")
def _(spark, folder):
    return alerts(spark, folder).filter(severity.at_least(F.col("severity"), "HIGH")).select("alert_id", "severity")


@query("notify_payload", GEO + f"SELECT alert_id, {oracle.payload()} AS payload FROM geo WHERE severity IN ('HIGH', 'CRITICAL')")
def _(spark, folder):
    return jobs.outbox(_located(spark, folder))


# --- Reports -----------------------------------------------------------------------------

RECENT = "SELECT event_id, ts, source, category, raw FROM ev {where} ORDER BY event_id DESC LIMIT {n}"


def _recent(name, where, n=fixed.RECENT_EVENTS, **chosen):
    @query(name, EV + RECENT.format(where=where, n=n))
    def _(spark, folder):
        found = reports.recent_events(events(spark, folder), n, **chosen)
        return found.select("event_id", "ts", "source", "category", "raw")


_recent("recent_events", "")
_recent("recent_events_by_category", "WHERE category = 'web'", category="web")
_recent("recent_events_by_source", "WHERE lower(source) = 'apache'", source="APACHE")
_recent("recent_events_by_both", "WHERE category = 'auth' AND lower(source) = 'auth'", category="auth", source="Auth")


@query("recent_events_all", EV + "SELECT event_id, category FROM ev")
def _(spark, folder):
    return reports.recent_events(events(spark, folder), -1).select("event_id", "category")


@query("recent_alerts", AL + f"SELECT {ALERT_COLUMNS} FROM alerts ORDER BY alert_id DESC LIMIT 100")
def _(spark, folder):
    return reports.recent_alerts(alerts(spark, folder)).select(ALERT_LIST)


@query("recent_alerts_by_severity", AL + f"SELECT {ALERT_COLUMNS} FROM alerts WHERE severity = 'CRITICAL' ORDER BY alert_id DESC LIMIT 100")
def _(spark, folder):
    return reports.recent_alerts(alerts(spark, folder), severity="CRITICAL").select(ALERT_LIST)


@query("overview_alerts", AL + "SELECT alert_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS time, rule_name, severity, event_id "
       "FROM alerts ORDER BY alert_id DESC LIMIT 8")
def _(spark, folder):
    return reports.overview_alerts(alerts(spark, folder))


@query("page_of_alerts", AL + "SELECT alert_id, rule_id FROM (SELECT * FROM alerts ORDER BY alert_id DESC LIMIT 500) p WHERE severity = 'HIGH'")
def _(spark, folder):
    return reports.page_of_alerts(alerts(spark, folder), "HIGH").select("alert_id", "rule_id")


@query("page_of_events", EV + "SELECT event_id, source FROM (SELECT * FROM ev ORDER BY event_id DESC LIMIT 500) p WHERE category = 'auth'")
def _(spark, folder):
    return reports.page_of_events(events(spark, folder), "auth").select("event_id", "source")


@query("alert_event_join", AL + "SELECT alert_id, rule_id, source, category, ev.raw FROM alerts JOIN ev ON ev.event_id = alerts.event_id")
def _(spark, folder):
    found = stage(alerts(spark, folder), "alerts")
    joined = reports.alert_details(found, events(spark, folder))
    return joined.select("alert_id", "rule_id", "source", "category", "raw")


@query("totals", AL + "SELECT 'events' AS what, count(*) AS n FROM ev UNION ALL SELECT 'alerts', count(*) FROM alerts")
def _(spark, folder):
    return reports.totals(events(spark, folder), alerts(spark, folder))


@query("alerts_by_severity", AL + "SELECT s AS severity, count(alert_id) AS n FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) v(s) "
       "LEFT JOIN alerts ON severity = s GROUP BY s")
def _(spark, folder):
    return reports.alerts_by_severity(alerts(spark, folder))


@query("events_by_category", EV + "SELECT category, count(*) AS n FROM ev GROUP BY category")
def _(spark, folder):
    return reports.events_by_category(events(spark, folder))


# Hours are counted on the table's own times, which span a month.
EV_OWN = f"WITH ev AS (SELECT l.event_id, e.ts, l.source, l.raw FROM ({oracle.LOGS}) l JOIN events e ON e.event_id = l.event_id) "
SINCE = "(SELECT max(ts) FROM ev) - INTERVAL 24 HOURS"


def _own_time(spark, folder):
    """Events at the times of the given table, and its last moment."""
    own = table(spark, folder, "events").select("event_id", "ts")
    last = own.agg(F.max("ts")).first()[0]
    return own, last


@query("events_by_hour", EV_OWN + oracle.HOURLY.format(since=SINCE))
def _(spark, folder):
    return reports.events_by_hour(*_own_time(spark, folder))


@query("events_by_hour_reference", EV_OWN + oracle.HOURLY.format(since=f"date_trunc('day', {SINCE})"))
def _(spark, folder):
    return reports.events_by_hour(*_own_time(spark, folder), whole_day=True)


TOP_IPS = "SELECT src_ip AS ip, count(*) AS n FROM ev WHERE src_ip IS NOT NULL {more} GROUP BY 1 ORDER BY n DESC, ip LIMIT 10"


@query("top_src_ips", EV + TOP_IPS.format(more=""))
def _(spark, folder):
    return reports.top_addresses(events(spark, folder))


@query("top_src_ips_alerted", AL + TOP_IPS.format(more="AND event_id IN (SELECT event_id FROM alerts)"))
def _(spark, folder):
    found = stage(alerts(spark, folder), "alerts")
    return reports.top_addresses(detect.flag_events(events(spark, folder), found), alerted_only=True)


@query("top_src_ip_bars", EV + f"SELECT ip, n, row_number() OVER (ORDER BY n DESC, ip) AS rank, CAST(floor(n * 100.0 / max(n) OVER () + 0.5) AS INT) AS bar "
       f"FROM ({TOP_IPS.format(more='')}) t")
def _(spark, folder):
    return reports.with_bars(reports.top_addresses(events(spark, folder)), "n", "ip").withColumn("rank", F.col("rank").cast("bigint"))


STATS = "SELECT rule_id, rule_name, severity, count(*) AS firing_count FROM alerts GROUP BY ALL ORDER BY firing_count DESC, rule_id LIMIT 20"


@query("rule_stats", AL + STATS)
def _(spark, folder):
    return reports.rule_stats(alerts(spark, folder))


@query("rule_kpis", AL + "SELECT (SELECT count(*) FROM rules) AS rules_configured, arg_max(rule_id, firing_count) AS top_rule, "
       f"max(firing_count) AS top_rule_count, count(*) AS rules_fired, round(avg(firing_count), 1) AS avg_firing FROM ({STATS}) s")
def _(spark, folder):
    return reports.rule_kpis(reports.rule_stats(alerts(spark, folder)), rules.catalogue(spark))


@query("rule_rank", AL + "SELECT rule_id, firing_count, row_number() OVER (ORDER BY firing_count DESC, rule_id) AS rank, "
       f"CAST(floor(firing_count * 100.0 / max(firing_count) OVER () + 0.5) AS INT) AS bar FROM ({STATS}) s WHERE severity = 'HIGH'")
def _(spark, folder):
    ranked = reports.ranked_rules(reports.rule_stats(alerts(spark, folder)), "HIGH")
    return ranked.select("rule_id", "firing_count", F.col("rank").cast("bigint").alias("rank"), "bar")


@query("coverage_by_category", AL + "SELECT r.category, count(DISTINCT r.id) AS rules, count(DISTINCT a.rule_id) AS rules_fired, "
       "count(a.alert_id) AS alerts FROM rules r LEFT JOIN alerts a ON a.rule_id = r.id GROUP BY 1")
def _(spark, folder):
    return reports.category_coverage(rules.catalogue(spark), alerts(spark, folder))


SCENARIOS = AL.rstrip() + f", sc(scenario, mitre) AS ({oracle.rows(constants.SCENARIOS)}), hit AS (SELECT scenario, mitre, " \
    "mitre IN (SELECT a.mitre FROM alerts a WHERE a.mitre IS NOT NULL) OR (mitre = 'T1046' AND EXISTS (SELECT 1 FROM ev WHERE category = 'suricata')) " \
    "AS detected FROM sc) "


def _techniques(spark, folder):
    return reports.detected_techniques(alerts(spark, folder), events(spark, folder))


@query("detection_by_scenario", SCENARIOS + "SELECT scenario, mitre, detected FROM hit")
def _(spark, folder):
    return reports.detection_by_scenario(_techniques(spark, folder))


@query("detection_rate", SCENARIOS + "SELECT count(*) AS scenarios, count(*) FILTER (detected) AS detected, "
       "round(avg(CAST(detected AS INT)) * 100, 1) AS rate FROM hit")
def _(spark, folder):
    return reports.detection_rate(_techniques(spark, folder))


def _json_map(source: str, key: str) -> str:
    return f"(SELECT '{{' || string_agg('\"' || {key} || '\":' || n, ',' ORDER BY {key}) || '}}' FROM ({source}) m)"


def _json_list(source: str, key: str, order: str) -> str:
    return f"(SELECT '[' || string_agg('{{\"{key}\":\"' || {key} || '\",\"count\":' || n || '}}', ',' ORDER BY {order}) || ']' FROM ({source}) l)"


_HOURS = oracle.HOURLY.format(since="(SELECT max(ts) FROM ev) - INTERVAL 24 HOURS")


@query("stats_document", AL + "SELECT '{\"total_events\":' || (SELECT count(*) FROM ev) || ',\"total_alerts\":' || (SELECT count(*) FROM alerts) "
       "|| ',\"by_severity\":' || " + _json_map("SELECT severity, count(*) AS n FROM alerts GROUP BY 1", "severity")
       + " || ',\"by_category\":' || " + _json_map("SELECT category, count(*) AS n FROM ev GROUP BY 1", "category")
       + " || ',\"events_by_hour\":' || " + _json_list(_HOURS, "hour", "hour")
       + " || ',\"top_src_ips\":' || " + _json_list(TOP_IPS.format(more=""), "ip", "n DESC, ip") + " || '}' AS document")
def _(spark, folder):
    parsed = events(spark, folder)
    now = parsed.agg(F.max("ts")).first()[0]
    return reports.stats_document(parsed, alerts(spark, folder), now)


# --- Streams -----------------------------------------------------------------------------


def _stream(spark, folder, ts=derived.SPARK_TS) -> DataFrame:
    """The derived log lines as a file stream over the given table."""
    given = table(spark, folder, "events").schema
    files = spark.readStream.schema(given).option("pathGlobFilter", "events.parquet").parquet(folder)
    return spark.sql(derived.for_spark(derived.LOGS, ts), events=files)


def _finished(stream: DataFrame, label: str, change=None) -> DataFrame:
    """Run the stream over all input and give what its sink holds."""
    root = new_path(stream.sparkSession, label)
    streams.finish(streams.start(stream, streams.batch_folder(f"{root}/out", change), f"{root}/state", True))
    return stream.sparkSession.read.parquet(f"{root}/out").drop("batch")


def _arrive(rows: DataFrame, path: str) -> None:
    """Rows of one round as new files of a stream: each task writes its own, so that each is read by a task of its own."""
    rows.write.mode("append").parquet(path)


def _replay(spark, checkpoint: str) -> None:
    """Make a query repeat its last micro-batch, as after a crash before its commit was noted."""
    files, folder = store.file_at(spark, f"{checkpoint}/commits")
    names = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().isdigit()]
    last = max(names, key=lambda p: int(p.getName()))
    for path in (last, last.getParent().suffix(f"/.{last.getName()}.crc")):
        files.delete(path, False)


@query("stream_events", EV + "SELECT event_id, category, message, src_ip, status FROM ev")
def _(spark, folder):
    out = streams.stream_events(_stream(spark, folder)).select("event_id", "category", "message", "src_ip", "status")
    return _finished(out, "stream_events")


def _stream_alerts(spark, folder, name, mode=detect.REFERENCE, rule_set=rules.BUILT_IN, then=lambda found: found):
    found = streams.counted_alerts(new_path(spark, "counted"), rule_set, mode)
    return _finished(streams.stream_events(_stream(spark, folder)), name, lambda batch, n: then(found(batch, n)))


for _mode, _name in ((detect.REFERENCE, "stream_alerts"), (detect.DOCUMENTED, "stream_alerts_documented")):
    @query(_name, oracle.base(_mode) + f"SELECT {ALERT_COLUMNS} FROM alerts")
    def _(spark, folder, mode=_mode, name=_name):
        return _stream_alerts(spark, folder, name, mode).select(ALERT_LIST)


@query("stream_rule_custom_key", RULE_CUSTOM_KEY)
def _(spark, folder):
    """In four micro-batches, so that counts go on over their borders."""
    root, found = new_path(spark, "rounds"), streams.counted_alerts(new_path(spark, "counted"), _path_rules())
    rows = _in_rounds(lines(spark, folder), 4)
    for k in range(4):
        _arrive(rows.filter(F.col("round") == k).drop("round"), f"{root}/in")
        given = spark.readStream.schema(schema.RAW_LOGS).parquet(f"{root}/in")
        streams.finish(streams.start(streams.stream_events(given), streams.batch_folder(f"{root}/out", found), f"{root}/state", True))
    return spark.read.parquet(f"{root}/out").filter(F.col("rule_id").isin("WEB-201", "WEB-202")).select("event_id", "rule_id")


def _in_rounds(rows: DataFrame, number: int) -> DataFrame:
    """Rows with the round, by event id, in which they come; written once, each round spread over all files."""
    rows = stage(rows.repartition("event_id"), "rounds")
    last = rows.agg(F.max("event_id")).first()[0]
    return rows.withColumn("round", F.call_function("div", F.col("event_id") * number, F.lit(last + 1)))


def _dealt(spark, folder, number: int) -> DataFrame:
    """``_in_rounds`` of the derived lines without their time: the given rows are dealt out, which are shorter than the lines."""
    given = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    last = given.agg(F.max("event_id")).first()[0]
    rows = spark.sql(derived.for_spark(derived.LOGS), events=given.repartition("event_id")).select("event_id", "source", "raw")
    return stage(rows.withColumn("round", F.call_function("div", F.col("event_id") * number, F.lit(last + 1))), "rounds")


# Sixteen arrival times of twenty seconds; a file holds the lines of one source and time.
CHUNK = "event_id * 16 // (SELECT max(event_id) + 1 FROM events)"
CHUNKED = derived.for_duckdb(derived.LOGS, f"TIMESTAMP '2024-01-01 00:00:00' + to_seconds(20 * ({CHUNK}))")


@query("stream_job_from_text", oracle.base(logs=CHUNKED) + "SELECT 'alert' AS what, rule_id AS name, source_ip AS ip, ts, count(*) AS n FROM alerts GROUP BY ALL "
       "UNION ALL SELECT 'event', category, src_ip, ts, count(*) FROM ev GROUP BY ALL UNION ALL SELECT 'flags that differ from the alerts', NULL, NULL, NULL, 0")
def _(spark, folder):
    """Files of all sources land in four rounds; the last micro-batch of both queries is repeated."""
    root = new_path(spark, "text")
    rows = _by_source(_dealt(spark, folder, 16).withColumnRenamed("round", "chunk"))
    tables = RunTables(spark, f"{root}/tables")
    part = F.regexp_extract("_metadata.file_path", r"chunk=(\d+)", 1).cast("int") * 20
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=part)
    watched = _watched(rows, f"{root}/in", "/chunk=*")

    def run():
        lines_in = sources.read_watched(spark, watched, stream=True, ts=ts)
        streams.finish(streams.start(lines_in, landing.land(tables), f"{root}/landing", True))
        streams.finish(streams.start(landing.landed(tables), landing.detect_into(tables), f"{root}/detection", True))

    for k in range(4):
        new = rows.filter(F.call_function("div", F.col("chunk"), F.lit(4)) == k)
        new.repartition("folder", "chunk").sortWithinPartitions("folder", "chunk", "event_id").select("folder", "chunk", "value").write.mode(
            "append").partitionBy("folder", "chunk").text(f"{root}/in")
        run()
    before = tables.claims().count()
    for query_state in ("landing", "detection"):
        _replay(spark, f"{root}/{query_state}")
    run()
    if tables.claims().count() != before:
        raise RuntimeError("a repeated micro-batch claimed another run")
    stored, found = tables.events(), tables.alerts()
    # which rows of one time and address reach a count depends on their order over files; how many do does not
    flagged = stored.join(found.select("event_id").distinct().withColumn("hit", F.lit(1)), "event_id", "full")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("name", "string"), ("ip", "string"), ("ts", "timestamp_ntz"))]
    wrong = flagged.agg(F.count_if(F.coalesce("hit", F.lit(0)) != F.coalesce("has_alert", F.lit(-1))).alias("n"))
    return found.groupBy(F.lit("alert").alias("what"), F.col("rule_id").alias("name"), F.col("source_ip").alias("ip"), "ts").agg(F.count("*").alias("n")).unionByName(
        stored.groupBy(F.lit("event").alias("what"), F.col("category").alias("name"), F.col("src_ip").alias("ip"), "ts").agg(F.count("*").alias("n"))).unionByName(
            wrong.select(F.lit("flags that differ from the alerts").alias("what"), *none, "n"))


# Every 97th row comes one round after its time.
ROUND = "event_id * 5 // (SELECT max(event_id) + 1 FROM events)"
ARRIVAL = f"WITH l AS ({oracle.LOGS}), a AS (SELECT event_id, ts, source, raw, least(4, {ROUND} + CASE WHEN event_id % 97 = 5 THEN 1 ELSE 0 END) AS batch FROM l), " \
    "m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, count(*) AS rows, " \
    "max(max(ts)) OVER (ORDER BY batch) AS newest FROM a GROUP BY batch), " \
    "late AS (SELECT a.* FROM a JOIN m USING (batch) WHERE ts < before - INTERVAL 5 SECONDS) "


def _landed_in_rounds(spark, folder) -> RunTables:
    """Every round is a start of its own from the checkpoint."""
    root = new_path(spark, "late")
    tables = RunTables(spark, f"{root}/tables")
    rows = _in_rounds(lines(spark, folder), 5)
    arrival = F.least(F.lit(4), F.col("round") + F.when(F.col("event_id") % 97 == 5, 1).otherwise(0))
    for k in range(5):
        _arrive(rows.filter(arrival == k).drop("round"), f"{root}/in")
        given = spark.readStream.schema(schema.RAW_LOGS).parquet(f"{root}/in").select("ts", "source", "raw")
        streams.finish(streams.start(given, landing.land(tables, delay=5), f"{root}/state", True))
    return tables


@query("late_rows", ARRIVAL + "SELECT ts, source, raw, batch FROM late")
def _(spark, folder):
    tables = _landed_in_rounds(spark, folder)
    batches = landing.landing_metrics(tables).select("run", "batch")
    return landing.late_lines(tables).join(batches, "run").select("ts", "source", "raw", "batch")


@query("late_row_counts", ARRIVAL + "SELECT m.batch, rows, count(late.batch) AS late, epoch_us(newest) AS newest FROM m LEFT JOIN late ON late.batch = m.batch GROUP BY ALL")
def _(spark, folder):
    return landing.landing_metrics(_landed_in_rounds(spark, folder)).drop("run")


@query("stream_rate_limit", oracle.RATE_LIMIT)
def _(spark, folder):
    """In four micro-batches, so that windows go on over their borders."""
    root, admission = new_path(spark, "admission"), CountedAdmission(new_path(spark, "instants"))
    rows = _in_rounds(lines(spark, folder, ts=derived.SPARK_FAST_TS), 4)
    for k in range(4):
        _arrive(rows.filter(F.col("round") == k).drop("round"), f"{root}/in")
        given = spark.readStream.schema(schema.RAW_LOGS).parquet(f"{root}/in")
        streams.finish(streams.start(given, streams.batch_folder(f"{root}/out", admission.admit), f"{root}/state", True))
    return spark.read.parquet(f"{root}/out").select("source", "event_id")


@query("stream_events_by_hour", "SELECT r.batch, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00:00') AS hour, count(*) AS n FROM events "
       "JOIN (SELECT unnest(range(4)) AS batch) r ON event_id % 4 <= r.batch GROUP BY ALL")
def _(spark, folder):
    """Hours as they stand after each of four micro-batches, all of which bring rows of every hour."""
    root = new_path(spark, "hours")
    given = stage(table(spark, folder, "events").select("event_id", "ts"), "events")
    hours, seen = KeyedCounts(spark, f"{root}/hours", "hour", whole=3), []
    for k in range(4):
        _arrive(given.filter(F.col("event_id") % 4 == k), f"{root}/in")
        rows = spark.readStream.schema(given.schema).parquet(f"{root}/in")
        streams.finish(streams.start(rows, hours.sink(clock.hour_label(F.col("ts"))), f"{root}/state", True))
        seen.append(stage(hours.now(), "version").withColumn("batch", F.lit(k).cast("bigint")))
    return functools.reduce(DataFrame.unionByName, seen)


@query("stream_located_alerts", GEO + "SELECT alert_id, rule_id, country, city FROM geo")
def _(spark, folder):
    """Alerts of a stream, located per micro-batch by the batch join."""
    known = stage(ranges(spark, folder), "ranges")
    found = _stream_alerts(spark, folder, "stream_geo", then=lambda batch: jobs.located(batch, known))
    return found.select("alert_id", "rule_id", "geo.country", "geo.city")


@query("stream_outbox", GEO + f"SELECT alert_id, {oracle.payload()} AS payload FROM geo WHERE severity = 'CRITICAL'")
def _(spark, folder):
    known = stage(ranges(spark, folder), "ranges")
    return _stream_alerts(spark, folder, "stream_outbox", then=lambda batch: jobs.outbox(jobs.located(batch, known), "CRITICAL"))


@query("stream_signature_hits", SIG + "SELECT flow_id, sid FROM hits")
def _(spark, folder):
    given = table(spark, folder, "events").schema
    files = spark.readStream.schema(given).option("pathGlobFilter", "events.parquet").parquet(folder)
    flows = spark.sql(derived.for_spark(derived.FLOWS), events=files)
    return _finished(signatures.match_signatures(flows).select("flow_id", "sid"), "stream_signatures")
