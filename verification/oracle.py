"""SQL statements for DuckDB, written independently of the DataFrame code they check."""

from logwarden import fixed_values as fixed
from verification import constants, derived


def quote(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def rows(values) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in values)


IP = r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"
MATCHED = "CASE WHEN regexp_matches({0}, '(?i)' || {1}) THEN TRUE ELSE FALSE END"

LOGS = derived.for_duckdb(derived.LOGS)


def parsed(logs: str = "logs") -> str:
    """Typed events of a table of log lines."""
    auth, web = quote(constants.AUTH_LINE), quote(constants.WEB_LINE)
    kernel, pri = quote(constants.KERNEL_LINE), quote(constants.PRIORITY_LINE)
    return f"""
SELECT event_id, ts, source, category, raw,
  CASE category WHEN 'auth' THEN regexp_extract(raw, {auth}, 4) END AS process,
  CASE category WHEN 'auth' THEN regexp_extract(raw, {auth}, 5) END AS pid,
  CASE category WHEN 'auth' THEN auth_msg WHEN 'kernel' THEN regexp_extract(raw, {kernel}, 1)
    WHEN 'syslog' THEN trim(regexp_extract(raw, {pri}, 2)) WHEN 'generic' THEN raw END AS message,
  CASE category WHEN 'auth' THEN nullif(regexp_extract(auth_msg, '{IP}', 1), '')
    WHEN 'web' THEN regexp_extract(raw, {web}, 1)
    WHEN 'suricata' THEN coalesce(json_extract_string(js, '$.src_ip'), '') END AS src_ip,
  CASE category WHEN 'web' THEN regexp_extract(raw, {web}, 3) END AS method,
  CASE category WHEN 'web' THEN split_part(uri, '?', 1) END AS path,
  CASE category WHEN 'web' THEN CASE WHEN instr(uri, '?') > 0 THEN url_decode(substr(uri, instr(uri, '?') + 1))
    ELSE '' END END AS query,
  CASE category WHEN 'web' THEN uri END AS full_uri,
  CASE category WHEN 'web' THEN CAST(regexp_extract(raw, {web}, 5) AS INT) END AS status,
  CASE category WHEN 'web' THEN CAST(0 AS INT) END AS size,
  CASE category WHEN 'suricata' THEN coalesce(json_extract_string(js, '$.alert.signature'), '') END AS signature,
  CASE category WHEN 'suricata' THEN CAST(coalesce(json_extract_string(js, '$.alert.signature_id'), '0') AS BIGINT)
    END AS signature_id,
  CASE category WHEN 'suricata' THEN coalesce(json_extract_string(js, '$.dest_ip'), '') END AS dest_ip,
  CASE category WHEN 'suricata' THEN coalesce(json_extract_string(js, '$.proto'), '') END AS proto,
  CASE category WHEN 'suricata' THEN coalesce(json_extract_string(js, '$.alert.http.http_method'), '') END AS http_method,
  CASE category WHEN 'suricata' THEN coalesce(json_extract_string(js, '$.alert.http.http_uri'), '') END AS http_uri,
  CASE category WHEN 'syslog' THEN CAST(regexp_extract(raw, {pri}, 1) AS INT) END AS priority
FROM (
 SELECT *, CASE
   WHEN regexp_matches(raw, {auth}) THEN 'auth' WHEN regexp_matches(raw, {web}) THEN 'web'
   WHEN regexp_matches(raw, {kernel}) THEN 'kernel'
   WHEN json_extract_string(js, '$.event_type') = 'alert' THEN 'suricata'
   WHEN regexp_matches(raw, {pri}) THEN 'syslog' ELSE 'generic' END AS category
 FROM (
  SELECT *, regexp_extract(raw, {auth}, 6) AS auth_msg, regexp_extract(raw, {web}, 4) AS uri,
    CASE WHEN source = 'suricata' AND raw LIKE '{{%' AND json_valid(raw) THEN raw ELSE '{{}}' END AS js
  FROM {logs}) p) c
"""


def entropy(x: str) -> str:
    return (
        f"(CASE WHEN {x} = '' THEN 0.0 ELSE -list_sum(list_transform(list_distinct(string_split({x}, '')), "
        f"lambda c: (length({x}) - length(replace({x}, c, ''))) / length({x})::DOUBLE * "
        f"log2((length({x}) - length(replace({x}, c, ''))) / length({x})::DOUBLE))) END)"
    )


TLS = f"""
SELECT event_id, regexp_extract(raw, '{constants.TLS_JA3}', 1) AS ja3, regexp_extract(raw, '{constants.TLS_SNI}', 1) AS sni,
  regexp_extract(raw, '{constants.TLS_VERSION}', 1) AS tls_version FROM ev WHERE contains(raw, 'TLS_EVENT')
"""

PATTERNS = {
    "AUTH-001": "category = 'auth' AND contains(lower(message), 'failed') AND contains(lower(process), 'ssh')",
    "AUTH-002": f"category = 'auth' AND regexp_matches(message, '(?i)' || {quote(constants.ROOT_ATTEMPT)})",
    "AUTH-003": f"category = 'auth' AND regexp_matches(message, '(?i)' || {quote(constants.ROOT_ACCEPTED)})",
    "AUTH-004": "category = 'auth' AND process = 'sudo' AND contains(lower(message), 'command')",
    "AUTH-005": "category = 'auth' AND contains(lower(message), 'failed')",
    "AUTH-006": f"category = 'auth' AND regexp_matches(message, '(?i)' || {quote(constants.LOGIN_ACCEPTED)})",
    "WEB-001": f"category = 'web' AND regexp_matches(path, '(?i)' || {quote(constants.TRAVERSAL)})",
    "WEB-002": "category = 'web' AND status BETWEEN 400 AND 499",
    "WEB-003": "category = 'web' AND (" + " OR ".join(
        f"regexp_matches({c}, '(?i)' || {quote(constants.SQL_INJECTION)})" for c in ("path", "query", "full_uri")) + ")",
    "WEB-004": "category = 'web' AND status BETWEEN 400 AND 499",
    "SYS-001": "category = 'kernel' AND contains(lower(message), 'oom')",
    "SYS-002": "category = 'kernel' AND contains(lower(message), 'segfault')",
    "NET-001": "event_id IN (SELECT event_id FROM tls WHERE tls_version IN ('0x0301','0x0302') "
               r"OR regexp_matches(tls_version, '^TLSv1($|\.1)'))",
    "NET-002": f"event_id IN (SELECT event_id FROM tls WHERE {entropy(chr(34) + 'lab' + chr(34))} > 3.8)",
    "NET-003": "event_id IN (SELECT event_id FROM tls WHERE ja3 IN ("
               + ", ".join(quote(j) for j, _ in constants.BAD_JA3) + "))",
}
COUNTED = {
    "reference": {"AUTH-001": ("ssh_n", 5), "AUTH-005": ("fail_n", 10), "WEB-002": ("2 * web_n - 1", 20),
                  "WEB-004": ("2 * web_n", 50)},
    "documented": {"AUTH-001": ("ssh_n", 5), "AUTH-005": ("fail_n", 10), "WEB-002": ("web_n", 20),
                   "WEB-004": ("web_n", 50)},
}
# texts as in the catalogue; what they stand for from here
TEXTS = {r[0]: r[1:3] for r in fixed.RULES}
RULE_ROWS = rows([(n, rule, *TEXTS[rule], *kind) for n, (rule, kind) in enumerate(constants.RULE_KINDS.items(), 1)])
RULES_CTE = f"rules(position, id, name, description, severity, category, mitre) AS ({RULE_ROWS})"


def firing(mode: str) -> str:
    """event_id, rule_id of everything that fires."""
    parts = []
    for rule, test in PATTERNS.items():
        if rule in COUNTED[mode]:
            count, least = COUNTED[mode][rule]
            parts.append(f"SELECT event_id, '{rule}' AS rule_id FROM counted WHERE {test} AND {count} >= {least}")
        elif rule == "AUTH-006":
            count = "least(n60, c300)" if mode == "reference" else "c300"
            parts.append(f"SELECT event_id, '{rule}' AS rule_id FROM followed WHERE kind = 0 AND {count} >= 3")
        else:
            parts.append(f"SELECT event_id, '{rule}' AS rule_id FROM ev WHERE {test}")
    return " UNION ALL ".join(parts)


def so_far(x: str, seconds: int, by: str) -> str:
    """Sum of x over the window, of rows of equal time those up to the own one in event order."""
    here = f"PARTITION BY {by}, ts"
    return (f"(sum({x}) OVER (PARTITION BY {by} ORDER BY ts RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND CURRENT ROW) "
            f"- sum({x}) OVER ({here}) + sum({x}) OVER ({here} ORDER BY event_id ROWS UNBOUNDED PRECEDING))")


def base(mode: str = "reference", upto: str = "alerts", logs: str = LOGS) -> str:
    """WITH clause: logs, ev, and with ``upto='alerts'`` also the alerts."""
    ctes = [f"logs AS ({logs})", f"ev AS ({parsed()})"]
    address = "coalesce(src_ip, 'unknown')"
    if upto == "alerts":
        ctes += [
            RULES_CTE,
            f"tls AS (SELECT *, split_part(sni, '.', 1) AS lab FROM ({TLS}) t)",
            "counted AS (SELECT *, "
            + ", ".join(f"{so_far(f'CASE WHEN {PATTERNS[rule]} THEN 1 ELSE 0 END', 60, address)} AS {name}"
                        for rule, name in (("AUTH-001", "ssh_n"), ("AUTH-005", "fail_n"), ("WEB-002", "web_n"))) + " FROM ev)",
            "followed AS (SELECT event_id, kind, "
            f"{so_far('kind', 300, 'key')} AS c300, "
            "last_value(n60 IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n60 "
            "FROM (SELECT event_id, ts, coalesce(src_ip, 'unknown') AS key, 1 AS kind, ssh_n AS n60 FROM counted "
            f"WHERE {PATTERNS['AUTH-001']} UNION ALL SELECT event_id, ts, coalesce(src_ip, 'unknown'), 0, NULL FROM ev "
            f"WHERE {PATTERNS['AUTH-006']}) u)",
            f"fired AS ({firing(mode)})",
            "alerts AS (SELECT f.event_id * 1000 + r.position AS alert_id, f.event_id, e.ts, f.rule_id, "
            "r.name AS rule_name, r.description, r.severity, r.mitre, e.src_ip AS source_ip, "
            f"nullif(regexp_extract(coalesce(nullif(e.src_ip, ''), e.raw), '{IP}', 1), '') AS geo_ip "
            "FROM fired f JOIN rules r ON r.id = f.rule_id JOIN ev e ON e.event_id = f.event_id)",
        ]
    return "WITH " + ", ".join(ctes) + " "


PRIVATE = r"^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|127\.|0\.)"


def ip_number(x: str) -> str:
    return " + ".join(
        f"CAST(split_part({x}, '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5)
    )


# Address ranges out of the nation and region tables: single addresses and one range over several blocks.
RANGES = f"""
SELECT CAST(3325256704 + n_nationkey AS BIGINT) AS start, CAST(3325256704 + n_nationkey AS BIGINT) AS "end",
  n_name AS country, r_name AS region, 'City ' || CAST(n_nationkey AS STRING) AS city,
  CASE WHEN n_nationkey % 2 = 0 THEN 'ISP ' || n_name ELSE '' END AS isp, '' AS org
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 4
UNION ALL
SELECT CAST(3405643776 AS BIGINT), CAST(3405905919 AS BIGINT), n_name, r_name, '', 'ISP wide', 'org'
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 4
"""
GEO_CTE = f"""
ranges AS ({RANGES}),
geo AS (SELECT a.*, CASE WHEN regexp_matches(geo_ip, '{PRIVATE}') THEN 'Internal' ELSE r.country END AS country,
  r.region, CASE WHEN regexp_matches(geo_ip, '{PRIVATE}') THEN 'Private Network' ELSE r.city END AS city,
  CASE WHEN regexp_matches(geo_ip, '{PRIVATE}') THEN 'N/A' ELSE r.isp END AS isp, r.org
 FROM alerts a LEFT JOIN ranges r ON NOT regexp_matches(a.geo_ip, '{PRIVATE}')
  AND ({ip_number('a.geo_ip')}) BETWEEN r.start AND r."end")
"""


def with_geo() -> str:
    return base().rstrip() + ", " + GEO_CTE


# One wide range, ranges of regions in it, and single addresses of nations in those.
NESTED = """
SELECT CAST(3325256704 AS BIGINT) AS start, CAST(3325518847 AS BIGINT) AS "end", 'Outer' AS country, '' AS region, '' AS city, 'wide' AS isp, '' AS org
UNION ALL
SELECT CAST(3325256704 + 64 * r_regionkey AS BIGINT), CAST(3325256704 + 64 * r_regionkey + 59 AS BIGINT), r_name, r_name, '', '', '' FROM region
UNION ALL
SELECT CAST(3325256704 + 64 * n_regionkey + 2 * n_nationkey AS BIGINT), CAST(3325256704 + 64 * n_regionkey + 2 * n_nationkey AS BIGINT),
  n_name, r_name, 'City ' || CAST(n_nationkey AS STRING), '', '' FROM nation JOIN region ON n_regionkey = r_regionkey
"""
# Addresses in and around them, from the customer table.
VISITORS = "SELECT DISTINCT c_custkey % 400 AS host FROM customer"


def json(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


def payload(brand: str = "Security log analytics") -> str:
    mark = "CASE severity " + " ".join(f"WHEN '{s}' THEN '{m}'" for s, m in constants.SEVERITY_MARKS.items()) + " ELSE '⚪' END"
    colour = "CASE severity " + " ".join(f"WHEN '{s}' THEN {c}" for s, c in constants.SEVERITY_COLOURS.items()) + " ELSE 8947848 END"
    place = "coalesce(nullif(concat_ws(', ', nullif(city, ''), nullif(region, ''), nullif(country, '')), ''), 'Unknown')"

    def field(name, value):
        return f"""'{{"name":"{name}","value":' || {json(value)} || ',"inline":true}}'"""

    fields = " || ',' || ".join([
        field("Rule", "'`' || rule_id || '`'"), field("Severity", f"{mark} || ' ' || severity"),
        field("MITRE", "'`' || coalesce(mitre, 'N/A') || '`'"),
        field("Source IP", "'`' || coalesce(nullif(source_ip, ''), 'Unknown') || '`'"),
        field("Location", place), field("ISP", "coalesce(isp, 'Unknown')"),
    ])
    foot = f"'{brand} • ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"
    title = f"{mark} || ' SIEM Alert — ' || rule_name"
    return (
        f"""'{{"embeds":[{{"title":' || {json(title)} || ',"description":' || {json('description')} || """
        f"""',"color":' || {colour} || ',"fields":[' || {fields} || '],"footer":{{"text":' || {json(foot)} || '}}}}]}}'"""
    )


NOW = "(SELECT max(ts) FROM ev)"
HOURLY = (
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00:00') AS hour, count(*) AS n FROM ev "
    "WHERE ts >= {since} GROUP BY 1"
)

# Greedy admission, one row of every source per step: an admitted row stays in the list for five seconds.
RATE_LIMIT = f"""
WITH RECURSIVE logs AS ({derived.for_duckdb(derived.LOGS, derived.DUCK_FAST_TS)}),
numbered AS MATERIALIZED (SELECT event_id, ts, source, row_number() OVER (PARTITION BY source ORDER BY ts, event_id) AS i FROM logs),
walk AS (
 SELECT source, CAST(0 AS BIGINT) AS i, CAST([] AS TIMESTAMP[]) AS held, CAST(NULL AS BIGINT) AS event_id, FALSE AS ok
 FROM (SELECT DISTINCT source FROM numbered) s
 UNION ALL
 SELECT source, i, CASE WHEN len(kept) < 500 THEN list_append(kept, ts) ELSE kept END, event_id, len(kept) < 500
 FROM (SELECT n.source, n.i, n.ts, n.event_id, list_filter(w.held, lambda h: h >= n.ts - INTERVAL 5 SECONDS) AS kept
  FROM walk w JOIN numbered n ON n.source = w.source AND n.i = w.i + 1) step)
SELECT source, event_id FROM walk WHERE ok
"""
