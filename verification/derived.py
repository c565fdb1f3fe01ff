"""Log lines, flow records and IDS lines derived from the ``events`` table, in one SQL text each.

The text runs on Spark and on DuckDB alike; ``@TS@`` is the only difference.
"""

SPARK_TS = "TIMESTAMP_NTZ'2024-01-01 00:00:00' + event_id * INTERVAL '0.1' SECOND"
DUCK_TS = "TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(event_id * 100)"
SPARK_FAST_TS = "TIMESTAMP_NTZ'2024-01-01 00:00:00' + event_id * INTERVAL '0.001' SECOND"
DUCK_FAST_TS = "TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(event_id)"

_SENDER = """
CASE WHEN user_id % 3 = 0 THEN '203.0.113.77'
     WHEN user_id % 8 IN (1, 5) THEN '10.0.0.' || CAST(user_id % 8 AS STRING)
     WHEN user_id % 8 = 2 THEN '172.20.3.4'
     ELSE '198.51.100.' || CAST(user_id % 8 AS STRING) END AS ip
"""

LOGS = f"""
SELECT event_id, @TS@ AS ts,
 CASE WHEN event_type IN ('error','signup') THEN 'auth' WHEN event_type = 'click' THEN 'apache'
      WHEN event_type = 'view' THEN 'flask' WHEN event_id % 6 = 0 THEN 'kernel'
      WHEN event_id % 6 = 1 THEN 'syslog:10.0.0.9' WHEN event_id % 6 IN (2,3) THEN 'suricata'
      WHEN event_id % 6 = 4 THEN 'tls' ELSE 'syslog' END AS source,
 CASE
  WHEN event_type = 'error' THEN 'Jan  1 00:00:00 gate sshd[' || CAST(event_id % 9000 + 1000 AS STRING)
    || ']: Failed password for ' || CASE WHEN user_id % 5 = 0 THEN 'root' ELSE 'ubuntu' END
    || CASE WHEN event_id % 13 = 0 THEN ' port 22 ssh2' ELSE ' from ' || ip || ' port 22 ssh2' END
  WHEN event_type = 'signup' AND event_id % 4 = 0 THEN '<86>Jan  1 00:00:00 gate sudo['
    || CAST(event_id % 900 + 100 AS STRING) || ']: ubuntu : command=/usr/sbin/service web restart'
  WHEN event_type = 'signup' THEN 'Jan  1 00:00:00 gate sshd[77]: Accepted '
    || CASE WHEN event_id % 2 = 0 THEN 'publickey' ELSE 'password' END || ' for '
    || CASE WHEN user_id % 7 = 0 THEN 'root' ELSE 'ubuntu' END || ' from ' || ip || ' port 22 ssh2'
  WHEN event_type IN ('click','view') THEN ip || ' - - [01/Jan/2024:00:00:00 +0000] "'
    || CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END || ' '
    || CASE event_id % 11 WHEN 0 THEN '/../../../etc/passwd' WHEN 1 THEN '/search?id=7%27%20OR%20%277%27%3D%277'
       WHEN 2 THEN '/search?q=7%27+OR+%277%27%3D%277' WHEN 3 THEN '/items?f=7%20OR%20SLEEP(3)--'
       WHEN 4 THEN '/f?x=../../etc/passwd' WHEN 5 THEN '/a/%2E%2e/b' WHEN 6 THEN '/q?a=%zz%C3%A9%2'
       ELSE '/page/' || CAST(user_id AS STRING) END
    || ' HTTP/1.1" ' || CASE WHEN value < 25 THEN '200' WHEN value < 60 THEN '404' WHEN value < 90 THEN '401'
       WHEN value < 150 THEN '403' ELSE '500' END
    || CASE WHEN event_type = 'click' THEN ' ' || CAST(200 + event_id % 800 AS STRING) ELSE ' -' END
  WHEN event_id % 6 = 0 THEN '[' || CAST(10000 + event_id AS STRING) || '.123] '
    || CASE WHEN user_id % 3 = 0 THEN 'worker invoked oom-killer'
       WHEN user_id % 3 = 1 THEN 'Memory exhausted, stopped task 9 (worker)'
       ELSE 'worker[77]: segfault at 8 ip 00001a error 4 in libc.so' END
  WHEN event_id % 6 = 1 THEN '<' || CAST(user_id % 192 AS STRING) || '>Jan  1 00:00:00 gate cron: job '
    || CAST(event_id AS STRING)
  WHEN event_id % 6 = 2 THEN '{{"event_type":"alert","src_ip":"' || ip
    || '","dest_ip":"10.0.0.1","proto":"TCP","alert":{{"signature_id":' || CAST(5001 + user_id % 6 AS STRING)
    || ',"signature":"SIG ' || CAST(user_id % 6 AS STRING) || '"'
    || CASE WHEN user_id % 4 = 0 THEN ',"http":{{"http_method":"GET","http_uri":"/x"}}' ELSE '' END || '}}}}'
  WHEN event_id % 6 = 3 THEN '{{"event_type":"flow","src_ip":"' || ip || '","proto":"UDP"}}'
  WHEN event_id % 6 = 4 THEN 'TLS_EVENT src=' || ip || ' tls_version=' || CASE user_id % 5 WHEN 0 THEN '0x0301'
       WHEN 1 THEN 'TLSv1' WHEN 2 THEN 'TLSv1.1' WHEN 3 THEN 'TLSv1.2' ELSE '0x0303' END
    || ' sni=' || CASE WHEN user_id % 4 = 0 THEN 'x7k2p9qz4mvb1tfh.example.com' ELSE 'www.example.org' END
    || ' ja3=' || CASE WHEN user_id % 6 = 0 THEN '72a589da586844d7f0818ce684948eea'
       ELSE '00000000000000000000000000000000' END
  ELSE 'Jan  1 00:00:00 gate systemd[1]: Finished rotation of archives.' END AS raw
FROM (SELECT event_id, user_id, event_type, value, {_SENDER} FROM @EVENTS@) b
"""

# Lines with surrounding blanks, colour codes, and some beyond the longest allowed line.
DIRTY = """
SELECT event_id, ts, source,
 CASE WHEN event_id % 50 = 0 THEN '   '
      WHEN event_id % 97 = 1 THEN '  ' || repeat(ESC || '[31m' || raw || ' ', 400)
      ELSE CHR(9) || ESC || '[1;32m' || raw || ESC || '[0m  ' END AS raw
FROM (SELECT *, CHR(27) AS ESC FROM (@LOGS@) l) m
"""

# IDS records whose HTTP part stands at the top level, as the IDS writes it.
EVE = """
SELECT event_id, ts, source, CASE WHEN source = 'suricata' AND event_id % 12 < 6 THEN
  replace(raw, '"proto":"TCP",', '"proto":"TCP","http":{"http_method":"POST","http_uri":"/top/' || CAST(event_id % 9 AS STRING) || '"},') ELSE raw END AS raw
FROM (@LOGS@) l
"""

FLOWS = f"""
SELECT event_id AS flow_id, @TS@ AS ts,
 CASE WHEN event_type IN ('click','view','purchase') THEN 'http' WHEN event_type = 'error' THEN 'tcp'
      ELSE 'icmp' END AS proto,
 ip AS src_ip, '10.0.0.1' AS dest_ip,
 CAST(CASE WHEN event_id % 4 = 0 THEN 80 ELSE 5000 END AS INT) AS dest_port,
 CASE WHEN event_type IN ('click','view','purchase') THEN
   CASE event_id % 17 WHEN 0 THEN '/q?id=1 UNION all select' WHEN 1 THEN '/q?id=1 Or 1=1' WHEN 2 THEN '/q?x=drop TABLE t'
     WHEN 3 THEN '/q?x=benchmark(9)' WHEN 4 THEN '/q?x=WAITFOR delay 9' WHEN 5 THEN '/q?x=1--'
     WHEN 6 THEN '/../etc/passwd' WHEN 7 THEN '/%2E%2e%2F' WHEN 8 THEN '/proc/self/environ' WHEN 9 THEN '/q?x=a|b'
     WHEN 10 THEN '/q?x=`id`' WHEN 11 THEN '/q?x=$(id)' WHEN 12 THEN '/q?x=a;b'
     ELSE '/page/' || CAST(user_id AS STRING) END END AS http_uri,
 CASE WHEN event_type IN ('click','view','purchase') THEN
   CASE event_id % 7 WHEN 0 THEN 'nikto/2.1' WHEN 1 THEN 'SQLMAP/1.7' WHEN 2 THEN 'Nessus' WHEN 3 THEN 'nmap scripting'
     WHEN 4 THEN 'mozilla/5.0' ELSE 'Mozilla/5.0' END END AS user_agent,
 CAST(CASE WHEN event_type = 'error' THEN CASE event_id % 7 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 41 WHEN 3 THEN 193
     WHEN 4 THEN 130 WHEN 5 THEN 18 ELSE 16 END END AS INT) AS tcp_flags,
 CAST(CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 8 ELSE 0 END END AS INT) AS icmp_type,
 CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'SSH-2.0-lib' WHEN event_type = 'error' THEN 'ssh-' END AS payload
FROM (SELECT event_id, user_id, event_type, {_SENDER} FROM @EVENTS@) b
"""

FASTLOG = f"""
SELECT event_id, CASE WHEN event_id % 10 = 9 THEN 'engine started'
  ELSE '01/02/2024-10:11:12.' || lpad(CAST(event_id % 1000000 AS STRING), 6, '0') || '  [**] [1:'
    || CASE event_id % 3 WHEN 0 THEN '5003:1] TCP SYN Scan - SYN Flag' WHEN 1 THEN '6001:1] Unusual HTTP User-Agent'
       ELSE '1001:2] SQLi - UNION SELECT' END
    || ' [**] ' || CASE WHEN event_id % 4 = 0 THEN '' ELSE '[Classification: Attempted Information Leak] ' END
    || '[Priority: 2] {{TCP}} ' || ip || ':40001 -> 10.0.0.1:8443' END AS raw
FROM (SELECT event_id, user_id, {_SENDER} FROM @EVENTS@) b
"""


def for_spark(sql: str, ts: str = SPARK_TS) -> str:
    """Text for ``spark.sql(text, events=table)``."""
    filled = sql.replace("@LOGS@", LOGS).replace("@TS@", ts)
    return filled.replace("{", "{{").replace("}", "}}").replace("@EVENTS@", "{events}")


def for_duckdb(sql: str, ts: str = DUCK_TS) -> str:
    return sql.replace("@LOGS@", LOGS).replace("@TS@", ts).replace("@EVENTS@", "events")
