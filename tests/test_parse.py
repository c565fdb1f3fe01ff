import pytest

from logwarden.operators.detect import detect
from logwarden.operators.parse import fields_from_json, fields_json, parse, response_bytes
from pyspark.sql import functions as F

# source, line, category, some fields, rules that fire on the single line
GOLDEN = [
    ("auth", "Mar 15 12:00:01 gate sshd[4711]: Failed password for root from 10.8.8.8 port 22 ssh2",
     "auth", {"process": "sshd", "pid": "4711", "src_ip": "10.8.8.8"}, {"AUTH-002"}),
    ("syslog:1.2.3.4", "<134>Apr 27 15:00:01 gate sshd[4711]: Failed password for root from 1.2.3.4 port 22 ssh2",
     "auth", {"src_ip": "1.2.3.4", "priority": None}, {"AUTH-002"}),
    ("auth", "Mar 15 12:01:00 gate sshd[4711]: Accepted password for root from 10.8.8.8 port 22 ssh2",
     "auth", {}, {"AUTH-003"}),
    ("auth", "Mar 15 12:10:11 gate sshd[1000]: Invalid user root from 10.4.4.4",
     "auth", {"src_ip": "10.4.4.4"}, {"AUTH-002"}),
    ("auth", "Mar 15 12:01:00 gate sudo[77]: ubuntu : command=/usr/sbin/service web restart",
     "auth", {"process": "sudo", "src_ip": None}, {"AUTH-004"}),
    ("auth", "Mar 15 12:01:00 gate su: session opened", "auth", {"process": "su", "pid": ""}, set()),
    ("syslog", "Mar 15 12:01:00 gate systemd[1]: Finished rotation of archives.",
     "generic", {"message": "Mar 15 12:01:00 gate systemd[1]: Finished rotation of archives."}, set()),
    ("flask", '198.51.100.23 - - [22/Apr/2026 12:00:00] "GET /search?id=1%20UNION%20SELECT%201,2,3-- HTTP/1.1" 404 512',
     "web", {"path": "/search", "query": "id=1 UNION SELECT 1,2,3--", "status": 404, "size": 0, "method": "GET",
             "full_uri": "/search?id=1%20UNION%20SELECT%201,2,3--"}, {"WEB-003"}),
    ("apache", '10.4.4.4 - - [15/Mar/2026:12:00:00 +0000] "GET /../../../etc/passwd HTTP/1.1" 404 512',
     "web", {"path": "/../../../etc/passwd", "query": ""}, {"WEB-001"}),
    ("apache", '10.4.4.4 - - [15/Mar/2026:12:00:00 +0000] "GET /f?x=../../etc/passwd HTTP/1.1" 200 5',
     "web", {"path": "/f"}, set()),
    ("apache", '10.4.4.4 - - [15/Mar/2026:12:00:00 +0000] "GET /search?q=7%27+OR+%277%27%3D%277 HTTP/1.1" 200 5',
     "web", {"query": "q=7'+OR+'7'='7"}, set()),
    ("apache", '10.4.4.4 - - [15/Mar/2026:12:00:00 +0000] "GET /s?a=%zz%2&b=%C3%A9%FF?c HTTP/1.1" 200 -',
     "web", {"query": "a=%zz%2&b=é�?c"}, set()),
    ("kernel", "[12345.678] Memory exhausted, stopped task 123 (worker)", "kernel", {}, set()),
    ("kernel", "[12345.678] worker[77]: segfault at 8 ip 00001a error 4 in libc.so", "kernel",
     {"message": "worker[77]: segfault at 8 ip 00001a error 4 in libc.so"}, {"SYS-002"}),
    ("kernel", "[1.2] OOM-killer: x", "kernel", {}, {"SYS-001"}),
    ("suricata", '{"event_type":"alert","src_ip":"192.168.7.1","dest_ip":"192.168.7.9","proto":"TCP",'
     '"alert":{"signature_id":5003,"signature":"TCP SYN Scan - SYN Flag"}}',
     "suricata", {"signature_id": 5003, "src_ip": "192.168.7.1", "http_uri": "", "http_method": ""}, set()),
    ("suricata", '{"event_type":"alert","alert":{"http":{"http_method":"GET","http_uri":"/a"}}}', "suricata",
     {"signature_id": 0, "signature": "", "src_ip": "", "http_uri": "/a", "http_method": "GET"}, set()),
    ("suricata", '{"event_type":"alert","alert":{"http":{"hostname":"h"}}}', "suricata", {"http_uri": None}, set()),
    ("suricata", '{"event_type":"alert"}', "suricata", {"signature": "", "signature_id": 0}, set()),
    ("suricata", '{"event_type":"alert","alert":null}', "generic", {}, set()),
    ("suricata", '{"event_type":"flow","src_ip":"192.168.7.1"}', "generic",
     {"message": '{"event_type":"flow","src_ip":"192.168.7.1"}'}, set()),
    ("suricata", '{"event_type":"alert"', "generic", {}, set()),
    ("Suricata", '{"event_type":"alert","alert":{}}', "generic", {}, set()),
    ("syslog:10.9.9.9", "<13>probe: refused login of 10.9.9.9", "syslog",
     {"priority": 13, "message": "probe: refused login of 10.9.9.9", "src_ip": None}, set()),
    ("syslog", "<99999999999>x", "syslog", {"priority": None, "message": "x"}, set()),
    ("tls", "TLS_EVENT src=203.0.113.77 tls_version=0x0301 sni=x7k2p9qz4mvb1tfh.example.com "
     "ja3=72a589da586844d7f0818ce684948eea", "generic", {}, {"NET-001", "NET-002", "NET-003"}),
    ("tls", "TLS_EVENT tls_version=TLSv1.2 sni=www.example.org ja3=00000000000000000000000000000000", "generic", {}, set()),
    ("tls", "TLS_EVENT tls_version=TLSv1", "generic", {}, {"NET-001"}),
    ("tls", "tls_version=TLSv1", "generic", {}, set()),
    ("x", "", "generic", {"message": ""}, set()),
]


@pytest.fixture(scope="module")
def outcome(spark):
    import datetime as dt

    from logwarden import schema
    rows = [(n, dt.datetime(2024, 1, 1) + dt.timedelta(hours=n), s, raw) for n, (s, raw, *_) in enumerate(GOLDEN)]
    events = parse(spark.createDataFrame(rows, schema.RAW_LOGS))
    alerts = {}
    for row in detect(events).collect():
        alerts.setdefault(row.event_id, set()).add(row.rule_id)
    return {r.event_id: r for r in events.collect()}, alerts


@pytest.mark.parametrize("n", range(len(GOLDEN)))
def test_golden_line(outcome, n):
    events, alerts = outcome
    _, _, category, fields, rules = GOLDEN[n]
    assert events[n].category == category
    assert {k: events[n][k] for k in fields} == fields
    assert alerts.get(n, set()) == rules


def test_lines_after_a_newline_are_not_looked_at(make_logs):
    row = parse(make_logs([(0, "a", "<5>one\ntwo")])).first()
    assert (row.category, row.message) == ("syslog", "one")


def test_http_part_of_the_documented_record(make_logs):
    line = '{"event_type":"alert","alert":{"signature_id":1},"http":{"http_method":"POST","http_uri":"/up"}}'
    logs = make_logs([(0, "suricata", line)])
    assert parse(logs).first().http_uri == ""
    assert parse(logs, documented_http=True).first().http_uri == "/up"


def test_response_size_as_extra_column(make_logs):
    web = '1.2.3.4 - - [x] "GET / HTTP/1.1" 200 {}'
    events = parse(make_logs([(0, "w", web.format(512)), (1, "w", web.format("-"))]))
    assert [r.n for r in events.orderBy("event_id").select(response_bytes().alias("n")).collect()] == [512, None]


def test_fields_as_json_and_back(spark, make_logs):
    events = parse(make_logs([(0, "kernel", "[1.0] hello")]))
    assert events.select(fields_json().alias("f")).first().f == '{"message":"hello"}'
    bad = spark.createDataFrame([("no json",), (None,)], "f string").select(fields_from_json(F.col("f")).alias("f"))
    assert [r.f.message for r in bad.collect()] == [None, None]
    assert all(r.f is not None for r in bad.collect())
