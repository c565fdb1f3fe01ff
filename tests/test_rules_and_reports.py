import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from logwarden import fixed_values as fixed
from logwarden import schema
from logwarden.functions import text
from logwarden.operators import rulefile, rules, signatures
from logwarden.operators.detect import detect, flag_events
from logwarden.operators.parse import parse
from logwarden.plans import reports

OVERRIDE = [("AUTH-002", False, None, None, None), ("SYS-002", True, "Crash", None, "CRITICAL"), ("NONE", False, None, None, None)]


def test_catalogue_search_and_counts(spark):
    table = rules.catalogue(spark)
    assert table.count() == 15
    assert {r.id for r in rules.search(table, "web", "flood").collect()} == {"WEB-002"}
    assert {r.id for r in rules.search(table, words="sqL").collect()} == {"WEB-003"}
    assert rules.search(table, "auth").count() == 6
    overrides = spark.createDataFrame(OVERRIDE, schema.RULE_OVERRIDES)
    assert tuple(rules.catalogue_counts(table, overrides).first()) == (15, 14, 4, 5)
    edited = {r.id: r for r in rules.edited_catalogue(table, overrides).collect()}
    assert "AUTH-002" not in edited and (edited["SYS-002"].name, edited["SYS-002"].severity) == ("Crash", "CRITICAL")


def test_overrides_reach_detection(spark, make_logs):
    logs = make_logs([(0, "k", "[1.0] segfault"), (1, "a", "Mar  1 1:00 h sshd[1]: failed root")])
    edited = rules.with_overrides(spark.createDataFrame(OVERRIDE, schema.RULE_OVERRIDES))
    found = [(r.rule_id, r.rule_name, r.severity) for r in detect(parse(logs), edited).collect()]
    assert found == [("SYS-002", "Crash", "CRITICAL")]


def test_all_rules_switched_off(spark, make_logs):
    logs = make_logs([(0, "k", "[1.0] segfault"), (1, "a", "Mar  1 1:00 h sshd[1]: failed root")])
    off = spark.createDataFrame([(r.id, False, None, None, None) for r in rules.BUILT_IN], schema.RULE_OVERRIDES)
    edited = rules.with_overrides(off)
    found = detect(parse(logs), edited)
    assert edited == () and found.collect() == []
    assert found.columns == detect(parse(logs)).columns
    assert [r.has_alert for r in flag_events(parse(logs), found).collect()] == [0, 0]


def flow(**given):
    base = dict(flow_id=1, ts=None, proto="http", src_ip="a", dest_ip="b", dest_port=5000, http_uri="/", user_agent="Mozilla",
                tcp_flags=None, icmp_type=None, payload=None)
    return tuple({**base, **given}.values())


@pytest.mark.parametrize("given, sids", [
    (dict(http_uri="/?q=1 UNION ALL SELECT"), {1001, 1003}),
    (dict(http_uri="/?q=1 UNION", dest_port=80), set()),
    (dict(http_uri="/?q=1 oR 1=1--"), {1002, 1007}),
    (dict(http_uri="/?DROP TABLE;"), {1004, 3004}),
    (dict(http_uri="/benchmark?waitfor DELAY"), {1005, 1006}),
    (dict(http_uri="/../%2E%2e%2f/etc/PASSWD/proc/self"), {2001, 2002, 2003, 2004}),
    (dict(http_uri="/a|`$("), {3001, 3002, 3003}),
    (dict(user_agent="NIKTO Mozilla sqlMAP nessus nmap", dest_port=80), {4001, 4002, 4003, 5001}),
    (dict(user_agent="mozilla"), {6001}),
    (dict(user_agent=None), set()),
    (dict(proto="icmp", icmp_type=8), {5002}),
    (dict(proto="icmp", icmp_type=0), set()),
    (dict(proto="tcp", tcp_flags=2), {5003}),
    (dict(proto="tcp", tcp_flags=2 + 128), set()),
    (dict(proto="tcp", tcp_flags=1 + 128 + 64), {5005}),
    (dict(proto="tcp", tcp_flags=41), {5006}),
    (dict(proto="tcp", payload="xSSH-2.0"), {6002}),
    (dict(proto="udp", payload="SSH-2.0"), set()),
])
def test_signatures(spark, given, sids):
    df = spark.createDataFrame([flow(**given)], schema.HTTP_FLOWS)
    assert {r.sid for r in signatures.match_signatures(df).collect()} == sids


def test_rule_text():
    rule = rulefile.parse_rule(r'alert tcp any any -> any 22 (msg:"a \"b\"; c"; content:!"x|3b 7C|\;y"; nocase; content:"SSH-"; flags:F,12; itype:8; '
                               'reference:url,example.org; classtype:attempted-recon; sid:7; rev:3;)')
    assert (rule.sid, rule.rev, rule.msg, rule.dest_port, rule.flags, rule.icmp_type) == (7, 3, 'a "b"; c', 22, (1, 63), 8)
    assert rule.contents == (rulefile.Content("x;|;y", "payload", True, True), rulefile.Content("SSH-"))
    for bad in ("alert tcp any any -> any any (sid:1; pcre:\"/x/\";)", "drop tcp any any -> any any (sid:1;)", "alert tcp 10.0.0.1 any -> any any (sid:1;)",
                "alert tcp any any -> any any (content:x; sid:1;)"):
        with pytest.raises(ValueError):
            rulefile.parse_rule(bad)
    with pytest.raises(ValueError):
        rulefile.parse_rules(["alert tcp any any -> any any (sid:1;)"] * 2)


def test_rules_with_several_contents(spark):
    rules_ = rulefile.parse_rules([
        '# contents of several fields', '',
        'alert http any any -> any any (msg:"both"; content:"/admin"; http_uri; content:"CURL"; http_user_agent; nocase; sid:1; rev:1;)',
        'alert http any any -> any any (msg:"one, not the other"; content:"/admin"; http_uri; content:!"curl"; http_user_agent; sid:2; rev:1;)',
        'alert http any any -> any 80 (msg:"port only"; sid:3; rev:1;)'])
    rows = [flow(proto="http", http_uri="/ADMIN", user_agent="Curl", dest_port=80), flow(proto="http", http_uri="/a/admin", user_agent="curl/8"),
            flow(proto="http", http_uri="/admin", user_agent="x"), flow(proto="http", http_uri="/admin", user_agent=None), flow(proto="tcp", payload="/admin")]
    found = rulefile.match_rules(spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], schema.HTTP_FLOWS), rules_)
    assert {(r.flow_id, r.sid) for r in found.collect()} == {(0, 3), (1, 1), (2, 2)}


def test_signature_list():
    assert len({s[0] for s in fixed.SIGNATURES}) == 25


def alert_rows(spark, rows):
    data = [(n, n, dt.datetime(2024, 1, 1), r, r + " name", "", s, m, None) for n, (r, s, m) in enumerate(rows)]
    return spark.createDataFrame(data, "alert_id bigint, event_id bigint, ts timestamp_ntz, rule_id string, rule_name string, "
                                       "description string, severity string, mitre string, source_ip string")


def test_rule_reports(spark):
    alerts = alert_rows(spark, [("WEB-001", "MEDIUM", "T1083")] * 3 + [("AUTH-003", "CRITICAL", None)] * 8 + [("SYS-002", "LOW", None)])
    stats = reports.rule_stats(alerts)
    assert [(r.rule_id, r.firing_count) for r in stats.collect()] == [("AUTH-003", 8), ("WEB-001", 3), ("SYS-002", 1)]
    assert tuple(reports.rule_kpis(stats, rules.catalogue(spark)).first()) == (15, "AUTH-003", 8, 3, 4.0)
    assert [(r.rule_id, r.rank, r.bar) for r in reports.ranked_rules(stats).orderBy("rank").collect()] == [
        ("AUTH-003", 1, 100), ("WEB-001", 2, 38), ("SYS-002", 3, 13)]
    assert [(r.rank, r.bar) for r in reports.ranked_rules(stats, "LOW").collect()] == [(1, 100)]
    cover = {r.category: (r.rules, r.rules_fired, r.alerts) for r in reports.category_coverage(rules.catalogue(spark), alerts).collect()}
    assert cover == {"auth": (6, 1, 8), "web": (4, 1, 3), "kernel": (2, 1, 1), "network": (3, 0, 0)}
    assert tuple(reports.detection_rate(reports.detected_techniques(alerts)).first()) == (4, 1, 25.0)
    empty = reports.rule_stats(alerts.limit(0))
    assert tuple(reports.rule_kpis(empty, rules.catalogue(spark)).first()) == (15, "–", 0, 0, 0.0)
    assert {r.severity: r.n for r in reports.alerts_by_severity(alerts).collect()} == {"LOW": 1, "MEDIUM": 3, "HIGH": 0, "CRITICAL": 8}


def test_recent_rows_and_limits(spark):
    alerts = alert_rows(spark, [("WEB-001", "LOW" if n % 2 else "HIGH", None) for n in range(700)])
    assert [r.alert_id for r in reports.recent_alerts(alerts, 3).collect()] == [699, 698, 697]
    assert reports.recent_alerts(alerts, -1).count() == 700
    assert reports.recent_alerts(alerts, 0).count() == 0
    assert reports.recent_alerts(alerts).count() == 100
    assert reports.page_of_alerts(alerts, "LOW").count() == 250


def test_hours_of_the_last_day(spark):
    times = [dt.datetime(2024, 3, 9, 0, 10), dt.datetime(2024, 3, 9, 12, 30), dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 3, 10, 12, 0)]
    events = spark.createDataFrame([(n, t) for n, t in enumerate(times)], "event_id bigint, ts timestamp_ntz")
    now = dt.datetime(2024, 3, 10, 12, 15)
    assert [(r.hour, r.n) for r in reports.events_by_hour(events, now).collect()] == [
        ("2024-03-09T12:00:00", 1), ("2024-03-10T02:00:00", 1), ("2024-03-10T12:00:00", 1)]
    assert reports.events_by_hour(events, now, whole_day=True).first().hour == "2024-03-09T00:00:00"


def test_stats_document(spark, make_logs):
    events = parse(make_logs([(0, "k", "[1.0] x"), (1, "w", '1.1.1.1 - - [x] "GET / HTTP" 200 1')]))
    alerts = alert_rows(spark, [("SYS-002", "LOW", None)])
    out = json.loads(reports.stats_document(events, alerts, dt.datetime(2024, 3, 1, 13)).first().document)
    assert out == {
        "total_events": 2, "total_alerts": 1, "by_severity": {"LOW": 1, "MEDIUM": 0, "HIGH": 0, "CRITICAL": 0},
        "by_category": {"kernel": 1, "web": 1}, "events_by_hour": [{"hour": "2024-03-01T12:00:00", "count": 2}],
        "top_src_ips": [{"ip": "1.1.1.1", "count": 1}],
    }


def test_words_in_any_case_are_those_of_the_lower_case_text(spark):
    texts = ["Failed x", "FAILED", "fa iled", "", None, "FAİLED", "ä FaIlEd", "Kernel failed", "a.b", "A.B é", "axb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for word in ("failed", "Kernel", "a.b", "É"):
        wanted = F.contains(F.lower("t"), F.lit(word.lower()))
        assert rows.filter(~text.has_any_case(F.col("t"), word).eqNullSafe(wanted)).count() == 0


def test_injection_in_a_part_that_the_uri_lacks(spark):
    rows = spark.createDataFrame([
        (0, "web", "/a", "", "/a"), (1, "web", "/a", "x=sleep", "/a?x=%73leep"), (2, "web", "/Union", "", "/b"), (3, "web", "/a", "", "/a?DROP table"),
        (4, "web", None, "a--b", None), (5, "auth", "/union", "", "/union")], "id int, category string, path string, query string, full_uri string")
    assert sorted(r.id for r in rows.filter(rules._sql_injection()).collect()) == [1, 2, 3, 4]
