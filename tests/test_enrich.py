import json
import random

import pytest
from pyspark.sql import functions as F

from logwarden import schema
from logwarden.functions import net, severity
from logwarden.operators.enrich import add_geo, innermost, locate
from logwarden.plans.jobs import outbox

# documentation networks, one range over several /16 blocks, one single address
RANGES = [
    (3221225984, 3221226239, "A", "r", "a", "ispA", ""),          # 192.0.2.0/24
    (3405803776, 3405803776, "B", "r", "", "ispB", "o"),          # 203.0.113.0
    (16777216, 17039359, "C", "", "c", "ispC", "o"),              # 1.0.0.0 - 1.3.255.255
]


def test_private_addresses(spark):
    ips = ["10.0.0.1", "172.16.0.1", "172.31.9.9", "172.32.0.1", "192.168.1.1", "192.169.1.1", "127.0.0.1", "0.1.2.3", "100.1.1.1", "", None]
    df = spark.createDataFrame([(i,) for i in ips], "ip string").select(net.is_private(F.col("ip")).alias("p"))
    assert [r.p for r in df.collect()] == [True, True, True, False, True, False, True, True, False, True, True]


def test_addresses_as_numbers(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("999.1.1.1",), ("255.255.255.255",)], "ip string")
    assert [r.n for r in df.select(net.ip_number(F.col("ip")).alias("n")).collect()] == [16909060, None, 4294967295]


def test_located_as_by_plain_comparison(spark):
    ips = ["192.0.2.0", "192.0.2.255", "192.0.3.0", "203.0.113.0", "203.0.113.1", "1.0.0.0", "1.2.7.7", "1.3.255.255",
           "1.4.0.0", "0.255.255.255", "192.0.2.0", "300.1.1.1"]
    addresses = spark.createDataFrame([(i,) for i in ips], "geo_ip string")
    found = {r.geo_ip: r.geo.country for r in locate(addresses, spark.createDataFrame(RANGES, schema.IP_RANGES)).collect()}
    assert found == {"192.0.2.0": "A", "192.0.2.255": "A", "203.0.113.0": "B", "1.0.0.0": "C", "1.2.7.7": "C", "1.3.255.255": "C"}


def test_innermost_of_random_nested_ranges(spark):
    """Pieces name the smallest range that holds an address; crossing ranges are refused."""
    rng = random.Random(2)

    def nested(low, high, depth):
        if depth == 0 or high - low < 4:
            return
        cuts = sorted(rng.sample(range(low, high + 1), 4))
        for start, end in ((cuts[0], cuts[1] - 1), (cuts[2], cuts[3])):
            if start <= end:
                yield start, end
                yield from nested(start, end, depth - 1)

    spans = sorted(set(nested(0, 3000, 6)))
    found = {}
    for start, end, index in innermost([(s, e, n) for n, (s, e) in enumerate(spans)]):
        for number in range(start, end + 1):
            assert number not in found
            found[number] = index
    for number in range(3001):
        holding = [(e - s, n) for n, (s, e) in enumerate(spans) if s <= number <= e]
        assert found.get(number) == (min(holding)[1] if holding else None)
    assert innermost([(0, 9, 0), (0, 9, 1), (5, 5, 2)]) == [(0, 4, 1), (5, 5, 2), (6, 9, 1)]
    with pytest.raises(ValueError):
        innermost([(0, 9, 0), (5, 12, 1)])


def test_located_in_nested_ranges(spark):
    """Outer ranges go on behind inner ones, over /16 blocks too."""
    wide = [(16777216, 17039359, "O", "", "", "", ""), (16842752, 16842800, "M", "", "", "", ""), (16842760, 16842760, "I", "", "", "", "")]
    ips = {"1.0.0.200": "O", "1.1.0.0": "M", "1.1.0.8": "I", "1.1.0.9": "M", "1.1.0.48": "M", "1.1.0.49": "O", "1.3.255.255": "O"}
    addresses = spark.createDataFrame([(i,) for i in [*ips, "1.4.0.0"]], "geo_ip string")
    assert {r.geo_ip: r.geo.country for r in locate(addresses, spark.createDataFrame(wide, schema.IP_RANGES)).collect()} == ips
    crossing = spark.createDataFrame([(16777216, 16908287, *"A    "), (16842752, 17039359, *"B    ")], schema.IP_RANGES)
    with pytest.raises(Exception, match="cross"):
        locate(addresses, crossing).collect()


def test_alert_location(spark):
    rows = [(1, "192.0.2.5"), (2, "10.0.0.1"), (3, "8.8.8.8"), (4, None)] + [(n, "192.0.2.5") for n in range(10, 200)]
    out = add_geo(spark.createDataFrame(rows, "alert_id bigint, geo_ip string"), spark.createDataFrame(RANGES, schema.IP_RANGES))
    geo = {r.alert_id: r.geo for r in out.collect()}
    assert len(geo) == len(rows)
    assert geo[1].asDict() == {"country": "A", "region": "r", "city": "a", "isp": "ispA", "org": ""}
    assert geo[2].asDict() == {"country": "Internal", "region": None, "city": "Private Network", "isp": "N/A", "org": None}
    assert geo[3] is None and geo[4] is None


ALERT = "alert_id bigint, ts timestamp_ntz, rule_id string, rule_name string, description string, severity string, mitre string, " \
        "source_ip string, geo struct<country string, region string, city string, isp string, org string>"


def test_notification(spark):
    import datetime as dt
    at = dt.datetime(2026, 4, 27, 15, 0, 0)
    rows = [
        (1, at, "WEB-003", "SQL Injection Attempt", "found", "HIGH", "T1190", "198.51.100.23", ("United States", "California", "Fremont", "Linode", None)),
        (2, at, "SYS-002", "Segmentation Fault", "crash", "LOW", None, None, None),
        (3, at, "X", None, None, "ODD", None, "", ("Internal", None, "Private Network", "N/A", None)),
    ]
    alerts = spark.createDataFrame(rows, ALERT)
    assert [r.alert_id for r in outbox(alerts).collect()] == [1]
    sent = {r.alert_id: json.loads(r.payload)["embeds"][0] for r in alerts.select("alert_id", severity.notification("B").alias("payload")).collect()}
    assert sent[1]["title"] == "🟠 SIEM Alert — SQL Injection Attempt"
    assert [f["value"] for f in sent[1]["fields"]] == ["`WEB-003`", "🟠 HIGH", "`T1190`", "`198.51.100.23`", "Fremont, California, United States", "Linode"]
    assert sent[1]["footer"]["text"] == "B • 2026-04-27T15:00:00.000000+00:00" and sent[1]["color"] == 0xFF6600
    assert [f["value"] for f in sent[2]["fields"]] == ["`SYS-002`", "🟢 LOW", "`N/A`", "`Unknown`", "Unknown", "Unknown"]
    assert sent[3]["color"] == 0x888888 and sent[3]["title"] == "⚪ SIEM Alert — Unknown"
    assert sent[3]["fields"][4]["value"] == "Private Network, Internal"


def test_severity_order(spark):
    df = spark.createDataFrame([("LOW",), ("HIGH",), ("CRITICAL",), ("odd",), (None,)], "s string")
    assert [r.x for r in df.select(severity.at_least(F.col("s"), "HIGH").alias("x")).collect()] == [False, True, True, False, False]
    assert [r.x for r in df.select(severity.at_least(F.col("s"), "odd").alias("x")).collect()] == [False] * 5
    geo = spark.createDataFrame([('{"city":"x","country":"y"}',)], "g string").select(severity.location(severity.geo_from_json(F.col("g"))).alias("l"))
    assert geo.first().l == "x, y"
