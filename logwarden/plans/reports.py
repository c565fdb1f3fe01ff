"""Report queries over the events and alerts tables."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logwarden import fixed_values as fixed
from logwarden.functions import text
from logwarden.functions.clock import MICROS, cell, hour_label, micros

HOUR = 3_600 * MICROS
MOST_GROUPS = 1_000  # of hours, categories and top addresses in the dashboard document; Spark cuts groups up to this on the map side


def newest(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Newest rows first; a negative limit means all.

    The smallest wanted key is found on the key column alone.  As a scalar subquery it becomes
    a filter of the scan, so the wide columns are read only where the newest rows are stored.
    """
    if limit < 0:
        return rows.orderBy(F.desc(key))
    top = rows.select(key).orderBy(F.desc(key)).limit(limit).agg(F.min(key))
    return rows.filter(F.col(key) >= top.scalar()).orderBy(F.desc(key)).limit(limit)


def recent_events(
    events: DataFrame, limit: int = fixed.RECENT_EVENTS, category: str | None = None,
    source: str | None = None,
) -> DataFrame:
    if category:
        events = events.filter(F.col("category") == category)
    if source:
        lowered = F.col("source_lc") if "source_lc" in events.columns else F.lower("source")
        events = events.filter(lowered == source.lower())
    return newest(events, "event_id", limit)


def recent_alerts(
    alerts: DataFrame, limit: int = fixed.RECENT_ALERTS, severity: str | None = None
) -> DataFrame:
    if severity:
        alerts = alerts.filter(F.col("severity") == severity)
    return newest(alerts, "alert_id", limit)


def overview_alerts(alerts: DataFrame, rows: int = fixed.OVERVIEW_ALERTS) -> DataFrame:
    return newest(alerts, "alert_id", rows).select(
        "alert_id", text.display_time(F.col("ts")).alias("time"), "rule_name", "severity", "event_id"
    )


def page_of_alerts(alerts: DataFrame, severity: str, rows: int = fixed.PAGE_ROWS) -> DataFrame:
    """The newest page, and of it the rows of one severity."""
    return newest(alerts, "alert_id", rows).filter(F.col("severity") == severity)


def page_of_events(events: DataFrame, category: str, rows: int = fixed.PAGE_ROWS) -> DataFrame:
    return newest(events, "event_id", rows).filter(F.col("category") == category)


def alert_details(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts with the event that caused them; both should be stored tables.

    Both sides are joined by the event id, which is even, and by a shared day column, which
    prunes days.
    """
    keys = [c for c in ("event_id", "dt") if c in alerts.columns and c in events.columns]
    return alerts.join(events.select(*keys, "source", "category", "raw"), keys)


def totals(events: DataFrame, alerts: DataFrame) -> DataFrame:
    counted = [
        events.agg(F.count("*").alias("n")).select(F.lit("events").alias("what"), "n"),
        alerts.agg(F.count("*").alias("n")).select(F.lit("alerts").alias("what"), "n"),
    ]
    return counted[0].unionByName(counted[1])


def alerts_by_severity(alerts: DataFrame) -> DataFrame:
    """One row per known severity, zero included."""
    counts = alerts.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITIES])
    return counts.unpivot([], fixed.SEVERITIES, "severity", "n")


def events_by_category(events: DataFrame) -> DataFrame:
    return events.groupBy("category").agg(F.count("*").alias("n"))


def events_by_hour(events: DataFrame, now: datetime | Column, whole_day: bool = False) -> DataFrame:
    """Events per hour of the last 24 hours; ``whole_day`` counts from the start of the first day."""
    now = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz") if isinstance(now, datetime) else now
    since = now - F.expr("INTERVAL 24 HOURS")
    if whole_day:
        since = since.cast("date").cast("timestamp_ntz")
    recent = events.filter(F.col("ts") >= since)
    return recent.groupBy(hour_label(F.col("ts")).alias("hour")).agg(F.count("*").alias("n")).orderBy("hour")


def _first(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows of an ordered report; a negative limit gives all."""
    return rows if limit < 0 else rows.limit(limit)


def top_addresses(events: DataFrame, alerted_only: bool = False, limit: int = fixed.TOP_ADDRESSES) -> DataFrame:
    """Most frequent source addresses of all events, or only of events with an alert."""
    if alerted_only:
        events = events.filter(F.col("has_alert") == 1)
    counts = events.filter(F.col("src_ip").isNotNull()).groupBy(F.col("src_ip").alias("ip")).agg(F.count("*").alias("n"))
    return _first(counts.orderBy(F.desc("n"), "ip"), limit)


def rule_stats(alerts: DataFrame, limit: int = fixed.TOP_RULES) -> DataFrame:
    """Firing counts of the most active rules, with the newest name and severity.

    KPIs over every fired rule take ``limit=-1``.
    """
    counts = (
        alerts.groupBy("rule_id")
        .agg(
            F.max_by("rule_name", "alert_id").alias("rule_name"),
            F.max_by("severity", "alert_id").alias("severity"),
            F.count("*").alias("firing_count"),
        )
    )
    return _first(counts.orderBy(F.desc("firing_count"), "rule_id"), limit)


def rule_kpis(stats: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules configured and fired, the top rule, and the mean firings of a fired rule."""
    first = F.struct((-F.col("firing_count")).alias("n"), "rule_id")
    fired = stats.agg(
        F.min_by("rule_id", first).alias("top_rule"), F.max("firing_count").alias("top_rule_count"),
        F.count("*").alias("rules_fired"), F.round(F.avg("firing_count"), 1).alias("avg_firing"),
    )
    parts = fired.withColumn("rules_configured", F.lit(None).cast("bigint")).unionByName(
        rules.agg(F.count("*").alias("rules_configured")), allowMissingColumns=True
    )
    return parts.agg(
        F.max("rules_configured").alias("rules_configured"),
        F.coalesce(F.max("top_rule"), F.lit("–")).alias("top_rule"),
        F.coalesce(F.max("top_rule_count"), F.lit(0)).alias("top_rule_count"),
        F.max("rules_fired").alias("rules_fired"),
        F.coalesce(F.max("avg_firing"), F.lit(0.0)).alias("avg_firing"),
    )


def with_bars(rows: DataFrame, count: str, tie: str) -> DataFrame:
    """Rank and bar width in percent of the largest count; for top lists of a few rows."""
    place = W.orderBy(F.desc(count), tie)
    share = F.col(count) / F.max(count).over(W.partitionBy()) * 100
    return rows.withColumns({
        "rank": F.row_number().over(place), "bar": F.floor(share + 0.5).cast("int"),
    })


def ranked_rules(stats: DataFrame, severity: str = "all") -> DataFrame:
    """Rule counts of one severity, ranked among themselves."""
    kept = stats if severity == "all" else stats.filter(F.col("severity") == severity)
    return with_bars(kept, "firing_count", "rule_id")


def category_coverage(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per rule category: rules, rules that fired, alerts; categories without alerts count 0."""
    fired = alerts.groupBy(F.col("rule_id").alias("id")).agg(F.count("*").alias("n"))
    return rules.join(fired, "id", "left").groupBy("category").agg(
        F.count("*").alias("rules"), F.count("n").alias("rules_fired"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("alerts"),
    )


def detected_techniques(alerts: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Techniques seen in alerts; IDS alert events stand for network scanning."""
    seen = alerts.select("mitre")
    if events is not None:
        scans = events.filter(F.col("category") == "suricata").select(F.lit("T1046").alias("mitre"))
        seen = seen.unionByName(scans)
    return seen.filter(F.col("mitre").isNotNull()).distinct()


def detection_by_scenario(techniques: DataFrame, scenarios=fixed.SCENARIOS) -> DataFrame:
    table = techniques.sparkSession.createDataFrame(list(scenarios), "scenario string, mitre string")
    return table.join(techniques.withColumn("hit", F.lit(True)), "mitre", "left").select(
        "scenario", "mitre", F.coalesce("hit", F.lit(False)).alias("detected")
    )


def detection_rate(techniques: DataFrame, scenarios=fixed.SCENARIOS) -> DataFrame:
    """Scenarios, detected ones and their share in percent."""
    return detection_by_scenario(techniques, scenarios).agg(
        F.count("*").alias("scenarios"), F.count_if("detected").alias("detected"),
        F.round(F.avg(F.col("detected").cast("int")) * 100, 1).alias("rate"),
    )


def _event_counts(events: DataFrame, now, whole_day: bool) -> DataFrame:
    """(section, key, n): events in total, by category, by hour and of the top addresses, from one scan.

    Grouping sets give each row to all groupings at once and are summed on the map side; of the
    addresses every task passes on the first ones only.
    """
    now = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz") if isinstance(now, datetime) else now
    since = now - F.expr("INTERVAL 24 HOURS")
    if whole_day:
        since = since.cast("date").cast("timestamp_ntz")
    hour = F.when(F.col("ts") >= since, cell(micros(F.col("ts")), HOUR))
    keys = events.select("category", hour.alias("hour"), "src_ip")
    counted = keys.groupingSets([["category"], ["hour"], ["src_ip"], []], "category", "hour", "src_ip").agg(
        F.count("*").alias("n"), F.grouping_id().alias("kind"))
    section = F.element_at(F.create_map(*[F.lit(v) for pair in ((3, "category"), (5, "hour"), (6, "ip"), (7, "total")) for v in pair]), F.col("kind").cast("int"))
    label = hour_label(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour").cast("int")))
    named = counted.select(section.alias("section"), "n", F.coalesce("category", label, "src_ip", F.when(F.col("kind") == 7, "events")).alias("key"))
    place = F.row_number().over(W.partitionBy("section").orderBy(F.desc("n"), "key"))
    known = named.filter(F.col("key").isNotNull()).withColumn("place", place).filter(F.col("place") <= MOST_GROUPS)
    return known.filter((F.col("section") != "ip") | (F.col("place") <= fixed.TOP_ADDRESSES)).select("section", "key", "n")


def _alert_counts(alerts: DataFrame) -> DataFrame:
    """(section, key, n): alerts in total and by severity, from one scan."""
    counts = alerts.agg(F.count("*").alias("alerts"), *[F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITIES])
    return counts.unpivot([], ["alerts", *fixed.SEVERITIES], "key", "n").select(
        F.when(F.col("key") == "alerts", "total").otherwise("severity").alias("section"), "key", "n")


def stats_document(events: DataFrame, alerts: DataFrame, now, whole_day: bool = False) -> DataFrame:
    """All dashboard numbers as one JSON document: one pass over each table, then a few dozen rows."""
    rows = _event_counts(events, now, whole_day).unionByName(_alert_counts(alerts))

    def entries(section: str, order: Column | None = None) -> Column:
        entry = F.struct((F.col("key") if order is None else order).alias("order"), "key", "n")
        return F.sort_array(F.collect_list(F.when(F.col("section") == section, entry)))

    def as_map(list_: Column) -> Column:
        return F.map_from_entries(F.transform(list_, lambda e: F.struct(e["key"], e["n"])))

    def as_list(list_: Column, name: str) -> Column:
        return F.transform(list_, lambda e: F.struct(e["key"].alias(name), e["n"].alias("count")))

    def total(what: str) -> Column:
        return F.max(F.when((F.col("section") == "total") & (F.col("key") == what), F.col("n")))

    gathered = rows.agg(
        total("events").alias("total_events"), total("alerts").alias("total_alerts"),
        entries("severity").alias("severity"), entries("category").alias("category"),
        entries("hour").alias("hour"),
        F.sort_array(F.collect_list(F.when(
            F.col("section") == "ip", F.struct((-F.col("n")).alias("order"), "key", "n")
        ))).alias("ip"),
    )
    return gathered.select(F.to_json(F.struct(
        "total_events", "total_alerts", as_map(F.col("severity")).alias("by_severity"),
        as_map(F.col("category")).alias("by_category"), as_list(F.col("hour"), "hour").alias("events_by_hour"),
        as_list(F.col("ip"), "ip").alias("top_src_ips"),
    )).alias("document"))
