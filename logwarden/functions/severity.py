"""Severity order, marks and the notification text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden import fixed_values as fixed
from logwarden import schema
from logwarden.functions import clock


def rank(severity: Column) -> Column:
    """1..4 for LOW..CRITICAL, 0 for anything else."""
    order = F.array(*[F.lit(s) for s in fixed.SEVERITIES])
    return F.coalesce(F.array_position(order, severity), F.lit(0))


def at_least(severity: Column, lowest: str) -> Column:
    if lowest not in fixed.SEVERITIES:
        return F.lit(False)
    return rank(severity) >= fixed.SEVERITIES.index(lowest) + 1


def _by_severity(severity: Column, values: dict, other) -> Column:
    found = F.create_map(*[F.lit(v) for pair in values.items() for v in pair])
    return F.coalesce(F.try_element_at(found, severity), F.lit(other))


def mark(severity: Column) -> Column:
    return _by_severity(severity, fixed.SEVERITY_MARKS, fixed.OTHER_MARK)


def colour(severity: Column) -> Column:
    return _by_severity(severity, fixed.SEVERITY_COLOURS, fixed.OTHER_COLOUR)


def location(geo: Column) -> Column:
    parts = [F.nullif(geo[name], F.lit("")) for name in ("city", "region", "country")]
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("Unknown"))


def geo_from_json(geo: Column) -> Column:
    return F.from_json(geo, schema.GEO)


def notification(brand: str = "Security log analytics") -> Column:
    """Chat-message JSON for one row of the alerts table."""
    severity = F.coalesce(F.col("severity"), F.lit("LOW"))
    badge = mark(severity)

    def field(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(True).alias("inline"))

    def quoted(value: Column) -> Column:
        return F.concat(F.lit("`"), value, F.lit("`"))

    fields = F.array(
        field("Rule", quoted(F.coalesce("rule_id", F.lit("N/A")))),
        field("Severity", F.concat_ws(" ", badge, severity)),
        field("MITRE", quoted(F.coalesce(F.nullif(F.col("mitre"), F.lit("")), F.lit("N/A")))),
        field("Source IP", quoted(F.coalesce(F.nullif(F.col("source_ip"), F.lit("")), F.lit("Unknown")))),
        field("Location", location(F.col("geo"))),
        field("ISP", F.coalesce(F.col("geo")["isp"], F.lit("Unknown"))),
    )
    moment = clock.iso_utc(F.col("ts"))
    message = F.struct(
        F.concat(badge, F.lit(fixed.MESSAGE_TITLE), F.coalesce("rule_name", F.lit("Unknown"))).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        colour(severity).alias("color"),
        fields.alias("fields"),
        F.struct(F.concat_ws(" • ", F.lit(brand), moment).alias("text")).alias("footer"),
    )
    return F.to_json(F.struct(F.array(message).alias("embeds")))
