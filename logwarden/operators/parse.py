"""Raw lines to typed events: one projection, first matching format wins, nothing is dropped."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logwarden import fixed_values as fixed
from logwarden import schema
from logwarden.functions import text

# Nested objects are taken as text, so their own shape never spoils the row.
_EVE = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("event_type", "src_ip", "dest_ip", "proto", "alert", "http")
])
_EVE_ALERT = T.StructType([
    T.StructField(name, T.StringType()) for name in ("signature", "signature_id", "http")
])


def _probes(raw: Column, source: Column) -> dict[str, Column]:
    """Per format one value that tells whether the line has that format.

    A pattern runs only on lines that hold the fixed characters it asks for."""
    maybe_auth = F.contains(raw, F.lit("su")) | F.contains(raw, F.lit("sshd"))
    maybe_eve = (source == "suricata") & F.startswith(text.strip(raw), F.lit("{"))
    eve = F.from_json(raw, _EVE)
    return {
        "_auth_line": F.when(maybe_auth, text.join_groups(raw, fixed.AUTH_LINE, (4, 5, 6))),
        "_web_line": F.when(F.contains(raw, F.lit('] "')), text.join_groups(raw, fixed.WEB_LINE, (1, 3, 5, 4))),
        "_kernel": F.when(F.startswith(raw, F.lit("[")), text.extract(raw, fixed.KERNEL_LINE)),
        "_eve": F.when(maybe_eve & (eve["event_type"] == "alert"), eve),
        "_priority": F.when(F.startswith(raw, F.lit("<")), text.extract(raw, fixed.PRIORITY_LINE, 2)),
    }


def _is_set(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def _eve_usable(raw: Column) -> Column:
    """The alert part is an object, or absent; a null or scalar one leaves the line generic."""
    alert = F.col("_eve.alert")
    has_key = F.array_contains(F.json_object_keys(raw), "alert")
    return F.col("_eve").isNotNull() & (F.startswith(alert, F.lit("{")) | (alert.isNull() & ~has_key))


def parse(logs: DataFrame, documented_http: bool = False) -> DataFrame:
    """``event_id, ts, source, raw`` -> the same plus ``category`` and the typed fields.

    ``documented_http`` also reads an IDS record's HTTP part from the top level, where the
    IDS really writes it; by default only the part inside ``alert`` counts.
    """
    raw, source = F.col("raw"), F.col("source")
    category = (
        F.when(F.col("_auth").isNotNull(), "auth")
        .when(F.col("_web").isNotNull(), "web")
        .when(_is_set("_kernel"), "kernel")
        .when(_eve_usable(raw), "suricata")
        .when(_is_set("_priority"), "syslog")
        .otherwise("generic")
    )
    # Through a generator, so that a filter on a parsed column is not pushed below the probes,
    # where it would run their patterns again for every use.
    probes = F.struct(*[probe.alias(name) for name, probe in _probes(raw, source).items()])
    probed = logs.select("*", F.inline(F.array(probes))).withColumns({
        "_auth": text.split_groups(F.col("_auth_line"), raw, 3),
        "_web": text.split_groups(F.col("_web_line"), raw, 4),
    }).withColumn("category", category)

    kind = F.col("category")

    def only(name: str, value: Column) -> Column:
        return F.when(kind == name, value)

    def part(name: str, place: int) -> Column:
        return F.get(name, F.lit(place))

    split = probed.withColumns({
        "full_uri": only("web", part("_web", 3)),
        "_alert": only("suricata", F.from_json(F.coalesce("_eve.alert", F.lit("{}")), _EVE_ALERT)),
    })

    full_uri = F.col("full_uri")
    query_at = F.instr(full_uri, "?")
    query = F.when(query_at > 0, F.substr(full_uri, query_at + 1)).otherwise("")

    http = F.coalesce("_alert.http", F.lit("{}"))
    if documented_http:
        http = F.coalesce(F.nullif(http, F.lit("{}")), F.col("_eve.http"), F.lit("{}"))

    def http_value(name: str) -> Column:
        return F.when(http == "{}", "").otherwise(F.get_json_object(http, f"$.{name}"))

    fields = {
        "process": part("_auth", 0),
        "pid": part("_auth", 1),
        "message": F.when(kind == "auth", part("_auth", 2))
        .when(kind == "kernel", F.col("_kernel"))
        .when(kind == "syslog", text.strip(F.col("_priority")))
        .when(kind == "generic", raw),
        "src_ip": F.when(kind == "auth", text.first_ipv4(part("_auth", 2)))
        .when(kind == "web", part("_web", 0))
        .when(kind == "suricata", F.coalesce("_eve.src_ip", F.lit(""))),
        "method": only("web", part("_web", 1)),
        "path": only("web", F.split_part(full_uri, F.lit("?"), F.lit(1))),
        "query": only("web", text.percent_decode(query)),
        "full_uri": full_uri,
        "status": only("web", part("_web", 2).try_cast("int")),
        "size": only("web", F.lit(0)),
        "signature": only("suricata", F.coalesce("_alert.signature", F.lit(""))),
        "signature_id": only(
            "suricata", F.coalesce(F.col("_alert.signature_id"), F.lit("0")).try_cast("bigint")
        ),
        "dest_ip": only("suricata", F.coalesce("_eve.dest_ip", F.lit(""))),
        "proto": only("suricata", F.coalesce("_eve.proto", F.lit(""))),
        "http_method": only("suricata", http_value("http_method")),
        "http_uri": only("suricata", http_value("http_uri")),
        "priority": only("syslog", text.extract(raw, fixed.PRIORITY_LINE).try_cast("int")),
    }
    return split.select(
        *[c for c in logs.columns if c != "raw"], "category", "raw",
        *[fields[f.name].alias(f.name) for f in schema.FIELDS.fields],
    )


def response_bytes() -> Column:
    """Response size of an access-log line, for reports that want the real one; null if '-'."""
    return F.trim(text.extract(F.col("raw"), fixed.WEB_LINE, 6)).try_cast("bigint")


def fields_json() -> Column:
    """The fields of a parsed event as sparse JSON."""
    return F.to_json(F.struct(*[f.name for f in schema.FIELDS.fields]))


def fields_from_json(column: Column) -> Column:
    """Back from JSON; text that is not JSON gives a record with no field set."""
    empty = F.from_json(F.lit("{}"), schema.FIELDS)
    return F.coalesce(F.from_json(column, schema.FIELDS), empty)
