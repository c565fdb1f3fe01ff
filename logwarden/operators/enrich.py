"""Location of addresses from a supplied range table."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logwarden import fixed_values as fixed
from logwarden import schema
from logwarden.functions import text
from logwarden.functions.net import ip_number, is_private
from logwarden.staging import stage

BLOCK = 65_536


def innermost(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Disjoint pieces (start, end, index) of nested spans (start, end, index), each under the innermost
    span that holds it.

    One sweep with a stack of the spans that are open: a span that begins cuts the one it lies in, a
    span that ends gives the rest back to the one below.  Of equal spans the one with the largest index counts.
    """
    pieces, opened = [], []  # opened: (end, index), inner ones last
    at = 0

    def upto(end: int) -> None:
        nonlocal at
        if opened and at <= end:
            pieces.append((at, end, opened[-1][1]))
        at = end + 1

    for start, end, index in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        while opened and opened[-1][0] < start:
            upto(opened[-1][0])
            opened.pop()
        if opened and opened[-1][0] < end:
            raise ValueError(f"ranges cross at {start}: one must hold the other")
        upto(start - 1)
        opened.append((end, index))
    while opened:
        upto(opened[-1][0])
        opened.pop()
    return pieces


def disjoint(ranges: DataFrame) -> DataFrame:
    """``block, number, piece_end, geo``: ranges cut at /16 blocks and, where they are nested, into
    pieces of the innermost one; crossing ranges are refused.

    The sweep sees numbers only.  A block holds at most 65,536 different starts; a table is prepared once.
    """
    names = [f.name for f in schema.GEO.fields]
    known = stage(ranges.select("start", "end", F.struct(*names).alias("geo")).filter(F.col("start") <= F.col("end"))
                  .groupBy("start", "end").agg(F.max("geo").alias("geo")), "ranges")
    first, last = F.floor(F.col("start") / BLOCK), F.floor(F.col("end") / BLOCK)
    cut = known.select("start", "end", F.explode(F.sequence(first, last)).alias("block"))

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        low, high = block * BLOCK, block * BLOCK + BLOCK - 1
        starts, ends = pdf["start"].tolist(), pdf["end"].tolist()
        # whole ranges are swept, so that crossing ones are seen, and the pieces cut to the block
        found = [p for p in innermost([(s, e, n) for n, (s, e) in enumerate(zip(starts, ends))]) if p[0] <= high and p[1] >= low]
        return pd.DataFrame({
            "block": [block] * len(found), "number": [max(p[0], low) for p in found], "piece_end": [min(p[1], high) for p in found],
            "start": [starts[p[2]] for p in found], "end": [ends[p[2]] for p in found]})

    pieces = cut.groupBy("block").applyInPandas(sweep, "block long, number long, piece_end long, start long, end long")
    return pieces.join(known, ["start", "end"]).select("block", "number", "piece_end", "geo")


def locate(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """``geo_ip, geo`` of distinct addresses that lie in one of the ranges, of nested ones the innermost.

    The piece that starts at or below an address is found by sorting both inside the address' /16
    block: a block holds at most 65,536 distinct addresses and some twice as many pieces, so the
    group size is bounded and no pairs are formed.
    """
    pieces = disjoint(ranges).select(
        "block", "number", F.lit(None).cast("string").alias("geo_ip"), F.struct("piece_end", "geo").alias("piece"))
    wanted = (
        addresses.select("geo_ip").distinct().withColumn("number", ip_number(F.col("geo_ip")))
        .filter(F.col("number").isNotNull())
        .select(F.floor(F.col("number") / BLOCK).alias("block"), "number", "geo_ip",
                F.lit(None).cast(pieces.schema["piece"].dataType).alias("piece"))
    )
    upwards = W.partitionBy("block").orderBy("number", F.col("geo_ip").isNotNull())
    return (
        pieces.unionByName(wanted)
        .withColumn("piece", F.last("piece", ignorenulls=True).over(upwards))
        .filter(F.col("geo_ip").isNotNull() & (F.col("number") <= F.col("piece.piece_end")))
        .select("geo_ip", F.col("piece.geo").alias("geo"))
    )


def internal():
    """Location of every private address."""
    known = {"country": fixed.INTERNAL_COUNTRY, "city": fixed.INTERNAL_CITY, "isp": fixed.INTERNAL_ISP}
    return F.struct(*[
        F.lit(known.get(f.name)).cast("string").alias(f.name) for f in schema.GEO.fields
    ])


def add_geo(rows: DataFrame, ranges: DataFrame, row_id: str = "alert_id") -> DataFrame:
    """Replace ``geo_ip`` by ``geo``: internal, looked up, or null when unknown.

    Rows that need no lookup get a join key of their own, so they spread evenly.
    """
    outside = F.col("geo_ip").isNotNull() & ~is_private(F.col("geo_ip"))
    found = locate(rows.filter(outside), ranges).select(F.col("geo_ip").alias("_key"), F.col("geo").alias("_geo"))
    key = F.when(outside, F.col("geo_ip")).otherwise(F.concat(F.lit("-"), F.col(row_id).cast("string")))
    private = F.col("geo_ip").isNotNull() & is_private(F.col("geo_ip"))
    return (
        rows.withColumn("_key", key).join(found, "_key", "left")
        .withColumn("geo", F.when(private, internal()).otherwise(F.col("_geo")))
        .drop("_key", "_geo", "geo_ip")
    )


def known_clients(events: DataFrame, blocklist: DataFrame) -> DataFrame:
    """TLS events whose client fingerprint is on a list ``ja3, family`` of any length.

    The list is joined as it is: Spark broadcasts it when its measured size allows.
    """
    seen = events.filter(F.contains("raw", F.lit(fixed.TLS_MARKER))).withColumn("ja3", text.ja3(F.col("raw")))
    return seen.filter(F.col("ja3") != "").join(blocklist.dropDuplicates(["ja3"]), "ja3")


def unlocated(alerts: DataFrame) -> DataFrame:
    """Alerts in table layout when no range table is at hand: only private ones are placed."""
    private = F.col("geo_ip").isNotNull() & is_private(F.col("geo_ip"))
    return alerts.withColumn("geo", F.when(private, internal())).drop("geo_ip")
