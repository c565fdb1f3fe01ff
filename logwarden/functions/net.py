"""Address expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden import fixed_values as fixed
from logwarden.functions import text


def is_private(ip: Column) -> Column:
    """True for private, loopback and zero networks and for an empty address."""
    return F.coalesce(ip, F.lit("")).rlike("^$|" + fixed.PRIVATE_IP)


def ip_number(ip: Column) -> Column:
    """Dotted address as BIGINT; null when a part is above 255."""
    parts = F.transform(F.split(ip, r"\."), lambda p: F.try_to_number(p, F.lit("999")).cast("bigint"))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, p: n * 256 + p)
    return F.when(F.forall(parts, lambda p: p <= 255), number)


def lookup_key(src_ip: Column, raw: Column) -> Column:
    """Address whose location describes the event: the source if set, else any in the line."""
    return text.first_ipv4(F.coalesce(F.nullif(src_ip, F.lit("")), raw))
