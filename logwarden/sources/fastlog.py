"""The IDS one-line alert log."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions import text

# Fixed format of a line: time, [gid:sid:rev], message, class, priority, protocol, end points.
LINE = (
    r"^(\S+)\s+\[\*\*\] \[(\d+):(\d+):(\d+)\] (.*?) \[\*\*\] "
    r"(?:\[Classification: ([^\]]*)\] )?\[Priority: (\d+)\] \{(\S+)\} (\S+) -> (\S+)$"
)


def parse_fastlog(lines: DataFrame) -> DataFrame:
    """Typed columns of the well-formed lines in ``raw``."""
    kept = [c for c in lines.columns if c != "raw"]
    names = ["seen_at", "gid", "sid", "rev", "msg", "class", "priority", "proto", "src", "dest"]
    # one run of the pattern; Spark keeps the joined groups as a column of their own
    joined = lines.withColumn("_joined", text.join_groups(F.col("raw"), LINE, tuple(range(1, len(names) + 1))))
    parts = joined.withColumn("_parts", text.split_groups(F.col("_joined"), F.col("raw"), len(names)))

    def value(place: int, name: str) -> Column:
        part = F.get("_parts", F.lit(place))
        if name == "seen_at":
            return F.try_to_timestamp(part, F.lit("MM/dd/yyyy-HH:mm:ss.SSSSSS")).cast("timestamp_ntz")
        return part.try_cast("int") if name in ("gid", "sid", "rev", "priority") else part

    columns = [value(n, name).alias(name) for n, name in enumerate(names)]
    return parts.filter(F.col("_parts").isNotNull()).select(*kept, *columns, "raw").filter(F.col("sid").isNotNull())


def with_word(lines: DataFrame, word: str) -> DataFrame:
    """Lines holding a word, any case."""
    return lines.filter(text.has_any_case(F.col("raw"), word))


def counts_by_signature(alerts: DataFrame) -> DataFrame:
    """Hits of each revision of a signature."""
    return (
        alerts.groupBy("gid", "sid", "rev", "msg").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "gid", "sid", "rev", "msg")
    )
