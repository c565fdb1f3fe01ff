"""Network signatures over HTTP and flow records."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden import fixed_values as fixed

COLUMNS = "sid int, msg string, proto string, dest_port int, field string, pattern string, " \
          "nocase boolean, negated boolean, class string"


def signature_table(spark: SparkSession, signatures=fixed.SIGNATURES) -> DataFrame:
    return spark.createDataFrame(list(signatures), COLUMNS)


def flag_value(flags: str) -> tuple[int, int]:
    """``FPU`` or ``F,12`` -> (wanted bits, compared bits); bits after the comma are ignored."""
    wanted, _, ignored = flags.partition(",")
    return (
        sum(fixed.TCP_FLAG_BITS[f] for f in wanted),
        255 - sum(fixed.TCP_RESERVED_BITS[f] for f in ignored),
    )


def condition(signature: tuple) -> Column:
    _, _, proto, port, field, pattern, nocase, negated, _ = signature
    test = F.col("proto") == proto
    if port is not None:
        test = test & (F.col("dest_port") == port)
    value = F.col(field)
    if field == "icmp_type":
        found = value == int(pattern)
    elif field == "tcp_flags":
        bits, compared = flag_value(pattern)
        found = value.bitwiseAND(F.lit(compared)) == bits
    else:
        found = F.contains(
            F.lower(value) if nocase else value, F.lit(pattern.lower() if nocase else pattern)
        )
    return test & (~found if negated else found)


def match_signatures(flows: DataFrame, signatures=fixed.SIGNATURES) -> DataFrame:
    """``flow_id, ts, src_ip, dest_ip, sid`` per hit: one projection, no join with patterns."""
    hits = F.array_compact(F.array(*[F.when(condition(s), F.lit(s[0])) for s in signatures]))
    return flows.select("flow_id", "ts", "src_ip", "dest_ip", F.explode(hits).alias("sid"))


def _with_texts(counts: DataFrame, signatures) -> DataFrame:
    texts = signature_table(counts.sparkSession, signatures)
    return counts.join(F.broadcast(texts.select("sid", "msg", "class")), "sid")  # the fixed list


def signature_counts(hits: DataFrame, signatures=fixed.SIGNATURES) -> DataFrame:
    counted = hits.groupBy("sid").agg(F.count("*").alias("hits"))
    return _with_texts(counted, signatures).orderBy(F.desc("hits"), "sid")


def class_counts(hits: DataFrame, signatures=fixed.SIGNATURES) -> DataFrame:
    counted = hits.groupBy("sid").agg(F.count("*").alias("hits"))
    return _with_texts(counted, signatures).groupBy("class").agg(F.sum("hits").alias("hits"))
