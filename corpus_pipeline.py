"""Corpus pipeline: toxic documents go, near copies go, repeated strings go, secrets are masked,
what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; ``run`` writes each
result as Parquet and reads it again for the next.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm import packing, queries, secrets, simhash, suffix_dedup, toxicity
from logwarden.llm.common import relieve, stage, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the score accepts, as they were. Null and empty texts have no feature and stay; repeated
    rows are judged alike; labels of null or unknown ids are not learned; an empty table stays empty; columns of
    any name are kept."""
    relieve(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id, rows without id last; of an
    id's texts the one with the smallest key, of repeated rows one. Null and empty texts are alike; an empty table
    stays empty; columns of any name are kept."""
    relieve(spark)
    return simhash.single(docs, size=simhash.SHINGLE, bits=simhash.BITS)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier; ``n_chars`` follows. What
    is left of a cut character goes with it. Documents stay, if need be empty."""
    relieve(spark)
    return suffix_dedup.cut_rows(docs, suffix_dedup.THRESHOLD)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret masked; ``n_chars`` follows. Null texts stay null; overlapping secrets are one
    mask; an empty table stays empty; columns of any name are kept."""
    relieve(spark)
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, with their ids and place in sequences of at most 1024 tokens: the ids of a sequence
    are those of its pieces by ``offset``. Null and empty texts are a piece of the end token; repeated rows are pieces
    of their own; an empty table gives no pieces; other columns are left out."""
    relieve(spark)
    return packing.pack(queries.pieces(docs, with_ids=True))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeated_strings),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack),
]
# Trained scores and tokenizers are no SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return stage(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])


