"""One query for each operator over its whole table, in the form the driver reads."""

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm import chat, cover_dedup, packing, quality, repair, search, secrets, simhash, suffix_dedup, tokens, toxicity, warc, whitening
from logwarden.llm.common import stage, table
from logwarden.llm.sql import ORACLES  # noqa: F401  (read by the driver beside QUERIES)

Query = Callable[[SparkSession, str], DataFrame]
END_ID = 2


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, folder, "documents"), threshold=100).drop("kept")


def pieces(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    tokenizer = tokens.json_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.cut_pieces(docs, tokenizer, END_ID, packing.LIMIT, with_ids)


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(pieces(table(spark, folder, "documents")))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.groups(table(spark, folder, "documents"), size=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.archive(table(spark, folder, "pages"), least=100)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_top_k_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.top(table(spark, folder, "embeddings"), every=50, k=5, scale=256)


def op7_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(
        "doc_id", *[secrets.count(F.col("spans"), kind).alias(f"n_{kind}") for kind in secrets.BASE],
        F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return cover_dedup.dedup(table(spark, folder, "documents"), window=35).drop("kept")


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = tokens.ranks_tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    decoded = tokens.decode(tokens.encode(table(spark, folder, "documents"), tokenizer), tokenizer)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok").alias("text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    read = functools.reduce(DataFrame.unionByName, [chat.read_back(part) for part in chat.format_parts(given.unionByName(odd))])
    return read.select("conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = whitening.finite(table(spark, folder, "embeddings"))
    found = whitening.fit(vectors)
    if found is None:
        return spark.createDataFrame([], OP12)
    rows = stage(whitening.whiten(vectors, found), "whitened")
    error = whitening.identity_error(rows, found)
    share = F.array(*[F.lit(None if v != v else float(v)).cast("double") for v in found.share])
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "value")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation",
        F.when(~F.isnan("value"), F.col("value")).alias("whitened"), F.get(share, F.col("k")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, folder, "conversations")))


OP12 = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_suffix_dedup, op2_best_fit_packing, op3_quality_rules, op4_simhash, op5_warc, op6_top_k_search, op7_secret_scans,
    op8_toxicity, op9_substring_dedup, op10_byte_bpe, op11_chat_windows, op12_whitening, op13_conversation_repair)}
