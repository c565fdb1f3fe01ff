"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every text version is a blob, named by its SHA-256. The ledger is a table of (blob, rule, rule
version) with the spans found. A scan looks only at pairs of blob and rule version the ledger does
not have, each blob once however many documents (paths) hold it, appends them, and joins the
findings back to all paths. A changed rule has another version and is scanned anew; texts that
come back are not.

Spans: a rule's matches and the gaps between them (the text split by the rule) alternate, so
running sums of their lengths are the places, in code points.

Cases: null is the empty text; empty texts are one blob without findings; repeated rows keep their
own findings each; spans of several rules at one place are ordered by the rules' order; extra
columns are ignored; an empty table gives no rows.
"""

import dataclasses
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden import staging
from logwarden.llm.common import release, stage, text_of


@dataclasses.dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates leftmost and without overlap; one is kept if its ``group`` has
    at least ``least`` characters. ``hint`` is a cheap test that no text with a match fails."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    hints: tuple[str, ...] = ()
    fold: bool = False

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.pattern, self.least, self.group)).encode()).hexdigest()[:16]


# Formats of secrets. A private key goes on to the next END line if no other block
# begins or ends before; without one through its header lines and base64, wrapped by white space or
# written line breaks: runs of 16 and more, and whole lines. Possessive groups need no stack in a long body.
_BREAK = r"(?:[ \t\r\n]|\\[nr])"
_PEM = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----(?:BEGIN|END) )[\s\S])*+-----END [A-Z ]*PRIVATE KEY-----"
        r"|(?:" + _BREAK + r"*+[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+(?=[\r\n\\]))*+"
        r"(?:" + _BREAK + r"*+[A-Za-z0-9+/]{16,}+={0,2}+|(?:[\r\n]|\\[nr])++[ \t]*+[A-Za-z0-9+/]++={0,2}+(?=[ \t]*+(?:[\r\n]|\\[nr]|(?![\s\S])))"
        r"|" + _BREAK + r"++[A-Za-z0-9+/]++={1,2}+)*+)")
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2,
         ("passw", "secret", "token", "api"), True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, ("AKIA",)),
    Rule("hex", r"[0-9a-f]{24,}"),  # a maximal run of the digits that has 24 is found from its first
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hints=("eyJ",)),
    Rule("pem", _PEM, hints=("PRIVATE KEY-----",)),
)
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:int,rank:int,kind:string,stop:int>>"


def may_match(rule: Rule, text: Column) -> Column:
    if not rule.hints:
        return text.rlike(rule.pattern)
    low = F.lower(text) if rule.fold else text
    found = low.contains(rule.hints[0])
    for hint in rule.hints[1:]:
        found = found | low.contains(hint)
    return found


def spans_of(rule: Rule, rank: int, text: Column) -> Column:
    """Places of the kept matches as [(start, rank, kind, stop)]."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    size = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    # each match after its gap: (where it ends, its own length, its group's length)
    pairs = F.zip_with(F.zip_with(F.split(text, rule.pattern, -1), found, lambda gap, match: F.struct(
        F.length(gap).alias("gap"), F.length(match).alias("size"))), size, lambda pair, group: F.struct(
            pair["gap"].alias("gap"), pair["size"].alias("size"), F.length(group).alias("least")))
    walked = F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans")),
        lambda held, pair: F.when(pair["size"].isNull(), held).otherwise(F.struct(
            (held["at"] + pair["gap"] + pair["size"]).alias("at"),
            F.when(pair["least"] < rule.least, held["spans"]).otherwise(F.array_append(held["spans"], F.struct(
                (held["at"] + pair["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
                (held["at"] + pair["gap"] + pair["size"]).alias("stop")))).alias("spans"))))
    return F.when(may_match(rule, text), walked["spans"]).otherwise(F.array().cast(SPAN))


def new_ledger(spark: SparkSession) -> str:
    return staging.new_path(spark, "ledger")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(blob, version, spans) of every pair scanned so far; a ledger not written yet has none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    schema = f"blob binary, version string, spans {SPAN}"
    if not files.exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scan_new(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the pairs of blob and rule version that the ledger lacks and append them.

    A blob's text is taken once for all its paths, before and after the shuffle, so a text that a
    third of the documents share travels once for each task."""
    spark = docs.sparkSession
    text = text_of()
    blobs = docs.select(F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), text.alias("text"))
    known = read_ledger(spark, ledger).filter(F.col("version").isin([r.version for r in rules]))
    if known.limit(1).count():
        seen = known.groupBy("blob").agg(F.collect_set("version").alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
    else:
        blobs = blobs.withColumn("seen", F.lit(None).cast("array<string>"))
    blobs = blobs.filter(F.size(F.array_except(F.array(*[F.lit(r.version) for r in rules]), F.coalesce("seen", F.array().cast("array<string>")))) > 0)
    once = blobs.groupBy("blob").agg(F.first("text").alias("text"), F.first("seen").alias("seen"))
    found = once.select("blob", F.explode(F.array(*[F.struct(
        F.lit(rule.version).alias("version"), F.coalesce(F.array_contains("seen", rule.version), F.lit(False)).alias("old"),
        F.when(F.coalesce(F.array_contains("seen", rule.version), F.lit(False)), None).otherwise(
            spans_of(rule, rank, F.col("text"))).alias("spans")) for rank, rule in enumerate(rules)])).alias("pair"))
    found.filter("not pair.old").select("blob", "pair.version", "pair.spans").write.mode("append").parquet(ledger)
    release(spark)


def found_in(spark: SparkSession, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans) of blobs with findings of these rules. The ledger tells places and versions; what a
    version is called, and its order, is what the rules say now."""
    place = {r.version: (n, r.kind) for n, r in reversed(list(enumerate(rules)))}
    named = F.create_map(*[x for version, (n, kind) in place.items() for x in (
        F.lit(version), F.struct(F.lit(n).alias("rank"), F.lit(kind).alias("kind")))])
    rows = read_ledger(spark, ledger).filter(F.col("version").isin(list(place)) & (F.size("spans") > 0)).withColumn("rule", F.try_element_at(named, F.col("version")))
    spans = F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), F.col("rule.rank").alias("rank"), F.col("rule.kind").alias("kind"), s["stop"].alias("stop")))
    return rows.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(spans))).alias("spans"))


def findings(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` (doc_id) with all spans of its text, by start, then rule."""
    known = found_in(docs.sparkSession, ledger, rules)
    paths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("blob"))
    return paths.join(known, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what is new in ``docs`` and return the findings of all its rows."""
    ledger = ledger or new_ledger(docs.sparkSession)
    scan_new(docs, ledger, rules)
    return findings(docs, ledger, rules)


def listed(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every found span, overlaps as one, replaced by ``[secret]``."""
    ledger = ledger or new_ledger(docs.sparkSession)
    scan_new(docs, ledger, rules)
    known = found_in(docs.sparkSession, ledger, rules)
    names, places = docs.columns, [f"c{n}" for n in range(len(docs.columns))]  # columns may have any name
    blob, spans, text = "blob", "spans", F.col(places[names.index("text")])
    parts = F.aggregate(
        F.col(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("text")),
        lambda held, s: F.when(s["stop"] <= held["at"], held)
        .when(s["start"] < held["at"], F.struct(s["stop"].alias("at"), held["text"].alias("text")))
        .otherwise(F.struct(s["stop"].alias("at"), F.concat(
            held["text"], F.substring(text, held["at"] + 1, s["start"] - held["at"]), F.lit("[secret]")).alias("text"))))
    whole = F.concat(parts["text"], F.substring(text, parts["at"] + 1, F.length(text)))
    joined = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(names, places)], F.unhex(F.sha2(text_of().cast("binary"), 256)).alias(blob)).join(
        known.hint("shuffle_hash"), blob, "left")
    clean = F.when(F.col(spans).isNull(), text).otherwise(whole)
    return joined.select(*[clean if c == "text" else F.col(p) for c, p in zip(names, places)]).toDF(*names)
