"""Quality rules and distribution divergence, in DataFrame functions only.

Base rules count words, symbols, repeated lines and words in repeated 5-word windows. The verdict
compares two histograms of a document with the reference of its language by Jensen-Shannon
distance: character classes, and the language's common words with one bin for all others.

References come from the corpus: the common words of a language are those in most of its
documents, the histograms are sums over all its documents that pass the base rules. A document is taken
out of its own reference, so that none is compared with itself. Every language has a reference of its
own; where fewer than FEW other documents are left in it, the character classes of all documents make up
for those that lack, and words are not compared. Documents without a language are judged against all
documents, in any language or none. The references are joined by language; they are broadcast only if
they were counted and are few. Short documents say little about a distribution: below MIN_CHARS or
MIN_WORDS the comparison is not made.

Cases: null and empty texts have no words and fail the base rules; repeated rows are judged each;
extra columns are ignored; an empty table gives no rows.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import stage, text_of
from logwarden.staging import sized

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # percent of the words
COMMON = 12
FEW = 2  # other documents from which a language's reference stands for itself
MIN_CHARS, MAX_CHAR_DISTANCE = 200, 0.36
LEAST_WORDS, MAX_WORD_DISTANCE = 100, 0.26
ALL = ""
BLANK = "[ \\t-\\r]+"
CLASSES = ("lower", "upper", "digit", "mark", "symbol", "rest", "blank")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def covered(hashes: Column, window: int) -> Column:
    """Words in windows whose hash is there twice or more: starts of such windows in order, each
    adding as many words as it reaches beyond the one before."""
    def starts(pairs: Column) -> Column:
        def twin(pair, k):
            before = F.when(k > 0, pairs[k - 1]["h"])
            after = F.when(k + 1 < F.size(pairs), pairs[k + 1]["h"])
            return F.when((before == pair["h"]) | (after == pair["h"]), pair["i"])
        return F.sort_array(F.filter(F.transform(pairs, twin), lambda i: i.isNotNull()))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.aggregate(
        let(pairs, starts), F.struct(F.lit(-window).alias("last"), F.lit(0).alias("words")),
        lambda held, i: F.struct(i.alias("last"), (held["words"] + F.least(F.lit(window), i - held["last"])).alias("words")))["words"]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    def windows(hashes):
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.xxhash64(*[hashes[i + k] for k in range(window)]))

    def number(found):
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(covered(found, window))

    return F.when(F.size(words) < 2, F.lit(0)).when(F.size(words) <= window, F.lit(0)).otherwise(
        let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), number))


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[^ \\t-\\r]"))
    return let(lines, lambda some: F.size(some) - F.size(F.array_distinct(some)))


def classes(text: Column, blanks: Column) -> Column:
    """Counts of character classes; all but lower-case letters and spaces are a short rest."""
    def of(rest: Column) -> Column:
        size = {
            "upper": F.regexp_count(rest, F.lit("\\p{Lu}")), "digit": F.regexp_count(rest, F.lit("\\p{Nd}")),
            "mark": F.regexp_count(rest, F.lit("[.,;:!?\"'()-]")), "symbol": F.regexp_count(rest, F.lit("[#*$%&|<>]")),
            "blank": blanks, "lower": F.length(text) - F.length(rest)}
        size["rest"] = F.length(rest) - size["upper"] - size["digit"] - size["mark"] - size["symbol"] - blanks
        return F.struct(*[size[c].cast("long").alias(c) for c in CLASSES])

    return let(F.regexp_replace(text, "[a-zß-öø-ÿ]+", ""), of)


def language(docs: DataFrame) -> Column:
    """Name of the reference: marked for a language, also an empty one, and ALL for null."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(ALL)) if "lang" in docs.columns else F.lit(ALL)


def common_words(docs: DataFrame, every: bool) -> DataFrame:
    """(ref, common): common words of each language, and with ``every`` of all documents under ALL."""
    shared = docs.select(language(docs).alias("ref"), F.explode(F.array_distinct(words_of(text_of()))).alias("word"))
    counts = shared.groupBy("ref", "word").agg(F.count("*").alias("n"))
    if every:
        counts = stage(counts, "words")
        counts = counts.filter(F.col("ref") != ALL).unionByName(
            counts.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("ref"), "word", "n"))
    # the group limit keeps COMMON words of each reference in every task
    place = F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("n"), F.desc("word")))
    best = counts.filter("n > 1").withColumn("place", place).filter(F.col("place") <= COMMON)
    rows = F.sort_array(F.collect_list(F.struct("n", "word")), False)
    # words at least a thousandth as frequent as the most frequent
    return best.groupBy("ref").agg(rows.alias("best")).select("ref", F.transform(
        F.filter("best", lambda r: r["n"] * 1000 >= F.col("best")[0]["n"]), lambda r: r["word"]).alias("common"))


def features(docs: DataFrame, common: DataFrame, every: bool) -> DataFrame:
    """Counts of every row, with its language's reference name; with ``every`` also those of the
    common words of all documents."""
    spare = common.filter(F.col("ref") == ALL).first() if every else None  # COMMON words
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), language(docs).alias("ref"))
    nothing = F.array().cast("array<string>")
    named = texts.join(sized(common), "ref", "left").select(
        "doc_id", "text", "ref", F.coalesce("common", nothing).alias("common"),
        F.array(*map(F.lit, spare["common"] if spare else [])).cast("array<string>").alias("shared"))

    def numbers(words: Column, of: str) -> Column:
        return F.array(*[(F.size(words) - F.size(F.array_remove(words, F.coalesce(F.get(of, F.lit(k)), F.lit(""))))).cast("long")
                         for k in range(COMMON)])

    def counted(words: Column) -> Column:
        in_words = F.length(F.array_join(words, ""))
        return F.struct(
            F.size(words).cast("long").alias("n_words"), in_words.cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            classes(F.col("text"), F.length("text") - in_words).alias("classes"),
            numbers(words, "common").alias("common"), *([numbers(words, "shared").alias("shared")] if every else []))

    found = named.select("doc_id", "ref", repeated_lines(F.col("text")).cast("long").alias("n_dup_lines"),
                         let(words_of(F.col("text")), counted).alias("c"))
    base = (F.col("c.n_words") < MIN_WORDS) | (100 * F.col("c.n_repeat_words") > MAX_REPEATED * F.col("c.n_words"))
    return found.select("doc_id", "ref", "c.n_words", "c.word_chars", F.col("c.classes.symbol").alias("n_symbols"), "n_dup_lines",
                        "c.n_repeat_words", base.alias("base_failed"), F.col("c.classes").alias("classes"), F.col("c.common").alias("common"),
                        *([F.col("c.shared").alias("shared")] if every else []))


def references(counted: DataFrame, every: bool) -> DataFrame:
    """Sums of the histograms over documents that pass the base rules, for each language and, with
    ``every``, for all documents together."""
    passing = counted.filter("not base_failed")

    def sums(of: str) -> list[Column]:
        return ([F.sum(f"classes.{c}").alias(f"ref_{c}") for c in CLASSES] + [F.sum(F.col(of)[k]).alias(f"ref_{k}") for k in range(COMMON)]
                + [F.sum("n_words").alias("ref_words"), F.count("*").alias("ref_docs")])

    own = passing.filter(F.col("ref") != ALL).groupBy("ref").agg(*sums("common"))
    return own.unionByName(passing.groupBy(F.lit(ALL).alias("ref")).agg(*sums("shared"))) if every else own


def distance(own: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of counts; null if one is empty."""
    def total(parts):
        return F.aggregate(parts, F.lit(0.0), lambda held, x: held + x)

    def shares(parts):
        return let(total(parts), lambda n: F.when(n > 0, F.transform(parts, lambda x: x / n)))

    def gain(p, m):
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(shares(own), shares(reference), lambda p, q: gain(p, (p + q) / 2) + gain(q, (p + q) / 2))
    return let(total(terms) / 2, lambda x: F.sqrt(F.when(x < 0, 0.0).otherwise(x)))  # rounding may go below zero


def histograms(prefix: str, words: str) -> list[Column]:
    """Character-class and common-word histograms as arrays of doubles."""
    chars = F.array(*[F.col(f"{prefix}{c}").cast("double") for c in CLASSES])
    common = [F.coalesce(F.col(f"{prefix}{k}"), F.lit(0)).cast("double") for k in range(COMMON)]
    return [chars, F.array(*common, F.col(words) - sum(common[1:], common[0]))]


def mixed(own: Column, others: Column, weight: Column) -> Column:
    """Shares of two histograms of counts, the first with the given weight; an empty one adds nothing."""
    def shares(parts: Column, scale: Column) -> Column:
        return let(F.aggregate(parts, F.lit(0.0), lambda held, x: held + x),
                   lambda n: F.transform(parts, lambda x: F.when(n > 0, scale * x / n).otherwise(F.lit(0.0))))

    return F.zip_with(shares(own, weight), shares(others, 1 - weight), lambda a, b: a + b)


def judge(docs: DataFrame) -> DataFrame:
    """Counts, distances and the verdict ``kept`` of every row."""
    every = not docs.filter(language(docs) == ALL).isEmpty()  # otherwise no row needs the words of all
    counted = stage(features(docs, stage(common_words(docs, every), "common"), every), "features")
    whole = counted.filter("not base_failed").agg(*[F.sum(f"classes.{c}").alias(c) for c in CLASSES]).first()
    joined = counted.join(sized(stage(references(counted, every), "references")), "ref", "left")
    own = joined.select("*", *[F.col("classes")[c].alias(f"own_{c}") for c in CLASSES], *[F.col("common")[k].alias(f"own_{k}") for k in range(COMMON)])
    held = F.when(F.col("base_failed"), 0).otherwise(1)  # whether the reference holds the document

    def without(reference: Column, values: list[Column]) -> Column:
        return F.array(*[reference[k] - v.cast("double") * held for k, v in enumerate(values)])

    (chars, words), (ref_chars, ref_words) = histograms("own_", "n_words"), histograms("ref_", "ref_words")
    classes = [F.col(f"own_{c}") for c in CLASSES]
    others = F.coalesce(F.col("ref_docs"), F.lit(0)) - held
    every_char = F.array(*[F.lit(float(whole[c] or 0)) for c in CLASSES])
    of_language = F.when(others > 0, without(ref_chars, classes)).otherwise(F.array(*[F.lit(0.0)] * len(CLASSES)))
    reference = mixed(of_language, without(every_char, classes), F.least(others, F.lit(FEW)) / FEW)
    rest = F.col("n_words") - sum([F.col(f"own_{k}") for k in range(1, COMMON)], F.col("own_0"))
    common = without(ref_words, [*[F.coalesce(f"own_{k}", F.lit(0)) for k in range(COMMON)], rest])
    size = sum([F.col(f"classes.{c}") for c in CLASSES[1:]], F.col("classes.lower"))
    return own.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(size >= MIN_CHARS, distance(chars, reference)).alias("char_distance"),
        F.when((F.col("n_words") >= LEAST_WORDS) & (others >= FEW), distance(words, common)).alias("word_distance"),
    ).withColumn("kept", ~F.col("base_failed") & (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE)
                 & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE))
