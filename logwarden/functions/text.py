"""Text expressions, all JVM-side."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden import fixed_values as fixed

# Unix lines: '.' stops at \n only.  Unicode classes: \w \d \s \b as in Unicode text.
MODE = "(?dU)"
ANY_CASE = "(?diU)"
SEPARATOR = "\x01"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def truncate(text: Column) -> Column:
    return F.substring(text, 1, fixed.MAX_LINE_CHARS)


def drop_ansi(text: Column) -> Column:
    return F.regexp_replace(text, fixed.ANSI_COLOUR, "")


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match; '' when there is none."""
    return F.regexp_extract(text, MODE + pattern, group)


def join_groups(text: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    """Several groups of the first match by one regex run, joined by a separator.

    The whole text is replaced, and the result is shorter than a matching text, so an
    unchanged text means no match.  Only the last group may hold the separator.  Keep the
    result as a column before ``split_groups``, so that it is computed once.
    """
    whole = rf"\A{pattern[1:]}" if pattern.startswith("^") else rf"\A(?s:.*?){pattern}"
    return F.regexp_replace(text, MODE + whole + r"(?s:.*)\z", SEPARATOR.join(f"${g}" for g in groups))


def split_groups(joined: Column, text: Column, groups: int) -> Column:
    """The joined groups as an array, null when there was no match."""
    return F.when(joined != text, F.split(joined, SEPARATOR, groups))


def like_any_case(text: Column, pattern: str) -> Column:
    return text.rlike(ANY_CASE + pattern)


def has_any_case(text: Column, word: str) -> Column:
    """Whether the lower-case text holds the lower-case word.

    Lowering every text is slow; one of ASCII characters only (as many octets as characters) is searched
    for an ASCII word by pattern, with the same result."""
    lowered = F.contains(F.lower(text), F.lit(word.lower()))
    if not word.isascii():
        return lowered
    pattern = "(?i)" + "".join(c if c.isalnum() or c in "_ " else f"\\{c}" for c in word)
    return F.when(F.octet_length(text) == F.length(text), text.rlike(pattern)).otherwise(lowered)


def first_ipv4(text: Column) -> Column:
    return F.nullif(extract(text, fixed.IPV4_TOKEN), F.lit(""))


def percent_decode(text: Column) -> Column:
    """Percent-decoding that keeps '+' and malformed escapes as they are."""
    kept = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(
        F.contains(text, F.lit("%")), F.url_decode(F.replace(kept, F.lit("+"), F.lit("%2B")))
    ).otherwise(text)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for ''."""
    size = F.length(text).cast("double")
    shares = F.transform(
        F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))),
        lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size,
    )
    return F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def first_label(host: Column) -> Column:
    return F.split_part(host, F.lit("."), F.lit(1))


def ja3(raw: Column) -> Column:
    return extract(raw, fixed.TLS_JA3)


def sni(raw: Column) -> Column:
    return extract(raw, fixed.TLS_SNI)


def tls_version(raw: Column) -> Column:
    return extract(raw, fixed.TLS_VERSION)


def display_time(ts: Column) -> Column:
    return F.concat(F.substr(ts.cast("string"), F.lit(1), F.lit(19)), F.lit(" UTC"))
