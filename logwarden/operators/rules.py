"""The rule catalogue: every rule is a name tag plus Column builders."""

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden import fixed_values as fixed
from logwarden.functions import text


@dataclass(frozen=True)
class WindowCount:
    """Fire from the ``at_least``-th matching row of one key within ``seconds``."""

    counter: str
    at_least: int
    seconds: int = fixed.WINDOW_SECONDS


@dataclass(frozen=True)
class FollowUp:
    """Fire when the key had ``at_least`` rows of ``counter`` in the last ``seconds``."""

    counter: str
    at_least: int
    seconds: int = fixed.FOLLOWUP_SECONDS


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    description: str
    severity: str
    category: str
    mitre: str | None
    match: Callable[[], Column]
    threshold: WindowCount | FollowUp | None = None
    key: Callable[[], Column] | None = None  # what the threshold counts by; the source address if not given


def _in(category: str, test: Column) -> Column:
    return (F.col("category") == category) & test


def _failed() -> Column:
    return _in("auth", text.has_any_case(F.col("message"), "failed"))


def _ssh_failed() -> Column:
    return _failed() & text.has_any_case(F.col("process"), "ssh")


def _root_attempt() -> Column:
    return _in("auth", text.like_any_case(F.col("message"), fixed.ROOT_ATTEMPT))


def _root_accepted() -> Column:
    return _in("auth", text.like_any_case(F.col("message"), fixed.ROOT_ACCEPTED))


def _sudo_command() -> Column:
    return _in("auth", (F.col("process") == "sudo") & text.has_any_case(F.col("message"), "command"))


def _login_accepted() -> Column:
    return _in("auth", text.like_any_case(F.col("message"), fixed.LOGIN_ACCEPTED))


def _traversal() -> Column:
    return _in("web", text.like_any_case(F.col("path"), fixed.TRAVERSAL))


def _client_error() -> Column:
    return _in("web", (F.col("status") >= 400) & (F.col("status") < 500))


def _sql_injection() -> Column:
    # The pattern looks at nothing around a match, so a part that stands in the full URI as it is needs no search of its own.
    def apart(name: str) -> Column:
        return ~F.coalesce(F.contains("full_uri", name), F.lit(False)) & text.like_any_case(F.col(name), fixed.SQL_INJECTION)
    return _in("web", text.like_any_case(F.col("full_uri"), fixed.SQL_INJECTION) | apart("path") | apart("query"))


def _kernel_word(word: str) -> Callable[[], Column]:
    return lambda: _in("kernel", text.has_any_case(F.col("message"), word))


def _tls(test: Column) -> Column:
    return F.contains(F.col("raw"), F.lit(fixed.TLS_MARKER)) & test


def _deprecated_tls() -> Column:
    version = text.tls_version(F.col("raw"))
    return _tls(
        version.isin(fixed.DEPRECATED_TLS_HEX)
        | version.rlike(text.MODE + fixed.DEPRECATED_TLS_TEXT)
    )


def _random_sni() -> Column:
    label = text.first_label(text.sni(F.col("raw")))
    return _tls(text.entropy(label) > fixed.SNI_ENTROPY_LIMIT)


def _bad_ja3() -> Column:
    return _tls(text.ja3(F.col("raw")).isin([ja3 for ja3, _ in fixed.BAD_JA3]))


_BEHAVIOUR: dict[str, tuple] = {
    "AUTH-001": (_ssh_failed, WindowCount("ssh_fail", fixed.SSH_FAILURES)),
    "AUTH-002": (_root_attempt, None),
    "AUTH-003": (_root_accepted, None),
    "AUTH-004": (_sudo_command, None),
    "AUTH-005": (_failed, WindowCount("login_fail", fixed.LOGIN_FAILURES)),
    "AUTH-006": (_login_accepted, FollowUp("ssh_fail", fixed.FOLLOWUP_FAILURES)),
    "WEB-001": (_traversal, None),
    "WEB-002": (_client_error, WindowCount("web_4xx", fixed.WEB_4XX)),
    "WEB-003": (_sql_injection, None),
    "WEB-004": (_client_error, WindowCount("web_4xx", fixed.WEB_4XX_HIGH)),
    "SYS-001": (_kernel_word("oom"), None),
    "SYS-002": (_kernel_word("segfault"), None),
    "NET-001": (_deprecated_tls, None),
    "NET-002": (_random_sni, None),
    "NET-003": (_bad_ja3, None),
}

BUILT_IN: tuple[Rule, ...] = tuple(
    Rule(*texts, *_BEHAVIOUR[texts[0]]) for texts in fixed.RULES
)


def select_rules(*ids: str) -> tuple[Rule, ...]:
    return tuple(r for r in BUILT_IN if r.id in ids)


def with_rule(rule: Rule, rules: tuple[Rule, ...] = BUILT_IN) -> tuple[Rule, ...]:
    """The rule set with one more rule at its end."""
    if any(r.id == rule.id for r in rules):
        raise ValueError(f"rule {rule.id} exists")
    return (*rules, rule)


def last_edits(overrides: DataFrame) -> DataFrame:
    """One edit of each rule: the one with the largest ``edited_at``, where there is such a column.

    Edits level in time, or without one, are ordered by their values, so the choice is the same
    in every run.
    """
    values = [c for c in ("enabled", "name", "description", "severity") if c in overrides.columns]
    order = F.struct(*[c for c in ("edited_at",) if c in overrides.columns], *values)
    return overrides.groupBy("id").agg(F.max_by(F.struct(*values), order).alias("edit")).select("id", "edit.*")


def with_overrides(overrides: DataFrame | list, rules: tuple[Rule, ...] = BUILT_IN) -> tuple[Rule, ...]:
    """Apply switched-off and edited rules, so that they reach detection.

    Only the last edit of known rules is fetched: at most one small row per rule.  Of a list the
    last entry of a rule counts.
    """
    if isinstance(overrides, DataFrame):
        overrides = last_edits(overrides.filter(F.col("id").isin([r.id for r in rules]))).collect()
    edits = {o["id"]: o for o in overrides}
    kept = []
    for rule in rules:
        edit = edits.get(rule.id)
        if edit is None:
            kept.append(rule)
        elif edit["enabled"] is not False:
            given = {k: edit[k] for k in ("name", "description", "severity") if edit[k] is not None}
            kept.append(replace(rule, **given))
    return tuple(kept)


def catalogue(spark: SparkSession, rules: tuple[Rule, ...] = BUILT_IN) -> DataFrame:
    """Rule texts as a table; ``position`` is the order of evaluation."""
    rows = [
        (n, r.id, r.name, r.description, r.severity, r.category, r.mitre)
        for n, r in enumerate(rules, 1)
    ]
    return spark.createDataFrame(
        rows,
        "position int, id string, name string, description string, severity string, "
        "category string, mitre string",
    )


def search(rules: DataFrame, category: str = "all", words: str = "") -> DataFrame:
    """Rules of a category whose id, name or description contains the words, any case."""
    found = rules if category == "all" else rules.filter(F.col("category") == category)
    if words:
        hits = [text.has_any_case(F.coalesce(c, F.lit("")), words) for c in ("id", "name", "description")]
        found = found.filter(hits[0] | hits[1] | hits[2])
    return found


def catalogue_counts(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rules in total, switched on, CRITICAL and HIGH."""
    off = last_edits(overrides).filter(~F.col("enabled")).select("id").withColumn("off", F.lit(True))
    return rules.join(off, "id", "left").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("off").isNull()).alias("active"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "HIGH").alias("high"),
    )


def edited_catalogue(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """Catalogue as edited: switched-off rules left out, edited texts in place."""
    overrides = last_edits(overrides)
    off = overrides.filter(~F.col("enabled")).select("id")
    edits = overrides.select("id", *[F.col(c).alias(f"new_{c}") for c in ("name", "description", "severity")])
    texts = {c: F.coalesce(f"new_{c}", c) for c in ("name", "description", "severity")}
    return (
        rules.join(off, "id", "left_anti").join(edits, "id", "left").withColumns(texts).select(*rules.columns)
    )
