"""Events to alerts: all rules in one projection, counts looked up only for what matched."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden import fixed_values as fixed
from logwarden.functions.clock import MICROS, micros
from logwarden.functions.net import lookup_key
from logwarden.operators import correlate, rules as catalogue
from logwarden.operators.rules import BUILT_IN, FollowUp, Rule, WindowCount
from logwarden.staging import stage

REFERENCE, DOCUMENTED = "reference", "documented"
RULE_SLOTS = 1000  # alert_id = event_id * RULE_SLOTS + position of the rule


def smallest_counts(rules: tuple[Rule, ...], mode: str) -> dict[str, dict[str, int]]:
    """Counter -> rule -> number of matching rows from which the rule fires.

    In reference mode all rules of one counter record each row, one after the other: the
    p-th of m rules sees m * (n - 1) + p at the n-th row.  In documented mode every rule
    counts for itself.
    """
    by_counter: dict[str, list[Rule]] = {}
    for rule in rules:
        if isinstance(rule.threshold, WindowCount):
            by_counter.setdefault(rule.threshold.counter, []).append(rule)
    counts = {}
    for counter, members in by_counter.items():
        if len({r.threshold.seconds for r in members}) > 1 or len({r.key for r in members}) > 1:
            raise ValueError(f"rules of counter {counter} differ in window or key")
        if len({r.match for r in members}) > 1:  # fed by several matches: every record of a rule counts
            counts[counter] = {r.id: r.threshold.at_least for r in members}
            continue
        shared = len(members) if mode == REFERENCE else 1
        counts[counter] = {
            r.id: max(1, -(-(r.threshold.at_least - min(p, shared)) // shared) + 1)
            for p, r in enumerate(members, 1)
        }
    return counts


def match_rules(events: DataFrame, tests: dict[str, Column], keys: dict[str, Column] | None = None) -> DataFrame:
    """One row per (event, matching test) with the ``key`` it counts under: the source address, or
    what ``keys`` gives for the test; a null key is ``unknown``, a null test is no match."""
    keys = keys or {}
    address = F.col("src_ip")
    tags = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(tag).alias("rule_id"), F.coalesce(keys.get(tag, address), F.lit(fixed.UNKNOWN_KEY)).alias("key")))
        for tag, test in tests.items()]))
    if not tests:  # every rule is switched off: an array without elements has no type of its own
        tags = F.array().cast("array<struct<rule_id: string, key: string>>")
    return events.select(
        "event_id", "ts", address.alias("source_ip"), lookup_key(address, F.col("raw")).alias("geo_ip"), F.inline(tags))


def mixed_counters(rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Counters fed by rules with different matches."""
    by_counter: dict[str, list[Rule]] = {}
    for rule in rules:
        if isinstance(rule.threshold, WindowCount):
            by_counter.setdefault(rule.threshold.counter, []).append(rule)
    return {c: members for c, members in by_counter.items() if len({r.match for r in members}) > 1}


def _counter_hits(matches: DataFrame, feeds: dict[str, tuple[str, int]]) -> DataFrame:
    """Rows to count, from the matches of one rule per counter."""
    counter = F.create_map(*[F.lit(v) for c, (tag, _) in feeds.items() for v in (tag, c)])
    width = F.create_map(*[F.lit(v) for tag, s in feeds.values() for v in (tag, s * MICROS)])
    tag = F.col("rule_id")
    return matches.filter(tag.isin([t for t, _ in feeds.values()])).select(
        F.try_element_at(counter, tag).alias("counter"), "key",
        F.try_element_at(width, tag).cast("bigint").alias("width"),
        micros(F.col("ts")).alias("us"), "event_id",
    )


def _mixed_silent(matches: DataFrame, members: list[Rule], wanted: dict[str, int]) -> DataFrame:
    """(event_id, rule_id) below its count in a counter that several matches feed.

    Every match of a rule is a record, in the order of the rules within an event; a rule fires at its
    own record when the record that lies ``at_least`` - 1 records back is still in the window.
    """
    counter, seconds = members[0].threshold.counter, members[0].threshold.seconds
    place = F.create_map(*[F.lit(v) for n, r in enumerate(members) for v in (r.id, n)])
    records = matches.filter(F.col("rule_id").isin([r.id for r in members])).select(
        F.lit(counter).alias("counter"), "key", F.lit(seconds * MICROS).cast("bigint").alias("width"), micros(F.col("ts")).alias("us"),
        (F.col("event_id") * RULE_SLOTS + F.try_element_at(place, F.col("rule_id"))).alias("event_id"))
    if max(wanted.values()) <= correlate.GROUP_LIMIT:
        silent = correlate.not_reached(records, {counter: wanted})
    else:
        silent = correlate.below_count(records, wanted, seconds)
    own = F.pmod(F.col("event_id"), F.lit(RULE_SLOTS)) == F.try_element_at(place, F.col("rule_id"))
    return silent.filter(own).select(F.call_function("div", F.col("event_id"), F.lit(RULE_SLOTS)).alias("event_id"), "rule_id")


class Plan:
    """What a rule set looks for: tests by tag, keys by tag, and the tag that feeds each counter."""

    def __init__(self, rules: tuple[Rule, ...] = BUILT_IN, only: tuple[str, ...] | None = None):
        self.rules = rules
        self.chosen = [r for r in rules if only is None or r.id in only]
        self.followups = [r for r in self.chosen if isinstance(r.threshold, FollowUp)]
        self.mixed = {
            c: members for c, members in mixed_counters(rules).items()
            if any(r in self.chosen for r in members)}
        self.window_rules = [r for r in self.chosen if isinstance(r.threshold, WindowCount)]
        self.tests = {r.id: r.match() for r in self.chosen}
        self.keys = {r.id: r.key() for r in self.chosen if r.key is not None}
        for members in self.mixed.values():  # all of them feed the counter, chosen or not
            self.tests |= {r.id: r.match() for r in members}
            self.keys |= {r.id: r.key() for r in members if r.key is not None}
        self.feeds: dict[str, tuple[str, int]] = {}
        for rule in self.window_rules:
            if rule.threshold.counter not in self.mixed:
                self.feeds.setdefault(rule.threshold.counter, (rule.id, rule.threshold.seconds))
        for rule in self.followups:
            counter = rule.threshold.counter
            if counter in self.mixed:
                raise ValueError(f"rule {rule.id} follows counter {counter}, which several matches feed")
            if counter not in self.feeds:
                feeder = next(
                    r for r in (*rules, *BUILT_IN)
                    if isinstance(r.threshold, WindowCount) and r.threshold.counter == counter
                )
                tag = f"counter:{counter}"
                self.tests[tag] = feeder.match()
                if feeder.key is not None:
                    self.keys[tag] = feeder.key()
                self.feeds[counter] = (tag, feeder.threshold.seconds)

    @property
    def counting_tags(self) -> list[str]:
        """Tags whose matches later rows may count."""
        return [t for t, _ in self.feeds.values()] + [r.id for members in self.mixed.values() for r in members]

    @property
    def back(self) -> tuple[int, int]:
        """Most matches of a key, and seconds, that a row looks back."""
        counts = [r.threshold.at_least for r in self.rules if r.threshold is not None]
        seconds = [r.threshold.seconds for r in self.rules if r.threshold is not None] + [s for _, s in self.feeds.values()]
        return max(counts, default=0), max(seconds, default=0)

    def match(self, events: DataFrame) -> DataFrame:
        return match_rules(events, self.tests, self.keys)

    def fire(self, matches: DataFrame, mode: str = REFERENCE, earlier: DataFrame | None = None) -> DataFrame:
        """The matches of chosen rules that fire.  ``earlier``: counting matches before these, which
        count but do not fire again."""
        known = matches if earlier is None else matches.unionByName(earlier)
        limits = smallest_counts(self.rules, mode)
        silent = []
        wanted = {
            c: {i: n for i, n in members.items() if i in self.tests}
            for c, members in limits.items() if c not in self.mixed and any(i in self.tests for i in members)
        }
        small = {c: members for c, members in wanted.items() if max(members.values()) <= correlate.GROUP_LIMIT}
        if small:
            counted = {c: f for c, f in self.feeds.items() if c in small}
            silent.append(correlate.not_reached(_counter_hits(known, counted), small))
        for counter in wanted.keys() - small.keys():
            hits = _counter_hits(known, {counter: self.feeds[counter]})
            silent.append(correlate.below_count(hits, wanted[counter], self.feeds[counter][1]))
        for counter, members in self.mixed.items():
            silent.append(_mixed_silent(known, members, limits[counter]))
        for rule in self.followups:
            counter = rule.threshold.counter
            hits = _counter_hits(known, {counter: self.feeds[counter]})
            after = matches.filter(F.col("rule_id") == rule.id).select("key", micros(F.col("ts")).alias("us"), "event_id")
            silent.append(
                correlate.not_supported(
                    after, hits, rule.threshold.at_least, rule.threshold.seconds, self.feeds[counter][1],
                    pruned=mode == REFERENCE,
                ).withColumn("rule_id", F.lit(rule.id))
            )
        matches = matches.drop("key")
        counting = [r.id for r in (*self.window_rules, *self.followups)]
        at_once = [r.id for r in self.chosen if r.id not in counting]
        if not silent:
            return matches.filter(F.col("rule_id").isin(at_once))
        fired = matches.filter(F.col("rule_id").isin(counting)).join(
            reduce(DataFrame.unionByName, silent), ["event_id", "rule_id"], "left_anti")
        if at_once:
            fired = matches.filter(F.col("rule_id").isin(at_once)).unionByName(fired)
        return fired


def fire(
    events: DataFrame,
    rules: tuple[Rule, ...] = BUILT_IN,
    mode: str = REFERENCE,
    only: tuple[str, ...] | None = None,
    staged: bool = True,
) -> DataFrame:
    """``event_id, ts, source_ip, geo_ip, rule_id`` of every rule that fires.

    ``only`` limits the output to some rules; shared counters still see the whole rule set.
    The matches are narrow and used several times, so they are written once (``staged``).
    """
    plan = Plan(rules, only)
    matches = plan.match(events)
    return plan.fire(stage(matches, "matches") if staged and plan.counting_tags else matches, mode)


def describe(fired: DataFrame, rules: tuple[Rule, ...] = BUILT_IN) -> DataFrame:
    """Alert rows of ``fire`` with number, name, description, severity and technique."""
    if len(rules) >= RULE_SLOTS:
        raise ValueError("too many rules")
    texts = catalogue.catalogue(fired.sparkSession, rules).select(
        F.col("id").alias("rule_id"), "position", F.col("name").alias("rule_name"),
        "description", "severity", "mitre",
    )
    return fired.join(F.broadcast(texts), "rule_id").select(  # fewer than RULE_SLOTS rows
        (F.col("event_id") * RULE_SLOTS + F.col("position")).alias("alert_id"),
        "event_id", "ts", "rule_id", "rule_name", "description", "severity", "mitre",
        "source_ip", "geo_ip",
    )


def detect(
    events: DataFrame,
    rules: tuple[Rule, ...] = BUILT_IN,
    mode: str = REFERENCE,
    only: tuple[str, ...] | None = None,
    staged: bool = True,
) -> DataFrame:
    """Alerts of parsed events, without location: add it with ``enrich.add_geo``."""
    return describe(fire(events, rules, mode, only, staged), rules)


def flag_events(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Events with ``has_alert`` (1/0): whether ``alerts`` holds one of the event.

    The alerted ids are one narrow row for each event; whether they are broadcast or shuffled is
    left to their size at run time.
    """
    alerted = alerts.select("event_id").distinct().withColumn("has_alert", F.lit(1))
    return events.join(alerted, "event_id", "left").withColumn("has_alert", F.coalesce("has_alert", F.lit(0)))
