"""Signatures from the text of a rule file, and one pass that looks for all their contents at once.

A rule is one line: ``alert <protocol> <source> <port> -> <destination> <port> (<option>; ...)``. Understood
are ``msg``, ``content`` (with ``!``, ``|hex bytes|`` and escapes) and what follows it (``nocase``, the field),
``flags``, ``itype``, ``classtype``, ``sid`` and ``rev``; a rule with any other condition is refused, as it
would fire too often without it.

Matching builds one automaton for each field and letter case, so a row is read once however many contents
there are; rules are then looked at only if one of their contents was found (or if they have none to find).
"""

import re
from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from logwarden.operators.signatures import flag_value

# Form of a rule line, and the columns that a content may be looked for in.
LINE = re.compile(r"^\s*alert\s+(\w+)\s+(\S+)\s+(\S+)\s+->\s+(\S+)\s+(\S+)\s+\((.*)\)\s*$")
FIELDS = {"http_uri": "http_uri", "http.uri": "http_uri", "http_user_agent": "user_agent", "http.user_agent": "user_agent"}
OPTION = re.compile(r'\s*([\w.]+)\s*(?::((?:[^;"\\]|\\.|"(?:[^"\\]|\\.)*")*))?;')
HIT = "flow_id long, ts timestamp_ntz, src_ip string, dest_ip string, sid int"
LARGEST_CONTENTS = 1_000_000  # characters of all contents; their automata travel with every task


@dataclass(frozen=True)
class Content:
    text: str
    field: str = "payload"
    nocase: bool = False
    negated: bool = False


@dataclass(frozen=True)
class Signature:
    sid: int
    rev: int
    msg: str
    classtype: str
    proto: str
    dest_port: int | None
    contents: tuple[Content, ...] = ()
    flags: tuple[int, int] | None = None  # wanted and compared bits
    icmp_type: int | None = None


def _unquoted(value: str) -> tuple[str, bool]:
    """Text of a quoted content, hex bytes and escapes resolved, and whether it is negated."""
    negated = value.startswith("!")
    inner = value[negated:].strip()
    if len(inner) < 2 or inner[0] != '"' or inner[-1] != '"':
        raise ValueError(f"content {value} is not quoted")
    out = []
    for n, part in enumerate(re.split(r"(?<!\\)\|", inner[1:-1])):  # every second part is hex
        if n % 2:
            out.append(bytes.fromhex(part).decode("latin-1"))
        else:
            out.append(re.sub(r"\\(.)", r"\1", part))
    return "".join(out), negated


def parse_rule(line: str) -> Signature:
    found = LINE.match(line)
    if not found:
        raise ValueError(f"not a rule: {line}")
    proto, source, source_port, target, port, options = found.groups()
    if (source, source_port, target) != ("any", "any", "any"):
        raise ValueError(f"addresses and source ports are not supported: {line}")
    given, contents, at = {}, [], 0
    while at < len(options.rstrip()):
        option = OPTION.match(options, at)
        if not option:
            raise ValueError(f"unreadable options: {options[at:]}")
        at, name, value = option.end(), option[1], (option[2] or "").strip()
        if name == "content":
            text, negated = _unquoted(value)
            contents.append({"text": text, "negated": negated})
        elif name == "nocase" and contents:
            contents[-1]["nocase"] = True
        elif name in FIELDS and contents:
            contents[-1]["field"] = FIELDS[name]
        elif name in ("msg", "flags", "itype", "classtype", "sid", "rev"):
            given[name] = value
        elif name not in ("reference", "metadata", "gid", "priority"):
            raise ValueError(f"option {name} is not supported: {line}")
    return Signature(
        int(given["sid"]), int(given.get("rev", 1)), re.sub(r"\\(.)", r"\1", given.get("msg", '""')[1:-1]), given.get("classtype", ""), proto.lower(),
        None if port == "any" else int(port), tuple(Content(**c) for c in contents),
        flag_value(given["flags"]) if "flags" in given else None, int(given["itype"]) if "itype" in given else None)


def parse_rules(lines: Iterable[str]) -> tuple[Signature, ...]:
    """Rules of a file; empty lines and comments are passed over, a sid may occur once."""
    rules = tuple(parse_rule(line) for line in lines if line.strip() and not line.lstrip().startswith("#"))
    if len({r.sid for r in rules}) < len(rules):
        raise ValueError("a sid occurs twice")
    return rules


class Matcher:
    """Contents of all rules by field and letter case."""

    def __init__(self, rules: tuple[Signature, ...]):
        self.rules = rules
        contents = {c for r in rules for c in r.contents}
        if sum(len(c.text) for c in contents) > LARGEST_CONTENTS:
            raise ValueError("too many contents for one pass: divide the rules")
        self.automata: dict[tuple[str, bool], ahocorasick.Automaton] = {}
        for content in contents:
            key = content.field, content.nocase
            text = content.text.lower() if content.nocase else content.text
            self.automata.setdefault(key, ahocorasick.Automaton()).add_word(text, (*key, text))
        for automaton in self.automata.values():
            automaton.make_automaton()
        self.by_content: dict[tuple, list[Signature]] = {}
        self.without: list[Signature] = []  # nothing that must be found
        for rule in rules:
            wanted = [c for c in rule.contents if not c.negated]
            if wanted:
                longest = max(wanted, key=lambda c: len(c.text))
                self.by_content.setdefault(self.key(longest), []).append(rule)
            else:
                self.without.append(rule)

    @staticmethod
    def key(content: Content) -> tuple:
        return content.field, content.nocase, content.text.lower() if content.nocase else content.text

    def sids(self, row: dict) -> list[int]:
        found = set()
        for (field, nocase), automaton in self.automata.items():
            if row[field]:
                found.update(key for _, key in automaton.iter(row[field].lower() if nocase else row[field]))
        possible = [r for key in found for r in self.by_content.get(key, ())] + self.without
        return sorted(r.sid for r in possible if self.holds(r, row, found))

    def holds(self, rule: Signature, row: dict, found: set) -> bool:
        if rule.proto != row["proto"] or (rule.dest_port is not None and rule.dest_port != row["dest_port"]):
            return False
        if rule.icmp_type is not None and rule.icmp_type != row["icmp_type"]:
            return False
        if rule.flags is not None and (row["tcp_flags"] is None or row["tcp_flags"] & rule.flags[1] != rule.flags[0]):
            return False
        # a field that is not there holds no content, and lacks none either
        return all(row[c.field] is not None and (self.key(c) in found) != c.negated for c in rule.contents)


def match_rules(flows: DataFrame, rules: tuple[Signature, ...]) -> DataFrame:
    """``flow_id, ts, src_ip, dest_ip, sid`` of every rule that a flow record meets."""
    matched = ["proto", "dest_port", "http_uri", "user_agent", "tcp_flags", "icmp_type", "payload"]
    kept = ["flow_id", "ts", "src_ip", "dest_ip"]

    def every(batches):
        matcher = Matcher(rules)  # an automaton for each task
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in matched]
            hits = [matcher.sids(dict(zip(matched, values))) for values in zip(*columns)]
            rows = [n for n, sids in enumerate(hits) for _ in sids]
            chosen = batch.select(kept).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array([s for sids in hits for s in sids], pa.int32())], [*kept, "sid"])

    if not rules:
        raise ValueError("no rules")
    Matcher(rules)  # refuses too large a set before any task starts
    return flows.select(*kept, *matched).mapInArrow(every, HIT)
