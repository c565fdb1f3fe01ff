"""Conversation structure repair by a square-root checkpointed dynamic program.

A row is reduced to a code: the class of its role's initial and its fault. States follow the form
``(s?(ua)+)?``: nothing yet, after s, after u, after a. The cost vector of a place says what the rest
costs at least from each state. Vectors are computed backward and kept only at checkpoints, every
sqrt(n) rows; walking forward, the vectors of one stretch at a time are computed again and the edits
whose cost is tight are chosen, the ASCII-least letter first: from a state every letter has one
successor, so this is the least of all cheapest audits. Vectors differ from their smallest entry by
a bounded amount, so steps are looked up after their first use.

Conversations up to SHORT bytes are repaired in one group. Longer ones are laid out by ranges and cut
into blocks of sqrt(n) rows: each block is reduced to its costs between states, one small row; these are
composed backward into the checkpoint vectors; every block is then walked by itself from every state it
can be entered in; the walks are joined by their ends. Texts are hashed as they stream by in order, so
only one block's edits are held, but the digest of one conversation is the work of one task.

Faults: the first of blank, duplicate (role and text seen earlier in the conversation) and truncated
counts. Cases: null text and role are one space; turns are taken in order, null first, those of one
number by the SHA-256 of role and text; a null conversation id is a conversation of its own; a
conversation without rows left has zeros, an empty audit and the digest of nothing; an empty table gives
no rows; extra columns are ignored.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm import turns
from logwarden.llm.common import stage

SHORT = 4 << 20  # weight of a conversation that one group may hold
ROW_WEIGHT = 256  # of a row besides its bytes
DELETE, RENAME, INSERT, TRUNCATED = 2, 1, 5, 5
OK, BLANK, DUPLICATE, CUT_OFF = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}  # state after the role that may come next
ROLE = {2: "user", 3: "assistant"}  # role whose row leads to the state
KEPT = {(SYSTEM, 0): 1, (USER, 0): 2, (USER, 1): 2, (USER, 3): 2, (ASSISTANT, 2): 3}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
SPACES = " \t\n\x0b\f\r"


class Machine:
    """Steps of the dynamic program, each computed once."""

    def __init__(self):
        self.steps: dict[tuple, tuple[tuple, float]] = {}
        self.walks: dict[tuple, tuple[str, int]] = {}

    @staticmethod
    def options(code: int, state: int) -> list[tuple[str, int, int]]:
        """(letter, cost, next state) of what can be done with a row, by letter."""
        initial, fault = divmod(code, 4)
        found = [("D", DELETE, state)]
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT_OFF else 0
            if (initial, state) in KEPT:
                found.append(("K", more, KEPT[initial, state]))
            found.append(("R", RENAME + more, NEXT[state]))
        return found

    @staticmethod
    def with_inserts(costs: list[float]) -> list[float]:
        for _ in costs:
            costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
        return costs

    def back(self, code: int, after: tuple) -> tuple[tuple, float]:
        """Vector before a row, less its smallest entry, and that entry."""
        found = self.steps.get((code, after))
        if found is None:
            costs = self.with_inserts([min(cost + after[q] for _, cost, q in self.options(code, state)) for state in range(4)])
            least = min(costs)
            found = self.steps[code, after] = tuple(c - least for c in costs), least
        return found

    def walk(self, code: int, after: tuple, state: int) -> tuple[str, int]:
        """Letters up to and with the row's own, and the state after it."""
        found = self.walks.get((code, after, state))
        if found is None:
            costs, least = self.back(code, after)
            letters, at = "", state
            while found is None:
                own = {letter: q for letter, cost, q in self.options(code, at) if cost + after[q] == costs[at] + least}
                if "D" in own:
                    found = letters + "D", own["D"]
                elif INSERT + costs[NEXT[at]] == costs[at]:
                    letters, at = letters + "I", NEXT[at]
                else:
                    letter = min(own)
                    found = letters + letter, own[letter]
            self.walks[code, after, state] = found
        return found

    @property
    def end(self) -> tuple:
        """Vector after the last row."""
        return tuple(self.with_inserts([0, math.inf, math.inf, 0]))

    def ending(self, state: int) -> str:
        """Letters after the last row."""
        letters = ""
        while state not in (0, 3):
            letters, state = letters + "I", NEXT[state]
        return letters

    def over(self, codes, after: tuple) -> tuple[tuple, float]:
        """Vector before a stretch of rows, and what was taken off on the way."""
        total = 0.0
        for code in reversed(codes):
            after, least = self.back(code, after)
            total += least
        return after, total

    def through(self, codes, after: tuple, state: int) -> tuple[str, int]:
        """Edits of a stretch whose vectors are computed again, and the state after it."""
        behind = [after]
        for code in reversed(codes):
            behind.append(self.back(code, behind[-1])[0])
        letters = []
        for place, code in enumerate(codes):
            some, state = self.walk(code, behind[len(codes) - 1 - place], state)
            letters.append(some)
        return "".join(letters), state

    def repair(self, codes) -> tuple[int, str]:
        """Cost and audit of a conversation, with vectors kept at every sqrt(n)-th row."""
        step = max(1, math.isqrt(len(codes)))
        after, cost, kept = self.end, 0.0, []
        for at in range((len(codes) - 1) // step * step if len(codes) else -1, -1, -step):
            kept.append(after)
            after, taken = self.over(codes[at:at + step], after)
            cost += taken
        letters, state = [], 0
        for at, behind in zip(range(0, len(codes), step), reversed(kept)):
            some, state = self.through(codes[at:at + step], behind, state)
            letters.append(some)
        return int(cost + after[0]), "".join(letters) + self.ending(state)


def class_of(role: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], OTHER)


class Applied:
    """Digest of the repaired rows, made while they stream by."""

    def __init__(self):
        self.state, self.any, self.hash = 0, False, hashlib.sha256()

    def _line(self, line: str) -> None:
        self.hash.update((("\n" if self.any else "") + line).encode())
        self.any = True

    def letter(self, letter: str, role: str = "", text: str = "") -> None:
        if letter == "D":
            return
        if letter == "K":
            self.state = KEPT[class_of(role), self.state]
            self._line(f"{role}:{text}")
        else:
            self.state = NEXT[self.state]
            self._line(f"{ROLE[self.state]}:{text if letter == 'R' else ''}")

    def row(self, letters: str, at: int, role: str, text: str) -> int:
        """The edits before a row and its own; gives the place after them."""
        while letters[at] == "I":
            self.letter("I")
            at += 1
        self.letter(letters[at], role, text)
        return at + 1

    def rest(self, letters: str, at: int) -> None:
        for letter in letters[at:]:
            self.letter(letter)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv, conv_id, turn, role, text, dropped) after the damage that the checksum of
    ``conv_id:turn`` names; dropped rows stay as a mark of their conversation."""
    shown = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("kind") == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1).cast("int"))).alias("copy"),
    ).drop("copy")


def _rows(damaged: DataFrame) -> DataFrame:
    """With key, digest and the fault that shows in the text alone."""
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), OK).otherwise(CUT_OFF)
    return damaged.select(
        "conv_id", turns.name(F.col("conv_id")).alias("conv"), "turn", "role", "text", turns.digest(F.col("role"), F.col("text")).alias("digest"),
        fault.cast("int").alias("fault"), "dropped")


def _summary(machine: Machine, rows: list[tuple]) -> tuple:
    """Result of a whole conversation from its rows (turn, role, text, digest, fault) in order."""
    seen, codes, faults = set(), [], [0, 0, 0, 0]
    for _, role, _, digest, fault in rows:
        if fault != BLANK and digest in seen:
            fault = DUPLICATE
        seen.add(digest)
        faults[fault] += 1
        codes.append(class_of(role) * 4 + fault)
    known = {r[0] for r in rows if r[0] is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum((a // 4, b // 4) not in LEGAL for a, b in zip(codes, codes[1:]))
    cost, audit = machine.repair(codes)
    applied, at = Applied(), 0
    for _, role, text, _, _ in rows:
        at = applied.row(audit, at, role, text)
    applied.rest(audit, at)
    return gaps, faults[BLANK], faults[DUPLICATE], faults[CUT_OFF], illegal, cost, audit, applied.hash.hexdigest()


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _short(rows: DataFrame) -> DataFrame:
    def repair(batches):
        machine = Machine()
        key, conv_id, held = None, None, []
        done: list[tuple] = []

        def batch():
            columns = list(zip(*done))
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", *NAMES])

        for given in batches:
            columns = [given.column(c).to_pylist() for c in ("conv", "conv_id", "turn", "role", "text", "digest", "fault", "dropped")]
            for conv, own, turn, role, text, digest, fault, dropped in zip(*columns):
                if conv != key:
                    if key is not None:
                        done.append((conv_id, *_summary(machine, held)))
                    key, conv_id, held = conv, own, []
                if not dropped:
                    held.append((turn, role, text, digest, fault))
            if len(done) >= 1024:
                yield batch()
                done = []
        if key is not None:
            done.append((conv_id, *_summary(machine, held)))
            yield batch()

    return rows.repartition("conv").sortWithinPartitions("conv", *turns.ORDER).mapInArrow(repair, f"conv_id long, {RESULT}")


def _blocks(rows: DataFrame) -> DataFrame:
    """(conv, block, blocks, codes) of long conversations: one byte a row, sqrt(n) rows a block."""
    again = rows.groupBy("conv", "digest").agg(F.count("*").alias("n"), F.min("place").alias("first")).filter("n > 1").select("conv", "digest", "first")
    initial = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in (("s", SYSTEM), ("u", USER), ("a", ASSISTANT)) for x in pair]),
                                          F.left("role", F.lit(1))), F.lit(OTHER))
    coded = rows.select("conv", "place", "block", "digest", "fault", initial.alias("initial")).join(again, ["conv", "digest"], "left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("place") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    code = F.unhex(F.lpad(F.hex(F.col("initial") * 4 + fault), 2, "0"))
    return coded.groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("place", code.alias("code")))).alias("rows")).select(
        "conv", "block", F.aggregate("rows.code", F.unhex(F.lit("")), lambda held, c: F.concat(held, c)).alias("codes"))


def _map_rows(df: DataFrame, function, kinds: str) -> DataFrame:
    """A generator over the rows of ``df`` as dictionaries, in its batches."""
    names = [part.split()[0] for part in kinds.split(", ")]

    def every(batches):
        machine = Machine()
        for batch in batches:
            found = list(function(machine, batch.to_pylist()))
            if found:
                yield pa.RecordBatch.from_pylist(found, schema)

    kind_of = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()),
               "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, kind_of[part.split()[1]]) for name, part in zip(names, kinds.split(", "))])
    return df.mapInArrow(every, kinds)


def _between(machine: Machine, rows):
    """Costs from each state before a block to each after it, and what its rows count."""
    for row in rows:
        codes = row["codes"]
        costs = []
        for state in range(4):
            vector, taken = machine.over(codes, tuple(0.0 if q == state else math.inf for q in range(4)))
            costs += [v + taken for v in vector]
        number = np.bincount(np.frombuffer(codes, np.uint8) % 4, minlength=4).tolist()
        yield {"conv": row["conv"], "block": row["block"], "costs": costs, "blank": number[BLANK], "duplicate": number[DUPLICATE],
               "truncated": number[CUT_OFF], "illegal": sum((a // 4, b // 4) not in LEGAL for a, b in zip(codes, codes[1:])),
               "head": codes[0] // 4, "tail": codes[-1] // 4}


def _checkpoints(table):
    """Vector after each block of one conversation (a row a block, of some sqrt(n) blocks)."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    after, out = np.array(Machine().end), []
    for row in reversed(rows):
        out.append(after.tolist())
        after = (np.array(row["costs"]).reshape(4, 4) + after[:, None]).min(axis=0)
    illegal = sum((a["tail"], b["head"]) not in LEGAL for a, b in zip(rows, rows[1:]))
    first = {"cost": int(after[0]), **{c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")},
             "illegal": illegal + sum(r["illegal"] for r in rows)}
    empty = dict.fromkeys(first)
    return pa.Table.from_pylist(
        [{"conv": r["conv"], "block": r["block"], "after": v, **(first if n == 0 else empty)} for n, (r, v) in enumerate(zip(rows, reversed(out)))],
        pa.schema([("conv", pa.string()), ("block", pa.int64()), ("after", pa.list_(pa.float64())),
                   *[(c, pa.int64()) for c in ("cost", "blank", "duplicate", "truncated", "illegal")]]))


CHECKED = "conv string, block long, after array<double>, cost long, blank long, duplicate long, truncated long, illegal long"


def _walked(machine: Machine, rows):
    """Edits and last state of a block for each state it may be entered in."""
    for row in rows:
        least = min(row["after"])
        after = tuple(v - least for v in row["after"])
        found = [machine.through(row["codes"], after, state) for state in range(4)]
        yield {"conv": row["conv"], "block": row["block"], "edits": [f[0] for f in found], "states": [f[1] for f in found]}


def _entries(table):
    """State before each block, from the last states of those before it."""
    state, out = 0, []
    for row in sorted(table.to_pylist(), key=lambda r: r["block"]):
        out.append({"conv": row["conv"], "block": row["block"], "entry": state})
        state = row["states"][state]
    if out:
        out[-1]["ending"] = Machine().ending(state)
    return pa.Table.from_pylist(out, pa.schema([("conv", pa.string()), ("block", pa.int64()), ("entry", pa.int64()), ("ending", pa.string())]))


def _digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256): every block's edits, then its rows, stream by in order."""
    both = edits.select("conv", "block", F.lit(-1).cast("long").alias("place"), F.col("edits").alias("role"), F.lit(None).cast("string").alias("text")).unionByName(
        rows.select("conv", "block", "place", "role", "text"))

    def apply(batches):
        key = applied = None
        letters, at, audit = "", 0, []

        def finish():
            applied.rest(letters, at)
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array(["".join(audit)]), pa.array([applied.hash.hexdigest()])],
                                              ["conv", "audit", "repaired_sha256"])

        for batch in batches:
            for conv, place, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv", "place", "role", "text")]):
                if conv != key:
                    if key is not None:
                        yield finish()
                    key, applied, letters, at, audit = conv, Applied(), "", 0, []
                if place < 0:
                    applied.rest(letters, at)
                    letters, at = role, 0
                    audit.append(role)
                else:
                    at = applied.row(letters, at, role, text)
        if key is not None:
            yield finish()

    return both.repartition("conv").sortWithinPartitions("conv", "block", "place").mapInArrow(apply, "conv string, audit string, repaired_sha256 string")


def _long(rows: DataFrame, weight: Column) -> DataFrame:
    laid = turns.laid_out(rows.filter("not dropped"), weight)
    sizes = stage(laid.groupBy("conv").agg(F.count("*").alias("n"), F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("width")), "sizes")
    seen = laid.filter("turn is not null").select("conv", "turn").distinct().groupBy("conv").agg(F.count("*").alias("known"))
    step = F.greatest(F.ceil(F.sqrt("n")), F.lit(1)).alias("step")
    placed = laid.join(turns.sized(sizes.select("conv", step)), "conv").withColumn("block", F.floor(F.col("place") / F.col("step")))
    blocks = stage(_blocks(placed), "blocks")
    costs = _map_rows(blocks, _between, "conv string, block long, costs array<double>, blank long, duplicate long, truncated long, illegal long, head long, tail long")
    checked = stage(costs.groupBy("conv").applyInArrow(_checkpoints, CHECKED), "checkpoints")
    walked = stage(_map_rows(blocks.join(checked.select("conv", "block", "after"), ["conv", "block"]), _walked,
                             "conv string, block long, edits array<string>, states array<long>"), "walked")
    entries = walked.select("conv", "block", "states").groupBy("conv").applyInArrow(_entries, "conv string, block long, entry long, ending string")
    edits = walked.join(entries, ["conv", "block"]).select("conv", "block", F.concat(
        F.get("edits", F.col("entry").cast("int")), F.coalesce("ending", F.lit(""))).alias("edits"))
    digests = _digests(placed, edits)
    names = rows.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    counts = checked.filter("cost is not null").drop("block", "after")
    gaps = F.coalesce(F.col("width") - F.col("known"), F.lit(0)).alias("gaps")
    found = names.join(counts, "conv", "left").join(sizes, "conv", "left").join(seen, "conv", "left").join(digests, "conv", "left")
    return found.select("conv_id", gaps, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
                        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repair(damaged: DataFrame, short: int = SHORT) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired rows of every conversation of ``damaged``
    (conv_id, turn, role, text, dropped)."""
    rows = _rows(damaged)
    weight = F.octet_length("text").cast("long") + F.octet_length("role") + ROW_WEIGHT
    found = turns.split(rows, weight, short)
    done = _short(found.short)
    return done if found.long is None else done.unionByName(_long(found.long, weight))
