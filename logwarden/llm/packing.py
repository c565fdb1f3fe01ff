"""Best-fit packing of token pieces by minimum bin slack.

Which piece goes where depends on lengths alone, and there are at most ``limit`` lengths. So Spark
counts the pieces of each length, and bins are planned on that histogram: the longest length left
opens a bin, a bitset subset-sum over the other lengths, each as often as it is left, finds the
fullest bin, and that pattern is repeated while its lengths last. A pattern that is used up has
used up a length to below its multiplicity, so the number of patterns depends on ``limit`` and not
on the number of pieces. Spark then numbers the pieces of each length and looks up their places.

Pieces are numbered within (length, part of the written table), plus the counts of the parts
before, so a length that most pieces have is spread like the table is.

Cases: rows with null length are refused by the filter of the caller's contract (lengths from 1 to
``limit``); repeated rows are pieces of their own; ties in length are broken by the columns of
the piece; an empty table gives no rows.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm import arrays
from logwarden.llm.common import stage

LIMIT = 1024


def fullest(left: dict[int, int], room: int) -> list[int]:
    """Lengths, larger first, whose sum is the largest that fits ``room``; bit s of a set says
    that some of the lengths looked at so far add up to s."""
    mask = (1 << (room + 1)) - 1
    sums, trail = 1, []
    for length in sorted((x for x in left if left[x] and x <= room), reverse=True):
        many, step = min(left[length], room // length), 1
        while many:  # binary splitting of the multiplicity
            take = min(step, many)
            trail.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            many, step = many - take, step * 2
        if sums >> room & 1:
            break
    rest, chosen = sums.bit_length() - 1, []
    for length, take, before in reversed(trail):
        if not before >> rest & 1:
            chosen += [length] * take
            rest -= length * take
    return sorted(chosen, reverse=True)


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many bins use each."""
    left = {length: n for length, n in counts.items() if n}
    out = []
    while left:
        seed = max(left)
        left[seed] -= 1
        pattern = [seed, *fullest(left, limit - seed)]
        left[seed] += 1
        need = Counter(pattern)
        times = min(left[length] // n for length, n in need.items())
        for length, n in need.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
        out.append((pattern, times))
    return out


def places(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by first number: bins from, times a bin, offset of the first in a bin."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: Counter = Counter()
    first_bin = 0
    for pattern, times in patterns:
        at = 0
        for length, n in Counter(pattern).items():
            found.setdefault(length, []).append((seen[length], first_bin, n, at))
            seen[length] += n * times
            at += n * length
        first_bin += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows)) for length, rows in found.items()}


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of ``pieces`` with the sequence each is in and its place there."""
    written = stage(pieces.withColumn("part", F.spark_partition_id()), "pieces")
    counts = stage(written.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    # at most ``limit`` rows come to the driver
    total = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = places(plan(total, limit))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    order = [F.col(c) for c in written.columns if c != "ids"]
    numbered = (written.withColumn("number", F.row_number().over(Window.partitionBy("part", "length").orderBy(*order)))
                .join(before, ["length", "part"]).withColumn("number", F.col("number") - 1 + F.col("before")).drop("part", "before"))

    def place(batches):
        for batch in batches:
            length, number = np.asarray(batch.column("length")), np.asarray(batch.column("number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length).tolist():
                rows = np.flatnonzero(length == value)
                begin, first_bin, many, at = found[value]
                k = np.searchsorted(begin, number[rows], "right") - 1
                inner = number[rows] - begin[k]
                sequence[rows] = first_bin[k] + inner // many[k]
                offset[rows] = at[k] + inner % many[k] * value
            columns = [batch.column(name) for name in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kept = [name for name in numbered.columns if name != "number"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.drop("number").schema)
    return numbered.mapInArrow(arrays.tidy(place), f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Ids of each sequence from packed pieces that carry ``ids``; a sequence has at most ``limit`` tokens."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(rows.alias("rows")).select(
        "sequence_id", F.aggregate("rows", F.lit(b""), lambda held, row: F.concat(held, row["ids"])).alias("ids"))
