"""Repeated windows of texts without comparing pairs: the part both substring operators share.

A *run* is a row of consecutive windows that share a *seed*, a hash of a short string inside all
of them; equal windows always share a seed. Runs whose seed occurs once cannot repeat. Runs of
equal content (``block``) repeat as a whole. Only where one seed has several contents are single
windows looked at, once per content: this is where copies begin or end.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm import arrays
from logwarden.llm.common import stage

RUNS = "seed long, block long, doc long, row_key long, start int, count int"
SEEDS = "seed long, n long"
SPOTS = "key long, doc long, row_key long, start int, n int"
CROWD = 1_000  # contents of a seed from which its windows are dealt one by one
# sample(data, offsets) -> seed, block, row, start in the row, count of windows
Sample = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]


def _seeds(texts: DataFrame, sample: Sample) -> DataFrame:
    """Seeds that occur more than once."""
    def count(batches):
        for batch in arrays.pieces(batches):
            seed, number = np.unique(sample(*arrays.plain(batch.column("text")))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([arrays.signed(seed), pa.array(number.astype(np.int64))], ["seed", "n"])

    counted = texts.select("text").mapInArrow(arrays.tidy(count), SEEDS)
    return counted.groupBy("seed").agg(F.sum("n").alias("n")).filter("n > 1").select("seed")


def _runs(texts: DataFrame, sample: Sample) -> DataFrame:
    def runs(batches):
        for batch in arrays.pieces(batches):
            seed, block, row, start, count = sample(*arrays.plain(batch.column("text")))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [arrays.signed(seed), arrays.signed(block), batch.column("doc").take(row), batch.column("row_key").take(row),
                 pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                ["seed", "block", "doc", "row_key", "start", "count"])

    return texts.select("doc", "row_key", "text").mapInArrow(arrays.tidy(runs), RUNS)


def repeated_runs(texts: DataFrame, sample: Sample) -> DataFrame:
    """Runs whose seed occurs more than once, written once. Two passes over the text keep the
    first shuffle at one number per run; a frequent seed is summed before it travels and the
    join can be split inside a seed."""
    return stage(_runs(texts, sample).join(_seeds(texts, sample), "seed", "left_semi"), "runs")


def contents(runs: DataFrame) -> DataFrame:
    """One row per content of a seed: how often it occurs and where first; written once."""
    return stage(runs.groupBy("seed", "block", "count").agg(
        F.count("*").alias("n"), F.min(F.struct("doc", "start", "row_key")).alias("first")), "contents")


def to_open(held: DataFrame, crowd: int = CROWD) -> DataFrame:
    """First places of the contents of seeds that have several: (doc, row_key, [(start, count,
    seed, crowded)]), crowded if the seed has more than ``crowd`` contents."""
    mixed = held.groupBy("seed").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    return (held.join(mixed, "seed").select("first.doc", "first.row_key", "first.start", "count", "seed", (F.col("kinds") > crowd).alias("crowded"))
            .groupBy("doc", "row_key").agg(F.collect_list(F.struct("start", "count", "seed", "crowded")).alias("open")))


def opened_windows(opened: pa.Array):
    """Row, start and count of each opened run, and its index and step for each of its windows."""
    flat = opened.flatten()
    row = np.repeat(np.arange(len(opened)), np.diff(np.asarray(opened.offsets)))
    count = np.asarray(flat.field("count")).astype(np.int64)
    run = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    return flat, row, np.asarray(flat.field("start")).astype(np.int64), count, run, step


def first_of_key(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each key of a batch the number of its places at the first one, by (doc, start), else 0;
    places level with the first (repeated rows of one id) have 1."""
    order = np.lexsort((start, doc, key))
    head = np.ones(len(key), bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    number = np.diff(np.append(np.flatnonzero(head), len(key)))
    first = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    n = np.zeros(len(key), np.int32)
    n[order] = (doc[order] == doc[first]) & (start[order] == start[first])
    n[order[head]] = number
    return n


def own_key(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A key of its own for a place that is settled."""
    return arrays.mix(doc.view(np.uint64) * arrays.BASE + start.astype(np.uint64))


def spots(texts: DataFrame, opened: DataFrame, names: Callable) -> DataFrame:
    """Windows of opened runs as (key, place, n): per batch only the first place of a key goes on
    with n = places in the batch; the others come with n = 0 and a key of their own, as they are
    repeats for certain. So a key has at most a row for each batch, however often it occurs.

    ``names(data, offsets, row, start)`` gives the keys of windows.
    """
    def name(batches):
        for batch in arrays.pieces(batches):
            _, row, start, _, run, step = opened_windows(batch.column("open"))
            at = np.unique(row[run].astype(np.int64) << 40 | (start[run] + step))  # each place once
            row, start = at >> 40, at & ((1 << 40) - 1)
            key = names(*arrays.plain(batch.column("text")), row, start)
            doc, row_key = np.asarray(batch.column("doc"))[row], np.asarray(batch.column("row_key"))[row]
            n = first_of_key(key, doc, start)
            key = np.where(n > 0, key, own_key(doc, start))
            yield pa.RecordBatch.from_arrays(
                [arrays.signed(key), pa.array(doc), pa.array(row_key), pa.array(start.astype(np.int32)), pa.array(n)],
                ["key", "doc", "row_key", "start", "n"])

    return (texts.select("doc", "row_key", "text").join(opened.hint("shuffle_hash"), ["doc", "row_key"])
            .select("doc", "row_key", "text", "open").mapInArrow(arrays.tidy(name), SPOTS))


def by_key():
    return Window.partitionBy("key")


def spans(runs: DataFrame, singles: DataFrame, length: int) -> DataFrame:
    """Covered [start, end) of each text as one array, ordered by start: whole runs and
    the windows of opened ones."""
    every = runs.unionByName(singles).select("doc", "row_key", "start", (F.col("start") + F.col("count") - 1 + length).alias("end"))
    return every.groupBy("doc", "row_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("covered"))


def with_spans(texts: DataFrame, covered: DataFrame) -> DataFrame:
    """Every text with its covered spans (null: none); the text side streams through the join."""
    return texts.join(covered.hint("shuffle_hash"), ["doc", "row_key"], "left")


def merged(covered) -> list[tuple[int, int]]:
    """Maximal runs of the covered places of one text; touching spans join."""
    out = []
    for span in covered or ():
        start, end = span["start"], span["end"]
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]
