"""Substring deduplication by words with difference-cover anchors.

A difference cover D of period v holds for any two positions a shift below v that brings both
onto positions of D (modulo v). So two equal windows of ``window`` words share an *aligned*
anchor: a string of ``window - v + 1`` words that starts at a cover position in both. Only these
are hashed. Each anchor stands for the v windows around it, clipped to its document; from a
repeated anchor the match is extended to those windows: as a whole if the whole neighbourhood
repeats, window by window otherwise.

Cases: null and short texts stay whole; repeated rows are places of their own, so both lose their
windows; a null id is one more id; extra columns are ignored; an empty table gives no rows.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm import arrays, repeats
from logwarden.llm.common import keyed, salt_for, stage

WINDOW = 35
# Perfect difference sets, period -> residues.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """Largest period that leaves anchors of at least two fifths of the window."""
    fitting = [v for v in COVERS if window - v + 1 >= 2 * window / 5]
    return (max(fitting), COVERS[max(fitting)]) if fitting else (1, (0,))


def _word_hashes(data, offsets):
    starts, ends, first = arrays.words(data, offsets)
    return arrays.Windows(arrays.BYTE_VALUES[data]).hash(starts, ends), first


def sampler(window: int):
    period, residues = cover_for(window)
    anchor = window - period + 1
    covered = np.zeros(period, bool)
    covered[list(residues)] = True

    def sample(data, offsets):
        hashes, first = _word_hashes(data, offsets)
        windows = arrays.Windows(hashes)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        low, high = first[row], first[row + 1]
        place = np.arange(len(hashes))
        at = np.flatnonzero(covered[(place - low) % period] & (place + anchor <= high) & (high - low >= window))
        row, low, high = row[at], low[at], high[at]
        start = np.maximum(at - period + 1, low)
        stop = np.minimum(at, high - window) + 1  # one past the last window start
        count = stop - start
        shape = (at - start).astype(np.uint64) << np.uint64(20) | count.astype(np.uint64)
        block = arrays.mix(windows.hash(start, stop - 1 + window) + shape)
        return windows.hash(at, at + anchor), block, row, start - low, count

    return sample


def window_names(window: int):
    def names(data, offsets, row, start):
        hashes, first = _word_hashes(data, offsets)
        at = first[row] + start
        return arrays.Windows(hashes).hash(at, at + window)

    return names


def repeated_spans(docs: DataFrame, salt: int, window: int = WINDOW) -> DataFrame:
    """(doc, row_key, covered): word spans of each text that lie in a repeated window."""
    texts = keyed(docs, salt)
    runs = repeats.repeated_runs(texts, sampler(window))
    held = repeats.contents(runs)
    whole = stage(runs.join(held.filter("n > 1").select("seed", "block", "count"), ["seed", "block", "count"], "left_semi")
                  .select("doc", "row_key", "start", "count"), "whole")
    spots = repeats.spots(texts, repeats.to_open(held), window_names(window))
    number = F.sum("n").over(repeats.by_key())
    repeated = stage(spots.withColumn("all", number).filter("n = 0 OR all > 1")
                     .select("doc", "row_key", "start", F.lit(1).alias("count")), "repeated")
    return stage(repeats.spans(whole, repeated, window), "covered")


def remove(docs: DataFrame, covered: DataFrame, salt: int) -> DataFrame:
    """doc_id, kept words joined by one space, words before, removed words, hash."""
    def cut(batches):
        for batch in batches:
            left, size, gone, digest = [], [], [], []
            for text, covered in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("covered").to_pylist()):
                words = text.split()
                kept, at = [], 0
                for start, end in repeats.merged(covered):
                    kept += words[at:start]
                    at = end
                kept += words[at:]
                rest = b" ".join(kept)
                left.append(rest)
                size.append(len(words))
                gone.append(len(words) - len(kept))
                digest.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(left, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(digest, pa.string())], ["doc_id", "kept", "n_words", "n_removed", "kept_sha256"])

    return repeats.with_spans(keyed(docs, salt), covered).select("doc_id", "text", "covered").mapInArrow(
        arrays.tidy(cut), "doc_id long, kept binary, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` with the words that are left."""
    salt = salt_for(docs)
    return remove(docs, repeated_spans(docs, salt, window), salt)
