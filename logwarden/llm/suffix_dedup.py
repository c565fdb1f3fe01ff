"""Suffix-array deduplication: bytes that repeat an earlier string of the threshold length go.

Prefix doubling ranks positions by ever longer prefixes, ``(rank at p, rank at p + offset)``,
and drops a position once its rank is its own. Sorting every byte of a corpus at every offset
moves it many times over, so the first rank is taken at sampled positions only:

1. the rank of a window at offset zero is its smallest hashed string of ``seed_bytes`` bytes
   (a minimizer). Neighbouring windows share it, so Spark sorts one row per some 35 positions;
   ranks that occur once leave,
2. runs of windows that are equal as a whole keep one representative, their first place,
3. where a rank still holds different strings, positions are opened and reranked by the pair
   (rank of the first half, rank of the half at the offset), which reaches the threshold. Unique
   pairs leave; of the others all but the first place are repeats.

Cases: a null or short text has no window and stays whole; a null id ranks before all ids;
repeated rows of one id are level, so neither is earlier than the other; texts of the same id
are told apart by a key that is checked to name one text only; extra columns are ignored; an empty table gives no rows.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm import arrays, repeats
from logwarden.llm.common import keyed, rank_of, salt_for, stage, text_key

THRESHOLD = 100
SEED_BYTES = 32
SEGMENT = arrays.PIECE_BYTES


def _segments(offsets: np.ndarray, threshold: int):
    """Stretches of at most SEGMENT windows in which whole short rows are taken together."""
    first = 0
    rows = len(offsets) - 1
    while first < rows:
        last = max(int(np.searchsorted(offsets, offsets[first] + SEGMENT, "right")) - 1, first + 1)
        if last == first + 1:
            size = int(offsets[last] - offsets[first])
            for at in range(0, max(size - threshold + 1, 1), SEGMENT):
                yield first, last, int(offsets[first]) + at, min(int(offsets[first]) + at + SEGMENT + threshold - 1, int(offsets[last])), at
        else:
            yield first, last, int(offsets[first]), int(offsets[last]), 0
        first = last


def sampler(threshold: int, seed_bytes: int):
    width = threshold - seed_bytes + 1

    def one(data, offsets):
        n = len(data)
        starts_of, ends_of = offsets[:-1], offsets[1:] - threshold + 1
        full = ends_of > starts_of
        if n < threshold or not full.any():
            return None
        windows = arrays.Windows(arrays.BYTE_VALUES[data])
        grams = windows.hash(slice(0, n - seed_bytes + 1), slice(seed_bytes, n + 1))
        grams = np.concatenate([grams, np.full(-len(grams) % width + width, np.uint64(2**64 - 1))])
        table = grams.reshape(-1, width)
        upto = np.minimum.accumulate(table, 1).ravel()
        onward = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
        smallest = np.minimum(onward[:n - threshold + 1], upto[width - 1:width + n - threshold])
        change = np.zeros(n + 2, np.int32)
        np.add.at(change, starts_of[full], 1)
        np.add.at(change, ends_of[full], -1)
        inside = np.cumsum(change)[:len(smallest)] > 0
        new = np.ones(len(smallest), bool)
        # a run ends with its anchor, the leftmost smallest string, so no window repeats inside it
        new[1:] = (smallest[1:] != smallest[:-1]) | (grams[:len(smallest) - 1] == smallest[:-1])
        new[starts_of[full]] = True
        new &= inside
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(smallest))
        row = np.searchsorted(offsets, start, "right") - 1
        stop = np.minimum(stop, ends_of[row])
        count = stop - start
        block = arrays.mix(windows.hash(start, stop - 1 + threshold) + count.astype(np.uint64))
        return smallest[start], block, row, start - offsets[row], count

    def sample(data, offsets):
        out = []
        for first, last, low, high, shift in _segments(offsets, threshold):
            found = one(data[low:high], np.clip(offsets[first:last + 1] - low, 0, high - low))
            if found:
                seed, block, row, start, count = found
                out.append((seed, block, row + first, start + shift, count))
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))

    return sample


def opened_names(texts: DataFrame, opened: DataFrame, threshold: int) -> DataFrame:
    """Ranks of the windows of opened runs: the pair (rank of the first half, rank of the half at
    the offset that reaches the threshold) for each window of a run.

    A run goes to its seed's ``bucket``. Windows of crowded seeds go one by one to the bucket of
    their pair; of equal pairs in a batch only the first goes on, the others are settled.
    """
    half = (threshold + 1) // 2

    def name(batches):
        for batch in arrays.pieces(batches):
            flat, row, start, count, run, step = repeats.opened_windows(batch.column("open"))
            data, offsets = arrays.plain(batch.column("text"))
            windows = arrays.Windows(arrays.BYTE_VALUES[data])
            at = offsets[row[run]] + start[run] + step
            rank, further = windows.hash(at, at + half), windows.hash(at + threshold - half, at + threshold)
            pair = arrays.mix(rank * arrays.BASE + further)
            seed = np.asarray(flat.field("seed"))
            crowded = flat.field("crowded").to_numpy(zero_copy_only=False).astype(bool)
            doc, row_key = np.asarray(batch.column("doc"))[row], np.asarray(batch.column("row_key"))[row]
            runs = pa.RecordBatch.from_arrays(
                [pa.array(seed), pa.array(doc), pa.array(row_key), pa.array(start.astype(np.int32)), pa.array(np.ones(len(row), bool)),
                 arrays.packed(pair, np.append(0, np.cumsum(count)))], fields)
            yield runs.filter(pa.array(~crowded))
            one = np.flatnonzero(crowded[run])
            run, step, pair = run[one], step[one], pair[one]
            doc, row_key, start = doc[run], row_key[run], start[run] + step
            first = repeats.first_of_key(pair, doc, start) > 0
            bucket = np.where(first, pair, repeats.own_key(doc, start))
            yield pa.RecordBatch.from_arrays(
                [arrays.signed(bucket), pa.array(doc), pa.array(row_key), pa.array(start.astype(np.int32)), pa.array(first),
                 arrays.packed(pair, np.arange(len(pair) + 1))], fields)

    fields = ["bucket", "doc", "row_key", "start", "open", "ranks"]
    return (texts.select("doc", "row_key", "text").join(opened.hint("shuffle_hash"), ["doc", "row_key"]).select("doc", "row_key", "text", "open")
            .mapInArrow(arrays.tidy(name), "bucket long, doc long, row_key long, start int, open boolean, ranks binary"))


def later_of_equal(named: DataFrame) -> DataFrame:
    """Stretches (doc, row_key, start, count) of windows whose rank has an earlier place."""
    def rank(batches):
        for batch in arrays.whole_groups(batches, "bucket"):
            pair, rows = arrays.unpacked(batch.column("ranks"), np.uint64)
            run = np.repeat(np.arange(batch.num_rows), np.diff(rows))
            doc, begin = np.asarray(batch.column("doc")), np.asarray(batch.column("start")).astype(np.int64)
            start = begin[run] + np.arange(len(run)) - rows[run]
            settled = ~batch.column("open").to_numpy(zero_copy_only=False).astype(bool)
            gone = (repeats.first_of_key(pair, doc[run], start) == 0) | settled[run]
            edge = np.ones(len(run), bool)
            edge[1:] = (run[1:] != run[:-1]) | (gone[1:] != gone[:-1])
            head = np.flatnonzero(edge)
            count = np.diff(np.append(head, len(run)))
            head, count = head[gone[head]], count[gone[head]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(run[head])), batch.column("row_key").take(pa.array(run[head])),
                 pa.array(start[head].astype(np.int32)), pa.array(count.astype(np.int32))], ["doc", "row_key", "start", "count"])

    return named.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(arrays.tidy(rank), "doc long, row_key long, start int, count int")


def repeated_spans(docs: DataFrame, salt: int, threshold: int = THRESHOLD, seed_bytes: int = SEED_BYTES) -> DataFrame:
    """(doc, row_key, covered): byte spans of each text that also start earlier."""
    seed_bytes = min(seed_bytes, threshold)
    texts = keyed(docs, salt)
    runs = repeats.repeated_runs(texts, sampler(threshold, seed_bytes))
    held = repeats.contents(runs)
    later = stage(runs.join(held.filter("n > 1").select("seed", "block", "count", "first"), ["seed", "block", "count"])
                  .filter(F.struct("doc", "start") > F.struct("first.doc", "first.start"))
                  .select("doc", "row_key", "start", "count"), "later")
    repeated = stage(later_of_equal(opened_names(texts, repeats.to_open(held), threshold)), "repeated")
    return stage(repeats.spans(later, repeated, threshold), "covered")


def remove(docs: DataFrame, covered: DataFrame, salt: int) -> DataFrame:
    """doc_id, text bytes left, their number before, removed bytes and removed runs, hash."""
    def cut(batches):
        for batch in batches:
            left, size, gone, number, digest = [], [], [], [], []
            for text, covered in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("covered").to_pylist()):
                spans = repeats.merged(covered)
                kept, at = [], 0
                for start, end in spans:
                    kept.append(text[at:start])
                    at = end
                kept.append(text[at:])
                rest = b"".join(kept)
                left.append(rest)
                size.append(len(text))
                gone.append(len(text) - len(rest))
                number.append(len(spans))
                digest.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(left, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(number, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeats.with_spans(keyed(docs, salt), covered).select("doc_id", "text", "covered").mapInArrow(
        arrays.tidy(cut), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with the bytes that are left."""
    salt = salt_for(docs)
    return remove(docs, repeated_spans(docs, salt, threshold), salt)


def cut_rows(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without the bytes of ``text`` that repeat an earlier string; bytes of characters that
    lost some of theirs go too, and ``n_chars``, where there is one, follows. Null texts stay null;
    columns of any name are kept as they are."""
    salt = salt_for(docs)
    covered = repeated_spans(docs, salt, threshold)
    names, places = docs.columns, [f"c{n}" for n in range(len(docs.columns))]  # Arrow functions take plain names only
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def cut(batches):
        for batch in batches:
            left = []
            for text, covered in zip(batch.column(text_at).cast(pa.binary()).to_pylist(), batch.column("covered").to_pylist()):
                kept, at = [], 0
                for start, end in repeats.merged(covered):
                    kept.append(text[at:start])
                    at = end
                left.append(None if text is None else b"".join([*kept, text[at:]]).decode("utf-8", "ignore"))
            columns = batch.columns[:len(places)]
            columns[text_at] = pa.array(left, pa.string())
            if chars_at is not None:
                columns[chars_at] = pa.array([None if t is None else len(t) for t in left], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, places)

    rows = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(names, places)], rank_of().alias("doc"), text_key(salt).alias("row_key"))
    kinds = ", ".join(f"{p} {'long' if f.name == 'n_chars' else f.dataType.simpleString()}" for p, f in zip(places, docs.schema))
    return repeats.with_spans(rows, covered).select(*places, "covered").mapInArrow(arrays.tidy(cut), kinds).toDF(*names)
