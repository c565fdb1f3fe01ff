"""SimHash near-duplicates with a covering code as anchors.

Fingerprints within ``bits`` differ by at most ``bits // blocks`` in one of ``blocks`` parts, whose
number follows the counted fingerprints. In each part the anchors are a covering code: Hamming code [15, 11] on the lowest 15 bits, all
words on the rest; its covering radius is 1. A fingerprint lives at its nearest anchor and is
replicated to every anchor that can be home to a fingerprint within the part's threshold, which
all lie within covering radius plus threshold. Residents and visitors are compared per anchor.

Equal fingerprints are one node from the start. A task links the fingerprints it compares and
passes on one link for each, so a group of near copies makes as many links as it has members.
Anchors with more than HOME_ROWS residents are dealt in parts, to which visitors are repeated.

Cases: null or empty texts have fingerprint zero; repeated rows share it; a null id takes part
but is never the smallest, and gets a null component if no other id is reachable; extra columns
are ignored; an empty table gives no rows.
"""

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm import arrays, graph
from logwarden.llm.common import stage, text_key

SHINGLE = 4
BITS = 4
SEED = 42
CODED = 15
HOME_ROWS = 65_536
WIDE = 1 << 26  # fingerprints up to which three parts of 2**17 anchors hold few residents each
ROWS = 2_048  # fingerprints replicated at once
PAIRS = 1 << 21  # compared at once
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
CHUNK = 255 * 64
NAME = ("doc_id", "key", "other")


def named_by() -> list[Column]:
    """What names a document: its id, and its text by 128 bits."""
    return [F.col("doc_id").cast("long").alias("doc_id"), text_key(0).alias("key"), text_key(1).alias("other")]


def fingerprint(text: bytes, size: int = SHINGLE) -> bytes:
    """64 bits, high byte first: the majority of each bit over the hashes of word shingles."""
    words = text.translate(LOWER).split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - size + 1].tolist()
    ends = ends[size - 1:].tolist()
    total, n = np.zeros(64, np.int64), len(starts)
    digest = xxhash.xxh64_digest
    for at in range(0, n, CHUNK):
        some = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])])
        lanes = LANES[np.frombuffer(some, np.uint8)].reshape(-1, 8)
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)  # no lane passes 255
        total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n).tobytes()


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, two keys that name the text, and its fingerprint as a long."""
    def every(batches):
        for batch in arrays.pieces(batches):
            found = b"".join([fingerprint(text or b"", size) for text in batch.column("text").cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in NAME], pa.array(np.frombuffer(found, ">i8").astype(np.int64))], [*NAME, "fp"])

    return docs.select(*named_by(), "text").mapInArrow(arrays.tidy(every), "doc_id long, key long, other long, fp long")


def parts_for(bits: int, n: int) -> int:
    """Number of parts: as few as leave each a threshold of one bit, and for many fingerprints fewer and
    wider ones with a threshold of two, whose anchors are that many more."""
    return max(1, bits // 2 + 1 if n <= WIDE else bits // 3 + 1)


def _parts(number: int) -> list[tuple[int, int]]:
    """(shift, width) of the parts."""
    cuts = [64 * k // number for k in range(number + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _home(values: np.ndarray) -> np.ndarray:
    """Nearest anchor: the bit that the syndrome names is flipped."""
    syndrome = np.zeros(len(values), np.uint64)
    for place in range(1, CODED + 1):
        bit = (values >> np.uint64(place - 1)) & np.uint64(1)
        syndrome ^= bit * np.uint64(place)
    return np.where(syndrome > 0, values ^ (np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1))), values)


def replicas(fps: np.ndarray, bits: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, resident) of every place of the given fingerprints."""
    rows, anchors, residents = [], [], []
    for part, (shift, width) in enumerate(_parts(number)):
        value = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        tag = np.uint64(part) << np.uint64(58)
        flips = [sum(1 << b for b in some) for k in range(bits // number + 1) for some in itertools.combinations(range(width), k)]
        around = np.stack([_home(value ^ np.uint64(flip)) for flip in flips], 1) | tag
        rows.append(np.arange(len(fps)))
        anchors.append(around[:, 0])
        residents.append(np.ones(len(fps), bool))
        around = np.sort(around, 1)
        fresh = np.ones(around.shape, bool)
        fresh[:, 1:] = around[:, 1:] != around[:, :-1]
        row, _ = np.nonzero(fresh)
        rows.append(row)
        anchors.append(around[fresh])
        residents.append(np.zeros(len(row), bool))
    return np.concatenate(rows), np.concatenate(anchors), np.concatenate(residents)


def _compare(anchor, fp, visitor, bits):
    """Links between residents and visitors of rows sorted by anchor, residents first."""
    homes, guests = np.flatnonzero(~visitor), np.flatnonzero(visitor)
    low = np.searchsorted(anchor[homes], anchor[guests], "left")
    many = np.searchsorted(anchor[homes], anchor[guests], "right") - low
    ends, at = np.cumsum(many), 0
    while at < len(guests):
        done = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, done + PAIRS, "right")), at + 1)
        n = many[at:to]
        guest = np.repeat(guests[at:to], n)
        home = homes[np.repeat(low[at:to] - (ends[at:to] - n), n) + np.arange(done, done + n.sum())]
        near = (np.bitwise_count(fp[guest] ^ fp[home]) <= bits) & (fp[home] < fp[guest])
        if near.any():
            yield graph.forest(fp[home[near]], fp[guest[near]])
        at = to


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``bits`` of each other."""
    number = parts_for(bits, fps.count())

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                fp = batch.column("fp").slice(at, ROWS)
                row, anchor, resident = replicas(np.asarray(fp).view(np.uint64), bits, number)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), fp.take(pa.array(row)), pa.array(~resident)], ["anchor", "fp", "visitor"])

    placed = fps.select("fp").mapInArrow(arrays.tidy(place), "anchor long, fp long, visitor boolean")
    crowded = (placed.filter("not visitor").groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOME_ROWS)
               .select("anchor", F.ceil(F.col("n") / HOME_ROWS).cast("int").alias("parts")))
    spread = placed.join(crowded, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).select(
        "anchor", "fp", "visitor",
        F.explode(F.when(F.col("visitor"), F.sequence(F.lit(0), F.col("parts") - 1))
                  .otherwise(F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")))).alias("part"))

    def compare(batches):
        kept = None  # residents of the anchor that the last batch ended in
        for batch in batches:
            anchor = np.asarray(batch.column("anchor"))
            part = np.asarray(batch.column("part")).astype(np.int64)
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            visitor = batch.column("visitor").to_numpy(zero_copy_only=False).astype(bool)
            if kept is not None and len(anchor):
                same = (kept[0] == anchor[0]) & (kept[1] == part[0])
                anchor, part = np.concatenate([kept[0][same], anchor]), np.concatenate([kept[1][same], part])
                fp, visitor = np.concatenate([kept[2][same], fp]), np.concatenate([np.zeros(same.sum(), bool), visitor])
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
            for a, b in _compare(np.cumsum(new), fp, visitor, bits):
                yield pa.RecordBatch.from_arrays([arrays.signed(a), arrays.signed(b)], ["a", "b"])
            if len(anchor):
                last = (anchor == anchor[-1]) & (part == part[-1]) & ~visitor
                kept = anchor[last], part[last], fp[last]

    return spread.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "visitor").mapInArrow(arrays.tidy(compare), "a long, b long")


def groups(docs: DataFrame, size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """NAME, fp, root and component_id of every row: the smallest fingerprint and the smallest id its
    fingerprint links to."""
    marked = stage(fingerprints(docs, size), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = graph.components(links(distinct, bits)).select(F.col("node").alias("fp"), "root")
    named = distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(stage(named.join(smallest, "root").select("fp", "root", "component_id"), "components"), "fp").select(
        *NAME, "fp", "root", "component_id")


def single(docs: DataFrame, size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The columns of ``docs`` with one row of each group: the smallest id, rows without id last; of
    one id's texts the one with the smallest key; of repeated rows any one."""
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), *NAME)
    kept = groups(docs, size, bits).groupBy("root").agg(F.min(order).alias("row")).select(*[F.col(f"row.{c}").alias(f"kept_{c}") for c in NAME])
    names, places = docs.columns, [f"c{n}" for n in range(len(docs.columns))]  # columns may have any name
    rows = docs.select(*named_by(), *[F.col(f"`{c}`").alias(p) for c, p in zip(names, places)])
    same = [F.col(c).eqNullSafe(F.col(f"kept_{c}")) for c in NAME]
    found = rows.join(kept, functools.reduce(lambda a, b: a & b, same), "left_semi")
    return found.dropDuplicates(list(NAME)).select(*places).toDF(*names)
