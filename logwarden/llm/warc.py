"""WARC archives: writing, reading, revisits, and a globally ordered capture index.

Every page is a capture. Of captures with equal payloads of ``least`` bytes or more, the one with
the smallest page_id is written as a response, the others as revisits of it. Archives are written
by Spark's text writer (headers, blank line, block; the writer's line separator ends a record), so
any file system that Spark writes serves; they are read as whole files, whose size is set by the
number of write tasks, and parsed by Content-Length.

Index: every archive has its captures sorted by URL key and time as one run. Spark deals the runs
to key ranges whose number follows the counted captures (split inside a frequent key by time, id and
archive), and each range merges its k runs by a
loser tree, which gives the histories of all URLs in one global order without sorting again.

Cases: null html is an empty payload; a null url has no target header and an empty key; control
and blank characters of a URL are percent-encoded; a null page_id is written as an empty id, is
never the one referred to, and is a response unless an id holds the same payload; repeated rows of
the smallest page_id are all responses; extra columns are ignored; an empty table gives no rows.
"""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden import staging
from logwarden.llm import arrays
from logwarden.llm.common import LOWEST, stage, text_of

LEAST = 100
VERSION = b"WARC/1.1"
FIRST_DATE = 1_704_067_200  # of page_id 0, a second for each id, anew after 10**9 of them
FILE_BYTES = 24_000_000  # payload of one archive
RANGE_ROWS = 200_000  # captures that one task merges
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
CAPTURE = ("url_key string, place long, page_id long, url string, ts long, record_type string, refers_to long, payload_bytes long, payload_digest string, "
           "archive string, position long, record_bytes long")


def captures(pages: DataFrame, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """page_id, url, html, digest, size and the capture referred to (null for responses)."""
    html = text_of("html")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.alias("html"),
                       F.octet_length(html).cast("long").alias("size"), F.sha2(html.cast("binary"), 256).alias("digest"))
    own = own.withColumn("known", F.coalesce("page_id", F.lit(LOWEST)))
    first = (own.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
             .filter("n > 1 and refers_to is not null").drop("n"))
    later = own.select("known", "digest").distinct().join(first, "digest").filter("known <> refers_to")
    files = max(1, -(-(own.agg(F.sum("size")).first()[0] or 0) // file_bytes))
    # payloads travel once: the join keeps their partitions, one for each archive
    return own.repartition(files, "known", "digest").join(later.hint("shuffle_hash"), ["known", "digest"], "left").drop("known")


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def record() -> Column:
    """A WARC record of a capture without the two line ends that close it."""
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    ts = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(1_000_000_000)) + FIRST_DATE
    # zone-free: seconds from a fixed day
    date = F.concat(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / 86400).cast("int")), "yyyy-MM-dd"), F.lit("T"),
                    *[x for part in ((ts % 86400) / 3600, (ts % 3600) / 60, ts % 60)
                      for x in (F.lpad(F.floor(part).cast("string"), 2, "0"), F.lit(":"))][:-1], F.lit("Z"))
    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.col("url"), "[\\x00-\\x20\\x7f]", "%20")
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    return F.concat(
        F.lit("WARC/1.1\r\n"), _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), number, F.lit(">"))), _header("WARC-Date", date),
        F.coalesce(_header("WARC-Target-URI", url), F.lit("")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("X-Full-Payload-Length", F.col("size").cast("string")),
        F.coalesce(_header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), F.lit("")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> str:
    """Write gzipped archives of about ``file_bytes`` of payload into ``folder``."""
    captures(pages, least, file_bytes).select(record().alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(folder)
    return folder


def parse(data: bytes):
    """Headers, position, size and block of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        if not data.startswith(VERSION, at):
            raise ValueError(f"no record at {at}")
        end = data.index(b"\r\n\r\n", at)
        headers = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode()
        size = int(headers["content-length"])
        stop = end + 4 + size
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} has another length than it says")
        yield headers, at, stop + 4 - at, data[end + 4:stop]
        at = stop + 4


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _seconds(date: str) -> int:
    return int(np.datetime64(date.removesuffix("Z"), "s").astype(np.int64))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record, the records of an archive as a run sorted by key, time and id
    (``place``). The payload of a response is hashed and compared with its header."""
    def every(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for headers, at, size, block in parse(zlib.decompress(content.as_buffer(), 31)):
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    length = int(headers["x-full-payload-length"])
                    if headers["warc-type"] == "response":
                        payload = memoryview(block)[block.index(b"\r\n\r\n") + 4:]
                        if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
                    url = headers.get("warc-target-uri")
                    rows.append((url_key(url), _seconds(headers["warc-date"]), _number(headers["warc-record-id"]), url, headers["warc-type"], _number(headers.get("warc-refers-to")), length, digest, path, at, size))
                if rows:
                    key, ts, page, *rest = zip(*sorted(rows, key=lambda r: (r[0], r[1], LOWEST if r[2] is None else r[2])))
                    columns = [key, range(len(rows)), page, rest[0], ts, *rest[1:]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64() if kind.endswith("long") else pa.string()) for c, kind in zip(columns, CAPTURE.split(", "))],
                        [kind.split()[0] for kind in CAPTURE.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(every, CAPTURE)


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then the path: captures of a site stand together."""
    rest = re.sub("^[a-z][a-z0-9+.-]*://", "", (url or "").lower())
    host = re.match("[^/?#]*", rest)[0]
    return ",".join(reversed(host.split("."))) + ")" + rest[len(host):]


class LoserTree:
    """Merges k sorted runs: an inner node holds the loser of its match, so taking the winner
    replays one path of log2 k matches."""

    def __init__(self, runs: list[list[tuple]]):  # rows are (key, anything)
        self.runs, self.at, self.k = runs, [0] * len(runs), max(1, len(runs))
        self.tree = [-1] * self.k
        for run in range(len(runs)):
            self._play(run)

    def _head(self, run: int):
        rows, at = self.runs[run], self.at[run]
        return (0, rows[at][0], run) if at < len(rows) else (1,)

    def _play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:  # first match here: wait for the other side
                self.tree[node] = run
                return
            if self._head(other) < self._head(run):
                self.tree[node], run = run, other
            node //= 2
        self.tree[0] = run

    def __iter__(self):
        while self.runs and self.at[self.tree[0]] < len(self.runs[self.tree[0]]):
            winner = self.tree[0]
            yield self.runs[winner][self.at[winner]]
            self.at[winner] += 1
            self._play(winner)


def histories(index: DataFrame) -> DataFrame:
    """All captures with ``range`` and ``place``: ordered by (range, place) they are ordered by URL
    key, time and id over the whole table. ``index`` holds sorted runs as ``read_archives`` does.

    Spark deals them to ranges of about RANGE_ROWS; archive and place split captures that are level in
    all three, so a range stays small however often one is repeated."""
    index = stage(index, "index")
    least = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-index.count() // RANGE_ROWS))
    names = index.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)

    def merge(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        page = [LOWEST if p is None else p for p in rows.column("page_id").to_pylist()]
        keys = zip(rows.column("url_key").to_pylist(), rows.column("ts").to_pylist(), page)
        runs: dict[str, list] = {}
        # a run may arrive in pieces; its places are its order
        for n, (archive, place, key) in enumerate(zip(rows.column("archive").to_pylist(), rows.column("place").to_pylist(), keys)):
            runs.setdefault(archive, []).append((place, key, n))
        order = [n for _, n in LoserTree([[(key, n) for _, key, n in sorted(run)] for run in runs.values()])]
        merged = rows.take(pa.array(order, pa.int64()))
        yield from merged.set_column(names.index("place"), "place", pa.array(range(len(order)), pa.int64())).to_batches()

    dealt = index.repartitionByRange(ranges, "url_key", "ts", "page_id", "archive", "place").withColumn("range", F.spark_partition_id())
    return dealt.mapInArrow(arrays.tidy(merge), f"{kinds}, range int")


def archive(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back, in capture order."""
    spark = pages.sparkSession
    folder = write_archives(pages, staging.new_path(spark, "warc"), least)
    return histories(read_archives(spark, folder))
