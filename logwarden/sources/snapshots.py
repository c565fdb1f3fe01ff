"""Snapshots of tables by manifest: what did not change since an earlier snapshot is shared with it.

A snapshot is a folder with a manifest and the data that no earlier snapshot holds. The unit is a leaf
folder of the table (say one day of one run): its files' names, sizes and times tell whether it changed.
Changed folders are copied by one Spark job; the manifest, written last, names for every leaf folder where
its copy lies, its rows and a checksum of all its values that does not depend on their order. A folder
without a manifest is no snapshot.

A restore writes a new version beside the table, compares it with the manifest and then switches the
table's pointer in one step: broken off before, it leaves the old table as it was. Expiry removes
manifests, and data that no other manifest names.
"""

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden import fixed_values as fixed
from logwarden.sources.store import POINTER, data_folder, exists, file_at, read_text, switch_pointer

STAMP = "%Y%m%d-%H%M%S"
MANIFEST = "dir string, mark string, base string, rows long, checksum string"


@contextmanager
def _plain_partitions(spark: SparkSession) -> Iterator[None]:
    """Folder names as they are: ``007`` is no number here."""
    name = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _leaves(spark: SparkSession, root: str) -> dict[str, str]:
    """Leaf folders with data below a table's folder, and a mark of their files."""
    files, folder = file_at(spark, root)
    base, found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/"), {}
    listed = files.listFiles(folder, True)
    while listed.hasNext():
        status = listed.next()
        parts = status.getPath().toString()[len(base) + 1:].split("/")
        if not any(p[:1] in "_." for p in parts):
            found.setdefault("/".join(parts[:-1]), []).append((parts[-1], status.getLen(), status.getModificationTime()))
    return {leaf: hashlib.sha256(json.dumps(sorted(held)).encode()).hexdigest() for leaf, held in found.items()}


def _columns(leaves) -> list[str]:
    """Partition columns, from the folders' names."""
    names = {tuple(p.split("=")[0] for p in leaf.split("/") if p) for leaf in leaves}
    if len(names) > 1:
        raise ValueError("folders of different depth or columns")
    return list(names.pop()) if names else []


def _read(spark: SparkSession, base: str, leaves: list[str]) -> DataFrame:
    with _plain_partitions(spark):
        reader = spark.read.option("basePath", base).option("mergeSchema", "true")
        return reader.parquet(*[f"{base}/{leaf}".rstrip("/") for leaf in leaves])


def _measured(rows: DataFrame, columns: list[str]) -> dict[str, tuple[int, str]]:
    """Rows and checksum of each leaf folder: one small row for each, summed on the map side."""
    values = sorted(c for c in rows.columns if c not in columns)
    # a column that a table lacks counts like null in it, so copies that got it are the same
    seen = F.xxhash64(*[F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.lit(c), F.col(f"`{c}`"))) for c in values])
    found = rows.groupBy(*columns).agg(F.count("*").alias("rows"), F.sum(seen.cast("decimal(38,0)")).cast("string").alias("checksum")).collect()
    return {"/".join(f"{c}={r[c]}" for c in columns): (r["rows"], r["checksum"]) for r in found}


def _manifest(spark: SparkSession, snapshot: str) -> list[dict]:
    text = read_text(spark, f"{snapshot}/manifest.json")
    if text is None:
        raise FileNotFoundError(snapshot)
    return json.loads(text)


def make_snapshot(spark: SparkSession, table: str, folder: str, now: datetime | None = None, name: str = "snapshot") -> str:
    """Snapshot of a table as ``folder/<name>-<UTC time>``."""
    if not exists(spark, table):
        raise FileNotFoundError(table)
    target = f"{folder}/{name}-{(now or datetime.now(timezone.utc)).strftime(STAMP)}"
    if exists(spark, f"{target}/manifest.json"):
        raise FileExistsError(target)
    root = data_folder(spark, table)
    leaves = _leaves(spark, root)
    columns = _columns(leaves)
    known = {(u["dir"], u["mark"]): u for _, path in list_snapshots(spark, folder, name) for u in _manifest(spark, path)}
    units = [known[leaf] for leaf in leaves.items() if leaf in known]
    changed = [leaf for leaf, mark in leaves.items() if (leaf, mark) not in known]
    if changed:
        writer = _read(spark, root, changed).write.mode("overwrite")
        (writer.partitionBy(*columns) if columns else writer).parquet(f"{target}/data")
        with _plain_partitions(spark):
            measured = _measured(spark.read.parquet(f"{target}/data"), columns)
        units += [{"dir": leaf, "mark": leaves[leaf], "base": f"{target}/data", "rows": measured[leaf][0], "checksum": measured[leaf][1]}
                  for leaf in changed]
    files, path = file_at(spark, f"{target}/manifest.json")
    out = files.create(path, True)
    out.write(bytearray(json.dumps(units).encode()))
    out.close()
    return target


def read_snapshot(spark: SparkSession, snapshot: str) -> DataFrame:
    """All rows of a snapshot; folder columns are text."""
    by_base: dict[str, list[str]] = {}
    for unit in _manifest(spark, snapshot):
        by_base.setdefault(unit["base"], []).append(unit["dir"])
    if not by_base:
        raise ValueError("a snapshot of a table without rows has no columns")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_read(spark, base, leaves) for base, leaves in by_base.items()])


def list_snapshots(spark: SparkSession, folder: str, name: str = "snapshot") -> list[tuple[datetime, str]]:
    """Time and path of the snapshots, oldest first."""
    files, target = file_at(spark, folder)
    if not files.exists(target):
        return []
    found = []
    for status in files.listStatus(target):
        base = status.getPath().getName()
        stamp = base[len(name) + 1:] if base.startswith(f"{name}-") else ""
        # other names, say of tables saved before a restore, are not snapshots
        if re.fullmatch(r"\d{8}-\d{6}", stamp) and exists(spark, f"{folder}/{base}/manifest.json"):
            found.append((datetime.strptime(stamp, STAMP).replace(tzinfo=timezone.utc), f"{folder}/{base}"))
    return sorted(found)


def expire_snapshots(
    spark: SparkSession, folder: str, keep_days: int = fixed.SNAPSHOT_KEEP_DAYS,
    now: datetime | None = None, name: str = "snapshot",
) -> int:
    """Remove snapshots strictly older than ``keep_days`` days; ``<= 0`` keeps all.  Data that a
    kept snapshot shares with a removed one stays."""
    if keep_days <= 0:
        return 0
    oldest = (now or datetime.now(timezone.utc)) - timedelta(days=keep_days)
    taken = list_snapshots(spark, folder, name)
    expired = [path for at, path in taken if at < oldest]
    held = {(u["base"], u["dir"]) for at, path in taken if at >= oldest for u in _manifest(spark, path)}
    gone = {(u["base"], u["dir"]) for path in expired for u in _manifest(spark, path)} - held
    for path in expired:  # first no snapshot any more, then its data
        files, manifest = file_at(spark, f"{path}/manifest.json")
        files.delete(manifest, False)
    for base, leaf in gone:
        files, data = file_at(spark, f"{base}/{leaf}".rstrip("/"))
        files.delete(data, True)
    kept = {base for base, _ in held}
    for path in expired:
        if f"{path}/data" not in kept:
            files, rest = file_at(spark, path)
            files.delete(rest, True)
    return len(expired)


def restore_snapshot(spark: SparkSession, snapshot: str, table: str, force: bool = False, now: datetime | None = None) -> str | None:
    """Make a table what a snapshot holds.  An existing table is refused, or with ``force`` saved first;
    gives the path of what was saved."""
    units, saved = _manifest(spark, snapshot), None
    if exists(spark, table):
        if not force:
            raise FileExistsError(table)
        parent, _, base = table.rstrip("/").rpartition("/")
        saved = make_snapshot(spark, table, parent, now, f"{base}-pre-restore")
    version = f"{table.rstrip('/')}/{POINTER}-{uuid.uuid4().hex}"
    files, folder = file_at(spark, version)
    files.mkdirs(folder)
    if units:
        columns = _columns([u["dir"] for u in units])
        writer = read_snapshot(spark, snapshot).write.mode("overwrite")
        (writer.partitionBy(*columns) if columns else writer).parquet(version)
        with _plain_partitions(spark):
            found = _measured(spark.read.parquet(version), columns)
        if found != {u["dir"]: (u["rows"], u["checksum"]) for u in units}:
            raise ValueError(f"{snapshot} is damaged: its data differ from its manifest")
    switch_pointer(spark, table, version)
    return saved
