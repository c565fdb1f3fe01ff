"""Event and alert tables that grow by runs, of which readers see the committed ones only.

A run has two steps. It *claims* a number, and with it a stretch of event ids that begins after
those of all runs before, once its lines are written; it *commits* after its events and alerts
are. Both are small files that appear under their name at once or not at all, so of two runs that
want one number the second takes the next: their ids are disjoint. A run has a key. Repeated after a
crash it finds its claim by the key, and so the same lines, arrival times and ids, and overwrites
what it left; repeated after its commit it changes nothing.

The files appear by a rename that fails if the name is taken, which HDFS does in one step. A store
without such a rename needs another way to exclude two claims at one instant.
"""

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from logwarden.sources import store

RUN = StructField("run", IntegerType())
CLAIM = "number long, key string, first_id long, rows long, late long, newest long, lines string"


@dataclass(frozen=True)
class Claim:
    """``lines``: folder of the landed lines; ``newest``: latest time (micros) of this run and those
    before it in its stream; ``late``: rows that came after the allowed delay."""

    number: int
    key: str
    first_id: int
    rows: int = 0
    late: int = 0
    newest: int | None = None
    lines: str | None = None


class RunTables:
    """Tables and ledger below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, *names: str) -> str:
        return "/".join([self.root, *names])

    def new_folder(self, label: str) -> str:
        """A folder that no reader looks into."""
        return self.path("_pending", f"{label}-{uuid.uuid4().hex}")

    # --- small files ---------------------------------------------------------------------

    def publish(self, source: str, path: str) -> bool:
        """Give a written file or folder its final name; False if that is taken."""
        return store.rename(self.spark, source, path)

    def _write_new(self, path: str, text: str) -> bool:
        """A file with this text under a name that was free."""
        draft = self.new_folder("file")
        files, target = store.file_at(self.spark, draft)
        out = files.create(target, True)
        out.write(bytearray(text.encode()))
        out.close()
        return self.publish(draft, path)

    def _numbers(self, folder: str) -> list[int]:
        files, target = store.file_at(self.spark, self.path("_ledger", folder))
        if not files.exists(target):
            return []
        return sorted(int(s.getPath().getName()[:10]) for s in files.listStatus(target) if s.getPath().getName()[:1] != ".")

    # --- the two steps -------------------------------------------------------------------

    def _claim_path(self, number: int) -> str:
        return self.path("_ledger", "claims", f"{number:010d}.json")

    def _key_path(self, key: str) -> str:
        return self.path("_ledger", "keys", hashlib.sha256(key.encode()).hexdigest())

    def find(self, key: str) -> Claim | None:
        """The claim of an earlier attempt."""
        number = store.read_text(self.spark, self._key_path(key))
        return None if number is None else Claim(**json.loads(store.read_text(self.spark, self._claim_path(int(number)))))

    def claim(self, key: str, rows: int = 0, **more) -> Claim:
        """First step: a number and ``rows`` ids that no other run has."""
        found = self.find(key)
        if found is not None:
            return found
        while True:
            taken = self._numbers("claims")
            last = json.loads(store.read_text(self.spark, self._claim_path(taken[-1]))) if taken else {"number": 0, "first_id": 0, "rows": 0}
            claim = Claim(last["number"] + 1, key, last["first_id"] + last["rows"], rows, **more)
            if self._write_new(self._claim_path(claim.number), json.dumps(asdict(claim))):
                if self._write_new(self._key_path(key), str(claim.number)):
                    return claim
                return self.find(key)  # another attempt of this run was first; this number stays unused

    def is_committed(self, claim: Claim) -> bool:
        return store.exists(self.spark, self.path("_ledger", "done", f"{claim.number:010d}"))

    def write(self, claim: Claim, events: DataFrame, alerts: DataFrame) -> None:
        """The run's rows, in place of those of a broken attempt."""
        for name, append, rows in (("alerts", store.append_alerts, alerts), ("events", store.append_events, events)):
            append(rows, f"{store.data_folder(self.spark, self.path(name))}/run={claim.number}", "overwrite")

    def commit(self, claim: Claim) -> None:
        """Second step: from now on readers see the run."""
        self._write_new(self.path("_ledger", "done", f"{claim.number:010d}"), claim.key)

    # --- reading -------------------------------------------------------------------------

    def _committed(self, name: str, layout: StructType) -> DataFrame:
        done = set(self._numbers("done"))
        broken = [n for n in self._numbers("claims") if n not in done]  # under way or given up: few
        folder = store.data_folder(self.spark, self.path(name))
        if not done or not store.exists(self.spark, folder):
            return self.spark.createDataFrame([], layout)
        rows = self.spark.read.schema(StructType([*layout.fields, RUN])).parquet(folder)
        return rows.filter((F.col("run") <= max(done)) & ~F.col("run").isin(broken)).select(*layout.names)

    def events(self) -> DataFrame:
        return self._committed("events", store.STORED_EVENTS)

    def alerts(self) -> DataFrame:
        return self._committed("alerts", store.STORED_ALERTS)

    def claims(self) -> DataFrame:
        """Number, key, ids, rows and late rows of all runs, committed or not."""
        if not store.exists(self.spark, self.path("_ledger", "claims")):
            return self.spark.createDataFrame([], CLAIM)
        return self.spark.read.schema(CLAIM).json(self.path("_ledger", "claims"))
