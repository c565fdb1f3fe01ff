"""Streaming queries and their replayable sink."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from logwarden.operators.clean import clean
from logwarden.operators.detect import REFERENCE, describe
from logwarden.operators.parse import parse
from logwarden.operators.rules import BUILT_IN, Rule
from logwarden.staging import scratch, stage
from logwarden.streaming.counted import CountedRules

def stream_events(logs: DataFrame) -> DataFrame:
    """Cleaned and parsed events; for the admission limit see ``CountedAdmission``."""
    return parse(clean(logs))


def counted_alerts(
    state: str, rules: tuple[Rule, ...] = BUILT_IN, mode: str = REFERENCE, delay: int = 10
) -> Callable[[DataFrame, int], DataFrame]:
    """Alerts of each micro-batch of events; counts go on over micro-batches in the table ``state``."""
    counted = CountedRules(state, rules, mode, delay)
    return lambda events, batch_id: describe(counted.fire(stage(events, "parsed"), batch_id), rules)


def batch_folder(path: str, change: Callable[[DataFrame, int], DataFrame] | None = None):
    """``foreachBatch`` sink: one folder per micro-batch, overwritten when a batch is replayed."""
    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            out = batch if change is None else change(batch, batch_id)
            out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def start(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False, interval: str = "10 seconds",
) -> StreamingQuery:
    """Start a query into a ``foreachBatch`` sink."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.foreachBatch(sink).start()


def finish(query: StreamingQuery) -> None:
    """Wait for a query over what is available now; its failure is raised."""
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))
