"""Event and alert tables and additive schemas."""

import uuid

from py4j.java_gateway import is_instance_of
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType

from logwarden import schema
from logwarden.operators.parse import fields_json

POINTER = "_current"  # in a table's folder: name of the version that is read and written
STORED_EVENTS = StructType([
    *[f for f in schema.EVENTS.fields if f.name != "has_alert"], StructField("fields", StringType()), StructField("has_alert", IntegerType()),
    StructField("source_lc", StringType()), StructField("dt", DateType()),
])
STORED_ALERTS = StructType([*schema.ALERTS.fields, StructField("dt", DateType())])


def with_layout(df: DataFrame, layout: StructType) -> DataFrame:
    """Columns of the layout; those missing in an older table are null."""
    empty = df.sparkSession.createDataFrame([], layout)
    return empty.unionByName(df, allowMissingColumns=True).select(*layout.names)


def event_rows(events: DataFrame) -> DataFrame:
    """Rows of the events table: defaults, day, lower-case source for pushed-down filters."""
    return events.withColumns({
        "source": F.coalesce("source", F.lit("unknown")),
        "category": F.coalesce("category", F.lit("generic")),
        "raw": F.coalesce("raw", F.lit("")),
        "fields": fields_json(),
        "source_lc": F.lower(F.coalesce("source", F.lit("unknown"))),
        "dt": F.col("ts").cast("date"),
    })


def append_events(events: DataFrame, path: str, mode: str = "append", compact: bool = True) -> None:
    """Append to the table partitioned by day and category.

    ``compact`` shuffles once so that a partition gets few large files; a day or category
    holding most rows is split over many of them.  Without it every task writes a file for
    each day and category it meets.
    """
    rows = event_rows(events)
    if compact:
        rows = rows.hint("rebalance", "dt", "category")
    rows.write.mode(mode).partitionBy("dt", "category").parquet(data_folder(events.sparkSession, path))


def append_alerts(alerts: DataFrame, path: str, mode: str = "append") -> None:
    with_layout(alerts, schema.ALERTS).withColumn("dt", F.col("ts").cast("date")).write.mode(
        mode
    ).partitionBy("dt").parquet(data_folder(alerts.sparkSession, path))


def _read(spark: SparkSession, path: str, layout: StructType) -> DataFrame:
    """A stored table by its layout: no footer is read to find columns, those a file lacks are null.

    A table without any row yet has no file; it reads as empty.
    """
    path = data_folder(spark, path)
    if not exists(spark, path):
        return spark.createDataFrame([], layout)
    return spark.read.schema(layout).parquet(path).select(*layout.names)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, STORED_EVENTS)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts of any age with their day ``dt``, which prunes folders."""
    return _read(spark, path, STORED_ALERTS)


def file_at(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = file_at(spark, path)
    return files.exists(target)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file; None if there is none."""
    files, target = file_at(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def rename(spark: SparkSession, source: str, path: str, replace: bool = False) -> bool:
    """Give a written file or folder its final name; False if that is taken and not to be replaced."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files, target = file_at(spark, path)
    files.mkdirs(target.getParent())
    if not replace and files.exists(target):
        return False
    kind = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, int(replace))
    if replace:
        options[0] = kind.OVERWRITE
    try:
        hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(hadoop.Path(source), target, options)
    except Py4JJavaError as error:
        if replace or not is_instance_of(spark.sparkContext._gateway, error.java_exception, "org.apache.hadoop.fs.FileAlreadyExistsException"):
            raise
        return False
    return True


def data_folder(spark: SparkSession, path: str) -> str:
    """Where a table's rows lie: its own folder, or after a restore the version its pointer names."""
    version = read_text(spark, f"{path.rstrip('/')}/{POINTER}")
    return path if version is None else version


def switch_pointer(spark: SparkSession, path: str, version: str) -> None:
    """From now on the table at ``path`` is ``version``; readers see the one or the other."""
    draft = f"{path.rstrip('/')}/_draft-{uuid.uuid4().hex}"
    files, target = file_at(spark, draft)
    out = files.create(target, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename(spark, draft, f"{path.rstrip('/')}/{POINTER}", replace=True)
