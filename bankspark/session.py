"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Room for code tables. Tables guessed larger than this are broadcast only once a shuffle has measured them: guesses come
# from file sizes and column widths, several hundred times below the rows of a compressed table with generated rows and
# few columns in use, and the driver holds every row of a broadcast table.
GUESSED_BROADCAST = 32 << 10
# The largest measured table that is broadcast. The driver gathers its rows, builds their hash table and keeps both with their
# serialized form: many times the measured size for short rows.
MEASURED_BROADCAST = 10 << 20
# What a byte of a file counts as in these guesses. Sorted keys and repeated values may take a hundredth of their rows' size,
# generated rows and columns left out another hundredth of it, so tables read from files always wait for the measure.
ROWS_PER_FILE_SIZE = 10_000

# What the operators rely on. AQE picks join strategies from run-time sizes and splits skewed
# join partitions, so no operator hints a broadcast of a table that grows.
RECOMMENDED_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": str(GUESSED_BROADCAST),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(MEASURED_BROADCAST),
    "spark.sql.sources.fileCompressionFactor": str(ROWS_PER_FILE_SIZE),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    # Plans are built from many column calls; recording the call site of each one costs more than the plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "bankspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with RECOMMENDED_CONF, overridden by ``conf``."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Switch on what joins of large tables need in a session made elsewhere.

    By default Spark splits a hot join partition only if no further shuffle follows from it; with
    the second setting it splits it in any case. What the session broadcasts by a guess above
    GUESSED_BROADCAST, it broadcasts by the measured size from then on, up to MEASURED_BROADCAST;
    tables in files are guessed by ROWS_PER_FILE_SIZE, so that well compressed ones are not guessed
    below it.
    """
    guessed = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    measured = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    size = guessed if measured is None else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(measured)
    if size > MEASURED_BROADCAST or (measured is None and guessed > GUESSED_BROADCAST):
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(min(size, MEASURED_BROADCAST)))
    if guessed > GUESSED_BROADCAST:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(GUESSED_BROADCAST))
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) < ROWS_PER_FILE_SIZE:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(ROWS_PER_FILE_SIZE))
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints, snapshots and stream state that every executor can reach.

    Read from ``spark.checkpoint.dir``. Only a local master may go without it, as in tests; a
    machine-local folder on a cluster would be lost with its machine, so that is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="bankspark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder, so that later branches read one fixed result."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_scratch: list[tuple[SparkSession, str]] = []


def _clear_scratch() -> None:
    for spark, folder in _scratch:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended before; its folder is then left to the cluster's own clearing
            return


atexit.register(_clear_scratch)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, deleted when the driver ends."""
    folder = f"{shared_dir(spark)}/{name}/{uuid.uuid4().hex}"
    _scratch.append((spark, folder))
    return folder
