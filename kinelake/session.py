"""Session settings shared by every entry point."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BLOCK_ROWS_CONF = "spark.kinelake.blockRows"
BLOCK_ROWS_DEFAULT = 8192

HOT_ROWS_CONF = "spark.kinelake.hotRows"
HOT_ROWS_DEFAULT = 250_000

_LOCAL: dict[str, str] = {}


def build_session(app: str = "kinelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC clock, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.compression.codec": "snappy",
        # HotSpot never compiles a method above 8000 bytes of bytecode. Filter taps over many joints can exceed that;
        # with this limit Spark splits them into small methods instead of running one huge method interpreted.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def block_rows(spark: SparkSession) -> int:
    """Frames per block: the unit one task sorts at a time, however long the episode is."""
    return int(spark.conf.get(BLOCK_ROWS_CONF, str(BLOCK_ROWS_DEFAULT)))


def hot_rows(spark: SparkSession) -> int:
    """Group size above which an exact quantile no longer keeps the group's values in one task."""
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors share; only a local master may do without a named one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local["):
        if "folder" not in _LOCAL:
            _LOCAL["folder"] = tempfile.mkdtemp(prefix="spark-kinelake-")
            atexit.register(shutil.rmtree, _LOCAL["folder"], ignore_errors=True)
        folder = _LOCAL["folder"]
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write a result that several later branches read, and read it back.

    Each branch then scans only its own columns, and a lost executor costs a re-read instead of the whole lineage. Tables of one
    application lie in one folder of its name below the shared one, which can go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/staged-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
