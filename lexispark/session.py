"""Session settings and the shared folder that iterative jobs write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "lexispark", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, use the session it gives."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **extra,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local master falls back to a temporary folder: on a cluster such a folder
    dies with its machine, so an unset `spark.checkpoint.dir` is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="lexispark-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, used: list[str] | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: like `checkpointed`, but computed once and read by columns.

    The path is added to `used`, for `removed` when nothing reads the table any more.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if used is not None:
        used.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, used: list[str]) -> None:
    """Remove tables of finished steps. Call it once what was made of them is written."""
    for path in used:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    used.clear()


def fan_out(df: DataFrame) -> DataFrame:
    """Spread a table that is small in bytes but costly to process.

    Adaptive execution sizes partitions by bytes and would leave such a table to one or two tasks.
    """
    spark = df.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(spark.sparkContext.defaultParallelism, shuffle))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a table that is small in bytes: a scan of few splits, which together hold SPREAD_BYTES at most.

    Anything larger is left as the scan split it, so a corpus is never shuffled for this.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions()
    split = as_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if parts >= cores or parts * split > SPREAD_BYTES:
        return df
    return df.repartition(cores)


#: At most so much text is shuffled to use idle cores.
SPREAD_BYTES = 2 << 30


def as_bytes(size: str) -> int:
    """A setting such as 134217728b, 16m or 1g as a number."""
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    number = size.lower().rstrip("b") or "0"
    return int(number[:-1]) * units[number[-1]] if number[-1] in units else int(number)
