"""Session defaults and the few settings that operators read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", name: str = "loomery", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the engine's defaults; keywords override settings (dots as double underscores).

    Unless ``spark.checkpoint.dir`` is given, intermediate tables go to a new folder of this machine.
    """
    conf = {"spark__checkpoint__dir": tempfile.mkdtemp(prefix="loomery-")} | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.driver.memory", memory)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than the cluster has cores, dealt out over all of them; any other as it is.

    For operators that spend much work on each row: a few unsplittable files would otherwise keep most cores idle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


#: Paths of the tables that ``stash`` has written and nobody has dropped, with their sessions.
_stashed: dict[str, SparkSession] = {}


def stash(df: DataFrame) -> DataFrame:
    """Write an intermediate result as a Parquet table beside the checkpoints and read it back.

    It ends the lineage like a checkpoint, but columnar and compressed; executors that are lost later cost their own tasks
    only. The folder is the one the cluster names in ``spark.checkpoint.dir``; only a local session without that setting
    uses a temporary one, since a cluster's machines do not share it. Tables are deleted by ``drop``, by ``release`` once
    the results that read them are written, and at the latest when the driver ends.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.gettempdir()
    path = f"{folder.rstrip('/')}/loomery-{uuid.uuid4().hex}"
    _stashed[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def small_enough(df: DataFrame, most: int) -> bool:
    """True if a table that is already materialised has at most ``most`` rows."""
    return df.limit(most + 1).count() <= most


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``stash`` that no later step reads; other DataFrames are left alone."""
    for df in tables:
        _delete(getattr(df, "_stashed_at", None))


def release() -> None:
    """Delete all tables of ``stash``. Call it when the results that read them have been written or collected."""
    for path in list(_stashed):
        _delete(path)


def _delete(path: str | None) -> None:
    spark = _stashed.pop(path, None)
    if spark is not None:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:
            pass  # the session is gone already


atexit.register(release)
