"""Session defaults and small helpers that every operator shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "linelore", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, AQE with skew handling, Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions for explicit range exchanges: the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set, local mode makes one that goes with the process; a cluster
    has no folder that every executor sees, so that is an error."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="linelore-")
        atexit.register(shutil.rmtree, _LOCAL[sc.applicationId], ignore_errors=True)
    return _LOCAL[sc.applicationId]


_LOCAL: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))


def drop_at_exit(spark: SparkSession, folder: str, now: bool = False) -> None:
    """Delete a folder of intermediate results when the session's file system is closed, or at once."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if now:
        fs.delete(path, True)
    else:
        fs.mkdirs(path)
        fs.deleteOnExit(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder; survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table whose rows cost much work each: dealt out to all cores where its files have fewer splits than there are cores.

    Large tables have more splits than cores and are read as they are, so nothing is shuffled at scale.
    """
    df = table(spark, root, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
