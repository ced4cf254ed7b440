"""Sessions: the settings every query of the engine relies on, and the package on every worker."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "_flockwise_shipped"
#: Spark's setting to delete the shuffles of an execution when it ends; releases that lack it delete them later.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = "local[8]", app: str = "flockwise", shuffle_partitions: int | None = None, checkpoints: str | None = None, **extra: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow; `extra` uses `_` for `.` in option names.

    Without `master` the cluster's own is taken (spark-submit). Shuffle partitions are the cluster's setting unless
    given; a local session has as many as cores, at least 8. `checkpoints` is a folder that all executors share, taken if
    the cluster names none; its files are deleted when nothing refers to them any more.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if shuffle_partitions is None and master.startswith("local["):
            cores = master[6:].split("]")[0].split(",")[0]
            shuffle_partitions = max(8, int(cores) if cores.isdigit() else os.cpu_count() or 8)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for name, value in {**settings, **{k.replace("_", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if checkpoints and not _named_folder(spark):
        spark.sparkContext.setCheckpointDir(checkpoints)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers of a cluster, which needn't have it installed; once a session."""
    context = spark.sparkContext
    if context.master.startswith("local[") or context.master == "local" or getattr(context, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="flockwise")
    archive = os.path.join(folder, "flockwise.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for place, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(place, name)
                    z.write(path, os.path.join("flockwise", os.path.relpath(path, root)))
    context.addPyFile(archive)  # the driver serves it as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    setattr(context, _SHIPPED, True)


def _named_folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in `spark.checkpoint.dir`; only where that is unset (tests, one machine) the session's own
    is taken, else one under the warehouse, since executors of a cluster don't share temporary folders.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(_named_folder(spark) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context.getCheckpointDir()


class Scratch:
    """Tables in the shared folder that cut the lineage of an iteration.

    A table written and read again has a plan of its own, where a checkpoint keeps what the planner knows of the rows,
    which grows with each round. Of each name the two newest tables are kept until `drop`.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.written: dict[str, int] = {}

    def cut(self, df: DataFrame, name: str, free: bool = False) -> DataFrame:
        """Writes and reads a table; with `free` the shuffles that made it are deleted at once, not when the driver collects."""
        number = self.written[name] = self.written.get(name, 0) + 1
        path = f"{self.root}/{name}-{number}"
        before = self.spark.conf.get(_FREE, None)
        if free:
            self.spark.conf.set(_FREE, "true")
        try:
            df.write.parquet(path)
        finally:
            if free:
                self.spark.conf.unset(_FREE) if before is None else self.spark.conf.set(_FREE, before)
        if number > 2:
            self._delete(f"{self.root}/{name}-{number - 2}")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
