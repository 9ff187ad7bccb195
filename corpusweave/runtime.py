"""Session, input tables and the shared folder for materialised intermediate tables."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Functions shipped to executors travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])


def get_session(cpus: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the operators are written for."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: Tables of texts and vectors, whose rows cost far more to work on than to move.
HEAVY = ("papers", "documents", "bundle", "live_store", "source_records")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table; columns are pruned and filters pushed by Catalyst. A heavy table that would be read by fewer than
    half as many tasks as there are cores, a small file that is, is dealt to all of them."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in HEAVY and 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores:
        return df.repartition(cores)
    return df


class Staging:
    """Written tables in the folder all executors share.

    They cut lineage like a reliable checkpoint but stay columnar and compressed, and keep size statistics for the
    planner. Everything written is removed when the driver ends; `drop` removes a superseded table at once.
    """

    _roots: dict[str, str] = {}

    def __init__(self, spark: SparkSession):
        self.spark = spark
        app = spark.sparkContext.applicationId
        if app not in self._roots:
            self._roots[app] = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
            atexit.register(self._delete, spark, self._roots[app])
        self.root = self._roots[app]
        self._paths: dict[int, str] = {}

    @staticmethod
    def _delete(spark: SparkSession, path: str) -> None:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; the folder belongs to the cluster's own cleaning
            pass

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write df once and return a plan that reads it back with the same schema."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
        out = self.spark.read.schema(schema).parquet(path)
        self._paths[id(out)] = path
        out._staged_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_staged_path", None)
        if path:
            self._delete(self.spark, path)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; only where it is unset and the master is local, a temporary folder."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="staged-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")
