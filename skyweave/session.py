"""Where intermediate tables live, and how lineage is cut.

Iterative operators write each round as a Parquet table in the shared folder that the cluster names in
``spark.checkpoint.dir`` and go on from the written rows. A lost executor then costs a re-read, never a
recomputation of earlier rounds.
"""

from __future__ import annotations

import pathlib
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one is made only in local mode where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-skyweave-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_MARKED: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; all paths of an application lie in one folder, to be removed when it has ended."""
    app = f"{shared_dir(spark)}/skyweave/{spark.sparkContext.applicationId}"
    if app not in _MARKED:
        _MARKED.add(app)
        # the file system deletes the folder when the driver's JVM ends
        folder = spark._jvm.org.apache.hadoop.fs.Path(app)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return f"{app}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return a reader of the written rows."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._skyweave_path = path
    return written


def materialise_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """:func:`materialise`, and the number of rows, counted while they are written."""
    seen = Observation()
    written = materialise(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    return written, seen.get["rows"]


class Growing:
    """A written table that rounds append to, so that a plan does not grow with the rounds."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.parts, self.schema = spark, scratch_path(spark, label), 0, None

    def append(self, df: DataFrame) -> int:
        """Writes the rows and returns how many there were."""
        seen = Observation()
        self.schema = df.schema if self.schema is None else self.schema
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.path}/part={self.parts}")
        self.parts += 1
        return seen.get["rows"]

    def part(self, k: int) -> DataFrame:
        """The rows of one round; negative numbers count from the last."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/part={k % self.parts}")

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/part={k}" for k in range(self.parts)])


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that still have to be read from them are lost."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/skyweave/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` that no later step reads."""
    path = getattr(df, "_skyweave_path", None)
    if path is None:
        return
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session: the yardstick for buckets, strips and islands."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks can import it wherever they run."""
    app = spark.sparkContext.applicationId
    with _SHIPPING:
        if app not in _SHIPPED:
            _ship(spark)
            _SHIPPED.add(app)


def _ship(spark: SparkSession) -> None:
    root = pathlib.Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-ship-')}/{root.name}", "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)
