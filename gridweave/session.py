"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Every join in the library carries `gid` in its key. With this setting two sides
# already partitioned by `gid` are joined on (gid, id) without another exchange.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
    # A row can be a block of thousands of vectors, so batches are bounded by bytes as well.
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
    # HotSpot never compiles a longer method; Spark then splits its code in place of interpreting it.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Stored tables are read a few times at most, so size counts for more than the time to unpack.
    "spark.sql.parquet.compression.codec": "zstd",
}


# Row groups of intermediate tables, small enough to give every core a share.
ROW_GROUP_BYTES = 16 << 20

_shipped: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings, which change plans but never results, and send the
    package to the Python workers."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers, once for each application."""
    if spark.sparkContext.applicationId not in _shipped:
        spark.sparkContext.addPyFile(_packed())
        _shipped.add(spark.sparkContext.applicationId)
    return spark


def _packed() -> str:
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="gridweave-py-")) / "gridweave.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    return str(archive)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a temporary folder only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="gridweave-")
    spark.sparkContext.setCheckpointDir(path)
    return shared_dir(spark)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's part of the shared folder, which is removed when
    the driver's JVM ends."""
    root = f"{shared_dir(spark)}/gridweave-{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)  # only an existing path can be marked for removal
    files.deleteOnExit(folder)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Cuts the lineage, so a value that depends on the physical layout (a partition
    number, say) stays the same when an executor is lost and tasks run again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that no later step reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def at_least_parallel(df: DataFrame) -> DataFrame:
    """Spread the rows of a scan that has fewer partitions than the session has cores,
    as a single file with one row group has. A scan of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
