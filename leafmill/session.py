"""Session settings and the few helpers that need the session itself."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for local work and tests; a cluster brings its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("leafmill")
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once a context, unless they find it on their path anyway."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    found = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {os.getcwd()}
    if not getattr(context, "_leafmill_shipped", False):
        context._leafmill_shipped = True
        if str(root) not in found and "site-packages" not in str(root):
            archive = Path(tempfile.mkdtemp()) / "leafmill.zip"  # the driver serves it to the executors
            with zipfile.ZipFile(archive, "w") as out:
                for file in sorted(root.glob("leafmill/**/*.py")):
                    out.write(file, file.relative_to(root))
            context.addPyFile(str(archive))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan over all cores: a file of one row group is one task, however many cores are free.

    Only a scan with fewer parts than the cluster has cores is shuffled; at scale there are more, and this does nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_paths: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where it is unset, a local one for a local session only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "leafmill-shared")
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of df as a table in the shared folder: later reads neither recompute them nor depend on an executor.

    Each call uses a folder of its own, so a re-run never meets the files of an earlier one. The folder stays until
    `release`, at the latest until Python ends, because the result is read lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _paths[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Removes all tables written so far; results that read them must have been used."""
    for path, spark in list(_paths.items()):
        try:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # the session may be gone; the folder then goes with the shared folder
            pass
        _paths.pop(path, None)


atexit.register(release)
