"""Session defaults and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Static defaults of a session of our own. On a cluster, submit with its own settings instead:
# none of the library's code depends on these values.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session, for tests and benches."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("saleslens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SALESLENS_DRIVER_MEMORY", "8g"))
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the session's ``spark.checkpoint.dir``.

    Tables written there outlive a lost executor. Where the setting is missing, a temporary
    folder is used in local mode only: on a cluster no machine-local folder is shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="saleslens-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def file_length(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder, of any file system Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def written(df: DataFrame, folder: str) -> DataFrame:
    """Write rows that several steps read, and read them back: they are computed once."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ship(spark: SparkSession, folder: Path = Path(__file__).parent) -> None:
    """A package's sources to the executors' Python, once for each context.

    They need not have it installed. Spark serves the archive from the driver, as it does files
    given with ``--py-files``.
    """
    sc = spark.sparkContext
    shipped = sc.__dict__.setdefault("_saleslens_shipped", set())
    if folder in shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="saleslens-")) / f"{folder.name}_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as file:
        for source in sorted(folder.rglob("*.py")):
            file.write(source, source.relative_to(folder.parent))
    sc.addPyFile(str(archive))
    shipped.add(folder)
