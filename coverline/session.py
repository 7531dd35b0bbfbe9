"""Session defaults and the two services every operator shares: table access and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest row count of a table that an operator may broadcast or turn into literals.
MAX_BROADCAST_ROWS = 50_000
_SCRATCH: list[str] = []


def get_session(app: str = "coverline", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session with the settings the engine is tested under (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("COVERLINE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless they find it by themselves (working directory or PYTHONPATH)."""
    root = Path(__file__).resolve().parents[1]
    sc = spark.sparkContext
    if getattr(sc, "_coverline_shipped", False) or Path.cwd() == root or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(tempfile.mkdtemp(prefix="coverline-package-")) / "coverline.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(Path(__file__).resolve().parent.rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(target))
    sc._coverline_shipped = True


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if set, else (tests) one is made and set."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="coverline-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for tables an operator writes and reads back."""
    path = f"{shared_dir(spark).rstrip('/')}/coverline-{label}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def clean_scratch(spark: SparkSession) -> None:
    """Deletes the tables operators wrote in this process; call it when no frame that reads them is needed any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _SCRATCH:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(hadoop).delete(path, True)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back (survives lost executors)."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if it holds at most ``limit`` rows, else ``df`` itself (Spark then shuffles)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
