"""Session set-up and the two ways lineage is cut: a written table or checkpoint()."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import warnings
import weakref
import zipfile
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, weakref.ref] = {}
_shipped: set[str] = set()


def build_session(app: str = "ledgersift", cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library expects of any cluster session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of all executors, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "ledgersift.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a local master one of our own.

    A cluster without spark.checkpoint.dir is an error: a machine-local folder would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), "ledgersift-shared")
    os.makedirs(folder, exist_ok=True)
    return f"file://{folder}"


def _delete(spark: SparkSession, path: str) -> None:
    if path.startswith("file:"):
        shutil.rmtree(urlsplit(path).path, ignore_errors=True)
        _written.pop(path, None)
        return
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception as e:  # the session may be gone already; the folder is temporary
        warnings.warn(f"{path} was not deleted: {e}", stacklevel=2)
    _written.pop(path, None)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written as Parquet into the shared folder and read again: lineage is cut and later reads prune columns.

    Unlike a checkpoint the copy has size statistics, so a join with it is broadcast only if its files are small.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_path = path
    _written[path] = weakref.ref(spark)
    return back


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df in as many parts as the session's shuffles have: for rows that are small but dear to work on.

    After an ordinary shuffle small parts are merged by their size alone, which would leave few tasks to do all the work.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame of written(), once nothing lazy reads it any more."""
    if path := getattr(df, "_written_path", None):
        _delete(df.sparkSession, path)


@atexit.register
def _discard_all() -> None:
    for path, ref in list(_written.items()):
        if spark := ref():
            _delete(spark, path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
