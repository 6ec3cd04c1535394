"""Session-level helpers shared by every operator: lineage cuts and size checks."""

from __future__ import annotations

import atexit
import gc
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    A temporary one is set only where it is unset and the master is local: on a
    cluster a machine-local folder would die with its machine.
    """
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"set {key} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="platewise-")
        spark.conf.set(key, folder)
    return folder.rstrip("/")


#: paths of the intermediate tables that are still there, by the id of their session's application
_TABLES: dict[str, list[str]] = {}


def _remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table, if the session's JVM still answers."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - nothing left to clean with
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, without its lineage.

    Survives the loss of executors, is computed once, and gives later plans real
    sizes to choose their joins by.  The table stays until :func:`free`,
    :func:`free_all` or the driver's end.  The shuffle files of the writing are deleted
    with its end; else they lie on the disk until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/platewise-{uuid.uuid4().hex}"
    tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(tidy, "false")
    spark.conf.set(tidy, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(tidy, before)
    mine = _TABLES.setdefault(spark.sparkContext.applicationId, [])
    if not mine:
        atexit.register(free_all, spark, spark.sparkContext.applicationId)
    mine.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut` gave and that no unfinished plan reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df.table_path
        _remove(spark, path)
        mine = _TABLES.get(spark.sparkContext.applicationId, [])
        if path in mine:
            mine.remove(path)


def free_all(spark: SparkSession, application: str | None = None) -> None:
    """Delete all intermediate tables of the session: for a caller who has written the results that read them."""
    mine = _TABLES.get(application or spark.sparkContext.applicationId, [])
    while mine:
        _remove(spark, mine.pop())


def let_go(spark: SparkSession) -> None:
    """Have what no plan reads any more deleted now: stored partitions and shuffle files go when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def at_most(df: DataFrame, limit: int) -> list | None:
    """Rows of ``df`` if there are at most ``limit`` of them, else ``None``.

    Never pulls more than ``limit + 1`` rows, so the driver's memory is bounded
    by the argument and not by the data.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application.

    Functions that run in workers name modules of the package, which a worker on
    another machine, or started in another folder, would not find.
    """
    sc = spark.sparkContext
    if getattr(sc, "_platewise_shipped", False):
        return
    package = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent).as_posix())
    folder = f"{shared_folder(spark)}/platewise-{uuid.uuid4().hex}"
    target = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/platewise.zip")
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(held.getvalue()))
    out.close()
    sc.addPyFile(f"{folder}/platewise.zip")
    sc._platewise_shipped = True
    atexit.register(_remove, spark, folder)
