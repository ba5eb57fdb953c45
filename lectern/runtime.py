"""Session settings and tables that cut lineage.

Long or iterative plans are cut by writing a parquet table into the folder all executors share
(``spark.checkpoint.dir``). A lost executor then costs at most the stage it was working on.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, tuple[SparkSession, str]] = {}


def local_session(app: str = "lectern", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """This session's own folder below ``spark.checkpoint.dir``.

    Only a session on the local master may do without that setting; it gets a temporary folder.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="lectern-")
            own = root
        else:
            own = f"{root.rstrip('/')}/lectern-{app}-{uuid.uuid4().hex[:8]}"
        _FOLDERS[app] = (spark, own)
    return _FOLDERS[app][1]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names of a folder's entries; none if it doesn't exist."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    _delete(spark, path)


@atexit.register
def _clean() -> None:
    for spark, path in _FOLDERS.values():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer partitions than there are cores; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


class Stored:
    """A table in the shared folder: ``df`` reads it, ``drop()`` deletes its files."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; the files go when the session ends."""
    return Stored(df, name).df
