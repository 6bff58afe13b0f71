"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Defaults for a session this package starts itself; a session given by the caller is never changed.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "lexmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package's defaults; ``conf`` overrides them (dots written as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is ``spark.checkpoint.dir``. Only where that is unset and the master is a single local process is a temporary
    folder made; on a cluster without the setting this raises, as a machine-local folder would lose data.
    """
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir")
    if not shared:
        shared = spark.conf.get("lexmill.scratch.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="lexmill-")
        atexit.register(shutil.rmtree, shared, True)
        spark.conf.set("lexmill.scratch.dir", shared)
    return shared.rstrip("/")


#: Tables written by :func:`materialise` that are still there.
_WRITTEN: list[str] = []


def materialise(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage with a table that outlives any executor, and lets later stages read only the columns they need. The
    tables are removed by :func:`release`, at the latest when the driver ends.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = f"{scratch_dir(spark)}/lexmill-{tag}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_release_quietly, spark)
    _WRITTEN.append(path)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._lexmill_path = path
    return kept


def materialise_by(df: DataFrame, column: str, values: list[str], tag: str = "t") -> dict[str, DataFrame]:
    """:func:`materialise` with a table of its own for each of ``values`` of ``column``, without that column.

    Spark then knows the size of each. Rows with other values are not written.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = f"{scratch_dir(spark)}/lexmill-{tag}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_release_quietly, spark)
    _WRITTEN.append(path)
    df.where(df[column].isin(values)).write.partitionBy(column).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs, own = at(path).getFileSystem(spark._jsc.hadoopConfiguration()), df.drop(column).schema
    folders = {v: f"{path}/{column}={v}" for v in values}
    return {v: spark.read.schema(own).parquet(f) if fs.exists(at(f)) else spark.createDataFrame([], own) for v, f in folders.items()}


def discard(df: DataFrame) -> None:
    """Remove the table behind a frame that :func:`materialise` gave; frames that still read it can no longer be run."""
    path = getattr(df, "_lexmill_path", None)
    if path in _WRITTEN:
        _WRITTEN.remove(path)
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> int:
    """Remove all tables written by :func:`materialise`; their number. Frames that still read them can no longer be run."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    removed = len(_WRITTEN)
    while _WRITTEN:
        at = path_of(_WRITTEN.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return removed


def _release_quietly(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:
        _WRITTEN.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context, wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_lexmill_shipped", False):
        return
    import os

    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="lexmill-package-")
    atexit.register(shutil.rmtree, folder, True)
    archive = shutil.make_archive(os.path.join(folder, f"lexmill-{uuid.uuid4().hex[:8]}"), "zip", os.path.dirname(root), os.path.basename(root))
    sc.addPyFile(archive)
    sc._lexmill_shipped = True
