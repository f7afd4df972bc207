"""Session helper and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_marked: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that results depend on (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corvane")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that Python operators run wherever the repository is not installed."""
    context = spark.sparkContext
    if getattr(context, "_corvane_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="corvane-ship-")) / "corvane.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    context._corvane_shipped = True


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder for scratch tables that the session names in ``spark.checkpoint.dir``.

    Where it is unset, a local session (one process, as in tests) gets a folder of its own; on a cluster that is an error,
    as executors would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share: this operator writes scratch tables there")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return _own[app]


def scratch_path(spark: SparkSession) -> str:
    """A new path below this application's scratch folder, which is deleted when the application's process ends."""
    top = f"{shared_dir(spark)}/corvane-{spark.sparkContext.applicationId}"
    if top not in _marked:
        p, fs = _path(spark, top)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _marked.add(top)
    return f"{top}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, broadcast: int | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of its plan go as soon as the table is written, for nothing else reads them. ``broadcast`` holds the sides that
    Spark broadcasts by itself to so many bytes: it judges scratch tables by their files, whose rows take many times that.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    wanted = {_CLEANUP: "true"} | ({} if broadcast is None else {_BROADCAST: str(broadcast)})
    before = {k: spark.conf.get(k, None) for k in wanted}  # None where only the default holds; releases without the cleanup ignore it
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._cv_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_cv_path", None):
            p, fs = _path(df.sparkSession, path)
            fs.delete(p, True)
