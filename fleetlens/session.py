"""Session settings, the shared folder used to cut lineage, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it is proven to have at most this many rows and bytes.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 32 << 20

_shipped: set[str] = set()


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and local runs; on a cluster, pass your own session to the operators."""
    builder = (
        SparkSession.builder.master(master)
        .appName("fleetlens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on, and this package on the executors."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package once per application, so that Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="fleetlens-"), "fleetlens.zip")  # read by this driver only
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("fleetlens", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(target)
    # stateful processors also run in a worker beside the driver, which gets no shipped files
    paths = [os.path.dirname(root), spark.sparkContext.environment.get("PYTHONPATH")]
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in paths if p)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session shares with its executors.

    A machine-local folder is taken only by a local session, whose executors are this process.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="fleetlens-")
        spark.sparkContext.setCheckpointDir(path)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; Spark removes it when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/fleetlens-scratch/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the copy."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Hint a broadcast when ``df`` is proven small; otherwise leave the join to shuffle."""
    text = [F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns]
    size = sum(text[1:], text[0]) + 8 * len(text)
    rows, wide = df.limit(max_rows + 1).agg(F.count("*"), F.sum(size)).first()
    if rows <= max_rows and (wide or 0) <= max_bytes:
        return F.broadcast(df)
    return df
