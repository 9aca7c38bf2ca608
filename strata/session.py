"""Session helpers: local sessions for tests/bench and the shared checkpoint folder.

On a cluster the session is created by the platform and ``spark.checkpoint.dir``
names a shared folder; the library only reads it.  A local folder is set only
when the session has none (tests, bench on one machine).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job of the library assumes: UTC wall clock, AQE re-planning
# (coalescing small shuffles, splitting skewed join partitions).
_SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "strata") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # iterative operators checkpoint every round; drop files no longer referenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in _SQL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators rely on to an existing session
    and make the package importable in its Python workers."""
    for k, v in _SQL_CONF.items():
        spark.conf.set(k, v)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a local one only if unset."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc._jsc.sc().getCheckpointDir().get()
    if not (sc.master == "local" or sc.master.startswith("local[")):
        # executors on other machines cannot see a folder of this one
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="strata-ckpt-", dir=os.environ.get("STRATA_SCRATCH", "/tmp"))
    sc.setCheckpointDir(local)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more, through the file system it lies in."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a folder."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def move_path(spark: SparkSession, path: str, to: str) -> None:
    """A folder moved to a place in the same file system; a folder that is not there is left out."""
    sc = spark.sparkContext
    a, b = sc._jvm.org.apache.hadoop.fs.Path(path), sc._jvm.org.apache.hadoop.fs.Path(to)
    fs = a.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if fs.exists(a) and not fs.rename(a, b):
        raise OSError(f"{path} could not be moved to {to}")


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver notice that finished jobs' shuffles are unreachable, so
    that Spark's cleaner removes their files before the next stage writes."""
    import gc
    import time

    for _ in range(2):  # what the first round frees may hold what the second finds
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``strata`` importable in Python workers (needed by the Arrow
    ``mapInPandas`` steps): zip the package once per application and add it
    with ``addPyFile``, which distributes it with the job."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    # the driver's own copy of the code; addPyFile serves it to every executor
    fd, path = tempfile.mkstemp(prefix="strata-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
