"""Session helpers.

The cluster owns the session; these helpers only fill in settings that are
unset (as in tests and local runs) and hand out scratch locations under the
shared ``spark.checkpoint.dir`` rather than a machine-local folder.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings we rely on; applied only when the session does not set them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Delete reliable checkpoint files once their frames are garbage collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "provguard") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Only a local session may go without the setting; it gets a temporary folder.  On a
    cluster each executor would write to its own disk, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = _LOCAL_DIRS.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="provguard-ckpt-")
        _LOCAL_DIRS[spark.sparkContext.applicationId] = path
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


_LOCAL_DIRS: dict[str, str] = {}
_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the shared checkpoint folder, removed when the driver ends.

    Frames that read it may be evaluated until then; ``drop_scratch`` is for what is surely spent."""
    if not _SCRATCH:
        atexit.register(remove_scratch)
    path = os.path.join(ensure_checkpoint_dir(spark), "provguard-scratch", f"{name}-{uuid.uuid4().hex[:12]}")
    _SCRATCH.append(path)
    return path


def scratch_made() -> list[str]:
    """The scratch folders that this driver has handed out and not dropped, oldest first."""
    return list(_SCRATCH)


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch folders that no frame still to be evaluated reads."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _SCRATCH.remove(name)


def remove_scratch() -> None:
    """Delete this driver's scratch folders, if its session still runs."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        drop_scratch(spark, scratch_made())


def plan_bytes(df: DataFrame) -> int:
    """Spark's size estimate of a frame (from file sizes and the plan; no job runs)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


UNKNOWN_BYTES = 1 << 62  # Spark gives the largest number to inputs of unknown size


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables a frame reads, by Spark's estimates (no job runs); 0 where unknown."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN_BYTES)


@contextlib.contextmanager
def compiled_projections(spark: SparkSession):
    """While this holds, frames of many computed columns run as compiled code.

    Spark fuses a frame's columns into one method, and the JVM never compiles methods of over 8,000 bytes; with this
    limit Spark leaves such methods alone and makes small ones instead.  It holds for what is executed
    inside, not for frames that are only built there."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    fd, path = tempfile.mkstemp(suffix=".zip", prefix=f"{package.name}-")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent).as_posix())
    spark.sparkContext.addPyFile(path)  # from the driver's disk to every executor
    _SHIPPED.add(app)
