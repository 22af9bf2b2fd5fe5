"""Session construction and cluster-shared locations."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every session of ours wants. They are runtime SQL confs, so they can
# also be applied to a session someone else built (see ``apply_sql_defaults``).
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows of a Python batch: at the default of 10,000 whole texts fill a worker's memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def get_session(master: str | None = None, app: str = "hitlink",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or get) a session. On a cluster pass ``master=None`` and let
    spark-submit decide; tests pass ``local[N]``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if master and master.startswith("local"):
        # Local mode runs everything in the driver JVM.
        b = b.config("spark.driver.memory", os.environ.get("HITLINK_DRIVER_MEMORY", "16g"))
    for k, v in SQL_DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: worker functions are pickled by reference, so the workers
    must be able to import it wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="hitlink-ship-")) / "hitlink.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def apply_sql_defaults(spark: SparkSession) -> None:
    for k, v in SQL_DEFAULTS.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # some confs are static on a shared session
            pass


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage and intermediate tables.

    Read from ``spark.checkpoint.dir`` as the cluster configures it; only when it
    is unset and everything runs in one local JVM (tests) fall back to a fresh
    scratch folder. On a cluster a folder of one machine would lose data, so an
    unset folder is an error there.
    """
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors share (master {master})")
        conf = tempfile.mkdtemp(prefix="hitlink-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(conf)
    return spark.sparkContext.getCheckpointDir() or conf


def materialize(df, name: str):
    """Write ``df`` as a parquet table under the shared checkpoint folder and read
    it back: lineage is cut (a lost executor does not recompute the upstream
    joins), the result is computed once however often it is read, and later
    reads get column pruning and filter push-down."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _CREATED.append(path)
    return spark.read.schema(df.schema).parquet(path)


# Paths that materialize() wrote in this process and drop_tables() has not deleted.
_CREATED: list[str] = []


@contextmanager
def recorded_tables() -> Iterator[list[str]]:
    """The list fills, at the end of the block, with the paths that materialize() wrote inside it."""
    before, paths = set(_CREATED), []
    yield paths
    paths.extend(p for p in _CREATED if p not in before)


def drop_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete materialized tables. Only their owner can say when: results that read them must have been consumed."""
    jvm = spark.sparkContext._jvm
    for path in list(paths):
        if path in _CREATED:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            _CREATED.remove(path)


def spread(df, min_partitions: int | None = None):
    """Give per-row work enough tasks. A scan yields one task per file split (a
    parquet row group cannot be split), so a small input stored as one row group
    would run every per-row expression before the first shuffle in one task.
    When the input has fewer partitions than the session's default parallelism,
    rows are spread round-robin; on a large input this is a no-op."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    have = df._jdf.rdd().getNumPartitions()
    return df.repartition(want) if have < want else df
