"""Session helpers: shared scratch space, size checks and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Most a lookup side may weigh before it is no longer broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024
# Catalyst takes a table of unknown size for at least this large.
UNKNOWN_BYTES = 1 << 60


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by ``spark.checkpoint.dir``.

    A machine-local folder is chosen only on a local master with nothing set;
    a cluster must name a folder all its executors can see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="tidewatch-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


_SCRATCH: list[str] = []


def scratch_mark() -> int:
    """A point to which :func:`drop_scratch` goes back."""
    return len(_SCRATCH)


def drop_scratch(spark: SparkSession, mark: int = 0, keep: DataFrame | None = None) -> None:
    """Delete tables that :func:`materialize` wrote since ``mark``, but for those ``keep`` reads."""
    kept = [f for f in keep.inputFiles()] if keep is not None else []
    for path in _SCRATCH[mark:]:
        name = path.rsplit("/", 1)[1]
        if not any(f"/{name}/" in f for f in kept):
            remove(spark, path)
            _SCRATCH.remove(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if it is there."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts lineage (an executor lost later re-reads files, not the whole plan) and
    gives every later pass a pruned columnar scan.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    _SCRATCH.append(path)
    return df.sparkSession.read.parquet(path)


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``; unknown sizes count as huge."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # no JVM handle (for instance Spark Connect)
        return 1 << 62


def takes_a_shuffle(df: DataFrame) -> bool:
    """Whether making ``df`` moves rows between tasks, so that reading it twice should not make it twice."""
    try:
        plan = df._jdf.queryExecution().sparkPlan().toString()
    except Exception:  # no JVM handle (for instance Spark Connect)
        return True
    return any(word in plan for word in ("Aggregate", "Join", "Window", "Exchange", "Sort ", "InArrow", "InPandas", "EvalPython"))


def table_state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and time of the last change of a table's folder or file."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(hpath).getLength(), fs.getFileStatus(hpath).getModificationTime()


def per_table(name: str) -> Callable:
    """Keep what a function of ``(spark, sf_dir)`` returned for as long as the table stays as it was."""
    def decorate(fn: Callable) -> Callable:
        held: dict = {}

        def kept(spark: SparkSession, sf_dir: str):
            key = (spark.sparkContext.applicationId, sf_dir)
            state = table_state(spark, f"{sf_dir}/{name}.parquet")
            if held.get(key, (None,))[0] != state:
                held[key] = (state, fn(spark, sf_dir))
            return held[key][1]

        kept.cache_clear = held.clear
        return kept

    return decorate


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the plans rely on for speed, not for results.

    The JVM does not compile methods over 8000 bytes of bytecode. A long chain of
    projections fused into one such method would run interpreted; past this limit
    Spark keeps them apart, in small methods that do get compiled.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def spread(scan: DataFrame) -> DataFrame:
    """Deal out a scan's rows when it has too few splits for the cores at hand.

    For a small table in one file, ahead of heavy per-row work. A table of many
    splits is returned as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() * 2 <= cores else scan


def is_directory(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hpath) and fs.getFileStatus(hpath).isDirectory()


def path_exists(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def local_session(cpus: int | str = "*", app: str = "tidewatch") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    parts = "8" if cpus == "*" else str(max(int(cpus), 2))
    return tune(
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
