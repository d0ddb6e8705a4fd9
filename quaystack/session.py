"""SparkSession defaults and shared-folder helpers.

The library never creates machine-local scratch space on a cluster: every
write that must survive executor loss goes under the folder the cluster
names in ``spark.checkpoint.dir``. Only when that setting is absent (unit
tests, a laptop) do we pick a fresh temporary folder ourselves.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "quaystack",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every query relies on (safe to call repeatedly).

    Timestamps in the inputs are zone-less wall-clock values; all derived
    seconds and formatted strings are computed in UTC so results do not
    depend on the machine's zone.

    The JVM never compiles a method of over 8,000 bytes; a stage whose wide
    projection makes one would run interpreted. Above the limit Spark
    generates the operators one by one, in methods that are compiled.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    checkpoint_dir(spark)
    _show_workers(spark)
    return spark


def _show_workers(spark: SparkSession) -> None:
    """Put this package's folder on the module path of Python workers; on a
    cluster without that folder install the package there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *known])


#: Partitions that adaptive execution starts from where whole records are
#: shuffled; it joins small ones up to its advisory size.
FINE = 1024


_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def _fine(spark: SparkSession) -> str:
    return str(max(FINE, int(spark.conf.get(_INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions"))))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    was = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in was.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def fine_shuffles(spark: SparkSession):
    """What is run inside shuffles into at least ``FINE`` partitions. The
    session's number alone may be a few for each core, however large the
    input: a task then sorts more rows than its memory holds, and spills."""
    return _settings(spark, {_INITIAL: _fine(spark)})


#: Stored or shuffled bytes that a task takes where whole records are sorted.
#: In memory they are some five (shuffled) to twenty times (stored) as many.
TASK_BYTES = 16 << 20


def small_tasks(spark: SparkSession):
    """Fine shuffles whose partitions are joined, and whose files are split,
    to ``TASK_BYTES`` a task at most. A map task's shuffle writer buffers all
    of its rows and a sort all of a partition's; what the memory of a task
    does not hold is spilled. Of a join, the side that has no more than that
    in any partition is hashed and the other is not sorted."""
    def at_most(key: str) -> str:
        return str(min(TASK_BYTES, _bytes(spark.conf.get(key))))

    advisory = at_most("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    return _settings(spark, {
        _INITIAL: _fine(spark), "spark.sql.adaptive.advisoryPartitionSizeInBytes": advisory,
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": advisory,
        "spark.sql.files.maxPartitionBytes": at_most("spark.sql.files.maxPartitionBytes")})


#: Files that a task may have open at a time; one that has rows for more
#: folders sorts them.
WRITERS = 16


def several_writers(spark: SparkSession):
    """What is written inside into a few folders, by a column, is not sorted
    by it before."""
    return _settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": str(WRITERS)})


def _bytes(text: str) -> int:
    """A size as settings spell it: ``64MB``, ``20k``, ``134217728b``."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", text.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the cluster names.

    Without the setting a local session gets a fresh temporary folder; a
    cluster session fails, as executors would write to disks of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quaystack-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/quaystack/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df, name: str, codec: str = "snappy"):
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but computes the input a single
    time (an eager checkpoint runs it once to count and again to save), and
    the stored Parquet survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return spark.read.parquet(path)
