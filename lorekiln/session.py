"""Session helpers: building a local session and cutting lineage safely."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "lorekiln") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names in ``spark.checkpoint.dir``.

    A temporary folder is made only for a local master, where the driver and
    the executors are one process; on a cluster an unset folder is an error,
    since a machine-local one would be lost with its executor.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lorekiln-checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (lineage ends here)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str, sort_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared checkpoint folder and read it back.

    Used where several later steps read the same intermediate columns: Parquet
    keeps column pruning and filter pushdown, which a checkpoint doesn't.
    ``sort_by`` clusters the rows inside each file, so that row-group
    statistics can skip.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    if not _STORED:
        atexit.register(_release_quietly, spark)
    _STORED.add(folder)
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Folders written by store() and not yet released.
_STORED: set[str] = set()


def _release_quietly(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        release(spark)


def release(spark: SparkSession) -> int:
    """Delete all tables of store(), once the results that read them are written; done at exit too. Returns how many."""
    sc, n = spark.sparkContext, 0
    if sc._jsc is None:
        return 0  # stopped: the folder goes with the checkpoint folder
    while _STORED:
        path = sc._jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        n += bool(path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True))
    return n


#: A key with more than this part of all rows is hot; so there are at most 1 / HOT such keys.
HOT = 1 / 1000


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, in which each key occurs at most once, however skewed ``left`` is.

    Rows of hot keys (more than HOT of all rows each, so at most 1 / HOT keys)
    meet their partner by a broadcast of those few rows; the others are
    shuffled. Null keys meet nothing. ``left`` is read three times, so it
    should be stored or cheap; ``how`` is ``left`` or ``inner``.
    """
    total = left.count()
    if not total:
        return left.join(right, keys, how)
    counts = left.groupBy(*keys).count().where(F.col("count") > max(1.0, total * HOT))
    hot = store(counts.dropna(subset=keys).select(*keys), "hot-keys")
    few = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))  # at most 1 / HOT rows
    return left.join(F.broadcast(hot), keys, "left_semi").join(few, keys, how).unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how))
