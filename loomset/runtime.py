"""Session helpers: where intermediate tables live and how they are written."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST_BYTES = 32 << 20  # most that a small table may send to every worker
HOT_ROWS = 1000  # a key with fewer rows is never hot
HOT_KEYS = 256  # no more keys than this can each hold over 1/256 of all rows
SALTS = 32
_test_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application, through the driver's file server.

    Workers then import it as modules, which outlive a task: what they load stays loaded.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    path = os.path.join(SparkFiles.getRootDirectory(), f"{os.path.basename(package)}-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for top, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    archive.write(os.path.join(top, name), os.path.relpath(os.path.join(top, name), root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, as the session's ``spark.checkpoint.dir`` names it.

    Only a ``local`` master may go without the setting; it then gets a temporary folder.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
    app = sc.applicationId
    if app not in _test_dirs:
        _test_dirs[app] = tempfile.mkdtemp(prefix="loomset-")
    return _test_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with a table that outlives any executor and can still be
    column-pruned, and pins values (partition numbers, range bounds) that a
    recomputation could change. The shuffle files of the write go with its end, not
    only when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP_KEY, "false")
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash ``df`` by ``keys`` over all shuffle partitions.

    For steps that unfold rows many times over: with the number given, adaptive
    execution does not merge partitions that only look small before they unfold.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def balance(table: DataFrame) -> DataFrame:
    """A freshly read ``table`` dealt out evenly if it has fewer splits than the session has cores.

    For costly work per row on a small file; a table of many splits passes unchanged.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def hot_keys(df: DataFrame, key: str) -> list:
    """The keys of ``df`` with the most rows, at most ``HOT_KEYS``, each over ``HOT_ROWS`` rows.

    Counted with map-side partial sums. Every key with more than 1/256 of all rows is among them.
    """
    counted = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS)
    return [r[0] for r in counted.orderBy(F.desc("n")).limit(HOT_KEYS).collect() if r[0] is not None]


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str, hot: list) -> DataFrame:
    """``left.join(right, key, how)`` with the rows of ``hot`` keys spread over ``SALTS`` parts.

    ``right`` has one row per key, so that only its few hot rows are repeated. The salt is a
    hash of the row, so that a task that is run again deals its rows as before.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    salt = F.when(is_hot, F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return (
        left.withColumn("_salt", salt)
        .join(right.withColumn("_salt", F.explode(salts)), [key, "_salt"], how)
        .drop("_salt")
    )


def small_table(df: DataFrame, max_rows: int, size: Column, max_bytes: int = BROADCAST_BYTES) -> list[Row] | None:
    """The rows of ``df`` if they are at most ``max_rows`` and their ``size`` at most ``max_bytes``, else None.

    The first ``max_rows`` + 1 rows are written before they are measured, so that ``df`` is
    computed once and nothing is fetched that is too large.
    """
    if max_rows <= 0:
        return None
    head = materialise(df.limit(max_rows + 1), "small")
    rows, total = head.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return head.collect() if rows <= max_rows and total <= max_bytes else None
