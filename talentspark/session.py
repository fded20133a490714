"""Session settings and the shared scratch folder."""

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20  # of an Arrow batch
# Parquet looks at sizes every 100 rows at first, which are a page of 40 MB where a row is a block of arrays; a reader
# takes a page in one piece, out of the heap, and a row group's values in one array
BLOCK_TABLE = {
    "parquet.page.size": 1 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 8,
    "parquet.block.size": 2 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 8,
    "parquet.enable.dictionary": "false",
}


def local_session(cores: int | str = 8, app: str = "talentspark") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset (local runs and tests) one is made on this machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "talentspark-scratch")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute a small result once and keep it as a reliable checkpoint; lost executors do not undo it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def settle_table(df: DataFrame, name: str, **options) -> DataFrame:
    """The same for large results: a parquet table in the shared folder, so that each reader
    takes only the columns it needs. Old tables are the owner's of that folder to expire."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, Spark deletes the shuffle files of a query when it ends, not when the driver's garbage happens to be collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core before heavy per-row work.

    A small file with a single row group is read by one task; a large table already has
    more partitions than cores and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of an Arrow batch, unless they are low already: texts can be long, and
    each batch is held several times by an executor and its Python process."""
    rows, size = (f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes"))
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set(size, f"{BATCH_BYTES}b")
