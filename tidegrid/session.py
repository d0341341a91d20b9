"""Session settings and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_scratch: str | None = None  # of a local session without a configured folder
_scopes = threading.local()


def build_session(app: str = "tidegrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local path would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
    global _scratch
    _scratch = _scratch or tempfile.mkdtemp(prefix="tidegrid-")
    return _scratch


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there.

    Used where one frame feeds several jobs, so that neither the work nor a
    lost executor makes Spark recompute the whole lineage.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def scratch_scope() -> Iterator[None]:
    """Remove the tables that are written inside, but for those written with ``keep``, when the block ends.

    For work whose result is a written table: what led to it is not read again.
    Tables kept in an inner block belong to the block around it.
    """
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for spark, path, name in stack.pop():
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _noted(spark: SparkSession, path: str, name: str | None, keep: bool) -> None:
    stack = _scopes.__dict__.get("stack", [])
    at = len(stack) - (2 if keep else 1)
    if at >= 0:
        stack[at].append((spark, path, name))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside send at most ``rows`` rows at a time to Python.

    For rows that hold whole texts: a batch, of 10,000 rows by default, lies in
    the executor and in its Python worker at once.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, partition_by: tuple[str, ...] = (), keep: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    For a frame that many jobs read in part: each job then reads only the
    columns and partitions it needs. ``keep``: outlives the ``scratch_scope``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidegrid-{uuid.uuid4().hex}"
    _noted(spark, path, None, keep)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def written_buckets(df: DataFrame, column: str, buckets: int, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in buckets of ``column`` in the shared folder and read it back.

    For a frame that is joined by one column several times: joins on it need no
    further shuffle of this side. ``df`` should be partitioned by the column
    already, or every task writes a file per bucket.
    """
    spark = df.sparkSession
    name = f"tidegrid_{uuid.uuid4().hex}"
    _noted(spark, f"{shared_dir(spark)}/{name}", name, False)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.bucketBy(buckets, column).option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name).select(*df.columns)
