"""Session defaults and reliable staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the library relies on; a value the cluster already set wins.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # files are big rows: small Arrow batches keep a Python worker's memory flat
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def build_session(master: str | None = None, app_name: str = "clonelens", **conf: str) -> SparkSession:
    """A session with ``conf``, and with the defaults above where nobody set them.

    Settings of a submitted application and of a session that already runs stay.
    """
    running = SparkSession.getActiveSession()
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if running is None:
        given = spark.sparkContext.getConf()
        for key, value in _DEFAULTS.items():
            if not given.contains(key):
                spark.conf.set(key, value)
    return spark


def staging_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: what the cluster names, else a local one.

    A machine-local folder is only ever used with a ``local`` master.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="clonelens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)  # lets Spark ML cut the lineage of its iterations
    return folder


def staged(df: DataFrame, name: str = "stage", folder: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage, evaluates an expensive plan exactly once, survives
    lost executors and lets later readers prune columns.  ``folder`` is the
    session's staging folder unless given; whoever gives one can delete it whole
    when the work is done.  With ``by`` the rows of equal values in those columns lie
    in a folder of their own, and readers that filter by them skip the others.
    """
    spark = df.sparkSession
    path = f"{folder or staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it a query's shuffle files go as soon as the query is done, for loops over large tables.

    Otherwise they stay until the driver collects the plans as garbage, and those of all rounds add up.
    """
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def unstaged(*tables: DataFrame) -> None:
    """Remove staged tables that later staged ones have replaced."""
    for table in tables:
        spark = table.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Below this much input per core a scan has too few splits to keep all cores busy.
_SPLIT_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """Give a costly narrow step one partition per core when the input is too small for that.

    Small files come as a single split; inputs beyond 16 MB per core have enough
    splits of their own and pass through without a shuffle.  The size is the sum
    of the plan's inputs as the optimizer knows them, so nothing runs here.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    inputs = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(inputs.apply(i).stats().sizeInBytes())) for i in range(inputs.size()))
    return df.repartition(cores) if size < cores * _SPLIT_BYTES else df
