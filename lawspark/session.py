"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "lawspark", memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks on one machine.

    On a cluster use the session the cluster gives; nothing below is needed
    for correctness. AQE stays on everywhere: it sizes shuffle partitions,
    splits skewed join partitions and picks broadcasts from measured sizes.
    """
    threads = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", threads)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder named in ``spark.checkpoint.dir``.

    Where that is unset, as in tests, the warehouse folder serves, which Spark
    itself needs to be shared.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a small table over all cores by a unique key; leave a large one alone.

    A file of one row group is read by one task, whatever is computed on it.
    The rows are shuffled only if the scan has fewer partitions than the
    cluster has cores, which a large table never has.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings, inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffles_dropped(spark: SparkSession):
    """What is written inside takes its shuffle files along when it ends.

    Otherwise they stay until the driver happens to collect its garbage, so that
    a query of many steps holds the shuffles of all of them at once. No later
    step reads them: each reads what was written.
    """
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``written`` for tables that nothing reads any more at the end: their folders are removed then."""
    made: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = scratch_dir(spark, name)
        made.append(path)
        return _written(df, path)

    try:
        yield keep
    finally:
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared scratch folder and read back.

    For results that several branches of a plan read: they are computed once,
    and a lost executor costs no recomputation of what led to them.
    """
    return _written(df, scratch_dir(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
