"""Session helpers: building a local session, reading tables, cutting lineage on shared storage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is read from ``spark.checkpoint.dir``.  Only a local master, whose executors are
    threads of this process, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"quillspark-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


class Cut:
    """Tables written to the shared folder to cut lineage.

    Tables that are no longer read are dropped by ``release`` or ``only``, the others by ``drop`` or at exit.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quillspark-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[tuple[DataFrame, str]] = []
        atexit.register(self.drop)

    def __call__(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        path = self.path()
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        # what the write has shuffled is read by nothing else; it would stay until the driver collects its garbage
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            writer.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before) if before is not None else self.spark.conf.unset(CLEANUP)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def release(self, *tables: DataFrame) -> None:
        """Deletes tables that no plan to be run reads any more."""
        for held, path in [t for t in self.tables if any(t[0] is x for x in tables)]:
            delete(self.spark, path)
            self.tables.remove((held, path))

    def only(self, *results: DataFrame) -> tuple[DataFrame, ...]:
        """Writes the results and deletes every other table."""
        kept = tuple(r if any(r is t for t, _ in self.tables) else self(r) for r in results)
        self.release(*[t for t, _ in self.tables if not any(t is k for k in kept)])
        return kept

    def drop(self) -> None:
        delete(self.spark, self.root)
        self.tables.clear()
