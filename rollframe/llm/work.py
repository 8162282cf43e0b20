"""Shared scratch tables of the llm operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from rollframe.session import checkpoint_dir, ship_package


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor does not recompute what came before), gives the
    planner a true size for its broadcast decision, and is visible to every executor.
    ``paths`` gets the table's folder.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    if paths is not None:
        paths.append(path)
    # what the write shuffled is of no use after it: the files go as it ends, not at some garbage collection
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, or with as many underscores behind it as make it none of ``columns`` (which Spark
    compares without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def scratch(spark: SparkSession) -> Iterator:
    """A :func:`written` whose tables are deleted as the block ends: for steps whose last reader
    is a table written after them.  What the block returns must not read them any more."""
    paths: list[str] = []
    try:
        yield lambda df, name: written(df, name, paths)
    finally:
        hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        for p in paths:
            hadoop(p).getFileSystem(conf).delete(hadoop(p), True)
