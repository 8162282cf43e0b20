"""Scans and sinks: parquet concat, shard discovery by file name, partitioned JSONL
rollout / validation logs and the metrics table.  Scratch output goes below the shared
``spark.checkpoint.dir`` (never a machine-local folder on a cluster)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollframe.session import checkpoint_dir

ROLLOUT_LOG_SCHEMA = T.StructType([
    T.StructField("input", T.StringType()), T.StructField("output", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("step", T.IntegerType()),
])
VALIDATION_LOG_SCHEMA = T.StructType([
    T.StructField("uid", T.StringType()), T.StructField("input", T.StringType()),
    T.StructField("response", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("reward_types", T.ArrayType(T.StringType())),
    T.StructField("split", T.StringType()), T.StructField("step", T.IntegerType()),
])


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/rollframe-{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and read it back: what follows
    neither recomputes it nor depends on its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_parquet_concat(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Read several parquet tables as one, columns matched by name, missing ones NULL.  Each
    table's schema comes from one of its files; no footers are merged."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in paths])


SHARD_NAME = r"(?<model>[^/]+)_(?<prompt>[^_/]+)_(?<start>\d+)_(?<seed>\d+)\.parquet"


def shard_path(folder: str, model: str, prompt: str, start: int, seed: int) -> str:
    return f"{folder}/{model}_{prompt}_{start}_{seed}.parquet"


def write_shard(df: DataFrame, folder: str, model: str, prompt: str, start: int, seed: int) -> None:
    """One shard, under the name that :func:`read_shards_if_exist` looks for."""
    df.write.mode("overwrite").parquet(shard_path(folder, model, prompt, start, seed))


def read_shards_if_exist(spark: SparkSession, folder: str, shards: list[tuple[str, str, int, int]]) -> DataFrame:
    """One scan over those of the ``{model}_{prompt}_{start}_{seed}.parquet`` shards that exist;
    the shard fields come from the path.  Raises if none does."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [shard_path(folder, *s) for s in shards]
    paths = [p for p in paths if hadoop(p).getFileSystem(conf).exists(hadoop(p))]
    if not paths:
        raise FileNotFoundError(f"none of {len(shards)} shards is in {folder}")
    name = F.input_file_name()
    return spark.read.parquet(*paths).withColumns({
        "shard_model": F.regexp_extract(name, SHARD_NAME, 1),
        "shard_prompt": F.regexp_extract(name, SHARD_NAME, 2),
        "shard_start": F.regexp_extract(name, SHARD_NAME, 3).cast("int"),
        "shard_seed": F.regexp_extract(name, SHARD_NAME, 4).cast("int"),
    })


def write_parquet_split(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """One parquet directory per split (``split=train/``...), pruned on read."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)


def write_generations_jsonl(df: DataFrame, path: str, step_col: str = "step", mode: str = "append") -> None:
    """Per-step JSONL of input / output / score (+ extra columns), partitioned by step."""
    df.write.mode(mode).partitionBy(step_col).json(path)


def write_validation_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """Validation log (uid, input, response, score, reward_types) partitioned by split and step."""
    df.write.mode(mode).partitionBy("split", "step").json(path)


def read_rollout_log(spark: SparkSession, path: str, schema: T.StructType = ROLLOUT_LOG_SCHEMA,
                     streaming: bool = False, max_files_per_trigger: int | None = None,
                     extra: T.StructType | None = None) -> DataFrame:
    """Inverse scan of the JSONL logs, batch or streaming, with an explicit schema; ``extra``
    names the further columns that the log's writer put in.  A batch scan without it finds them
    in the files, after the columns of ``schema``."""
    if extra is None and not streaming and schema is ROLLOUT_LOG_SCHEMA:
        found = spark.read.json(path).schema
        extra = T.StructType([f for f in found.fields if f.name not in schema.names])
    if extra is not None:
        schema = T.StructType([*schema.fields, *[f for f in extra.fields if f.name not in schema.names]])
    if streaming:
        r = spark.readStream.schema(schema)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        return r.json(path)
    return spark.read.schema(schema).json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Append ``(step, split, metric, value)`` rows to the metrics table."""
    metrics.select("step", "split", "metric", F.col("value").cast("double")).write.mode("append").partitionBy("step").parquet(path)
