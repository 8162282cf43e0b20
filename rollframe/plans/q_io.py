"""Registered source / sink / streaming queries.  Logs are written below
the session's ``spark.checkpoint.dir`` and read back, batch or streaming.

Streaming queries read their log as files, two a micro-batch.  Rows come up to a tenth of the
log's span of event time after later ones, in hashed order, so the operators' lateness is
finite: rows leave them as the watermark passes.  A closing record at the end lets the last ones go."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as TT

from rollframe.operators import callbacks as CB
from rollframe.plans import tables as T
from rollframe.plans.catalog import ROLLOUTS_SQL, TOKENS_SQL, register, r6, with_
from rollframe.sources import io as IO
from rollframe.sources.fanout import write_fan_out
from rollframe.streaming import jobs as S

FILES, PER_BATCH = 6, 2
#: Rows of a log part; a file of the log is so many of them as its rows need.
PART_ROWS = 250_000


def _at(id_):
    """Event time from an id: a second each, from 2000 on."""
    return F.timestamp_seconds(F.lit(946684800) + id_)


def _span(log, time_col):
    """(first, last) event time of a log in seconds, the lateness of its files, and its rows."""
    sec = F.col(time_col).cast("double")
    lo, hi, n = log.agg(F.min(sec), F.max(sec), F.count(F.lit(1))).first()
    lo, hi = lo or 0.0, hi or 0.0
    return lo, hi, float(int((hi - lo) / 10) + 1), n


@register("read_parquet_concat", """SELECT doc_id, NULL AS item_id, text, lang FROM documents
UNION ALL SELECT NULL AS doc_id, item_id, text, NULL AS lang FROM benchmark""")
def q_read_parquet_concat(spark, sf_dir):
    d = IO.read_parquet_concat(spark, [f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet"])
    return d.select("doc_id", "item_id", "text", "lang")


def _log(spark, sf_dir):
    r = T.rollouts(spark, sf_dir)
    return r.select(F.col("uid").cast("string").alias("input"), F.col("pred").alias("output"),
                    "score", "step", F.col("data_source"), F.col("pred").alias("reward_type"),
                    F.col("response_id"), F.col("sample_idx"), F.col("uid"))


@register("read_rollout_log", with_(ROLLOUTS_SQL) + """
SELECT CAST(uid AS VARCHAR) AS input, pred AS output, score, step, data_source, response_id FROM rollouts""")
def q_read_rollout_log(spark, sf_dir):
    path = IO.scratch_path(spark, "rollout-log")
    log = _log(spark, sf_dir).select("input", "output", "score", "step", "data_source", "response_id")
    IO.write_generations_jsonl(log, path)
    extra = TT.StructType([TT.StructField("data_source", TT.StringType()), TT.StructField("response_id", TT.LongType())])
    return IO.read_rollout_log(spark, path, extra=extra)


@register("generations_log_roundtrip", with_(ROLLOUTS_SQL) + """
SELECT CAST(uid AS VARCHAR) AS input, pred AS output, score, step FROM rollouts""")
def q_generations_log_roundtrip(spark, sf_dir):
    path = IO.scratch_path(spark, "generations")
    IO.write_generations_jsonl(_log(spark, sf_dir).select("input", "output", "score", "step"), path)
    return IO.read_rollout_log(spark, path).select("input", "output", "score", "step")


@register("read_shards_if_exist", """SELECT o_orderkey, o_totalprice, 'model' AS shard_model, 'p0' AS shard_prompt,
  CAST(o_orderkey % 3 * 100 AS INTEGER) AS shard_start, 7 AS shard_seed FROM orders""")
def q_read_shards_if_exist(spark, sf_dir):
    path = IO.scratch_path(spark, "shards")
    o = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    starts = [0, 100, 200, 300]  # no shard 300 is written: it is absent, not an error
    for s in starts[:3]:
        IO.write_shard(o.where(F.col("o_orderkey") % 3 == s // 100), path, "model", "p0", s, 7)
    return IO.read_shards_if_exist(spark, path, [("model", "p0", s, 7) for s in starts])


@register("write_parquet_split", """SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM customer""")
def q_write_parquet_split(spark, sf_dir):
    path = IO.scratch_path(spark, "split")
    c = T.table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_custkey") % 10 == 0, "test").otherwise("train").alias("split"))
    IO.write_parquet_split(c, path)
    return spark.read.parquet(path)


@register("write_validation_jsonl", with_(ROLLOUTS_SQL) + """
SELECT CAST(uid AS VARCHAR) AS uid, data_source AS input, pred AS response, score, [pred] AS reward_types, step,
  CASE WHEN response_id % 2 = 0 THEN 'val' ELSE 'test' END AS split FROM rollouts""")
def q_write_validation_jsonl(spark, sf_dir):
    path = IO.scratch_path(spark, "validation")
    r = T.rollouts(spark, sf_dir).select(
        F.col("uid").cast("string").alias("uid"), F.col("data_source").alias("input"), F.col("pred").alias("response"), "score",
        F.array("pred").alias("reward_types"), "step", F.when(F.col("response_id") % 2 == 0, "val").otherwise("test").alias("split"))
    IO.write_validation_jsonl(r, path)
    return IO.read_rollout_log(spark, path, IO.VALIDATION_LOG_SCHEMA)


@register("write_metrics", with_(ROLLOUTS_SQL) + """
SELECT step, 'val' AS split, 'mean_score/' || data_source AS metric, round(avg(score), 6) AS value FROM rollouts GROUP BY step, data_source""")
def q_write_metrics(spark, sf_dir):
    path = IO.scratch_path(spark, "metrics")
    m = T.rollouts(spark, sf_dir).groupBy("step", "data_source").agg(r6(F.avg("score")).alias("value"))
    IO.write_metrics(m.select("step", F.lit("val").alias("split"), F.concat(F.lit("mean_score/"), "data_source").alias("metric"), "value"), path)
    return spark.read.parquet(path).select("step", "split", "metric", "value")


class _Arrivals:
    """A log dealt once by the number of the file that a row comes in: event time plus a delay by
    hash below the lateness.  A file is ``parts`` part files, as many for each number, so that a
    micro-batch takes whole files and tasks share the writing."""

    def __init__(self, spark, log, time_col):
        lo, hi, self.late, n = _span(log, time_col)
        self.log, self.time_col, self.parts = log, time_col, max(1, -(-n // (FILES * PART_ROWS)))
        delay = F.pmod(F.xxhash64(*log.columns), F.lit(int(self.late)))
        number = F.least(F.floor((F.col(time_col).cast("double") - lo + delay) / ((hi - lo + self.late) / FILES)), F.lit(FILES - 1)).cast("int")
        path = IO.scratch_path(spark, "arrivals")
        numbered = log.withColumn("__file", number)
        numbered.write.partitionBy("__file").parquet(path)
        self.numbered = spark.read.schema(numbered.schema).parquet(path)

    def write(self, path, numbers=range(FILES)):
        """Files one after the other: a file source reads them in the order of their times."""
        spark, schema = self.log.sparkSession, self.log.schema
        none = spark.createDataFrame([], schema).coalesce(1)
        for n in numbers:
            self.numbered.where(F.col("__file") == n).drop("__file").repartition(self.parts).write.mode("append").json(path)
            # a part without rows is not written: an empty one takes its place
            there = len(spark.read.schema(schema).json(path).inputFiles())
            for _ in range((n + 1) * self.parts - there):
                none.write.mode("append").json(path)

    def close(self, path, **values):
        S.closing_rows(self.log, self.time_col, **values).coalesce(1).write.mode("append").json(path)

    def stream(self, path):
        return IO.read_rollout_log(self.log.sparkSession, path, self.log.schema, streaming=True, max_files_per_trigger=PER_BATCH * self.parts)


def _stream(spark, log, name, time_col=None, close=None):
    """(``log`` as a stream of JSON files, its lateness in seconds); the closing record comes last."""
    path = IO.scratch_path(spark, name)
    if time_col:
        arrivals = _Arrivals(spark, log, time_col)
        arrivals.write(path)
        arrivals.close(path, **(close or {}))
        return arrivals.stream(path), arrivals.late
    log.repartition(FILES, F.xxhash64(*log.columns)).write.json(path)
    return IO.read_rollout_log(spark, path, log.schema, streaming=True, max_files_per_trigger=PER_BATCH), 0.0


@register("stream_reward_type_share", with_(ROLLOUTS_SQL) + """
SELECT step, data_source, pred AS reward_type, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY step, data_source), 6) AS share FROM rollouts GROUP BY step, data_source, pred""")
def q_stream_reward_type_share(spark, sf_dir):
    stream, _ = _stream(spark, _log(spark, sf_dir).select("step", "data_source", "reward_type"), "rt-log")
    out = S.drain_complete(S.stream_reward_type_share(stream), IO.scratch_path(spark, "rt-out"),
                           IO.scratch_path(spark, "ckpt"), S.reward_type_shares)
    return out.select("step", "data_source", "reward_type", "n", r6("share").alias("share"))


@register("stream_group_filter", with_(ROLLOUTS_SQL) + """
, g AS (SELECT *, CAST(uid AS VARCHAR) || '-' || CAST(sample_idx // 4 AS VARCHAR) AS grp FROM rollouts)
, s AS (SELECT grp, CASE WHEN count(*) < 4 THEN 'incomplete' WHEN min(acc) <> max(acc) THEN 'kept' END AS status FROM g GROUP BY grp)
SELECT response_id, grp, acc, status FROM g JOIN s USING (grp) WHERE status IS NOT NULL""")
def q_stream_group_filter(spark, sf_dir):
    stream, late, span = _groups(spark, sf_dir)
    # a group's rows may be as far apart as the log is long
    out = S.drain(S.stream_group_filter(stream, 4, "grp", "acc", "at", f"{int(late)} seconds", int(span * 1000) + 1000),
                  IO.scratch_path(spark, "grp-out"), IO.scratch_path(spark, "ckpt"))
    return out.where("grp <> 'closing'").select("response_id", "grp", "acc", "status")


def _groups(spark, sf_dir):
    r = T.rollouts(spark, sf_dir).select(
        "response_id", F.concat(F.col("uid").cast("string"), F.lit("-"), (F.col("sample_idx") / 4).cast("bigint").cast("string")).alias("grp"),
        "acc", _at(F.col("response_id")).alias("at"))
    lo, hi, *_ = _span(r, "at")
    return *_stream(spark, r, "grp-log", "at", {"grp": F.lit("closing")}), hi - lo


@register("stream_keep_until_enough", with_(ROLLOUTS_SQL) + """
, g AS (SELECT *, CAST(uid AS VARCHAR) || '-' || CAST(sample_idx // 4 AS VARCHAR) AS grp FROM rollouts)
, s AS (SELECT grp, min(acc) AS lo, max(acc) AS hi FROM g GROUP BY grp HAVING count(*) = 4 AND min(acc) <> max(acc))
SELECT count(*) // 2 AS n_groups, 4 * (count(*) // 2) AS n_rows, true AS all_vary, true AS rounds_in_order FROM s""")
def q_stream_keep_until_enough(spark, sf_dir):
    """Generation until half of the groups that can be kept are: exactly so many come out."""
    stream, late, span = _groups(spark, sf_dir)
    r = T.rollouts(spark, sf_dir).groupBy("uid", (F.col("sample_idx") / 4).cast("bigint").alias("k")).agg(
        F.count("*").alias("n"), F.min("acc").alias("lo"), F.max("acc").alias("hi"))
    target = r.where("n = 4 and lo <> hi").count() // 2
    filtered = S.stream_group_filter(stream, 4, "grp", "acc", "at", f"{int(late)} seconds", int(span * 1000) + 1000)
    kept = S.keep_until_enough(filtered, target, FILES, "grp", IO.scratch_path(spark, "enough"), IO.scratch_path(spark, "ckpt"))
    g = kept.groupBy("grp").agg(F.count("*").alias("n"), (F.min("acc") != F.max("acc")).alias("varies"), F.max("round").alias("round"),
                                F.min("round").alias("first"))
    return g.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.min("varies").alias("all_vary"),
                 F.min(F.col("round") == F.col("first")).alias("rounds_in_order"))


def _attempts(spark, sf_dir):
    return T.table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("value").alias("reward"), _at(F.col("event_id")).alias("at"))


_TOOL_SQL = """
SELECT event_id, user_id, CASE WHEN value > coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0.0)
  THEN 0.0e0 ELSE -0.05e0 END AS tool_reward FROM events"""


def _tool_rewards(stream, late):
    return S.stream_tool_reward(stream, "user_id", "event_id", "reward", "at", late, grace=late)


@register("stream_tool_reward", _TOOL_SQL)
def q_stream_tool_reward(spark, sf_dir):
    stream, late = _stream(spark, _attempts(spark, sf_dir), "tool-log", "at", {"user_id": F.lit(-1)})
    out = S.drain(_tool_rewards(stream, late), IO.scratch_path(spark, "tool-out"), IO.scratch_path(spark, "ckpt"))
    return out.where("user_id >= 0 and status = 'ok'").select("event_id", "user_id", "tool_reward")


@register("resume", _TOOL_SQL)
def q_resume(spark, sf_dir):
    """The tool rewards again, by a query that ends after part of its files and is started anew
    from its checkpoint when the rest has come."""
    arrivals, path = _Arrivals(spark, _attempts(spark, sf_dir), "at"), IO.scratch_path(spark, "resume-log")
    out, ckpt = IO.scratch_path(spark, "resume-out"), IO.scratch_path(spark, "ckpt")

    def run():
        return S.drain(_tool_rewards(arrivals.stream(path), arrivals.late), out, ckpt)

    arrivals.write(path, range(FILES // 2))
    run()
    arrivals.write(path, range(FILES // 2, FILES))
    arrivals.close(path, user_id=F.lit(-1))
    return run().where("user_id >= 0 and status = 'ok'").select("event_id", "user_id", "tool_reward")


@register("stream_adaptive_kl", with_(TOKENS_SQL) + """
, RECURSIVE_STEPS AS (SELECT uid AS run, response_id AS step,
    abs(list_sum(list_transform(list_zip(log_probs, ref_log_probs), lambda e: e[1] - e[2]))) AS kl,
    row_number() OVER (PARTITION BY uid ORDER BY response_id) AS i FROM tokens)
, f AS (SELECT *, 1 + least(greatest(kl / 0.1 - 1, -0.2), 0.2) * 4 / 1000 AS m FROM RECURSIVE_STEPS)
SELECT run, step, round(0.2 * coalesce(exp(sum(ln(m)) OVER (PARTITION BY run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0), 6) AS kl_coef
FROM f""")
def q_stream_adaptive_kl(spark, sf_dir):
    t = T.tokens(spark, sf_dir)
    kl = F.abs(F.aggregate(F.zip_with("log_probs", "ref_log_probs", lambda a, b: a - b), F.lit(0.0), lambda s, x: s + x))
    steps = t.select(F.col("uid").alias("run"), F.col("response_id").alias("step"), kl.alias("kl"), F.lit(4).alias("n_steps"),
                     _at(F.col("response_id")).alias("at"))
    stream, late = _stream(spark, steps, "kl-log", "at", {"run": F.lit(-1)})
    out = S.drain(S.stream_adaptive_kl(stream, 0.2, 0.1, 1000, "at", late, grace=late), IO.scratch_path(spark, "kl-out"),
                  IO.scratch_path(spark, "ckpt"))
    return out.where("run >= 0 and status = 'ok'").select("run", "step", r6("kl_coef").alias("kl_coef"))


@register("scoring timeout", """
SELECT event_id, CASE WHEN hit THEN value ELSE 0.0e0 END AS score, CASE WHEN hit THEN 'Correct' ELSE 'TimeoutError' END AS reward_type
FROM (SELECT *, event_id % 3 <> 0 AND event_id % 500 <= 360 AS hit FROM events)""")
def q_scoring_timeout(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events")
    at = _at(F.col("event_id"))
    asked = ev.select("event_id", at.alias("at"))
    # a third of the answers never come, and some come too late
    given = ev.where(F.col("event_id") % 3 != 0).select(
        F.col("event_id").alias("event_id_result"), _at(F.col("event_id") + F.col("event_id") % 500).alias("at_result"),
        F.col("value").alias("score"), F.lit("Correct").alias("reward_type"))
    requests, a = _stream(spark, asked, "asked", "at", {"event_id": F.lit(-1)})
    results, b = _stream(spark, given, "given", "at_result", {"event_id_result": F.lit(-2)})
    out = S.drain(S.scoring_with_timeout(requests, results, "event_id", "at", watermark=f"{int(max(a, b) + 1000)} seconds"), IO.scratch_path(spark, "scored"),
                  IO.scratch_path(spark, "ckpt"))
    return out.where("event_id >= 0").select("event_id", "score", "reward_type")


@register("write_fan_out", with_(ROLLOUTS_SQL) + """
, m AS (SELECT step, 'mean_score/' || data_source AS metric, round(avg(score), 6) AS value FROM rollouts GROUP BY step, data_source)
SELECT unnest(['csv', 'jsonl', 'parquet']) AS back_end, step, metric, value FROM m""")
def q_write_fan_out(spark, sf_dir):
    """Metric rows to three back ends in one pass, read back from each."""
    path = IO.scratch_path(spark, "fanout").removeprefix("file:")
    m = T.rollouts(spark, sf_dir).groupBy("step", "data_source").agg(r6(F.avg("score")).alias("value"))
    m = m.select("step", F.concat(F.lit("mean_score/"), "data_source").alias("metric"), "value")
    write_fan_out(m, [(f, f"{path}/{f}") for f in ("parquet", "jsonl", "csv")])
    schema = m.schema
    back = [spark.read.parquet(f"{path}/parquet"), spark.read.schema(schema).json(f"{path}/jsonl"),
            spark.read.schema(schema).option("header", True).csv(f"{path}/csv")]
    back = [b.select(F.lit(n).alias("back_end"), *schema.names) for n, b in zip(("parquet", "jsonl", "csv"), back)]
    return back[0].unionByName(back[1]).unionByName(back[2])


@register("metric_callbacks", with_(ROLLOUTS_SQL) + """
SELECT 'lengths' AS callback, 'longest' AS metric, round(CAST(max(length(pred)) AS DOUBLE), 6) AS value FROM rollouts
UNION ALL SELECT 'scores', 'mean', round(avg(score), 6) FROM rollouts
UNION ALL SELECT 'scores', 'best', round(max(score), 6) FROM rollouts
UNION ALL SELECT 'types', 'share_1', round(avg(CASE WHEN pred = '1' THEN 1.0e0 ELSE 0.0e0 END), 6) FROM rollouts""")
def q_metric_callbacks(spark, sf_dir):
    """Three callbacks over one write of the batch, their metrics logged by them; a fourth, for a
    column that the batch lacks, does not run."""
    batch = T.rollouts(spark, sf_dir).select("uid", "pred", "score")
    rows = []

    def log(name):
        return lambda step, split, values: rows.extend((name, k, float(v)) for k, v in values.items())

    path = IO.scratch_path(spark, "batch")
    CB.write_with_callbacks(batch, lambda d: d.write.parquet(path), [
        CB.MetricCallback("scores", {"mean": F.avg("score"), "best": F.max("score")}, log("scores"), ("score",)),
        CB.MetricCallback("lengths", {"longest": F.max(F.length("pred"))}, log("lengths"), ("pred",)),
        CB.MetricCallback("types", {f"share_{k}": v for k, v in CB.class_counts("pred", ["1"]).items()}, log("types"), ("pred",)),
        CB.MetricCallback("missing", {"n": F.count("reward_types")}, log("missing"), ("reward_types",))], step=3)
    return spark.createDataFrame(rows, "callback string, metric string, value double").select("callback", "metric", r6("value").alias("value"))


@register("transform_records", """SELECT conv_id, role || ': ' || length(text) AS line FROM conversations WHERE role <> 'system'
UNION ALL SELECT conv_id, 'system' AS line FROM conversations WHERE role = 'system'
UNION ALL SELECT conv_id, 'again' AS line FROM conversations WHERE role = 'system'""")
def q_transform_records(spark, sf_dir):
    """A user's record transform that gives one or two records for each."""
    def lines(record, mark):
        if record["role"] == "system":
            return [{"conv_id": record["conv_id"], "line": x} for x in ("system", mark)]
        return {"conv_id": record["conv_id"], "line": f"{record['role']}: {len(record['text'])}"}

    return CB.transform_records(T.table(spark, sf_dir, "conversations"), lines, "conv_id bigint, line string", mark="again")


@register("write_generations_jsonl", with_(ROLLOUTS_SQL) + """
SELECT step, count(*) AS n, round(sum(score), 6) AS total, count(DISTINCT data_source) AS sources FROM rollouts WHERE step >= 3 GROUP BY step""")
def q_write_generations_jsonl(spark, sf_dir):
    """The generations log, appended step by step in two writes and read from one step on: the
    step is a folder, so earlier ones are not opened."""
    path = IO.scratch_path(spark, "generations")
    log = _log(spark, sf_dir).select("input", "output", "score", "step", "data_source")
    IO.write_generations_jsonl(log.where("step % 2 = 0"), path)
    IO.write_generations_jsonl(log.where("step % 2 = 1"), path)
    back = IO.read_rollout_log(spark, path, extra=TT.StructType([TT.StructField("data_source", TT.StringType())]))
    return back.where("step >= 3").groupBy("step").agg(F.count("*").alias("n"), r6(F.sum("score")).alias("total"),
                                                      F.countDistinct("data_source").alias("sources"))
