"""Structured Streaming twins of the batch operators over the JSONL rollout logs.

Each job returns a streaming DataFrame.  Stateful jobs keep state per bucket of groups (a call
and a state row per group would cost more than the rows) and act on
it in event-time order: rows wait in state until the watermark has passed them, so neither the
order of files nor the cut into micro-batches or Arrow chunks changes a result.  State lives
in the query's ``checkpointLocation``; a restart with the same location resumes.  Results go
to a file sink below the shared checkpoint folder, never to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rollframe.operators.indexing import with_row_index
from rollframe.session import ship_package

#: Event time of a closing record: a source that has ended sends one, so that the watermark
#: passes every real row.
CLOSING_TIME = "2200-01-01 00:00:00"


def stream_reward_type_share(events: DataFrame, class_col: str = "reward_type", step_col: str = "step",
                             source_col: str = "data_source") -> DataFrame:
    """Running counts per (step, source, class), for a complete-mode sink with
    :func:`reward_type_shares` as its view."""
    return events.groupBy(step_col, source_col, class_col).agg(F.count(F.lit(1)).alias("n"))


def reward_type_shares(counts: DataFrame, step_col: str = "step", source_col: str = "data_source") -> DataFrame:
    """``share`` of each count in its (step, source) total."""
    total = counts.groupBy(step_col, source_col).agg(F.sum("n").alias("__all"))
    return counts.join(total, [step_col, source_col]).withColumn("share", F.col("n") / F.col("__all")).drop("__all")


def stream_reward_type_share_windowed(events: DataFrame, ts_col: str, window: str, watermark: str,
                                      class_col: str = "reward_type") -> DataFrame:
    """Event-time variant: tumbling windows with a watermark for late rows."""
    return (events.withWatermark(ts_col, watermark)
            .groupBy(F.window(ts_col, window), class_col).agg(F.count(F.lit(1)).alias("n")))


def _millis(ts: pd.Series) -> pd.Series:
    return (ts.astype("datetime64[ns]").astype("int64") // 1_000_000).astype("int64")


def _plain(values: list) -> list:
    """Python values (no numpy scalars; missing as None)."""
    return [None if v is None or (isinstance(v, float) and v != v) else v.item() if hasattr(v, "item") else v for v in values]


#: Buckets of keys that share one call and one state row.
BUCKETS = 1024


def _bucketed(rows: DataFrame, key_col: str, buckets: int) -> DataFrame:
    """Rows with the bucket of their key; a null key has one of its own, so that the others'
    columns hold no nulls and keep their type in pandas."""
    return rows.withColumn("__bucket", F.when(F.col(key_col).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key_col), F.lit(buckets))))


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False).replace_schema_metadata()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas(integer_object_nulls=True)


def _arrived(pdfs: Iterator[pd.DataFrame], time_col: str, names: list[str]) -> pd.DataFrame:
    """The rows of a call in arrival order, with ``__at`` in milliseconds."""
    rows = _appended(*pdfs)
    return rows[names].assign(__at=_millis(rows[time_col])) if len(rows) else pd.DataFrame(columns=[*names, "__at"])


def _appended(*frames: pd.DataFrame) -> pd.DataFrame:
    """One frame; those without rows have no say in its types."""
    there = [f for f in frames if len(f)] or list(frames[:1]) or [pd.DataFrame()]
    return pd.concat(there, ignore_index=True)


def _codes(*keys: pd.Series) -> tuple[list[np.ndarray], pd.Series]:
    """Each series as numbers of its values, and the values; missing ones count as one value."""
    codes, values = pd.factorize(pd.concat([k for k in keys if len(k)], ignore_index=True), use_na_sentinel=False)
    return np.split(codes, np.cumsum([len(k) for k in keys])[:-1]), pd.Series(values)


def stream_group_filter(responses: DataFrame, n_per_group: int, group_col: str, metric_col: str, time_col: str,
                        watermark: str, wait_ms: int, buckets: int = BUCKETS) -> DataFrame:
    """Hold a group's responses until ``n_per_group`` have arrived; emit them with ``status``
    ``kept`` if the metric varies (or the group is one trajectory), else nothing.  Null and NaN
    metrics are no values: they are left out of the comparison, as in the batch filter.

    A group that is still short ``wait_ms`` of event time after its latest row comes out with
    ``status`` ``incomplete``, so no group stays in state for ever and none is lost unseen.  For
    as long, a decided group is remembered, without its rows: what still comes of it has
    ``status`` ``extra``, also from the micro-batch that completed it.

    Groups are dealt to ``buckets`` by hash; a bucket's groups share a state row, two Arrow
    tables: held rows, and groups with the time at which they leave."""
    ship_package(responses.sparkSession)
    names = [f.name for f in responses.schema.fields if f.name not in (group_col, time_col)]
    out = T.StructType([responses.schema[group_col], *[responses.schema[n] for n in names], T.StructField("status", T.StringType())])
    group_cols = [group_col, "__until", "__timeout", "__decided"]

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, groups = map(_unpacked, state.get) if state.exists else (pd.DataFrame(columns=[group_col, *names]), pd.DataFrame(columns=group_cols))
        mark = state.getCurrentWatermarkMs()
        new = _arrived(pdfs, time_col, [group_col, *names]).sort_values("__at", kind="stable")
        (of_group, of_held, of_new), values = _codes(groups[group_col], held[group_col], new[group_col])
        n = len(values)

        # what is known of each group, by its number
        until, timeout = np.zeros(n, "int64"), np.zeros(n, "int64")
        decided, here = np.zeros(n, bool), np.zeros(n, bool)
        until[of_group], timeout[of_group], decided[of_group] = groups["__until"], groups["__timeout"], groups["__decided"]
        here[of_new] = True
        np.maximum.at(until, of_new, new["__at"].to_numpy("int64") + wait_ms)
        timeout[here] = np.maximum(until[here], mark + 1)
        gone = ~here & (timeout < mark)

        # the first n_per_group rows of a group that is not decided are its own, others are extra
        rows, of_row = _appended(held, new.drop(columns="__at")), np.concatenate([of_held, of_new])
        extra = decided[of_row] | (pd.Series(of_row).groupby(of_row).cumcount().to_numpy() >= n_per_group)
        full = ~decided & (np.bincount(of_row, minlength=n) >= n_per_group)
        varies = np.full(n, n_per_group == 1)
        counts = ~extra & full[of_row] & rows[metric_col].notna().to_numpy()
        if counts.any():
            metric = rows.loc[counts, metric_col].groupby(of_row[counts])
            lo, hi = metric.min(), metric.max()
            varies[lo.index] |= (lo != hi).to_numpy()

        status = np.select([extra, (full & varies)[of_row], (gone & ~decided)[of_row]], ["extra", "kept", "incomplete"], "")
        leaves = status != ""
        if leaves.any():
            yield rows[leaves].assign(status=status[leaves])
        if gone.all():
            state.remove()
            return
        stay = pd.DataFrame(dict(zip(group_cols, (values, until, timeout, decided | full))))[~gone]
        state.update((_packed(rows[~leaves & ~full[of_row]]), _packed(stay)))
        state.setTimeoutTimestamp(max(int(stay["__timeout"].min()), mark + 1))

    return _bucketed(responses.withWatermark(time_col, watermark), group_col, buckets).groupBy("__bucket").applyInPandasWithState(
        fn, outputStructType=out, stateStructType="held binary, groups binary", outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout)


def keep_until_enough(filtered: DataFrame, target: int, max_rounds: int, group_col: str, path: str, checkpoint: str) -> DataFrame:
    """Dynamic sampling: rounds of generation (micro-batches) until ``target`` groups are kept.

    ``filtered`` is :func:`stream_group_filter`.  Each round that keeps groups writes them to a
    folder of its own below ``path``, in round order and by group within a round; the last one
    writes only as many as are still missing.  The number kept so far is read from the rounds
    before, so a round that is run again after a failure writes the same again.  Once ``target``
    is reached the query is stopped and what the source still has is not asked for.

    Raises RuntimeError if ``max_rounds`` rounds (0: any number) or the whole source give fewer.
    Returns the kept rows with their ``round``: exactly ``target`` groups."""
    spark = filtered.sparkSession
    schema = T.StructType([*[f for f in filtered.schema.fields if f.name != "status"], T.StructField("round", T.LongType())])
    state = {"have": 0, "rounds": 0}

    def so_far(before: int) -> int:
        folders = [f"{path}/round-{r}" for r in range(before)]
        there = [f for f in folders if _exists(spark, f)]
        return spark.read.schema(schema).parquet(*there).select(group_col).distinct().count() if there else 0

    def write(batch: DataFrame, batch_id: int) -> None:
        have = so_far(batch_id)
        # a micro-batch that starts before the query is stopped is no further round
        state["have"], state["rounds"] = have, min(batch_id, max_rounds or batch_id)
        if have >= target or (max_rounds and batch_id >= max_rounds):
            batch.write.format("noop").mode("overwrite").save()  # the engine wants its state committed
            return
        kept = batch.where("status = 'kept'").drop("status").withColumn("round", F.lit(batch_id).cast("long"))
        # a micro-batch with state must be computed once
        kept.select(*schema.names).write.mode("overwrite").parquet(f"{path}/kept-{batch_id}")
        kept = spark.read.schema(schema).parquet(f"{path}/kept-{batch_id}").where(F.col(group_col).isNotNull())
        groups = kept.select(group_col).distinct()
        if have + groups.count() > target:
            # more than are missing: the first of them by a distributed ranking, since a sort with a
            # limit passes all that are missing through one task
            chosen = with_row_index(groups, group_col, "__place").where(F.col("__place") < target - have)
            kept = kept.join(chosen.select(group_col), group_col)
        kept.select(*schema.names).write.mode("overwrite").parquet(f"{path}/round-{batch_id}")
        state["have"], state["rounds"] = so_far(batch_id + 1), batch_id + 1

    q = (filtered.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    while q.isActive and state["have"] < target and not (max_rounds and state["rounds"] >= max_rounds):
        q.awaitTermination(0.05)  # far less than a micro-batch: the next one must not be committed
    q.stop()
    if q.exception():
        raise q.exception()
    have = so_far(state["rounds"])
    if have < target:
        raise RuntimeError(f"{have} of {target} groups kept after {state['rounds']} rounds of generation")
    return spark.read.schema(schema).parquet(*[f for f in (f"{path}/round-{r}" for r in range(state["rounds"])) if _exists(spark, f)])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _ordered_scan(rows: DataFrame, key_col: str, order_col: str, value_cols: list[str], time_col: str, lateness: float,
                  grace: float, start: float, step: Callable[[float, tuple], tuple[float, float]], out_col: str,
                  buckets: int = BUCKETS) -> DataFrame:
    """Per key, ``carry, out = step(carry, values)`` over rows in (event time, order) order.

    Rows wait in state, as Arrow tables, until the latest event time is ``lateness`` seconds past
    them; then they leave, so a key holds the rows of that span and its carry.  A row that comes
    later than that has missed its turn: it comes out at once with ``status`` ``late`` and no
    value, if by no more than ``grace`` seconds; later still it is dropped by the engine and counted
    in the query's progress (``numRowsDroppedByWatermark``).  All others have ``status`` ``ok``.

    Keys are dealt to ``buckets`` by hash; a bucket's keys share a state row."""
    ship_package(rows.sparkSession)
    out = T.StructType([rows.schema[key_col], rows.schema[order_col], T.StructField(out_col, T.DoubleType()),
                        T.StructField("status", T.StringType())])
    names = list(dict.fromkeys([key_col, order_col, *value_cols]))
    grace_ms = int(grace * 1000)

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, carries = map(_unpacked, state.get) if state.exists else (pd.DataFrame(columns=[*names, "__at"]), pd.DataFrame(columns=[key_col, "__carry"]))
        mark = state.getCurrentWatermarkMs()
        passed = mark + grace_ms if mark > 0 else -1
        new = _arrived(pdfs, time_col, names)
        (of_carry, of_waiting, of_new), values = _codes(carries[key_col], waiting[key_col], new[key_col])
        late = (new["__at"] <= passed).to_numpy(bool)
        if late.any():
            yield new.loc[late, [key_col, order_col]].assign(**{out_col: float("nan"), "status": "late"})
        waiting = _appended(waiting, new[~late]).assign(__key=np.concatenate([of_waiting, of_new[~late]]))
        leaves = (waiting["__at"] <= passed).to_numpy(bool)
        carry = np.full(len(values), start)
        carry[of_carry] = carries["__carry"]
        if leaves.any():
            ready = waiting[leaves].sort_values(["__at", order_col], kind="stable")
            last, done = carry.tolist(), []
            for k, *v in zip(ready["__key"].tolist(), *[_plain(ready[c].tolist()) for c in value_cols]):
                last[k], value = step(last[k], v)
                done.append(value)
            carry = np.array(last, "float64")
            yield ready[[key_col, order_col]].assign(**{out_col: done, "status": "ok"})
        rest = waiting[~leaves].drop(columns="__key")
        state.update((_packed(rest), _packed(pd.DataFrame({key_col: values, "__carry": carry}))))
        if len(rest):
            state.setTimeoutTimestamp(max(int(rest["__at"].min()) - grace_ms, mark + 1))

    delay = f"{int((lateness + grace) * 1000)} milliseconds"
    return _bucketed(rows.withWatermark(time_col, delay), key_col, buckets).groupBy("__bucket").applyInPandasWithState(
        fn, outputStructType=out, stateStructType="waiting binary, carries binary", outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout)


def stream_tool_reward(attempts: DataFrame, instance_col: str, attempt_col: str, reward_col: str, time_col: str,
                       lateness: float, grace: float = 0.0) -> DataFrame:
    """Per instance, the tool penalty of each attempt: 0.0 when the reward improved on the
    previous attempt (0.0 before the first), else -0.05.  Order, lateness and ``status`` as in
    :func:`_ordered_scan`; a null reward improves on nothing and is passed over by the next one."""
    def step(last: float, v: tuple) -> tuple[float, float]:
        return (last, -0.05) if v[0] is None else (v[0], 0.0 if v[0] > last else -0.05)

    return _ordered_scan(attempts, instance_col, attempt_col, [reward_col], time_col, lateness, grace, 0.0, step, "tool_reward")


def stream_adaptive_kl(step_kl: DataFrame, init_coef: float, target: float, horizon: int, time_col: str, lateness: float,
                       grace: float = 0.0, run_col: str = "run", step_col: str = "step", kl_col: str = "kl",
                       n_col: str = "n_steps") -> DataFrame:
    """Adaptive KL coefficient per run: the coefficient used at each step, updated after it by
    ``beta *= 1 + clip(kl/target - 1, +-0.2) * n/horizon``; a step without a KL value leaves it
    as it is.  Order, lateness and ``status`` as in :func:`_ordered_scan`."""
    def step(beta: float, v: tuple) -> tuple[float, float]:
        if v[0] is None or v[1] is None:
            return beta, beta
        err = min(max(v[0] / target - 1, -0.2), 0.2)
        return beta * (1 + err * v[1] / horizon), beta

    return _ordered_scan(step_kl, run_col, step_col, [kl_col, n_col], time_col, lateness, grace, float(init_coef), step, "kl_coef")


def scoring_with_timeout(requests: DataFrame, results: DataFrame, key: str, ts_col: str,
                         timeout: str = "360 seconds", watermark: str | None = None) -> DataFrame:
    """Stream-stream left outer join of scoring requests and results within ``timeout``
    of event time, rows of either side up to ``watermark`` late (``timeout`` if not given);
    unmatched requests come out (after the watermark passes) with score 0.0
    and the ``TimeoutError`` label."""
    req = requests.withWatermark(ts_col, watermark or timeout).alias("q")
    res = results.withWatermark(f"{ts_col}_result", watermark or timeout).alias("r")
    cond = (F.col(f"q.{key}") == F.col(f"r.{key}_result")) & (
        F.col(f"r.{ts_col}_result").between(F.col(f"q.{ts_col}"), F.col(f"q.{ts_col}") + F.expr(f"INTERVAL {timeout}")))
    j = req.join(res, cond, "leftOuter")
    return j.select("q.*", F.coalesce(F.col("r.score"), F.lit(0.0)).alias("score"),
                    F.when(F.col(f"r.{key}_result").isNull(), F.lit("TimeoutError"))
                    .otherwise(F.coalesce(F.col("r.reward_type"), F.lit("Correct"))).alias("reward_type"))


def closing_rows(like: DataFrame, time_col: str, **values: Column) -> DataFrame:
    """One record at the closing time, other columns null but for ``values``."""
    spark = like.sparkSession
    cols = [(F.lit(CLOSING_TIME).cast("timestamp") if f.name == time_col else values.get(f.name, F.lit(None)))
            .cast(f.dataType).alias(f.name) for f in like.schema.fields]
    return spark.range(1).select(*cols)


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an append-mode query over what its source has now, into parquet at ``path``; the
    table written so far."""
    q = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drain_complete(stream: DataFrame, path: str, checkpoint: str,
                   view: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """The same for a complete-mode aggregate: each micro-batch writes ``view`` of its result
    as parquet of its own, and the latest one is read."""
    last: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        view(batch).write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")
        last.append(batch_id)

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination()
    if not last:
        return view(stream.sparkSession.createDataFrame([], stream.schema))
    return stream.sparkSession.read.parquet(f"{path}/batch-{last[-1]}")
