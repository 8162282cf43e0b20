"""Streaming operators: bounded state, late rows, groups in rounds."""

import datetime as dt

import pytest

from rollframe.streaming import jobs as S


def feed(spark, tmp_path, rows, schema, per_file):
    """Rows in files of ``per_file``, read one file a micro-batch, in order."""
    d = str(tmp_path / "in")
    for i in range(0, len(rows), per_file):
        spark.createDataFrame(rows[i:i + per_file], schema).coalesce(1).write.mode("append").json(d)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(d)


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


TOOL = "k string, i bigint, r double, at timestamp"


def started(stream, tmp_path):
    q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def test_rows_leave_before_the_source_ends_and_late_ones_are_labelled(spark, tmp_path):
    rows = [("a", i, float(i % 5), at(10 * i)) for i in range(40)]
    rows[20], rows[23] = rows[23], rows[20]  # 30 seconds out of order: within the lateness
    late = ("a", 100, 9.0, at(150))          # 250 seconds late: past its turn, within the grace
    gone = ("a", 101, 9.0, at(-5000))        # beyond both
    rows = [*rows, late, gone, ("a", 102, None, at(400)), ("b", 0, 1.0, at(410))]
    q = started(S.stream_tool_reward(feed(spark, tmp_path, rows, TOOL, 4), "k", "i", "r", "at", 40, grace=400), tmp_path)
    got = {(r["k"], r["i"]): (r["tool_reward"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["a", 100] == (None, "late") and ("a", 101) not in got
    # no closing record: rows before the last event time less the lateness are out, later ones wait
    out = {i for k, i in got if k == "a" and i < 100}
    assert set(range(36)) <= out and 102 not in out and ("b", 0) not in got
    last = 0.0
    for i in sorted(out):
        assert got["a", i] == (0.0 if i % 5 > last else -0.05, "ok")
        last = float(i % 5)
    assert sum(s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators) == 1


def test_state_holds_the_lateness_only(spark, tmp_path, monkeypatch):
    rows = [("a", i, float(i % 3), at(i)) for i in range(600)]
    stream = S.stream_tool_reward(feed(spark, tmp_path, rows, TOOL, 50), "k", "i", "r", "at", 20)
    q = started(stream, tmp_path)
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 570
    # one key: its state is the rows of the lateness and of a file, not the 600 rows
    sizes = [s.memoryUsedBytes for p in q.recentProgress for s in p.stateOperators]
    assert max(sizes) < 60_000


GROUP = "g string, m double, i bigint, at timestamp"


def test_groups_of_missing_metrics_and_extra_rows(spark, tmp_path):
    nan = float("nan")
    rows = [("vary", 1.0, 0, at(0)), ("vary", 0.0, 1, at(1)), ("none", None, 2, at(2)), ("none", None, 3, at(3)),
            ("some", None, 4, at(4)), ("some", 1.0, 5, at(5)), ("flat", 1.0, 6, at(6)), ("flat", 1.0, 7, at(7)),
            ("mixed", 1.0, 8, at(8)), ("mixed", 2.0, 9, at(9)), ("mixed", 3.0, 10, at(10)), ("short", 1.0, 11, at(11)),
            ("nan", nan, 12, at(12)), ("nan", 2.0, 13, at(13)), ("vary", 5.0, 14, at(14)), ("end", 0.0, 15, at(5000)), ("end2", 0.0, 16, at(5001))]
    stream = S.stream_group_filter(feed(spark, tmp_path, rows, GROUP, 5), 2, "g", "m", "at", "30 seconds", 60_000)
    started(stream, tmp_path)
    got = {(r["g"], r["i"]): r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: v for k, v in got.items() if k[0] != "end"} == {
        ("vary", 0): "kept", ("vary", 1): "kept", ("vary", 14): "extra", ("mixed", 8): "kept", ("mixed", 9): "kept", ("mixed", 10): "extra",
        ("short", 11): "incomplete"}


def varied(n):
    return [(f"g{i // 2:03d}", float(i % 2), i, at(i)) for i in range(n)]


def test_generation_stops_at_the_target(spark, tmp_path):
    stream = S.stream_group_filter(feed(spark, tmp_path, varied(80), GROUP, 20), 2, "g", "m", "at", "30 seconds", 60_000)
    kept = S.keep_until_enough(stream, 13, 0, "g", str(tmp_path / "kept"), str(tmp_path / "ckpt"))
    rows = kept.collect()
    # ten groups a round: all of the first, the first three of the second
    assert sorted({r["g"] for r in rows}) == [f"g{i:03d}" for i in range(13)] and len(rows) == 26
    assert {r["g"]: r["round"] for r in rows} == {f"g{i:03d}": i // 10 for i in range(13)}


def test_generation_that_does_not_reach_the_target_fails(spark, tmp_path):
    stream = S.stream_group_filter(feed(spark, tmp_path, varied(60), GROUP, 20), 2, "g", "m", "at", "30 seconds", 60_000)
    with pytest.raises(RuntimeError, match="20 of 25 groups kept after 2 rounds"):
        S.keep_until_enough(stream, 25, 2, "g", str(tmp_path / "a"), str(tmp_path / "ckpt-a"))
    with pytest.raises(RuntimeError, match="30 of 99 groups kept after"):
        S.keep_until_enough(stream, 99, 0, "g", str(tmp_path / "b"), str(tmp_path / "ckpt-b"))


def test_a_round_run_again_writes_the_same(spark, tmp_path):
    """A restart from the checkpoint finds the rounds already written and goes on after them."""
    args = ("g", str(tmp_path / "kept"), str(tmp_path / "ckpt"))
    stream = S.stream_group_filter(feed(spark, tmp_path, varied(80), GROUP, 20), 2, "g", "m", "at", "30 seconds", 60_000)
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        S.keep_until_enough(stream, 15, 1, *args)
    rows = S.keep_until_enough(stream, 15, 0, *args).collect()
    assert {r["g"] for r in rows if r["round"] == 0} == {f"g{i:03d}" for i in range(10)}
    assert len({r["g"] for r in rows}) == 15 and len(rows) == 30


def state_rows(q):
    return max(s.numRowsTotal for p in q.recentProgress for s in p.stateOperators)


def test_groups_share_state_rows(spark, tmp_path):
    """Many groups are few calls and state rows, and each gets what it would get alone."""
    sizes = {f"g{i}": 1 + i % 5 for i in range(60)} | {None: 4}
    members = sorted((j, g or "") for g, n in sizes.items() for j in range(n))
    rows = [(g or None, None if i % 11 == 0 else float(i * 7 % 3), i, at(i)) for i, (_, g) in enumerate(members)]
    feeding = [*rows, ("end", 0.0, -1, at(5000)), ("end2", 0.0, -2, at(5001))]
    stream = S.stream_group_filter(feed(spark, tmp_path, feeding, GROUP, 50), 3, "g", "m", "at", "30 seconds", 1_000_000, buckets=4)
    q = started(stream, tmp_path)
    expected = {}
    for g in sizes:
        own = [r for r in rows if r[0] == g]
        values = {r[1] for r in own[:3]} - {None}
        status = "incomplete" if len(own) < 3 else "kept" if len(values) > 1 else None
        expected |= {(g, r[2]): (r[1], status) for r in own[:3] if status} | {(g, r[2]): (r[1], "extra") for r in own[3:]}
    out = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["i"] >= 0]
    assert {(r["g"], r["i"]): (r["m"], r["status"]) for r in out} == expected and len(out) == len(expected)
    assert state_rows(q) <= 5


def test_keys_share_state_rows(spark, tmp_path):
    """As above, for scans in order: keys of 17 digits beside a null one, missing rewards, rows out of order."""
    big = 10 ** 16 + 1
    rows = [(None if i % 40 == 39 else big + i % 40, i, None if i % 13 == 0 else float(i * 5 % 7), at(i)) for i in range(300)]
    feeding = [rows[i ^ 1] for i in range(300)] + [(-1, -1, 0.0, at(5000)), (-1, -2, 0.0, at(5001))]
    stream = S._ordered_scan(feed(spark, tmp_path, feeding, "k bigint, i bigint, r double, at timestamp", 75), "k", "i", ["r"], "at", 20, 20, 0.0,
                             lambda last, v: (last if v[0] is None else v[0], last), "before", buckets=4)
    q = started(stream, tmp_path)
    last, expected = {}, {}
    for k, i, r, _ in rows:
        expected[k, i] = (last.get(k, 0.0), "ok")
        last[k] = last.get(k, 0.0) if r is None else r
    out = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["i"] >= 0]
    assert {(r["k"], r["i"]): (r["before"], r["status"]) for r in out} == expected and len(out) == 300
    assert state_rows(q) <= 5


def test_a_round_takes_only_groups_that_can_be_named(spark, tmp_path):
    rows = [(g, float(i % 2), i, at(i)) for i, g in enumerate((None, None, "a", "a", "b", "b"))]
    stream = S.stream_group_filter(feed(spark, tmp_path, rows, GROUP, 6), 2, "g", "m", "at", "30 seconds", 60_000)
    kept = S.keep_until_enough(stream, 1, 0, "g", str(tmp_path / "kept"), str(tmp_path / "ckpt")).collect()
    assert [(r["g"], r["round"]) for r in kept] == [("a", 0), ("a", 0)]


@pytest.mark.parametrize("name", ["stream_tool_reward", "resume"])
def test_log_files_have_as_many_parts_each(spark, tmp_path, monkeypatch, name):
    """Files of several parts, some without rows, are micro-batches of whole files: no row comes late."""
    from rollframe.plans import catalog, q_io

    monkeypatch.setattr(q_io, "PART_ROWS", 20)
    ids = [i if i < 240 else 10_000 + i for i in range(300)]
    rows = [(e, i * 3 % 17, "click", float(i * 11 % 23)) for i, e in enumerate(ids)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double")
    events.write.parquet(str(tmp_path / "events.parquet"))
    arrivals = q_io._Arrivals(spark, q_io._attempts(spark, str(tmp_path)), "at")
    assert arrivals.parts == 3
    arrivals.write(str(tmp_path / "log"))
    files = list((tmp_path / "log").glob("part-*"))
    assert len(files) == q_io.FILES * 3 and any(f.stat().st_size == 0 for f in files)
    last, expected = {}, {}
    for e, u, _, v in rows:
        expected[e] = (u, 0.0 if v > last.get(u, 0.0) else -0.05)
        last[u] = v
    got = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r["event_id"]: (r["user_id"], r["tool_reward"]) for r in got} == expected and len(got) == 300
