"""Fan-out sink, metric callbacks, record transforms, harness text."""

import os

import pytest
from pyspark.sql import functions as F

from rollframe.operators import callbacks as CB
from rollframe.operators import testcases as C
from rollframe.sources.fanout import write_fan_out


def targets(tmp_path):
    return [(f, str(tmp_path / f)) for f in ("parquet", "jsonl", "csv")]


def read(spark, tmp_path):
    schema = "id bigint, x string"
    frames = [spark.read.parquet(str(tmp_path / "parquet")), spark.read.schema(schema).json(str(tmp_path / "jsonl")),
              spark.read.schema(schema).option("header", True).csv(str(tmp_path / "csv"))]
    return [sorted((r["id"], r["x"]) for r in f.collect()) for f in frames]


def test_every_back_end_gets_every_row_once(spark, tmp_path):
    d = spark.range(0, 500, 1, 4).select("id", F.concat(F.lit("é "), F.col("id").cast("string")).alias("x"))
    want = sorted((r["id"], r["x"]) for r in d.collect())
    write_fan_out(d, targets(tmp_path))
    assert read(spark, tmp_path) == [want] * 3
    write_fan_out(d.limit(3), targets(tmp_path))
    assert [len(x) for x in read(spark, tmp_path)] == [503] * 3
    write_fan_out(d.where("id < 7"), targets(tmp_path), "overwrite")
    assert read(spark, tmp_path) == [want[:7]] * 3
    assert not [n for _, p in targets(tmp_path) for n in os.listdir(p) if n.startswith("_staging")]


def test_a_failed_task_leaves_no_row_in_any_back_end(spark, tmp_path):
    d = spark.range(0, 400, 1, 4).select("id", F.lit("x").alias("x"))
    write_fan_out(d.limit(5), targets(tmp_path))
    before = read(spark, tmp_path)
    bad = d.withColumn("x", F.when(F.col("id") == 399, F.raise_error(F.lit("broken"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="broken"):
        write_fan_out(bad, targets(tmp_path))
    assert read(spark, tmp_path) == before
    assert not [n for _, p in targets(tmp_path) for n in os.listdir(p) if n.startswith("_staging")]


def test_fan_out_of_nothing_and_bad_targets(spark, tmp_path):
    write_fan_out(spark.range(0).select("id", F.lit("x").alias("x")), targets(tmp_path))
    assert all(os.listdir(p) == [] for _, p in targets(tmp_path))
    for bad in ([], [("orc", "/tmp/x")], [("csv", "/tmp/x"), ("jsonl", "/tmp/x/")]):
        with pytest.raises(ValueError):
            write_fan_out(spark.range(1), bad)


def test_three_callbacks_read_the_batch_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    batch = spark.range(100).select("id", (F.col("id") % 4).cast("string").alias("kind")).mapInArrow(count, "id bigint, kind string")
    got = []
    cbs = [CB.MetricCallback("n", {"rows": F.count("*")}, lambda s, p, v: got.append((s, p, v))),
           CB.MetricCallback("kinds", CB.class_counts("kind", ["0", "9"]), lambda s, p, v: got.append(v), ("kind",)),
           CB.MetricCallback("top", {"top": F.max("id")}, lambda s, p, v: got.append(v)),
           CB.MetricCallback("absent", {"n": F.count("nope")}, lambda s, p, v: got.append("never"), ("nope",))]
    values = CB.write_with_callbacks(batch, lambda d: d.write.parquet(str(tmp_path / "b")), cbs, 7, "val")
    assert reads.value == 100 and spark.read.parquet(str(tmp_path / "b")).count() == 100
    assert got == [(7, "val", {"rows": 100}), {"0": 0.25, "9": 0.0}, {"top": 99}] and set(values) == {"n", "kinds", "top"}


def test_callbacks_that_fail(spark, tmp_path):
    got, batch = [], spark.range(5)

    def broken(step, split, values):
        raise KeyError("oops")

    cbs = [CB.MetricCallback("a", {"n": F.count("*")}, broken), CB.MetricCallback("b", {"n": F.count("*")}, lambda *v: got.append(v))]
    with pytest.raises(RuntimeError, match="callback a failed"):
        CB.write_with_callbacks(batch, lambda d: d.write.parquet(str(tmp_path / "x")), cbs, 1)
    assert got == [(1, "train", {"n": 5})]
    with pytest.raises(Exception, match="no batch"):
        CB.write_with_callbacks(batch.select(F.raise_error(F.lit("no batch"))), lambda d: d.write.format("noop").mode("overwrite").save(), cbs, 2)
    assert len(got) == 1
    with pytest.raises(ValueError, match="two callbacks"):
        CB.write_with_callbacks(batch, lambda d: None, [cbs[0], cbs[0]], 3)


def test_record_transforms(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "id int, t string")

    def words(record, up=False):
        return None if record["t"] is None else [{"id": record["id"], "w": w.upper() if up else w} for w in record["t"].split()]

    rows = CB.transform_records(d, words, "id int, w string, extra double", up=True).collect()
    assert [tuple(r) for r in rows] == [(1, "A", None), (1, "B", None), (3, "C", None)]


REAL, DOC = "def generate_input_1():\n    return 1\n", '"""\ndef generate_input_1():\n    pass\n"""\n'
CHECK = "def check_output(a):\n    return a\n"
HARNESS = [
    (REAL, True), (DOC, False), ("x = 1\n" + DOC + REAL, True), (DOC.replace('"""', "'''"), False), ("# it's\n" + REAL, True),
    ("s = 'a\\'b' # \"\"\"\n" + REAL, True), ('t = "\\""\n' + DOC, False), (DOC.rsplit('"""', 1)[0], False), (REAL + CHECK, False),
    (REAL + CHECK + "    assert a\n", True), (REAL + "'''\n" + CHECK + "'''\n", True), ("class A:\n    def generate_input_1(self): pass\n", False),
    ("def  generate_input_2 ():\n  pass", True), ("", False), (None, False), (REAL + "def solve(x): pass", False),
    ('x = """' + "a \\\" ' " * 50_000 + '"""\n' + REAL, True)]


def test_harness_functions_are_those_of_the_program(spark):
    d = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(HARNESS)], "i int, code string")
    got = {r["i"]: r["ok"] for r in d.select("i", C.validate_harness_text("code", "solve").alias("ok")).collect()}
    assert got == {i: ok for i, (_, ok) in enumerate(HARNESS)}
