"""User hooks: metric callbacks that cost no scan of their own, and record transforms.

A callback names aggregates over the batch; they are observed while the batch is written, and the
callback gets their values when the write has succeeded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollframe.session import ship_package


@dataclass(frozen=True)
class MetricCallback:
    """name; aggregates: metric name to an aggregate column over the batch's rows; needs: columns
    without which the callback does not run; then: gets (step, split, {metric: value})."""

    name: str
    aggregates: dict[str, Column]
    then: Callable[[int, str, dict], None]
    needs: tuple[str, ...] = field(default=())


def write_with_callbacks(batch: DataFrame, write: Callable[[DataFrame], None], callbacks: Iterable[MetricCallback],
                         step: int, split: str = "train") -> dict[str, dict]:
    """Runs ``write(batch)``, one action over the whole batch, then every callback whose columns are
    there; {callback: values}.

    Values come from the tasks of that very write (``DataFrame.observe``), so all callbacks
    together read the batch once.  A write that fails runs no callback; a callback that fails
    raises after the others have run.  An empty batch gives the aggregates' values over no rows."""
    called, seen = [], set()
    for c in callbacks:
        if c.name in seen:
            raise ValueError(f"two callbacks are named {c.name}")
        seen.add(c.name)
        if all(n in batch.columns for n in c.needs):
            o = Observation(f"{c.name}-{step}-{split}")
            batch = batch.observe(o, *[a.alias(k) for k, a in c.aggregates.items()])
            called.append((c, o))
    write(batch)
    values, failed = {c.name: dict(o.get) for c, o in called}, []
    for c, _ in called:
        try:
            c.then(step, split, values[c.name])
        except Exception as e:  # noqa: BLE001
            failed.append((c.name, e))
    if failed:
        raise RuntimeError(f"callback {failed[0][0]} failed after the batch was written") from failed[0][1]
    return values


def class_counts(col: str, classes: Iterable[str]) -> dict[str, Column]:
    """Share of the rows of each class, for a callback."""
    return {c: F.avg(F.coalesce((F.col(col) == c).cast("double"), F.lit(0.0))) for c in classes}


def transform_records(df: DataFrame, fn: Callable, schema: T.StructType | str, **kwargs) -> DataFrame:
    """A user's dataset transform: ``fn(record: dict, **kwargs)`` gives a dict, a list of dicts, or
    None to drop the record; on Arrow batches.  Fields that ``fn`` does not give are null."""
    ship_package(df.sparkSession)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = schema.names

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for record in batch.to_pylist():
                made = fn(record, **kwargs)
                out += [] if made is None else [made] if isinstance(made, dict) else made
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out], schema=arrow)

    return df.mapInArrow(run, schema)
