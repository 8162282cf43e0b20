"""Position in a run over shuffled batches: stop after any batch, continue with the next.

The order of an epoch is computed from (seed, epoch) by a keyed permutation of the row index, so
a position is three numbers.  They are written beside their predecessors under a name of their own
and then moved into place in one step: a reader finds the last whole position, whatever was
interrupted.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollframe.operators.batch import epoch_batches


class BatchCursor(NamedTuple):
    """The next batch to run: ``offset`` of epoch ``epoch`` in the order that ``seed`` gives."""

    seed: int
    epoch: int = 0
    offset: int = 0

    def advanced(self, batches_per_epoch: int, by: int = 1) -> BatchCursor:
        """After ``by`` more batches; behind an epoch's last batch the next epoch begins."""
        if batches_per_epoch < 1:
            raise ValueError("an epoch has at least one batch")
        done = self.epoch * batches_per_epoch + self.offset + by
        return BatchCursor(self.seed, *divmod(done, batches_per_epoch))


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _positions(fs, path, folder: str) -> list[tuple[int, str]]:
    if not fs.exists(path(folder)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(folder))]
    return sorted((int(n[7:-5]), n) for n in names if n.startswith("cursor-") and n.endswith(".json") and n[7:-5].isdigit())


def save_cursor(spark: SparkSession, folder: str, cursor: BatchCursor) -> None:
    """Replaces the position kept in ``folder`` (any file system that Spark can write).  One
    writer at a time; the last two positions are kept."""
    fs, path = _fs(spark, folder)
    had = _positions(fs, path, folder)
    fs.mkdirs(path(folder))
    part = path(f"{folder}/.{uuid.uuid4().hex}.part")
    out = fs.create(part, False)
    try:
        out.write(bytearray(json.dumps(cursor._asdict()).encode()))
    finally:
        out.close()
    number = had[-1][0] + 1 if had else 0
    if not fs.rename(part, path(f"{folder}/cursor-{number:020d}.json")):
        raise RuntimeError(f"position {number} could not be moved into place: is there another writer?")
    for _, name in had[:-1]:
        fs.delete(path(f"{folder}/{name}"), False)


def load_cursor(spark: SparkSession, folder: str) -> BatchCursor | None:
    """The position last saved in ``folder``; None if there is none."""
    fs, path = _fs(spark, folder)
    had = _positions(fs, path, folder)
    if not had:
        return None
    row = spark.read.text(f"{folder}/{had[-1][1]}", wholetext=True).first()
    return BatchCursor(**json.loads(row[0]))


def remaining_batches(df: DataFrame, cursor: BatchCursor, batch_size: int, index_col: str, n: int, drop_last: bool = True) -> DataFrame:
    """The rows of the cursor's epoch from its batch on, with ``batch``: what a run that was never
    stopped would still have before it in this epoch.  A projection and a filter, no shuffle."""
    d = epoch_batches(df, batch_size, index_col, cursor.seed, True, drop_last, n, index_col, cursor.epoch)
    return d.where(F.col("batch") >= cursor.offset)
