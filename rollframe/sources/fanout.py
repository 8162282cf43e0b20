"""A sink that sends one pass over a table to several back ends, all or nothing.

A Python Data Source: every task writes its rows for each back end into a staging folder of the
run; the commit moves the files of all tasks into place, an abort deletes the staging folder.  A
failed or repeated task therefore leaves nothing that a reader can see.  Back ends are folders on
any file system that ``pyarrow.fs`` knows by URI (a plain path is the local or mounted one).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv, fs, parquet
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from rollframe.session import ship_package

FORMATS = ("parquet", "jsonl", "csv")


@dataclass
class Parts(WriterCommitMessage):
    """Files that a task has staged: (back end, name)."""

    files: list


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class _Lines:
    """JSON lines of record batches."""

    def __init__(self, out):
        self.out = out

    def write_batch(self, batch: pa.RecordBatch) -> None:
        for row in batch.to_pylist():
            self.out.write((json.dumps(row, default=str, ensure_ascii=False) + "\n").encode())

    def close(self) -> None:
        pass


class FanOutWriter(DataSourceArrowWriter):
    def __init__(self, targets: list[dict], schema, overwrite: bool):
        self.targets, self.schema, self.overwrite = targets, schema, overwrite
        self.run = uuid.uuid4().hex

    def _staging(self, target: dict) -> str:
        return f"{target['path'].rstrip('/')}/_staging-{self.run}"

    def write(self, iterator) -> Parts:
        name = f"part-{uuid.uuid4().hex}"  # a repeated attempt stages files of its own
        writers, files = [], []
        for i, target in enumerate(self.targets):
            system, folder = _open(self._staging(target))
            system.create_dir(folder, recursive=True)
            file = f"{name}.{target['format']}"
            files.append((i, file))
            writers.append((target["format"], system, f"{folder}/{file}", [None, None]))
        try:
            for batch in iterator:
                for kind, system, path, held in writers:
                    if held[0] is None:
                        held[1] = system.open_output_stream(path)
                        held[0] = (parquet.ParquetWriter(held[1], batch.schema) if kind == "parquet"
                                   else csv.CSVWriter(held[1], batch.schema) if kind == "csv" else _Lines(held[1]))
                    held[0].write_batch(batch)
        finally:
            for *_, held in writers:
                for thing in held:
                    if thing is not None:
                        thing.close()
        return Parts([f for f, (*_, held) in zip(files, writers) if held[0] is not None])

    def commit(self, messages) -> None:
        staged = [f for m in messages if m is not None for f in m.files]
        for i, target in enumerate(self.targets):
            system, folder = _open(target["path"].rstrip("/"))
            _, staging = _open(self._staging(target))
            system.create_dir(folder, recursive=True)
            old = [x.path for x in system.get_file_info(fs.FileSelector(folder)) if x.is_file] if self.overwrite else []
            for _, name in [f for f in staged if f[0] == i]:
                system.move(f"{staging}/{name}", f"{folder}/{name}")
            for path in old:
                system.delete_file(path)
        self.abort([])

    def abort(self, messages) -> None:
        for target in self.targets:
            system, staging = _open(self._staging(target))
            if system.get_file_info(staging).type != fs.FileType.NotFound:
                system.delete_dir(staging)


class FanOutSource(DataSource):
    """``df.write.format("fanout").option("targets", json)``: see :func:`write_fan_out`."""

    @classmethod
    def name(cls) -> str:
        return "fanout"

    def writer(self, schema, overwrite: bool) -> FanOutWriter:
        return FanOutWriter(json.loads(self.options["targets"]), schema, overwrite)


def write_fan_out(df: DataFrame, targets: list[tuple[str, str]], mode: str = "append") -> None:
    """Write ``df`` to every (format, folder) of ``targets`` in one pass; formats are parquet,
    jsonl and csv.  ``mode``: append or overwrite.  If a task fails for good, no back end has any
    row of the run.  Between the back ends the commit's moves are not one step: a driver lost among
    them leaves the staging folders of the rest, with their rows."""
    unknown = [f for f, _ in targets if f not in FORMATS]
    if unknown or not targets:
        raise ValueError(f"formats are {FORMATS}, not {unknown}")
    if len({p.rstrip("/") for _, p in targets}) < len(targets):
        raise ValueError("two back ends share a folder")
    spark = df.sparkSession
    ship_package(spark)
    spark.dataSource.register(FanOutSource)
    text = json.dumps([{"format": f, "path": p} for f, p in targets])
    df.write.format("fanout").option("targets", text).mode(mode).save()
