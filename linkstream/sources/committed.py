"""A stream sink that adds each batch exactly once: a Python data source whose
tasks write data files and whose driver commits them by batch id.

Files lie under ``data/`` and count for nothing until the batch's manifest
``commits/<batch id>.json``, put in place by a rename, names them.  A task that
runs twice leaves a file that no manifest names; a batch that is replayed writes
new files and replaces its own manifest; an aborted batch removes what its tasks
report.  ``read_committed`` reads the files of all manifests.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from linkstream.constants import SINK_BATCH_ROWS
from linkstream.sources import files

FORMAT = "linkstream-committed"


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    rows: int


class CommittedWriter(DataSourceStreamArrowWriter):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.rows = int(options.get("batchsize", SINK_BATCH_ROWS))

    def _fs(self) -> tuple[pyarrow.fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            fs, at = pyarrow.fs.FileSystem.from_uri(self.path)
        else:
            fs, at = pyarrow.fs.LocalFileSystem(), self.path
        return fs, at.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file a task, written as rows come, in row groups of ``batchsize``."""
        fs, at = self._fs()
        name, rows, writer = f"{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(f"{at}/data", recursive=True)
                writer = pq.ParquetWriter(f"{at}/data/{name}", batch.schema, filesystem=fs)
            writer.write_table(pa.Table.from_batches([batch]), row_group_size=max(self.rows, 1))
            rows += batch.num_rows
        if writer is not None:
            writer.close()
        return Written([name] if rows else [], rows)

    def commit(self, messages: list, batchId: int) -> None:
        fs, at = self._fs()
        done = [m for m in messages if m is not None]
        body = json.dumps({"batch_id": batchId, "files": sorted(n for m in done for n in m.names), "rows": sum(m.rows for m in done)})
        fs.create_dir(f"{at}/commits", recursive=True)
        draft = f"{at}/commits/.{batchId}.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(body.encode())
        fs.move(draft, f"{at}/commits/{batchId}.json")

    def abort(self, messages: list, batchId: int) -> None:
        fs, at = self._fs()
        for m in messages:
            for name in m.names if m is not None else []:
                fs.delete_file(f"{at}/data/{name}")


class CommittedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema: StructType, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(self.options)


def write_committed(stream: DataFrame, path: str, checkpoint: str, trigger: dict):
    """Start a query that adds each batch of ``stream`` to the table at ``path`` once."""
    stream.sparkSession.dataSource.register(CommittedSource)
    return (stream.writeStream.format(FORMAT).option("path", path).option("checkpointLocation", checkpoint)
                  .outputMode("append").trigger(**trigger).start())


def read_committed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    manifests = [n for n in files.names(spark, f"{path}/commits") if n.endswith(".json")]
    listed = (json.loads(files.published(spark, f"{path}/commits/{n}"))["files"] for n in manifests)
    paths = [f"{path}/data/{name}" for found in listed for name in found]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
