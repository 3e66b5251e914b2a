"""Sinks: document tables, exact files and reports."""

from __future__ import annotations

import posixpath
import sys
import uuid
from collections.abc import Iterable
from functools import partial

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from webquire.operators.packing import SEPARATOR
from webquire.operators.report import report_json
from webquire.session import qualified

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_docs(docs: DataFrame, out: str, partition_by: str = "host", mode: str = "error") -> None:
    """Documents as parquet, one folder per host.

    The rebalance hint brings a host's rows together and still splits a host that
    holds a large share of them.
    """
    docs.hint("rebalance", F.col(partition_by)).write.partitionBy(partition_by).mode(mode).parquet(out)


def _write_rows(rows: Iterable[Row], out: str) -> None:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(out)
    for row in rows:
        target = posixpath.join(root, row["path"])
        system.create_dir(posixpath.dirname(target), recursive=True)
        # a retried task replaces the whole file at once
        draft = f"{target}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(draft) as stream:
            stream.write(row["content"].encode("utf-8"))
        system.move(draft, target)


def write_files(docs: DataFrame, out: str, path: str = "path", content: str = "content") -> None:
    """One file per row under its exact relative name, written by the executors.

    ``out`` must be a folder that all executors reach; without a scheme it is on Spark's
    default file system.
    """
    out = qualified(docs.sparkSession, out)
    named = docs.select(F.col(path).alias("path"), F.col(content).alias("content"))
    named.foreachPartition(partial(_write_rows, out=out))


def _stream_parts(rows: Iterable[Row], out: str) -> None:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(out)
    open_key, stream, draft, target = None, None, "", ""

    def finish() -> None:
        if stream is not None:
            stream.close()
            system.move(draft, target)

    for row in rows:
        if (row["grp"], row["part"]) != open_key:
            finish()
            open_key = (row["grp"], row["part"])
            target = posixpath.join(root, row["grp"], row["file"])
            system.create_dir(posixpath.dirname(target), recursive=True)
            draft = f"{target}.{uuid.uuid4().hex}.tmp"
            stream = system.open_output_stream(draft)
        else:
            stream.write(SEPARATOR.encode())
        stream.write(row["content"].encode("utf-8"))
    finish()


def write_parts(placed: DataFrame, out: str) -> None:
    """The files of ``operators.packing.placed_texts`` below ``out``, one folder per group.

    A task streams the sorted documents of its parts into their files, so it holds one
    document at a time however large a part is.
    """
    placed.repartition("grp", "part").sortWithinPartitions("grp", "part", "seq").foreachPartition(
        partial(_stream_parts, out=qualified(placed.sparkSession, out))
    )


def write_report(reports: DataFrame, out: str, mode: str = "error") -> None:
    """Report objects as pretty JSON, one object per file."""
    report_json(reports).write.mode(mode).option("maxRecordsPerFile", 1).text(out)
