"""Sources: page stores, document trees, archives and reports.

Files are listed and read by tasks through ``pyarrow.fs``, each on its own, so one that cannot be read is a row with an
error, an empty one is a row as well, and an archive is read by ranges.
"""

from __future__ import annotations

import bz2
import posixpath
import struct
import sys
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webquire.operators.report import REPORT
from webquire.session import cut, qualified

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_BYTES = 64 << 20
# bytes and files, compressed bytes of one archive, and directories of archives that are dealt to a task together
DEAL_BYTES, DEAL_FILES, DEAL_ARCHIVES = 64 << 20, 1_000, 8
# names a task reads before it hands on the folders that are left, and the tasks that share those
WALKED, LISTERS = 10_000, 1_000
# bytes that a row can hold
ROW_BYTES = (1 << 31) - (1 << 20)
# bytes of a file or entry read at once
READ_BYTES = 1 << 20


def _children(batches: Iterator[pa.RecordBatch], root: str, suffix: str) -> Iterator[pa.RecordBatch]:
    """What stands below folders: files, and the folders that are left once a task has seen ``WALKED`` names."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(root)
    whole = store.get_file_info(place)
    if whole.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    seen, cut_off = 0, len(place.rstrip("/")) + 1
    for batch in batches:
        folders = batch.column(0).to_pylist()
        if whole.type == fs.FileType.File:
            folders, rows = [], [("", whole.size, False)]
        else:
            rows = []
        while folders and seen < WALKED:
            folder = folders.pop()
            for info in store.get_file_info(fs.FileSelector(posixpath.join(place, folder) if folder else place)):
                seen += 1
                name = info.path[cut_off:]
                if info.type == fs.FileType.Directory:
                    folders.append(name)
                elif name.lower().endswith(suffix):
                    rows.append((name, info.size, False))
        rows += [(folder, 0, True) for folder in folders]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.bool_()))], names=["path", "length", "folder"])


def list_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """``(path, length)`` of the files below a folder whose names end in ``suffix``, in any letter case.

    Only names and lengths are read, of empty files too.  Tasks walk down folders; what a task leaves over is dealt out
    for another round, so a large tree is listed by many.  ``path`` may be one file, whose relative path is empty.
    """
    walk = partial(_children, root=qualified(spark, path), suffix=suffix)
    folders, rounds = spark.range(1).select(F.lit("").alias("path")), []
    while True:
        rounds.append(cut(folders.mapInArrow(walk, "path string, length long, folder boolean"), "files"))
        left = rounds[-1].filter("folder").select("path")
        count = left.count()
        if not count:
            break
        folders = left.repartition(count, "path") if count < LISTERS else left.repartition(LISTERS, "path")
    return reduce(DataFrame.union, rounds).filter("not folder").select("path", "length")


def _dealt(listed: DataFrame, files: int, size: int | None = None) -> DataFrame:
    """The files dealt to tasks so that each has about ``files`` of them, and ``size`` bytes."""
    n, total = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    return listed.repartition(max(1, -(-n // files), -(-total // size) if size else 0), "path")


def _batches(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``BATCH_BYTES`` of content at most, or one row."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    for row in rows:
        more = len(row[-2] or b"")
        if held and (size + more > BATCH_BYTES or len(held) >= 10_000):
            yield flush()
            held, size = [], 0
        held.append(row)
        size += more
    if held:
        yield flush()


def _contents(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(root)

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    if length > ROW_BYTES:
                        raise OSError(f"file of {length} bytes is too large for a row")
                    with store.open_input_stream(posixpath.join(place, path) if path else place) as stream:
                        content = stream.read()
                    yield path, content, None
                except OSError as e:
                    yield path, None, f"cannot be read: {e}"

    yield from _batches(rows(), ["path", "content", "error"], [pa.string(), pa.binary(), pa.string()])


def _read_tree(spark: SparkSession, path: str, suffix: str, errors: bool) -> DataFrame:
    listed = _dealt(list_files(spark, path, suffix), DEAL_FILES, DEAL_BYTES)
    read = listed.mapInArrow(partial(_contents, root=qualified(spark, path)), "path string, content binary, error string")
    return read.select("path", F.col("content").cast("string").alias("content"), *(["error"] if errors else []))


def read_html(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    """``(path, content)`` of all ``.html`` files below a directory, in any letter case.

    A file that cannot be read is a row without content; ``errors`` adds the column ``error`` that says why.
    """
    return _read_tree(spark, path, ".html", errors)


def read_markdown(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    """``(path, content)`` of all ``.md`` files below a directory.

    A file that cannot be read is a row without content, which ``combine`` counts as a file without words; ``errors``
    adds the column ``error`` that says why.
    """
    return _read_tree(spark, path, ".md", errors)


ENTRY = "archive string, path string, offset long, packed long, size long, method int, locked boolean, crc long, error string"


class _Seekable:
    """An open file that refuses a bad position as other files do, by an ``OSError``."""

    def __init__(self, file: "pa.NativeFile") -> None:
        self.file, self.read, self.tell = file, file.read, file.tell

    def seek(self, to: int, whence: int = 0) -> int:
        try:
            return self.file.seek(to, whence)
        except ValueError as e:
            raise OSError(str(e)) from e


def _directory(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """The central directory of each archive, read by seeking to its end."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(root)
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 3, pa.int32(), pa.bool_(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                try:
                    with store.open_input_file(posixpath.join(place, archive) if archive else place) as file, zipfile.ZipFile(_Seekable(file)) as z:
                        # of several entries with one path the last one counts
                        last = {posixpath.normpath(i.filename.lstrip("/")): i for i in z.infolist() if not i.is_dir()}
                except (zipfile.BadZipFile, EOFError, OSError, NotImplementedError, ValueError, struct.error) as e:
                    yield archive, *[None] * 7, f"archive cannot be read: {e}"
                    continue
                for path, i in last.items():
                    if path.lower().endswith(".html") and path.split("/")[0] != "..":
                        yield archive, path, i.header_offset, i.compress_size, i.file_size, i.compress_type, bool(i.flag_bits & 1), i.CRC, None

    held = []
    for row in rows():
        held.append(row)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """A row per ``.html`` entry of one or many archives: where it stands, its sizes, method and checksum.

    Only the directories at the ends of the archives are read.  Entries whose path leaves the archive are left out; an
    archive whose directory cannot be read is one row with an ``error``.
    """
    return _dealt(list_files(spark, path, ".zip"), DEAL_ARCHIVES).mapInArrow(partial(_directory, root=qualified(spark, path)), ENTRY)


def _entry(file: "pa.NativeFile", entry: dict) -> bytes:
    """One entry, unpacked piece by piece from its range of the archive, and checked."""
    if entry["locked"]:
        raise OSError("entry is encrypted")
    if entry["size"] > ROW_BYTES:
        raise OSError(f"entry of {entry['size']} bytes is too large for a row")
    file.seek(entry["offset"])
    head = file.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise OSError("no entry where the directory says")
    name, extra = struct.unpack("<HH", head[26:30])
    file.seek(entry["offset"] + 30 + name + extra)
    if entry["method"] == zipfile.ZIP_DEFLATED:
        unpacker = zlib.decompressobj(-15)
    elif entry["method"] == zipfile.ZIP_BZIP2:
        unpacker = bz2.BZ2Decompressor()
    elif entry["method"] == zipfile.ZIP_STORED:
        unpacker = None
    else:
        raise OSError(f"compression method {entry['method']} is not supported")
    out, left, crc = bytearray(), entry["packed"], 0
    while left > 0 and (piece := file.read(min(left, READ_BYTES))):
        left -= len(piece)
        if unpacker is None:
            out += piece
        while unpacker is not None and not unpacker.eof and len(out) <= entry["size"]:
            # a step's output is bounded too, so a small entry cannot unpack into all memory
            more = unpacker.decompress(piece, READ_BYTES)
            out += more
            piece = unpacker.unconsumed_tail if entry["method"] == zipfile.ZIP_DEFLATED else b""
            if not piece and len(more) < READ_BYTES:
                break
    crc = zlib.crc32(out)
    if len(out) != entry["size"] or crc != entry["crc"]:
        raise OSError(f"entry is damaged: {len(out)} of {entry['size']} bytes, checksum {crc:08x} for {entry['crc']:08x}")
    return bytes(out)


def _unpacked(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(root)

    def rows() -> Iterator[tuple]:
        file, opened = None, None
        for batch in batches:
            for entry in batch.to_pylist():
                archive, path = posixpath.basename(entry["archive"] or place), entry["path"]
                if entry["error"]:
                    yield archive, None, None, entry["error"]
                    continue
                try:
                    if opened != entry["archive"]:
                        file, opened = store.open_input_file(posixpath.join(place, entry["archive"]) if entry["archive"] else place), entry["archive"]
                    yield archive, path, _entry(file, entry).decode("utf-8", "replace"), None
                except (OSError, zlib.error, EOFError, struct.error) as e:
                    yield archive, path, None, str(e)

    yield from _batches(rows(), ["archive", "path", "content", "error"], [pa.string()] * 4)


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, path, content, error)`` of the ``.html`` entries of one or many ZIP archives.

    The directories are read first; then entries are dealt to tasks by where they stand, about ``DEAL_BYTES`` of an
    archive to each, and read by range.  So an archive may be of any size and is read by many tasks.  Entries whose
    path leaves the archive are skipped.  A damaged entry has its error instead of content, as has one that is
    encrypted or too large for a row; a damaged archive is one row without a path.
    """
    entries = cut(zip_entries(spark, path), "zip-entries")
    dealt = entries.repartition("archive", F.floor(F.col("offset") / DEAL_BYTES)).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(partial(_unpacked, root=qualified(spark, path)), "archive string, path string, content string, error string")


def read_pages(spark: SparkSession, path: str, url: str = "url", html: str = "html") -> DataFrame:
    """Page store ``(url, final_url, html, error)`` from parquet; absent columns are NULL."""
    table = spark.read.parquet(path)

    def column(name: str, source: str) -> Column:
        return (F.col(source) if source in table.columns else F.lit(None).cast("string")).alias(name)

    return table.select(
        column("url", url), column("final_url", "final_url"), column("html", html), column("error", "error")
    )


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Report objects, in the fixed schema."""
    return spark.read.schema(REPORT).option("multiLine", True).json(path)
