"""Token ids in training order: fixed-stride shards addressed by a keyed permutation.

1. Every partition encodes its documents, ends each with ``END_OF_TEXT`` and packs the stream into sequences of
   ``length`` tokens; only a partition's last sequence is padded. The sequences are written once.
2. Counts per partition make the sequence's dense number ``index`` in ``[0, n)``.
3. A keyed Feistel network over the next power of four, walked until the value falls below ``n``, is a permutation of
   ``[0, n)``: ``slot = permute(index)``. It needs no table, and its inverse finds the sequence of any slot.
4. Slots are dealt by range: shard ``slot // shard_records``. Each range is sorted by slot and streamed into one file,
   in which slot ``s`` starts at byte ``(s % shard_records) * stride``. A reader can start or resume at any slot.

File names are fresh for each task attempt and the index lists only files of attempts that succeeded.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from webquire.llm.common import bounded_batches
from webquire.llm.tokens import END_OF_TEXT, Encoder, ship
from webquire.session import cut, work_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 2_048
SHARD_RECORDS = 16_384
KEY = 20_240_607
ROUNDS = 6
FLUSH_BYTES = 8 << 20
TOKEN = np.dtype("<u2")  # the vocabularies have fewer than 65,536 ids

INDEX = "slot long, shard long, file string, position long, part int, seq long, n_tokens int, docs array<struct<id:long,start:int,n:int>>, sha256 string"


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of ``[0, n)``, or its inverse, at each of ``index``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = [(key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64) for r in range(ROUNDS)]
    out = np.asarray(index).astype(np.uint64)
    walking = np.ones(len(out), dtype=bool)
    while walking.any():  # the domain is less than 16 n (4 n for large n), so few steps
        x = out[walking]
        left, right = x >> bits, x & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        out[walking] = left << bits | right
        walking = out >= np.uint64(n)
    return out.astype(np.int64)


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """``part, seq, n_tokens, docs, tokens``: the packed sequences. ``docs`` lists whose tokens they hold, with the end mark."""
    bounded_batches(docs.sparkSession)
    shipped = ship(docs.sparkSession, vocabulary)
    schema = StructType.fromDDL("part int, seq long, n_tokens int, docs array<struct<id:long,start:int,n:int>>, tokens binary")
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(shipped.value), TaskContext.get().partitionId()
        buffer, fill, segments, seq = np.full(length, END_OF_TEXT, dtype=TOKEN), 0, [], 0
        rows: list[tuple] = []

        def close() -> None:
            nonlocal fill, segments, seq
            rows.append((part, seq, fill, segments, buffer.tobytes()))
            buffer.fill(END_OF_TEXT)
            fill, segments, seq = 0, [], seq + 1

        def out() -> Iterator[pa.RecordBatch]:
            if rows:
                columns = list(zip(*rows))
                rows.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.append(encoder.encode(text.as_py() or ""), END_OF_TEXT)
                if tokens.max() > np.iinfo(TOKEN).max:
                    raise ValueError(f"token {tokens.max()} does not fit {TOKEN}")
                at = 0
                while at < len(tokens):
                    n = min(length - fill, len(tokens) - at)
                    buffer[fill : fill + n] = tokens[at : at + n]
                    segments.append({"id": key, "start": fill, "n": n})
                    fill, at = fill + n, at + n
                    if fill == length:
                        close()
                        if len(rows) * length * TOKEN.itemsize >= FLUSH_BYTES:
                            yield from out()
        if fill:
            close()
        yield from out()

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(pack, schema)


def write_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_records: int = SHARD_RECORDS,
    key: int = KEY, folder: str | None = None, vocabulary: str | None = None,
) -> DataFrame:
    """Write the shards and return their index, itself a written table: ``slot, shard, file, position, part, seq, n_tokens, docs, sha256``.

    A null or empty text is an end mark alone. Repeated rows are encoded each; a null id stays null in ``docs``. Other
    columns are left out. An empty table writes no shard and gives an empty index.
    """
    spark = docs.sparkSession
    folder = folder or work_path(spark, "shards")
    at = work_path(spark, "sequences")
    made = sequences(docs, id_col, text_col, length, vocabulary)
    made.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 9).parquet(at)
    stored = spark.read.schema(made.schema).parquet(at)
    # one row per partition of the encoding step
    counts = stored.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    n = sum(r["n"] for r in counts)
    starts = np.cumsum([0] + [r["n"] for r in counts]).tolist()
    first = np.zeros(max((r["part"] for r in counts), default=-1) + 1, dtype=np.int64)
    first[[r["part"] for r in counts]] = starts[:-1]
    offsets = spark.sparkContext.broadcast(first)  # eight bytes per partition
    placed = StructType.fromDDL("shard int, slot long, part int, seq long, n_tokens int, docs array<struct<id:long,start:int,n:int>>, packed binary")
    placed_arrow, index_arrow = to_arrow_schema(placed), to_arrow_schema(StructType.fromDDL(INDEX))
    stride = length * TOKEN.itemsize

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for b in batches:
            slot = permute(offsets.value[b.column("part").to_numpy()] + b.column("seq").to_numpy(), n, key)
            packed = pa.array([press.compress(t.as_buffer()) for t in b.column("tokens")], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array((slot // shard_records).astype(np.int32)), pa.array(slot), b.column("part"), b.column("seq"), b.column("n_tokens"), b.column("docs"), packed], schema=placed_arrow)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        unpress = zstandard.ZstdDecompressor()
        out, name, shard, next_slot = None, "", -1, 0
        for b in batches:
            positions, names, digests = [], [], []
            for s, slot, packed in zip(b.column("shard").to_pylist(), b.column("slot").to_pylist(), b.column("packed")):
                if s != shard:
                    if out is not None:
                        out.close()
                    store.create_dir(root, recursive=True)
                    shard, next_slot, name = s, s * shard_records, f"shard-{s:08d}-{uuid.uuid4().hex}.bin"
                    out = store.open_output_stream(f"{root}/{name}")
                if slot != next_slot:
                    raise ValueError(f"slot {next_slot} is missing in shard {shard}")
                record = unpress.decompress(packed.as_buffer())
                out.write(record)
                positions.append((slot - shard * shard_records) * stride)
                names.append(f"{folder}/{name}")
                digests.append(hashlib.sha256(record).hexdigest())
                next_slot += 1
            shards = pa.array(b.column("shard").to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("slot"), shards, pa.array(names, pa.string()), pa.array(positions, pa.int64()), b.column("part"), b.column("seq"), b.column("n_tokens"), b.column("docs"), pa.array(digests, pa.string())], schema=index_arrow)
        if out is not None:
            out.close()

    dealt = stored.mapInArrow(place, placed).repartitionById(max(1, -(-n // shard_records)), "shard").sortWithinPartitions("slot")
    return cut(dealt.mapInArrow(write, INDEX), "shard-index")


def read_slots(index: DataFrame, first: int, stop: int, length: int = LENGTH, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """``slot, tokens``: the records of slots ``first`` to ``stop``, each shard read as one stream from its first wanted record."""
    stride = length * TOKEN.itemsize
    schema = StructType.fromDDL("slot long, tokens array<int>")
    arrow = to_arrow_schema(schema)
    spans = index.where(F.col("slot").between(first, stop - 1)).groupBy("shard", "file").agg(F.min("slot").alias("a"), F.max("slot").alias("b"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(r["file"])
                with store.open_input_file(path) as f:
                    f.seek((r["a"] - r["shard"] * shard_records) * stride)
                    for at in range(r["a"], r["b"] + 1, 512):
                        k = min(512, r["b"] + 1 - at)
                        tokens = np.frombuffer(f.read(k * stride), dtype=TOKEN).reshape(k, length)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + k)), pa.array(list(tokens.astype(np.int32)), pa.list_(pa.int32()))], schema=arrow)

    return spans.mapInArrow(read, schema)
