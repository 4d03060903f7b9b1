"""Record files: framed, checksummed protobuf examples, read and written as a Spark data source named ``records``.

A record is its length (8 bytes), the masked CRC-32C of those bytes, its data, and the masked CRC-32C of the data, all
little-endian. The data are an example: features by name, each a list of byte strings, floats or whole numbers.
A file is a partition, in the order of the first numbers in the files' names.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Fixed values of the format: the checksum's polynomial (reversed) and what its mask adds.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
#: Bytes of a lane of the checksum; bytes of records that are read or written at once.
LANE, BATCH_BYTES = 256, 2 << 20

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(POLYNOMIAL), _TABLE >> 1).astype(np.uint32)


def _after_zeros(n: int) -> np.ndarray:
    """What each byte of a register becomes after ``n`` zero bytes, as four tables."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)).astype(np.uint32)
    for _ in range(n):
        state = _TABLE[state & np.uint32(255)] ^ (state >> np.uint32(8))
    return state


_SHIFT = _after_zeros(LANE)


def crc32c(records: list[bytes]) -> np.ndarray:
    """The CRC-32C of each record.

    Records are cut into lanes that go through the table side by side. A leading zero changes nothing, so the first lane is
    filled up in front; the register's initial ones are the first four bytes' complement; lanes are joined by their register after a lane of zeros.
    """
    lanes, counts = [], []
    for r in records:
        first = bytes(b ^ 255 for b in r[:4]) if len(r) >= 4 else b""
        body = first + r[4:] if len(r) >= 4 else b""
        counts.append(-(-len(body) // LANE))
        lanes.append(b"\0" * (counts[-1] * LANE - len(body)) + body)
    table = np.frombuffer(b"".join(lanes), np.uint8).reshape(-1, LANE)
    state = np.zeros(len(table), np.uint32)
    for column in table.T:
        state = _TABLE[(state ^ column) & np.uint32(255)] ^ (state >> np.uint32(8))
    out, at, counts_of = np.zeros(len(records), np.uint32), np.r_[0, np.cumsum(counts)][:-1], np.array(counts)
    for k in range(max(counts, default=0)):
        more = np.flatnonzero(counts_of > k)
        x = out[more]
        out[more] = _SHIFT[0][x & 255] ^ _SHIFT[1][(x >> 8) & 255] ^ _SHIFT[2][(x >> 16) & 255] ^ _SHIFT[3][x >> 24] ^ state[at[more] + k]
    for i, r in enumerate(records):
        if len(r) < 4:
            x = 0xFFFFFFFF
            for b in r:
                x = int(_TABLE[(x ^ b) & 255]) ^ (x >> 8)
            out[i] = x
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def framed(records: list[bytes]) -> bytes:
    """Records with lengths and checksums."""
    sizes = [struct.pack("<Q", len(r)) for r in records]
    return b"".join(size + struct.pack("<I", a) + r + struct.pack("<I", b) for size, a, r, b in zip(sizes, masked(crc32c(sizes)).tolist(), records, masked(crc32c(records)).tolist(), strict=True))


def _number(n: int) -> bytes:
    n, out = n & (1 << 64) - 1, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _part(field: int, data: bytes) -> bytes:
    return _number(field << 3 | 2) + _number(len(data)) + data


def encoded(features: dict[str, list]) -> bytes:
    """An example of ``features``: lists of bytes, floats or whole numbers, in the order of their names."""
    entries = []
    for name, values in sorted(features.items()):
        if values and isinstance(values[0], bytes):
            kind = _part(1, b"".join(_part(1, v) for v in values))
        elif values and isinstance(values[0], float):
            kind = _part(2, _part(1, struct.pack(f"<{len(values)}f", *values)))
        else:
            kind = _part(3, _part(1, b"".join(map(_number, values))))
        entries.append(_part(1, _part(1, name.encode()) + _part(2, kind)))
    return _part(1, b"".join(entries))


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    out, shift = 0, 0
    while True:
        byte = data[at]
        out |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return out, at


def _parts(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    at = 0
    while at < len(data):
        tag, at = _read_number(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _read_number(data, at)
        else:
            size, at = _read_number(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            if at + size > len(data):
                raise ValueError("a field goes beyond the record")
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def decoded(data: bytes) -> dict[str, list]:
    """The features of an example; numbers in one packed field or one by one."""
    out = {}
    for entry in (e for f, features in _parts(data) if f == 1 for g, e in _parts(features) if g == 1):
        fields = dict(_parts(entry))
        values: list = []
        for kind, content in _parts(fields.get(2, b"")):
            for _, v in _parts(content):
                if kind == 1:
                    values.append(v)
                elif kind == 2:
                    values += struct.unpack(f"<{len(v) // 4}f", v)
                elif isinstance(v, int):
                    values.append(_signed(v))
                else:
                    at = 0
                    while at < len(v):
                        n, at = _read_number(v, at)
                        values.append(_signed(n))
        out[fields[1].decode()] = values
    return out


def natural_key(path: str) -> tuple:
    name = os.path.basename(path)
    number = re.search(r"\d+", name)
    return (number is None, int(number.group()) if number else 0, name)


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class RecordFile(InputPartition):
    path: str


class Damaged(ValueError):
    """A record whose frame or checksum is wrong, by file and number."""


def read_frames(stream, name: str) -> Iterator[list[bytes]]:
    """The checked records of a file, in lists of about BATCH_BYTES."""
    held: list[tuple[bytes, bytes, int, int]] = []
    n = size = 0

    def checked() -> list[bytes]:
        lengths, data = masked(crc32c([h[0] for h in held])), masked(crc32c([h[1] for h in held]))
        for k, (_, _, a, b) in enumerate(held):
            if a != lengths[k] or b != data[k]:
                raise Damaged(f"record {n - len(held) + k} of {name} is damaged: its {'length' if a != lengths[k] else 'data'} and checksum differ")
        return [h[1] for h in held]

    while head := stream.read(12):
        length = struct.unpack("<Q", head[:8])[0] if len(head) == 12 else 0
        if len(head) < 12 or masked(crc32c([head[:8]]))[0] != struct.unpack("<I", head[8:])[0]:
            raise Damaged(f"record {n} of {name} is damaged: its length and checksum differ")
        body = stream.read(length + 4)
        if len(body) < length + 4:
            raise Damaged(f"record {n} of {name} is damaged: the file ends within it")
        held.append((head[:8], body[:-4], struct.unpack("<I", head[8:])[0], struct.unpack("<I", body[-4:])[0]))
        n, size = n + 1, size + length
        if size >= BATCH_BYTES:
            yield checked()
            held, size = [], 0
    if held:
        yield checked()


def _value(values: list | None, kind: T.DataType):
    if values is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [_value([v], kind.elementType) for v in values]
    if not values:
        return None
    return values[0].decode() if isinstance(kind, T.StringType) else values[0]


class RecordReader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str):
        self.schema, self.path = schema, path

    def partitions(self) -> list[RecordFile]:
        system, path = _filesystem(self.path)
        info = system.get_file_info(path)
        found = [info.path] if info.is_file else [f.path for f in system.get_file_info(pafs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", "."))]
        return [RecordFile(f) for f in sorted(found, key=natural_key)]

    def read(self, partition: RecordFile) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        system, _ = _filesystem(self.path)
        with system.open_input_stream(partition.path) as stream:
            n = 0
            for records in read_frames(stream, os.path.basename(partition.path)):
                columns = {f.name: [] for f in self.schema}
                for k, record in enumerate(records):
                    try:
                        features = decoded(record)
                        for f in self.schema:
                            columns[f.name].append(_value(features.get(f.name), f.dataType))
                    except (IndexError, KeyError, ValueError) as e:
                        raise Damaged(f"record {n + k} of {os.path.basename(partition.path)} isn't an example: {e}") from e
                n += len(records)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class RecordWriter(DataSourceArrowWriter):
    """Rows as records; a file for each value of ``shard``, or for each task. Files are moved to their names when all tasks are done."""

    def __init__(self, schema: T.StructType, path: str, shard: str | None, prefix: str):
        self.fields, self.path, self.shard, self.prefix = schema.names, path.rstrip("/"), shard, prefix
        self.hidden = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, path = _filesystem(self.path)
        context, made, open_files = TaskContext.get(), [], {}
        system.create_dir(f"{path}/{self.hidden}", recursive=True)
        try:
            for batch in iterator:
                rows: dict[int, list[bytes]] = {}
                for row in batch.to_pylist():
                    at = row.pop(self.shard) if self.shard else context.partitionId()
                    features = {}
                    for name, v in row.items():
                        if v is not None:
                            features[name] = [x.encode() if isinstance(x, str) else int(x) if isinstance(x, bool) else x for x in (v if isinstance(v, list) else [v])]
                    rows.setdefault(at, []).append(encoded(features))
                for at, records in rows.items():
                    if at not in open_files:
                        for stream in open_files.values():
                            stream.close()
                        open_files.clear()  # rows come by shard, so one file at a time is open
                        own = f"{path}/{self.hidden}/{uuid.uuid4().hex}"
                        made.append((own, f"{self.prefix}-{at:05}{'' if self.shard else '-' + uuid.uuid4().hex[:8]}.records"))
                        open_files[at] = system.open_output_stream(own)
                    open_files[at].write(framed(records))
        finally:
            for stream in open_files.values():
                stream.close()
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _filesystem(self.path)
        for message in messages:
            for own, name in message.files if message else []:
                system.move(own, f"{path}/{name}")
        system.delete_dir(f"{path}/{self.hidden}")

    def abort(self, messages: list[Written | None]) -> None:
        system, path = _filesystem(self.path)
        if system.get_file_info(f"{path}/{self.hidden}").type != pafs.FileType.NotFound:
            system.delete_dir(f"{path}/{self.hidden}")


class RecordFiles(DataSource):
    """The source ``records``; a schema names the features to read: text, binary, numbers, or arrays of them. A missing feature is null."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def reader(self, schema: T.StructType) -> RecordReader:
        return RecordReader(schema, self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(schema, self.options["path"], self.options.get("shard"), self.options.get("prefix", "train"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The examples of the record files at ``path``, a file or a folder, checked; a damaged record is an error that names it.

    ``schema`` names features and their kinds. Files come in the order of the numbers in their names.
    """
    spark.dataSource.register(RecordFiles)
    return spark.read.format("records").schema(schema).load(path)


def write_records(df: DataFrame, path: str, shard: str | None = None, prefix: str = "train") -> None:
    """``df`` as record files (K08): one for each value of ``shard`` (a whole number, not written), or one a task.

    Numbers with a fraction are kept in four bytes, as the format has them. Nulls are left out. Values of one shard go to one task, so keep shards to a size that a task can write.
    """
    df.sparkSession.dataSource.register(RecordFiles)
    doubles = {f.name: F.col(f.name).cast("long") for f in df.schema if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) and f.name != shard}
    df = df.withColumns(doubles)
    writer = df.write.format("records").mode("append").option("prefix", prefix)
    if shard:
        df = df.where(F.col(shard).isNotNull())
        writer = df.repartition(shard).sortWithinPartitions(shard).write.format("records").mode("append").option("prefix", prefix).option("shard", shard)
    writer.save(path)
