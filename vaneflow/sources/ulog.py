"""Binary logs of the public ULog format as sample, parameter and message tables."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

MAGIC = b"ULog\x01\x12\x35"
# The format's scalar types.
TYPES = {"int8_t": "b", "uint8_t": "B", "int16_t": "h", "uint16_t": "H", "int32_t": "i", "uint32_t": "I", "int64_t": "q", "uint64_t": "Q", "float": "f", "double": "d", "bool": "?", "char": "c"}
SCHEMA = "log_id string, kind string, topic string, multi_id long, field string, seq long, ts_us long, v double, v_str string"


def _split(kind: str) -> tuple[str, int]:
    base, _, n = kind.partition("[")
    return base, int(n.rstrip("]")) if n else 1


def _layout(formats: dict[str, list[tuple[str, str]]], name: str, prefix: str = "", deep: int = 0) -> list[tuple[str, str]]:
    """(field, code) of a message in order, nested ones and arrays spelt out."""
    out = []
    for kind, field in formats.get(name, []):
        base, n = _split(kind)
        if base == "char" and n > 1:
            out.append((prefix + field, f"{n}s"))
            continue
        for i in range(n):
            full = prefix + field + (f"[{i}]" if n > 1 else "")
            if base in TYPES:
                out.append((full, TYPES[base]))
            elif deep < 8:
                out += _layout(formats, base, full + ".", deep + 1)
    return out


def records(source: bytes | BinaryIO, topics: set[str] | None = None) -> Iterator[tuple]:
    """(kind, topic, multi_id, field, seq, ts_us, v, v_str) of one log, bytes or an open file, which is read message by
    message; topics: only these are unpacked.  Ends where the file is cut off."""
    read = (io.BytesIO(source) if isinstance(source, bytes) else source).read
    if not read(16).startswith(MAGIC):
        yield ("error", None, None, None, 0, None, None, "not a ULog file")
        return
    formats: dict[str, list[tuple[str, str]]] = {}
    subs: dict[int, tuple[str, int, struct.Struct, list[str]] | None] = {}
    seq, last = 0, None
    while len(head := read(3)) == 3:
        size, kind = struct.unpack("<HB", head)
        body = read(size)
        if len(body) < size:
            yield ("error", None, None, None, seq, last, None, "cut off")
            return
        seq += 1
        match chr(kind):
            case "F":
                name, _, rest = body.decode("latin-1").partition(":")
                formats[name] = [tuple(f.split(" ", 1)) for f in rest.split(";") if " " in f]
            case "A":
                name = body[3:].decode("latin-1")
                fields = [f for f in _layout(formats, name)]
                while fields and fields[-1][0].split(".")[-1].startswith("_padding"):
                    fields.pop()
                wanted = topics is None or name in topics
                subs[struct.unpack_from("<H", body, 1)[0]] = (name, body[0], struct.Struct("<" + "".join(c for _, c in fields)), [f for f, _ in fields]) if wanted else None
            case "D":
                sub = subs.get(struct.unpack_from("<H", body)[0])
                if sub is None or len(body) - 2 < sub[2].size:
                    continue
                values = dict(zip(sub[3], sub[2].unpack_from(body, 2), strict=True))
                last = values.get("timestamp")
                for f, v in values.items():
                    if f != "timestamp" and "_padding" not in f:
                        text = v.rstrip(b"\0").decode("utf-8", "replace") if isinstance(v, bytes) else None
                        yield ("sample", sub[0], sub[1], f, seq, last, None if isinstance(v, bytes) else float(v), text)
            case "I" | "P":
                key = body[1 : 1 + body[0]].decode("latin-1")
                typ, _, name = key.partition(" ")
                value = body[1 + body[0] :]
                base, n = _split(typ)
                num = struct.unpack_from("<" + TYPES[base], value)[0] if base in TYPES and base != "char" and len(value) >= struct.calcsize(TYPES[base]) else None
                yield ("info" if chr(kind) == "I" else "parameter" if last is None else "parameter_change", None, None, name, seq, last, None if num is None else float(num), value.decode("utf-8", "replace").rstrip("\0") if num is None else typ)
            case "Q":
                key = body[2 : 2 + body[1]].decode("latin-1")
                typ, _, name = key.partition(" ")
                num = float(struct.unpack_from("<" + TYPES[typ], body, 2 + body[1])[0])
                for bit, label in ((1, "system_default"), (2, "airframe_default")):
                    if body[0] & bit:
                        yield (label, None, None, name, seq, last, num, typ)
            case "L":
                yield ("message", None, None, None, seq, struct.unpack_from("<Q", body, 1)[0], float(body[0] - 48 if 48 <= body[0] <= 57 else body[0]), body[9:].decode("utf-8", "replace"))
            case "O":
                yield ("dropout", None, None, None, seq, last, float(struct.unpack_from("<H", body)[0]), None)
    if head:
        yield ("error", None, None, None, seq, last, None, "cut off")


def read_ulogs(spark: SparkSession, path: str, topics: set[str] | None = None) -> DataFrame:
    """All records of the logs under a path, one row each, told apart by kind; log_id is the file's path.

    Files come through Spark, whatever store it reads, as whole rows, so a log may have 2 GB at most; the format `ulog`
    (register) has no such bound.  A file that is none, or cut off, has a row of kind error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                rows, cols = [], [c.split()[0] for c in SCHEMA.split(", ")]
                for r in records(bytes(data), topics):
                    rows.append((name, *r))
                    if len(rows) >= 50_000:
                        yield _frame(rows, cols)
                        rows = []
                yield _frame(rows, cols)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def _frame(rows: list[tuple], cols: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=cols).astype({"multi_id": "Int64", "seq": "Int64", "ts_us": "Int64", "v": "float64"})


class ULogFile(InputPartition):
    """One log, by its address."""

    def __init__(self, path: str):
        self.path = path


class ULogReader(DataSourceReader):
    """Logs as rows of SCHEMA, a partition a file.

    Files are read through Arrow's file systems (local or mounted folders, and stores that Arrow can reach), message by
    message, so a log of any size takes little memory.  Equality and `isin` on topic and kind are pushed into the
    unpacking: samples of other topics are passed over undecoded.
    """

    def __init__(self, path: str):
        self.path, self.topics, self.kinds = path, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            match f:
                case EqualTo(attribute=("topic",), value=v):
                    self.topics = self._both(self.topics, {v})
                case In(attribute=("topic",), value=vs):
                    self.topics = self._both(self.topics, set(vs))
                case EqualTo(attribute=("kind",), value=v):
                    self.kinds = self._both(self.kinds, {v})
                case In(attribute=("kind",), value=vs):
                    self.kinds = self._both(self.kinds, set(vs))
                case IsNotNull(attribute=("kind",)):  # it never is
                    pass
                case _:
                    yield f

    @staticmethod
    def _both(old: set[str] | None, new: set[str]) -> set[str]:
        return new if old is None else old & new

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(path)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        scheme = self.path.split("://", 1)[0] if "://" in self.path else "file"
        return [ULogFile(f"{scheme}://{f.path}") for f in sorted(files, key=lambda f: f.path) if f.is_file and f.base_name.endswith(".ulg")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.path)
        rows: list[tuple] = []
        with store.open_input_stream(path, buffer_size=1 << 20) as source:
            for r in records(source, self.topics):
                if (self.kinds is None or r[0] in self.kinds) and (self.topics is None or r[1] in self.topics):
                    rows.append((partition.path, *r))
                if len(rows) >= 50_000:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
        fields = [c.split() for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(list(x), types[t]) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


class ULogSource(DataSource):
    """spark.read.format("ulog").load(path), after register()."""

    @classmethod
    def name(cls) -> str:
        return "ulog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ULogReader:  # noqa: ANN001
        return ULogReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ULogSource)


def samples(records_: DataFrame) -> DataFrame:
    return records_.filter("kind = 'sample'").drop("kind")


def parameters(records_: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    kinds = ["parameter", "parameter_change", "system_default", "airframe_default"]
    return records_.filter(F.col("kind").isin(kinds)).select("log_id", F.col("field").alias("name"), "v", F.col("v_str").alias("type"), "kind", "ts_us")
