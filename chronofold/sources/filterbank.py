"""SIGPROC filterbank files as a Spark data source, and a writer."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, fields

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The format's keywords.
INT_KEYS = ("telescope_id", "machine_id", "data_type", "barycentric", "pulsarcentric", "ibeam", "nbeams", "npuls", "nbins", "nbits", "nifs", "nchans")
DOUBLE_KEYS = ("az_start", "za_start", "src_raj", "src_dej", "tstart", "tsamp", "fch1", "foff", "refdm", "period")
TEXT_KEYS = ("rawdatafile", "source_name")
LONGEST_STRING = 4096
SAMPLE_TYPES = {8: np.dtype("<u1"), 16: np.dtype("<u2"), 32: np.dtype("<f4")}
SPARK_TYPES = {8: "short", 16: "int", 32: "float"}
CHANNEL_ORDERS = ("frequency_ascending", "preserve_file_order")
REVERSE_BACKENDS = ("auto", "cpu_scalar", "cpu_openmp")


@dataclass
class Header:
    """The 28 fields of a header; nsamples follows from the file's size."""

    header_size: int = 0
    nsamples: int = 0
    telescope_id: int = 0
    machine_id: int = 0
    data_type: int = 0
    barycentric: int = 0
    pulsarcentric: int = 0
    ibeam: int = 0
    nbeams: int = 0
    npuls: int = 0
    nbins: int = 0
    nbits: int = 0
    nifs: int = 0
    nchans: int = 0
    az_start: float = 0.0
    za_start: float = 0.0
    src_raj: float = 0.0
    src_dej: float = 0.0
    tstart: float = 0.0
    tsamp: float = 0.0
    fch1: float = 0.0
    foff: float = 0.0
    refdm: float = 0.0
    period: float = 0.0
    rawdatafile: str = ""
    source_name: str = ""
    frequency_table: list[float] = field(default_factory=list)
    uses_frequency_table: bool = False

    @property
    def dtype(self) -> np.dtype:
        if self.nbits not in SAMPLE_TYPES:
            raise RuntimeError(f"Unsupported filterbank nbits: {self.nbits}")
        return SAMPLE_TYPES[self.nbits]

    @property
    def row_bytes(self) -> int:
        return self.nifs * self.nchans * self.dtype.itemsize

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.nsamples, self.nifs, self.nchans


def _open(path: str):
    """A seekable input and its size, from any store that Arrow reads (local path, file://, s3://, hdfs://, gs://)."""
    try:
        store, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
        return store.open_input_file(name), store.get_file_info(name).size
    except (OSError, pa.ArrowInvalid) as e:
        raise RuntimeError(f"Failed to open filterbank file: {path}") from e


class _Fields:
    def __init__(self, source):
        self.source = source

    def exact(self, n: int, what: str) -> bytes:
        data = self.source.read(n)
        if len(data) != n:
            raise RuntimeError(f"Truncated filterbank header while reading {what}")
        return data

    def string(self) -> str:
        (n,) = struct.unpack("<i", self.exact(4, "string length"))
        if not 1 <= n <= LONGEST_STRING:
            raise RuntimeError(f"Invalid filterbank string length: {n}")
        return self.exact(n, "string").decode("latin-1")

    def number(self, kind: str, what: str):
        return struct.unpack(f"<{kind}", self.exact(struct.calcsize(kind), what))[0]


def parse_header(source, size: int) -> Header:
    """The header of an open file of ``size`` bytes; frequencies as in the file."""
    at = _Fields(source)
    if at.string() != "HEADER_START":
        raise RuntimeError("Non-standard filterbank file: missing HEADER_START")
    h, in_table = Header(), False
    while (key := at.string()) != "HEADER_END":
        if key in TEXT_KEYS:
            setattr(h, key, at.string())
        elif key == "FREQUENCY_START":
            in_table, h.uses_frequency_table, h.frequency_table = True, True, []
        elif key == "FREQUENCY_END":
            in_table, h.nchans = False, len(h.frequency_table)
        elif key == "fchannel":
            if not in_table:
                raise RuntimeError("fchannel outside FREQUENCY block")
            h.frequency_table.append(at.number("d", key))
            h.fch1 = h.foff = 0.0
        elif key in DOUBLE_KEYS:
            setattr(h, key, at.number("d", key))
        elif key in INT_KEYS:
            setattr(h, key, at.number("i", key))
        elif key == "nsamples":
            at.number("i", key)  # the file's size tells
        else:
            raise RuntimeError(f"Unknown filterbank header field: {key}")
    h.header_size = source.tell()
    for name in ("nchans", "nifs"):
        if getattr(h, name) <= 0:
            raise RuntimeError(f"Invalid filterbank {name}")
    h.nsamples, rest = divmod(size - h.header_size, h.row_bytes)
    if rest:
        raise RuntimeError("Filterbank data size is not a whole number of rows")
    if not h.uses_frequency_table:
        h.frequency_table = [h.fch1 + c * h.foff for c in range(h.nchans)]
    elif len(h.frequency_table) != h.nchans:
        raise RuntimeError("Filterbank frequency table length does not match nchans")
    return h


def reversed_channels(h: Header, order: str) -> bool:
    if order not in CHANNEL_ORDERS:
        raise ValueError(f"channel_order must be one of {CHANNEL_ORDERS}")
    if order != CHANNEL_ORDERS[0]:
        return False
    if h.uses_frequency_table:
        return h.frequency_table[0] > h.frequency_table[-1]
    return h.foff < 0


def read_header(path: str, order: str = "frequency_ascending") -> tuple[Header, bool]:
    """The header as results see it, and whether channels are to be reversed."""
    source, size = _open(path)
    with source:
        h = parse_header(source, size)
    turn = reversed_channels(h, order)
    if turn:
        h.frequency_table = h.frequency_table[::-1]
        if not h.uses_frequency_table or h.foff:
            h.foff = abs(h.foff)
        h.fch1 = h.frequency_table[0]
    return h, turn


def _rows(source, h: Header, turn: bool, begin: int, end: int) -> np.ndarray:
    source.seek(h.header_size + begin * h.row_bytes)
    data = source.read((end - begin) * h.row_bytes)
    out = np.frombuffer(data, h.dtype).reshape(end - begin, h.nifs, h.nchans)
    return out[:, :, ::-1] if turn else out


class _Chunk(InputPartition):
    def __init__(self, begin: int, end: int):
        super().__init__((begin, end))
        self.begin, self.end = begin, end


class _Reader(DataSourceReader):
    def __init__(self, path: str, order: str, chunk_bytes: int):
        self.path, self.chunk_bytes = path, chunk_bytes
        self.header, self.turn = read_header(path, order)

    def partitions(self) -> Sequence[InputPartition]:
        step = max(1, self.chunk_bytes // self.header.row_bytes)
        n = self.header.nsamples
        return [_Chunk(a, min(n, a + step)) for a in range(0, n, step)] or [_Chunk(0, 0)]

    def read(self, partition: _Chunk) -> Iterator[pa.RecordBatch]:
        h = self.header
        per = h.nifs * h.nchans
        step = max(1, (1 << 18) // per)
        kind = {8: np.int16, 16: np.int32, 32: np.float32}[h.nbits]
        source, _ = _open(self.path)
        with source:
            for a in range(partition.begin, partition.end, step):
                b = min(partition.end, a + step)
                block = _rows(source, h, self.turn, a, b)
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.arange(a, b), per)),
                        pa.array(np.tile(np.repeat(np.arange(h.nifs, dtype=np.int32), h.nchans), n)),
                        pa.array(np.tile(np.arange(h.nchans, dtype=np.int32), n * h.nifs)),
                        pa.array(np.ascontiguousarray(block).astype(kind).ravel()),
                    ],
                    names=["t", "ifno", "chan", "value"],
                )


class FilterbankSource(DataSource):
    """``spark.read.format("filterbank").load(path)``: rows (t, ifno, chan, value).

    Options: channelOrder (frequency_ascending, preserve_file_order), chunkBytes (64 MiB): a partition
    reads that many bytes of whole rows, so a file of any size is read by many tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "filterbank"

    def _reader(self) -> _Reader:
        path = self.options.get("path")
        if not path:
            raise ValueError("a path is needed")
        return _Reader(path, self.options.get("channelorder", self.options.get("channelOrder", CHANNEL_ORDERS[0])), int(self.options.get("chunkbytes", self.options.get("chunkBytes", 64 << 20))))

    def schema(self) -> str:
        h, _ = read_header(self.options["path"])
        return f"t long, ifno int, chan int, value {SPARK_TYPES[h.nbits]}"

    def reader(self, schema) -> DataSourceReader:
        return self._reader()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilterbankSource)


def _string(text: str) -> bytes:
    data = text.encode("latin-1")
    return struct.pack("<i", len(data)) + data


def header_bytes(h: Header) -> bytes:
    """A header in the format; keys with their default are left out, but for those that are needed."""
    out = io.BytesIO()
    out.write(_string("HEADER_START"))
    for key in TEXT_KEYS:
        if getattr(h, key):
            out.write(_string(key) + _string(getattr(h, key)))
    needed = {"nifs", "nbits", "tsamp", "tstart", "telescope_id", "machine_id", "data_type"}
    for key in INT_KEYS:
        if key != "nchans" and (getattr(h, key) or key in needed):
            out.write(_string(key) + struct.pack("<i", getattr(h, key)))
    for key in DOUBLE_KEYS:
        if key not in ("fch1", "foff") and (getattr(h, key) or key in needed):
            out.write(_string(key) + struct.pack("<d", getattr(h, key)))
    out.write(_string("nchans") + struct.pack("<i", h.nchans))
    if h.uses_frequency_table:
        out.write(_string("FREQUENCY_START"))
        for f in h.frequency_table:
            out.write(_string("fchannel") + struct.pack("<d", f))
        out.write(_string("FREQUENCY_END"))
    else:
        out.write(_string("fch1") + struct.pack("<d", h.fch1) + _string("foff") + struct.pack("<d", h.foff))
    out.write(_string("HEADER_END"))
    return out.getvalue()


def write_filterbank(samples: DataFrame, h: Header, path: str, chunk_bytes: int = 4 << 20, nsamples: int | None = None) -> None:
    """Samples (t, ifno, chan, value) as one file.

    Tasks put whole rows of the file together, a chunk of time each.  On a file system that allows it (any
    mounted one) they write their chunks in place, so no sample passes the driver, and a task that runs
    again writes the same bytes again.  Object stores have no such writes: there the driver passes the
    chunks on in order and holds one at a time.  A sample that is missing is written as 0.
    """
    store, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    step = max(1, chunk_bytes // h.row_bytes)
    head = header_bytes(h)
    n = samples.agg(F.max("t")).first()[0] + 1 if nsamples is None else nsamples
    in_place = isinstance(store, pyarrow.fs.LocalFileSystem)

    def pack(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        t = table["t"].to_numpy() - chunk * step
        rows = np.zeros((min(step, n - chunk * step), h.nifs, h.nchans), h.dtype)
        rows[t, table["ifno"].to_numpy(), table["chan"].to_numpy()] = table["value"].to_numpy().astype(h.dtype)
        data = rows.tobytes()
        if in_place:
            with open(name, "r+b") as out:
                out.seek(len(head) + chunk * step * h.row_bytes)
                out.write(data)
            data = None
        return pa.table({"chunk": [chunk], "data": pa.array([data], pa.binary())})

    rows = samples.select(F.floor(F.col("t") / step).cast("long").alias("chunk"), "t", "ifno", "chan", "value")
    packed = rows.groupBy("chunk").applyInArrow(pack, "chunk long, data binary")
    if in_place:
        with open(name, "wb") as out:
            out.write(head)
            out.truncate(len(head) + n * h.row_bytes)
        packed.agg(F.count("*")).collect()
        return
    at = 0
    with store.open_output_stream(name) as out:
        out.write(head)
        for row in packed.orderBy("chunk").toLocalIterator():
            out.write(bytes((row["chunk"] * step - at) * h.row_bytes) + row["data"])
            at = min(n, (row["chunk"] + 1) * step)
        out.write(bytes((n - at) * h.row_bytes))


def header_frame(spark: SparkSession, h: Header) -> DataFrame:
    kinds = {int: "long", float: "double", str: "string", bool: "boolean"}
    kind = lambda f: "array<double>" if f.name == "frequency_table" else kinds[type(getattr(h, f.name))] if not isinstance(getattr(h, f.name), bool) else "boolean"
    return spark.createDataFrame([tuple(asdict(h).values())], ", ".join(f"{f.name} {kind(f)}" for f in fields(h)))
