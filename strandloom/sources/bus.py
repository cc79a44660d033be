"""BUS files in binary: a data source of fixed-size records behind a header, in any number of splits.

A file is a header (magic, version, lengths of barcode and UMI, a text) and records of 32 bytes: barcode
and UMI as two bits a base, equivalence class, count, flags and padding.  With read numbers in the flags, as
a numbered run writes them, the flags are the read index.

``bus_source(spark)`` registers it as format ``bus``; paths are those of pyarrow's file systems (local,
hdfs://, s3:// and so on).  A folder is read as all of its ``.bus`` files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.fixed import on_workers

#: Fixed values of the format.
MAGIC, VERSION = b"BUS\x00", 1
RECORD = np.dtype([("barcode", "<u8"), ("umi", "<u8"), ("ec", "<i4"), ("count", "<u4"), ("flags", "<u4"), ("pad", "<u4")])
BASES = np.frombuffer(b"ACGT", np.uint8)
SCHEMA = "barcode string, umi string, ec int, count long, read_index long"
#: Records of a split (128 MB), and of an Arrow batch.
SPLIT, BATCH = 1 << 22, 1 << 16


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """``viewfs`` and the like need a file system that pyarrow knows; plain paths are local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Header:
    barcode: int
    umi: int
    size: int  # bytes before the first record

    @classmethod
    def of(cls, place: fs.FileSystem, path: str) -> Header:
        with place.open_input_file(path) as f:
            head = f.read(20)
            if len(head) < 20 or head[:4] != MAGIC:
                raise ValueError(f"{path} is no BUS file")
            version, barcode, umi, text = np.frombuffer(head[4:], "<u4").tolist()
            if version != VERSION or barcode > 32 or umi > 32:
                raise ValueError(f"{path}: version {version}, barcodes of {barcode} and UMIs of {umi} bases aren't known")
            return cls(barcode, umi, 20 + text)

    def written(self) -> bytes:
        return MAGIC + np.array([VERSION, self.barcode, self.umi, 0], "<u4").tobytes()


def decoded(codes: np.ndarray, size: int) -> pa.Array:
    """Two bits a base, the first base highest, as texts of ``size`` bases."""
    shifts = (2 * np.arange(size - 1, -1, -1)).astype(np.uint64)
    letters = BASES[(codes[:, None] >> shifts & np.uint64(3)).astype(np.intp)]
    offsets = np.arange(len(codes) + 1, dtype=np.int32) * size
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))


def encoded(texts: pa.Array, size: int, what: str) -> np.ndarray:
    """The codes of texts that all have ``size`` bases of A, C, G and T."""
    raw = pa.chunked_array([texts]).combine_chunks().cast(pa.large_string()).fill_null("")
    _, places, held = raw.buffers()
    offsets = np.frombuffer(places, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    if len(raw) and (np.diff(offsets) != size).any():
        raise ValueError(f"every {what} must have {size} bases")
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    code = np.searchsorted(BASES, data)
    if (BASES[np.minimum(code, 3)] != data).any():
        raise ValueError(f"a {what} has other letters than A, C, G and T")
    shifts = (2 * np.arange(size - 1, -1, -1)).astype(np.uint64)
    return (code.reshape(len(raw), size).astype(np.uint64) << shifts).sum(1, dtype=np.uint64)


@dataclass
class Split(InputPartition):
    path: str
    header: Header
    first: int
    records: int


class BusReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("recordsPerSplit", SPLIT))

    def partitions(self) -> list[Split]:
        place, path = _located(self.path)
        known = place.get_file_info(path)
        if known.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        folder = known.type == fs.FileType.Directory
        files = [f for f in place.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name.endswith(".bus")] if folder else [known]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            header = Header.of(place, f.path)
            records, rest = divmod(f.size - header.size, RECORD.itemsize)
            if records < 0 or rest:
                raise ValueError(f"{f.path} ends within a record")
            out += [Split(f.path, header, at, min(self.split, records - at)) for at in range(0, records, self.split)]
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not isinstance(split, Split):  # a source without any split is asked once
            return
        place, _ = _located(self.path)
        with place.open_input_file(split.path) as f:
            f.seek(split.header.size + split.first * RECORD.itemsize)
            for at in range(0, split.records, BATCH):
                rows = np.frombuffer(f.read(min(BATCH, split.records - at) * RECORD.itemsize), RECORD)
                columns = [decoded(rows["barcode"], split.header.barcode), decoded(rows["umi"], split.header.umi), pa.array(rows["ec"])]
                columns += [pa.array(rows[c].astype(np.int64)) for c in ("count", "flags")]
                yield pa.RecordBatch.from_arrays(columns, ["barcode", "umi", "ec", "count", "read_index"])


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class BusWriter(DataSourceArrowWriter):
    """A file for each task, first under a name that readers don't see; the commit renames them."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        place, path = _located(self.path)
        place.create_dir(path)
        name, out, header = f"{path}/_{self.run}-{uuid.uuid4().hex}.part", None, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
                if header is None:
                    header = Header(len(column("barcode")[0].as_py()), len(column("umi")[0].as_py()), 20)
                    out = place.open_output_stream(name)
                    out.write(header.written())
                rows = np.zeros(batch.num_rows, RECORD)
                rows["barcode"], rows["umi"] = encoded(column("barcode"), header.barcode, "barcode"), encoded(column("umi"), header.umi, "UMI")
                for c, into in (("ec", "ec"), ("count", "count"), ("read_index", "flags")):
                    values = column(c).to_numpy(zero_copy_only=False)
                    if (values < 0).any() and c != "ec" or (values > np.iinfo(RECORD[into]).max).any():
                        raise ValueError(f"{c} doesn't fit a BUS record")
                    rows[into] = values
                out.write(rows.tobytes())
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        place, path = _located(self.path)
        place.create_dir(path)
        if self.overwrite:
            for f in place.get_file_info(fs.FileSelector(path)):
                if f.is_file and f.base_name.endswith(".bus"):
                    place.delete_file(f.path)
        for i, m in enumerate(m for m in messages if m is not None and m.path):
            place.move(m.path, f"{path}/part-{i:05d}-{self.run}.bus")
        # what attempts that failed or ran twice have left
        for f in place.get_file_info(fs.FileSelector(path)):
            if f.base_name.startswith(f"_{self.run}-"):
                place.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        place, path = _located(self.path)
        for f in place.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.run}-"):
                place.delete_file(f.path)


class BusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BusReader:
        return BusReader(self.options)

    def writer(self, schema, overwrite: bool) -> BusWriter:
        return BusWriter(self.options, overwrite)


def bus_source(spark: SparkSession) -> None:
    """Make ``spark.read.format("bus")`` and ``df.write.format("bus")`` known to the session."""
    on_workers(spark.range(0))
    spark.dataSource.register(BusSource)


def read_bus(spark: SparkSession, path: str, records_per_split: int = SPLIT) -> DataFrame:
    """barcode, umi, ec, count, read_index of a BUS file or a folder of them.

    A file that isn't one, or that ends within a record, raises an error.
    """
    bus_source(spark)
    return spark.read.format("bus").option("recordsPerSplit", records_per_split).load(path)


def write_bus(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder with a BUS file for each task that has rows.  Barcodes must have one length, and UMIs too."""
    bus_source(rows.sparkSession)
    place, local = _located(path)
    if mode == "errorifexists" and place.get_file_info(local).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    kinds = [f"CAST({c} AS {t}) AS {c}" for c, t in (part.strip().split(" ") for part in SCHEMA.split(","))]
    rows.selectExpr(*kinds).write.format("bus").mode("overwrite" if mode == "overwrite" else "append").save(path)
