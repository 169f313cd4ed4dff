"""A Spark data source of recordings: partitions planned from a listing, files read by the tasks that need them.

A recording is <folder>/<stem>.<data> (an array of channels x samples), its mask <stem>.npy (blocks x loci) and perhaps
<stem>.json.  Content never goes through a shuffle: a task opens the files of its own partition, one recording at a time.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: All columns; a narrower schema reads only the files of its columns.
COLUMNS = {
    "folder": "string", "stem": "string", "has_json": "boolean", "data": "array<array<double>>",
    "mask": "array<array<boolean>>", "annotation": "string",
}
SPLIT_BYTES, SPLIT_FILES = 128 << 20, 4096
_NAME = re.compile(r"(.*)\.(\w+)")


def _opened(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _array(content: bytes, entry: str) -> np.ndarray:
    held = np.load(io.BytesIO(content), allow_pickle=False)
    return held[entry] if hasattr(held, "files") else held


@dataclass
class Split(InputPartition):
    """Recordings of one folder: their path below the root and (stem, suffix as written of each kind)."""

    path: str
    stems: list[tuple[str, dict[str, str]]]


class RecordingReader(DataSourceReader):
    """Plans splits of at most ``splitBytes`` or ``splitFiles``, of the named folders only where ``folders`` names some."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}  # Spark doesn't keep their case
        if "path" not in options:
            raise ValueError("recordings need a path")
        unknown = [f.name for f in schema if f.name not in COLUMNS]
        if unknown:
            raise ValueError(f"recordings have no column {unknown[0]}")
        self.schema, self.root = schema, options["path"]
        self.data, self.entry = options.get("data", "npz").lower(), options.get("entry", "data")
        self.bytes, self.files = int(options.get("splitbytes", SPLIT_BYTES)), int(options.get("splitfiles", SPLIT_FILES))
        if self.data == "npy":
            raise ValueError("masks are .npy files, so data can't be")
        self.folders: set[str] | None = set(json.loads(options["folders"])) if "folders" in options else None

    def _kinds(self) -> dict[str, str]:
        """Suffix of the files that each wanted column reads."""
        return {c: k for c, k in (("data", self.data), ("mask", "npy"), ("annotation", "json")) if c in self.schema.names}

    def partitions(self) -> list[Split]:
        """A folder at a time: names are kept of complete recordings only, as the splits that tasks are sent."""
        from pyarrow import fs

        store, top = _opened(self.root)
        wanted, todo, out = set(self._kinds().values()), [top], []
        while todo:
            here = todo.pop()
            held: dict[str, dict[str, tuple[str, int]]] = {}
            skipped = self.folders is not None and here.rstrip("/").rsplit("/", 1)[-1] not in self.folders
            for info in store.get_file_info(fs.FileSelector(here)):
                found = _NAME.fullmatch(info.base_name)
                if info.type == fs.FileType.Directory:
                    todo.append(info.path)
                elif found and not skipped and not info.base_name.startswith(("_", ".")):
                    held.setdefault(found[1], {}).setdefault(found[2].lower(), (found[2], info.size))
            split, size, count = [], 0, 0
            for stem in sorted(s for s, kinds in held.items() if self.data in kinds and "npy" in kinds):
                more = sum(n for k, (_, n) in held[stem].items() if k in wanted)
                if split and (size + more > self.bytes or count >= self.files):
                    out.append(Split(here, split))
                    split, size, count = [], 0, 0
                split.append((stem, {k: suffix for k, (suffix, _) in held[stem].items() if k in (self.data, "npy", "json")}))
                size, count = size + more, count + 1
            if split:
                out.append(Split(here, split))
        return out or [Split(top, [])]  # Spark reads without a partition as one that it passes None

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.root)
        shape = to_arrow_schema(self.schema)
        decode = {
            "data": lambda c: _array(c, self.entry).astype(float).tolist(),
            "mask": lambda c: _array(c, self.entry).astype(bool).tolist(),
            "annotation": lambda c: c.decode(),
        }
        for stem, suffixes in partition.stems:
            row = {"folder": partition.path.rstrip("/").rsplit("/", 1)[-1], "stem": stem, "has_json": "json" in suffixes}
            for column, kind in self._kinds().items():
                row[column] = None
                if kind in suffixes:
                    path = f"{partition.path.rstrip('/')}/{stem}.{suffixes[kind]}"
                    with store.open_input_stream(path) as f:
                        content = f.read()
                    try:
                        row[column] = decode[column](content)
                    except (ValueError, KeyError, EOFError, OSError) as e:
                        raise ValueError(f"{path} holds no {column}: {e}") from e
            yield pa.RecordBatch.from_pylist([{n: row[n] for n in shape.names}], schema=shape)


class PruningReader(RecordingReader):
    """The reader of sessions that push filters down (``spark.sql.python.filterPushdown.enabled``; Spark refuses it in others)."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the folder prune the listing; Spark keeps all others."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("folder",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.folders = named if self.folders is None else self.folders & named
            else:
                yield f


class Recordings(DataSource):
    """``spark.read.format("recordings")``: options path, data (suffix, npz), entry (array of an archive), splitBytes, splitFiles,
    folders (names as JSON; other folders aren't planned), pushdown (true where the session pushes filters down)."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return ", ".join(f"{n} {t}" for n, t in COLUMNS.items())

    def reader(self, schema: StructType) -> RecordingReader:
        kind = PruningReader if self.options.get("pushdown") == "true" else RecordingReader
        return kind(schema, dict(self.options))


def scan(spark: SparkSession, root: str, columns: tuple[str, ...] = tuple(COLUMNS), folders: list[str] | None = None, **options) -> DataFrame:
    """The recordings below a folder that have data and a mask, with ``columns`` only; other files aren't opened.

    Recordings without a mask are left out, a missing annotation is null; files of other kinds, hidden ones and
    folders without recordings don't count.  A file that can't be decoded ends the read with its path.  A recording
    is held whole by one task.
    """
    spark.dataSource.register(Recordings)
    schema = ", ".join(f"{c} {COLUMNS[c]}" for c in columns)
    options["pushdown"] = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    if folders is not None:
        options["folders"] = json.dumps(folders)
    return spark.read.format("recordings").schema(schema).options(**options).load(root)


def store(df: DataFrame, root: str) -> int:
    """Write recordings (folder, stem, data, mask or null, annotation or null) as files below a folder; how many.

    Files are named by their recording, so a task that runs again writes the same ones.
    """
    def put(batches):
        fs, top = _opened(root)
        for b in batches:
            for r in b.to_pylist():
                fs.create_dir(f"{top}/{r['folder']}", recursive=True)
                packed: dict[str, bytes | None] = {"json": None if r["annotation"] is None else r["annotation"].encode()}
                for kind, value, save in (("npz", r["data"], lambda f, v: np.savez(f, data=v)), ("npy", r["mask"], np.save)):
                    held = io.BytesIO()
                    if value is not None:
                        save(held, np.array(value))
                    packed[kind] = held.getvalue() or None
                for kind, content in packed.items():
                    if content is not None:
                        with fs.open_output_stream(f"{top}/{r['folder']}/{r['stem']}.{kind}") as f:
                            f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    found = df.select("folder", "stem", "data", "mask", "annotation").mapInArrow(put, "n long").agg({"n": "sum"}).first()[0]
    return found or 0
