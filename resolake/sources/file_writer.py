"""A Spark data source that writes one file a group in formats that Spark has no writer for: .npy matrices and GraphML."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote
from xml.sax.saxutils import escape

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _matrix(rows: Iterator[Row]) -> Iterator[bytes]:
    """A matrix is held whole: its cells come in order, its size is known at the end."""
    a, b, w = (np.array(c) for c in zip(*((r["a"], r["b"], r["w"]) for r in rows), strict=True))
    out = np.zeros((int(a.max()) + 1, int(b.max()) + 1))
    out[a, b] = w
    file = io.BytesIO()
    np.save(file, out)
    yield file.getvalue()


def _graph(rows: Iterator[Row]) -> Iterator[bytes]:
    """Nodes and edges are written as they come."""
    yield b'<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="weight" for="edge" attr.name="weight" attr.type="double"/>\n<graph edgedefault="directed">\n'
    for r in rows:
        if r["kind"] == 0:
            yield f'<node id="{escape(str(r["a"]))}"/>\n'.encode()
        else:
            weight = "" if r["w"] is None else f'<data key="weight">{r["w"]!r}</data>'
            yield f'<edge source="{r["a"]}" target="{r["b"]}">{weight}</edge>\n'.encode()
    yield b"</graph>\n</graphml>\n"


_FORMATS = {"npy": _matrix, "graphml": _graph}


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    """Tasks write under a staging folder of the job; committing moves their files to the target, aborting removes them."""

    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite = path, kind, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def write(self, iterator: Iterator[Row]) -> _Written:
        store, root = self._open()
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"  # of this attempt: another attempt's files are not committed
        store.create_dir(folder, recursive=True)
        files = []
        for name, rows in groupby(iterator, lambda r: r["name"]):
            files.append(f"{folder}/{quote(str(name), safe='')}.{self.kind}")
            with store.open_output_stream(files[-1]) as out:
                for chunk in _FORMATS[self.kind](rows):
                    out.write(chunk)
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = self._open()
        if self.overwrite:
            old = [f.path for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path.endswith(f".{self.kind}")]
            for path in old:
                store.delete_file(path)
        for m in messages:
            for file in m.files if m else []:
                store.move(file, f"{root}/{file.rsplit('/', 1)[1]}")
        self._clear(store, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*self._open())

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


class GroupedFiles(DataSource):
    """df.write.format("grouped_files").option("kind", ...).save(path): rows of a group must lie together, in the file's order."""

    @classmethod
    def name(cls) -> str:
        return "grouped_files"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options["kind"], overwrite)


def write_grouped(rows: DataFrame, path: str, kind: str, order: list[str]) -> None:
    """A file a name, <name>.<kind>, with the name's rows in order; earlier files of the kind in the folder go."""
    rows.sparkSession.dataSource.register(GroupedFiles)
    together = rows.repartition("name").sortWithinPartitions("name", *order)
    together.write.format("grouped_files").option("kind", kind).mode("overwrite").save(path)
