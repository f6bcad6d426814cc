"""The `file_facts` data source: what files in a directory are, read by ranges and not whole.

    spark.dataSource.register(FileFacts)
    spark.read.format("file_facts").option("kind", "wave").load("/audio")
    spark.read.format("file_facts").option("kind", "sha256").load("/outputs")

kind wave walks the chunks of RIFF files by their sizes: rate, channels, bits, frames. kind sha256 gives
length and digest, read in pieces. A partition is a batch of files; files that can't be read keep their row, with an
error. The store is one that pyarrow opens (a local path, file:, hdfs:, s3:, gs:).
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from hashlib import sha256

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PIECE = 1 << 20
NO_FACTS = (None, None, None, None)


def wave_facts(read: Callable[[int, int], bytes], length: int) -> tuple:
    """(rate, channels, bits, frames, error) of a RIFF file, from read(place, size).

    Chunks may come in any order and hold anything; each is as long as its size says, padded to an even
    place. A data chunk that says more than the file holds, as unfinished recordings do, has what is there.
    """
    head = read(0, 12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return (*NO_FACTS, "header")
    at, form, data = 12, None, None
    while at + 8 <= length and (form is None or data is None):
        name, size = struct.unpack("<4sI", read(at, 8))
        if name == b"fmt ":
            form = read(at + 8, 16)
        elif name == b"data":
            data = min(size, length - at - 8)
        at += 8 + size + size % 2
    if form is None or len(form) < 16 or data is None:
        return (*NO_FACTS, "fmt" if form is None or len(form) < 16 else "data")
    _, channels, rate, _, block, bits = struct.unpack("<HHIIHH", form)
    return (rate, channels, bits, data // block, None) if block else (*NO_FACTS, "block")


def _digest(file, length: int) -> str:
    whole = sha256()
    for at in range(0, length, PIECE):
        whole.update(file.read_at(min(PIECE, length - at), at))
    return whole.hexdigest()


class Files(InputPartition):
    """A batch of files of one store."""

    def __init__(self, root: str, names: list[tuple[str, int]]) -> None:
        self.root, self.names = root, names


class FactsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.kind, self.each = options["path"], options.get("kind", "wave"), int(options.get("files", 500))

    def partitions(self) -> list[Files]:
        store, place = _opened(self.root)
        found = store.get_file_info(fs.FileSelector(place, recursive=True))
        names = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        return [Files(self.root, names[at : at + self.each]) for at in range(0, len(names), self.each)]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _opened(partition.root)
        for name, length in partition.names:
            try:
                with store.open_input_file(name) as file:
                    if self.kind == "wave":
                        facts = wave_facts(lambda at, size, file=file: file.read_at(size, at), length)
                    else:
                        facts = (length, _digest(file, length), None)
            except OSError as error:
                facts = (*NO_FACTS, type(error).__name__) if self.kind == "wave" else (None, None, type(error).__name__)
            yield (name, *facts)


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    if root.startswith("file:"):
        root = root.removeprefix("file:").replace("///", "/", 1)
    return fs.FileSystem.from_uri(root)


class FileFacts(DataSource):
    """See the module's text. Options: path, kind (wave or sha256), files (of one partition at most)."""

    @classmethod
    def name(cls) -> str:
        return "file_facts"

    def schema(self) -> str:
        kinds = {"wave": "path string, rate bigint, channels bigint, bits bigint, frames bigint, error string", "sha256": "path string, length bigint, sha256 string, error string"}
        kind = self.options.get("kind", "wave")
        if kind not in kinds:
            raise ValueError(f"kind is one of {sorted(kinds)}, not {kind}")
        return kinds[kind]

    def reader(self, schema: StructType) -> FactsReader:
        return FactsReader(dict(self.options))
