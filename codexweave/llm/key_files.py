"""Tables by 128-bit digest in files of the shared folder, mapped into memory where they are asked.

A table that grows with the corpus is neither collected nor broadcast, and there is one way
to ask it at any size: 256 files by the first byte of the digest, each with sorted digests and
a number per key, and beside it the texts where the values are texts. The folder has to be one
that executors and driver see as a path; from a store pyarrow knows by URI each worker copies
the files it asks for.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexweave.sources.tables import shared_folder


def digest(text: str) -> bytes:
    """A 128-bit digest that is the same in every process."""
    return xxhash.xxh3_128_digest(text.encode("utf-8", "replace"))


def halves(keys: Iterator[str]) -> tuple[pa.Array, pa.Array]:
    """The high and low halves of the digests of ``keys`` as signed numbers."""
    both = np.frombuffer(b"".join(map(digest, keys)), ">u8").astype(np.uint64).view(np.int64)
    return pa.array(both[::2]), pa.array(both[1::2])


class KeyFiles:
    """Numbers, or texts, by key; exact but for equal 128-bit digests."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.files: list[tuple | None] = [None] * 256
        self.texts: list[np.ndarray | None] = [None] * 256

    def _file(self, first: int) -> tuple:
        """High halves, low halves and numbers of a file, sorted by digest."""
        data = _mapped(self.folder, f"{first:02x}", np.uint64)
        n = len(data) // 3
        self.files[first] = found = tuple(memoryview(data[k * n : (k + 1) * n]) for k in range(3))
        return found

    def __getitem__(self, key: str) -> int:
        """The key's number; 0 for an unknown key."""
        told = digest(key)
        high, low, numbers = self.files[told[0]] or self._file(told[0])
        h, l = int.from_bytes(told[:8]), int.from_bytes(told[8:])
        at = bisect_left(high, h)
        while at < len(high) and high[at] == h:
            if low[at] == l:
                return numbers[at]
            at += 1
        return 0

    def text(self, key: str) -> str | None:
        """The key's text; None for an unknown key."""
        place = self[key]
        if not place:
            return None
        first = digest(key)[0]
        if self.texts[first] is None:
            self.texts[first] = _mapped(self.folder, f"{first:02x}.txt", np.uint8)
        begin, size = place >> 24, place & 0xFFFFFF
        return self.texts[first][begin : begin + size].tobytes().decode("utf-8")


def _located(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if re.match(r"\w+:/", folder) else (fs.LocalFileSystem(), folder)


def _mapped(folder: str, name: str, kind: type) -> np.ndarray:
    """A file's values; one of a remote store is mapped from a local copy, one never written is empty."""
    store, path = _located(folder)
    info = store.get_file_info(f"{path}/{name}")
    if info.type == fs.FileType.NotFound or not info.size:
        return np.zeros(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.asarray(np.memmap(info.path, kind, "r"))
    with tempfile.NamedTemporaryFile() as copy:
        fs.copy_files(info.path, copy.name, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
        return np.asarray(np.memmap(copy.name, kind, "r"))


def _writer(folder: str) -> object:
    def write(store: fs.FileSystem, name: str, data: bytes) -> None:
        with store.open_output_stream(made := f"{name}-{uuid.uuid4().hex}") as out:  # a repeated task replaces whole files
            out.write(data)
        store.move(made, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _located(folder)
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is not None:
            high, low = (np.asarray(table.column(k)).view(np.uint64) for k in (0, 1))
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            values = table.column(2).take(pa.array(order))
            firsts, starts = np.unique(high >> np.uint64(56), return_index=True)
            for first, begin, end in zip(firsts.tolist(), starts.tolist(), [*starts[1:].tolist(), len(high)], strict=True):
                name, part = f"{path}/{first:02x}", values.slice(begin, end - begin)
                if pa.types.is_string(part.type):
                    texts = [t.encode("utf-8") for t in part.to_pylist()]
                    at = np.cumsum([0, *map(len, texts)])[:-1].astype(np.uint64)
                    numbers = (at << np.uint64(24)) | np.array([len(t) for t in texts], np.uint64)
                    write(store, f"{name}.txt", b"".join(texts))
                else:
                    numbers = np.asarray(part).view(np.uint64)
                write(store, name, np.concatenate([high[begin:end], low[begin:end], numbers]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([table.num_rows if table is not None else 0], pa.int64())], ["n"])

    return run


def key_files(rows: DataFrame, label: str) -> KeyFiles:
    """The table of ``rows`` (high long, low long, and a positive long or a non-empty string), each key once.

    A text is at most 16 MB. No row reaches the driver.
    """
    folder = f"{shared_folder(rows.sparkSession)}/codexweave/{label}-{uuid.uuid4().hex}"
    store, path = _located(folder)
    store.create_dir(path)
    rows.repartition(F.shiftrightunsigned(rows.columns[0], 56)).mapInArrow(_writer(folder), "n long").agg(F.sum("n")).collect()
    return KeyFiles(folder)
