"""A library's vectors in files that all executors share, mapped into memory by the tasks that compare with them.

A table that every task meets in full is written once, as it is stored, beside the session's checkpoints, in
files of a bounded number of rows. A task maps them and multiplies in single precision; what it finds is
decided in double wherever single precision can't tell. Nothing is sent to a task but file names.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame

from crateflow.session import shared_folder

#: Rows of a file, and columns of a product held at once.
ROWS, WIDE = 32768, 4096
#: Vectors computed in double at once.
EXACT = 4096


def _place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path, and the path there."""
    if urlparse(uri).scheme in ("", "file"):
        return pa.fs.LocalFileSystem(), urlparse(uri).path
    return pa.fs.FileSystem.from_uri(uri)


def sink(uri: str) -> pa.NativeFile:
    """A new file to write to."""
    fs, path = _place(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    return fs.open_output_stream(path)


def flat(uri: str, dtype: type) -> np.ndarray:
    """A file of numbers, mapped into memory where it can be."""
    fs, path = _place(uri)
    if isinstance(fs, pa.fs.LocalFileSystem):
        return np.memmap(path, dtype, "r").view(np.ndarray)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix of its own type."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    if not len(column):
        return np.zeros((0, 0), np.float32)
    dim = int(offsets[1] - offsets[0])
    if not (np.diff(offsets) == dim).all():
        raise ValueError("vectors must have one length")
    return flat[offsets[0] : offsets[-1]].reshape(len(column), dim)


def _norms(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    for at in range(0, len(x), EXACT):
        part = x[at : at + EXACT].astype(np.float64)
        out[at : at + EXACT] = np.sqrt(np.einsum("ij,ij->i", part, part))
    return out


def _even(x: np.ndarray) -> np.ndarray:
    """Rows of extreme length moved by a power of two, which changes no direction."""
    top = np.abs(x).max(axis=1, initial=0)
    odd = np.flatnonzero((top > 0) & np.isfinite(top) & ((top < 1e-9) | (top > 1e9)))
    if len(odd):
        x = x.copy()
        x[odd] = np.ldexp(x[odd], -np.frexp(top[odd])[1][:, None])
    return x


class Shelf:
    """Files of rows: ``id``, other plain columns, and a vector."""

    def __init__(self, folder: str, files: list[tuple[str, int]]):
        self.folder, self.files = folder, files

    def drop(self) -> None:
        fs, path = _place(self.folder)
        if isinstance(fs, pa.fs.LocalFileSystem):
            shutil.rmtree(path, ignore_errors=True)
        else:
            fs.delete_dir(path)

    def open(self) -> Opened:
        return Opened([f for f, _ in self.files])


def shelve(rows: DataFrame, vector: str, prepare: Callable[[pa.Table], pa.Table] = lambda t: t, order: str = "id", even: bool = True) -> Shelf:
    """Every row of ``rows`` in files; ``prepare`` makes the plain columns of a file's rows, which stand in the order of one of them.

    A row without a vector, or with one that has no finite length, is kept with zeros and a ``norm`` of NaN.
    ``even``: only directions count, so that rows of extreme length may be moved by a power of two. Columns
    ``v:*`` are axes of a second vector.
    """
    folder = f"{shared_folder(rows.sparkSession)}/shelf-{uuid.uuid4().hex}"

    def write(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        column = t.column(vector).combine_chunks()
        there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        given = _matrix(column.take(pa.array(there)) if len(there) < len(column) else column)
        given = _even(given) if even else given
        norm = np.full(len(t), np.nan)
        norm[there] = _norms(given)
        plain = prepare(t.drop_columns([vector])).append_column("norm", pa.array(np.where(np.isfinite(norm), norm, np.nan)))
        x = np.zeros((len(t), given.shape[1]), given.dtype)
        x[there] = given
        x[~np.isfinite(norm)] = 0
        at = np.argsort(plain.column(order).to_numpy(), kind="stable")
        plain = plain.take(pa.array(at)).combine_chunks()
        path = f"{folder}/{uuid.uuid4().hex}"
        fs, where = _place(path)
        fs.create_dir(os.path.dirname(where), recursive=True)
        schema = plain.schema.append(pa.field("x", pa.list_(pa.from_numpy_dtype(x.dtype), x.shape[1])))
        with fs.open_output_stream(where) as sink, pa.ipc.new_file(sink, schema) as out:
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x[at].ravel()), x.shape[1]) if x.shape[1] else pa.nulls(len(x), schema.field("x").type)
            out.write_batch(pa.record_batch([*(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in plain.columns), flat], schema=schema))
        return pa.record_batch([pa.array([path]), pa.array([len(t)])], names=["file", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                if kept and n + part.num_rows > ROWS:
                    yield write(kept)
                    kept, n = [], 0
                kept.append(part)
                n += part.num_rows
        if n:
            yield write(kept)

    found = rows.mapInArrow(run, "file string, n bigint").collect()
    return Shelf(folder, sorted((r.file, r.n) for r in found))


class Opened:
    """The files as a task sees them. A row's place counts through all files, in their order."""

    def __init__(self, files: list[str]):
        self.files, self.maps = files, {}
        plain: dict[str, list[np.ndarray]] = {}
        sizes = []
        for k in range(len(files)):
            b = self._batch(k)
            sizes.append(b.num_rows)
            for name in (c for c in b.schema.names[:-1] if not c.startswith("v:")):
                plain.setdefault(name, []).append(b.column(name).to_numpy(zero_copy_only=False))
        self.starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.plain = {k: np.concatenate(v) for k, v in plain.items()}
        self.known = ~np.isnan(self.plain["norm"]) if files else np.zeros(0, bool)
        if files:
            norm = np.where(self.known, self.plain["norm"], 0.0)
            self.inverse = np.divide(1.0, norm, out=np.zeros(len(norm)), where=norm > 0)
            self.inverse32 = self.inverse.astype(np.float32)
            self.dim = max(self.stored(k).shape[1] for k in range(len(files)))
            #: What a single-precision cosine can be off.
            self.error = np.float32((self.dim + 32) * 2.0**-24)
            self.by_id = np.argsort(self.plain["id"], kind="stable")
            self.sorted_ids = self.plain["id"][self.by_id]

    def _batch(self, k: int) -> pa.RecordBatch:
        if k in self.maps:
            return self.maps[k]
        fs, path = _place(self.files[k])
        if isinstance(fs, pa.fs.LocalFileSystem):
            self.maps[k] = pa.ipc.open_file(pa.memory_map(path)).get_batch(0)
            return self.maps[k]
        with fs.open_input_file(path) as f:
            return pa.ipc.open_file(f).get_batch(0)

    def stored(self, k: int) -> np.ndarray:
        """The vectors of a file."""
        x = self._batch(k).column("x")
        return x.flatten().to_numpy().reshape(len(x), -1) if x.null_count == 0 else np.zeros((len(x), 0), np.float32)

    def features(self, k: int) -> np.ndarray:
        """The second vectors of a file."""
        b = self._batch(k)
        return np.column_stack([b.column(c).to_numpy() for c in b.schema.names if c.startswith("v:")])

    def rows(self, places: np.ndarray, second: bool = False) -> np.ndarray:
        """The vectors at these places in double."""
        out = None
        file = np.searchsorted(self.starts, places, side="right") - 1
        for k in np.unique(file):
            hit = np.flatnonzero(file == k)
            x = self.features(int(k)) if second else self.stored(int(k))
            out = np.zeros((len(places), x.shape[1])) if out is None else out
            out[hit] = x[places[hit] - self.starts[k]]
        return out

    def units(self, places: np.ndarray) -> np.ndarray:
        """The vectors at these places at unit length, in double; zero vectors stay zero."""
        out = np.zeros((len(places), self.dim))
        file = np.searchsorted(self.starts, places, side="right") - 1
        for k in np.unique(file):
            hit = np.flatnonzero(file == k)
            x = self.stored(int(k))
            out[hit, : x.shape[1]] = x[places[hit] - self.starts[k]]
        length = np.sqrt(np.einsum("ij,ij->i", out, out))
        return np.divide(out, length[:, None], out=np.zeros_like(out), where=length[:, None] > 0)

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of every row of the files that has one of a row's ids; ``ids``: rows of ids."""
        flat = ids.ravel()
        low, high = np.searchsorted(self.sorted_ids, flat, side="left"), np.searchsorted(self.sorted_ids, flat, side="right")
        n = high - low
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(flat)) // max(1, ids.shape[1]), n), self.by_id[np.repeat(low, n) + inside]

    def products(self, units: np.ndarray, spans: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, cosines in single precision with every unit row) of spans (file, first place in it, places from there or a slice)."""
        a = np.ascontiguousarray(units, np.float32)
        last, x = None, None
        for k, at, cols in spans:
            if k != last:
                last, x = k, self.stored(k)
            places = self.starts[k] + at + (np.arange(cols.start, cols.stop, cols.step or 1) if isinstance(cols, slice) else cols)
            part = x[at:][cols]
            if not part.shape[1]:
                continue
            d = a @ part.astype(np.float32, copy=False).T
            d *= self.inverse32[places]
            yield places, d

    def cosines(self, units: np.ndarray, r: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Cosines of pairs in double, 12 decimals: copies tie wherever they stand."""
        out = np.empty(len(r))
        for at in range(0, len(r), EXACT):
            part = slice(at, at + EXACT)
            out[part] = np.einsum("ij,ij->i", units[r[part]], self.units(places[part]))
        return np.round(out, 12)
