"""Stored tensors as rows. Their pickles are read with names of this module's own only, so nothing foreign is ever called."""

from __future__ import annotations

import io
import pickle
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format: storage names and their element types; bfloat16 is the upper half of a float32.
STORAGES = {
    "BFloat16Storage": "bfloat16", "BoolStorage": "?", "ByteStorage": "u1", "CharStorage": "i1", "DoubleStorage": "<f8", "FloatStorage": "<f4", "HalfStorage": "<f2", "IntStorage": "<i4", "LongStorage": "<i8", "ShortStorage": "<i2",
}
SCHEMA = "path string, name string, shape array<long>, values array<double>, error string"


class TensorError(ValueError):
    """A file that isn't a stored tensor, or refers to something that may not be read."""


class Storage(NamedTuple):
    kind: str
    key: str
    count: int


class Tensor(NamedTuple):
    storage: Storage
    offset: int
    shape: tuple
    strides: tuple


def _tensor(storage, offset, shape, strides, *_) -> Tensor:
    return Tensor(storage, offset, tuple(shape), tuple(strides))


class _Reader(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return _tensor
        if module == "torch" and name in STORAGES:
            return STORAGES[name]
        if (module, name) == ("collections", "OrderedDict"):
            return dict
        raise TensorError(f"{module}.{name} may not be read")

    def persistent_load(self, pid):
        kind, dtype, key, _, count = pid[:5]
        if kind != "storage":
            raise TensorError(f"unknown reference {kind}")
        return Storage(dtype, str(key), int(count))


def _elements(raw: bytes, storage: Storage) -> np.ndarray:
    dtype = np.dtype("<u2" if storage.kind == "bfloat16" else storage.kind)
    if len(raw) != storage.count * dtype.itemsize:
        raise TensorError(f"storage {storage.key} has {len(raw)} bytes")
    flat = np.frombuffer(raw, dtype)
    return (flat.astype(np.uint32) << 16).view(np.float32) if storage.kind == "bfloat16" else flat


def _array(t: Tensor, flat: np.ndarray) -> np.ndarray:
    last = t.offset + sum((n - 1) * s for n, s in zip(t.shape, t.strides, strict=True))
    if t.offset < 0 or any(s < 0 for s in t.strides) or (0 not in t.shape and last >= len(flat)):
        raise TensorError("a view beyond its storage")
    return np.lib.stride_tricks.as_strided(flat[t.offset :], t.shape, [s * flat.itemsize for s in t.strides])


def _named(node, name: str = "") -> Iterator[tuple[str, Tensor]]:
    if isinstance(node, Tensor):
        yield name, node
    elif isinstance(node, dict):
        for k, v in node.items():
            yield from _named(v, f"{name}.{k}" if name else str(k))
    elif isinstance(node, (list, tuple)):
        for k, v in enumerate(node):
            yield from _named(v, f"{name}[{k}]")


def tensors(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """(name, array) of each tensor of a file: an archive with an entry per storage, or the older form of pickles in a row."""
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            main = next((n for n in z.namelist() if n.rsplit("/", 1)[-1] == "data.pkl"), None)
            if main is None:
                raise TensorError("an archive without data.pkl")
            found = list(_named(_Reader(io.BytesIO(z.read(main))).load()))
            for name, t in found:
                yield name, _array(t, _elements(z.read(f"{main[: -len('data.pkl')]}data/{t.storage.key}"), t.storage))
        return
    stream = io.BytesIO(data)
    for _ in range(3):  # magic number, version, facts on the system
        _Reader(stream).load()
    found = list(_named(_Reader(stream).load()))
    kinds = {t.storage.key: t.storage for _, t in found}
    held = {}
    for key in _Reader(stream).load():
        count = int.from_bytes(stream.read(8), "little")
        if key in kinds:
            size = np.dtype("<u2" if kinds[key].kind == "bfloat16" else kinds[key].kind).itemsize
            held[key] = _elements(stream.read(count * size), kinds[key]._replace(count=count))
        else:
            raise TensorError(f"storage {key} has no tensor")
    for name, t in found:
        yield name, _array(t, held[t.storage.key])


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, shape, values, error) of every tensor below a folder, values in row-major order. A file that can't be read is one row with its error."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = [(file, n, list(a.shape), np.ascontiguousarray(a, np.float64).ravel(), None) for n, a in tensors(bytes(content))]
                except Exception as e:  # a damaged or foreign file is a row, not a failed job
                    rows = [(file, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "name", "shape", "values", "error"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, SCHEMA)
