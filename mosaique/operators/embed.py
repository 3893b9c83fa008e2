"""Embeddings of images by a pluggable backend.

A backend is made once in each Python worker, which later tasks use again. A batch that fails is tried again image by image; an image that
fails alone has a null vector and an error, and the rest go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import ModelConfig, ModelInfo, Settings, chunk_size, input_side
from . import media


class Backend(Protocol):
    """extract gives all tokens' output or the class token of some images, a row for each."""

    def load(self, path: str | None) -> None: ...
    def extract(self, images: list[bytes]) -> np.ndarray: ...
    def info(self) -> ModelInfo: ...


class HistogramBackend:
    """A stand-in without weights: the mean and shades of coarse tiles. Alike images have alike vectors."""

    def __init__(self, config: ModelConfig):
        self.config = config

    def load(self, path: str | None) -> None:
        pass

    def extract(self, images: list[bytes]) -> np.ndarray:
        tiles = 8
        out = np.zeros((len(images), self.config.hidden), dtype=np.float32)
        for i, data in enumerate(images):
            small = media.resize(media.decode(data), tiles, tiles).astype(np.float32) / 255 + 1e-3
            flat = small.ravel()
            out[i] = np.resize(flat, self.config.hidden)
        return out

    def info(self) -> ModelInfo:
        return ModelInfo("histogram", "numpy", self.config)


class OnnxBackend:
    """An ONNX model whose first input takes (n, 3, height, width) and whose first output is used. Where the file
    fixes height and width, images have these. A session uses one thread unless told otherwise, as a task for each
    core runs beside it."""

    #: Providers in the order they are tried.
    PROVIDERS = ["TensorrtExecutionProvider", "CUDAExecutionProvider", "DmlExecutionProvider", "CPUExecutionProvider"]

    def __init__(self, config: ModelConfig, threads: int = 1):
        self.config, self.threads, self.session, self.path = config, threads, None, None

    def load(self, path: str | None) -> None:
        import onnxruntime

        if not path:
            raise ValueError("a model file is needed")
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = self.threads
        there = [p for p in self.PROVIDERS if p in onnxruntime.get_available_providers()]
        self.session, self.path = onnxruntime.InferenceSession(path, options, providers=there), path
        sides = self.session.get_inputs()[0].shape[2:]
        if len(sides) == 2 and all(isinstance(x, int) for x in sides):
            self.config = replace(self.config, height=sides[0], width=sides[1])

    def extract(self, images: list[bytes]) -> np.ndarray:
        tensors = np.stack([media.preprocess(media.decode(x), self.config) for x in images])
        first = self.session.get_inputs()[0].name
        out = self.session.run(None, {first: tensors})[0]
        return out.reshape(len(images), -1)

    def info(self) -> ModelInfo:
        kind = "Q4" if self.path and "q4" in self.path.lower() else "F32"
        return ModelInfo(self.path or "", "onnx", self.config, kind)


def pooled(vectors: np.ndarray, settings: Settings) -> np.ndarray:
    """The class token unless all tokens are kept, at unit length; tiny vectors stay."""
    if not settings.full:
        vectors = vectors[:, : settings.model.hidden]
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (vectors / np.where(norms > 1e-12, norms, 1.0)).astype(np.float32)


def extract_all(backend: Backend, images: list[bytes | None]) -> tuple[list[np.ndarray | None], list[str | None]]:
    """A vector or an error for each image."""
    out: list[np.ndarray | None] = [None] * len(images)
    errors: list[str | None] = [None if x is not None else "unreadable" for x in images]
    there = [i for i, x in enumerate(images) if x is not None]
    try:
        found = backend.extract([images[i] for i in there]) if there else []
        for i, v in zip(there, found, strict=True):
            out[i] = v
    except Exception:  # one bad image must not take the batch with it
        for i in there:
            try:
                out[i] = backend.extract([images[i]])[0]
            except Exception as error:
                errors[i] = str(error) or type(error).__name__
    return out, errors


#: The backend that this worker made last, and what it was made from.
_MADE: dict[tuple, Backend] = {}


def backend_for(make: Callable[[ModelConfig], Backend], config: ModelConfig, path: str | None) -> Backend:
    """The backend of a maker, a model and a file, kept for the worker's next tasks. One that is made by a function
    without a name of its own is not kept."""
    named = getattr(make, "__qualname__", "<")
    key = (getattr(make, "__module__", ""), named, config, path)
    if key not in _MADE:
        made = make(config)
        made.load(path)
        _MADE.clear()
        if "<" in named:
            return made
        _MADE[key] = made
    return _MADE[key]


def embed(rows: DataFrame, make: Callable[[ModelConfig], Backend], settings: Settings, model_path: str | None = None, content: str = "content") -> DataFrame:
    """rows with `features` and `error` in place of the bytes in content."""
    names = [c for c in rows.columns if c not in (content, "features", "error")]
    size = chunk_size(input_side(settings.tier, settings.model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = backend_for(make, settings.model, model_path)
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                vectors, errors = extract_all(backend, part.column(0).to_pylist())
                vectors = [None if v is None else pooled(v[None], settings)[0] for v in vectors]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], [*names, "features", "error"])

    from pyspark.sql.types import ArrayType, FloatType

    schema = rows.select(*names).schema.add("features", ArrayType(FloatType())).add("error", "string")
    return rows.select(content, *names).mapInArrow(run, schema)
