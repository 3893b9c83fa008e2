"""The engine: scan, extract, similar, compare, cache and thumbnails over folders of images."""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings, model_for, settings_for
from ..functions import files as messages
from ..functions.files import normal_path
from ..operators import cache as caches
from ..operators import embed, media, similarity, vit
from ..operators.cache import FeatureCache
from ..sources import catalog
from ..storage import stored

#: Backends that need a model file, and the name of the one that needs none.
BACKENDS, TILES = {"onnx": embed.OnnxBackend, "numpy": vit.NumpyBackend}, "tiles"
#: Snapshots that stay in memory.
SNAPSHOTS = 4


@dataclass
class NeedsModel:
    """A cache-only query that the cache cannot answer, and for how many images."""

    misses: int


@dataclass
class Snapshot:
    """A folder's vectors as they were at one version of its cache."""

    rows: DataFrame
    version: str | None
    dim: int
    loaded_at: float


class SnapshotRegistry:
    """Persisted folders, the oldest of which gives way when a new folder comes. Replacing a folder evicts no other."""

    def __init__(self, most: int = SNAPSHOTS):
        self.most = most
        self._held: dict[str, Snapshot] = {}

    def put(self, folder: str, snapshot: Snapshot) -> None:
        self.drop(folder)
        if len(self._held) >= self.most:
            self.drop(min(self._held, key=lambda f: self._held[f].loaded_at))
        snapshot.rows.persist()
        self._held[folder] = snapshot

    def get(self, folder: str, version: str | None, dim: int) -> Snapshot | None:
        """A snapshot of this version and length; a stale one is dropped."""
        found = self._held.get(folder)
        if found and (found.version != version or found.dim != dim):
            self.drop(folder)
            return None
        return found

    def drop(self, folder: str) -> None:
        if found := self._held.pop(folder, None):
            found.rows.unpersist()

    def __len__(self) -> int:
        return len(self._held)

    def __contains__(self, folder: str) -> bool:
        return folder in self._held


@dataclass
class Extracted:
    rows: DataFrame
    hits: int
    misses: int
    failed: int
    seconds: float

    @property
    def images_per_second(self) -> float:
        return (self.hits + self.misses) / max(self.seconds, 1e-9)


@dataclass
class Engine:
    """make builds the backend in each worker; None means that no model can be loaded. Progress calls get
    (message, total, processed, hits, misses)."""

    spark: SparkSession
    settings: Settings = field(default_factory=Settings)
    make: Callable | None = embed.HistogramBackend
    model_path: str | None = None
    cache_root: str | None = None
    legacy_keys: bool = False
    progress: Callable[[str, int, int, int, int], None] = lambda *_: None

    def __post_init__(self) -> None:
        self.snapshots = SnapshotRegistry()

    @property
    def dim(self) -> int:
        return self.settings.feature_length

    def cache(self, folder: str) -> FeatureCache:
        """A folder's cache, in the folder or below cache_root."""
        if not self.cache_root:
            return FeatureCache(self.spark, f"file://{os.path.abspath(folder)}/.mosaique-cache")
        name = hashlib.sha256(os.path.abspath(folder).encode()).hexdigest()[:24]
        return FeatureCache(self.spark, f"{self.cache_root.rstrip('/')}/{name}")

    def _keys(self) -> dict[str, str]:
        return {} if self.legacy_keys else {"model_id": self.settings.model_id, "tier": self.settings.tier}

    def scan(self, folder: str, recursive: bool = True, progress: Callable[[int, float], None] | None = None) -> DataFrame:
        return catalog.scan(self.spark, folder, recursive, progress)

    def _entries(self, folder: str, recursive: bool = True) -> DataFrame:
        """The catalog with the identity that the cache is keyed by, listed once."""
        return stored(self.scan(folder, recursive).withColumn("last_modified", F.col("filetime")), "entries")

    def _embedded(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """Vectors of images that the cache lacks, and how many failed."""
        if self.make is None:
            raise RuntimeError("no model is loaded")
        made = stored(embed.embed(catalog.contents(rows.drop("features")), self.make, self.settings, self.model_path), "embedded")
        failed = made.filter("features IS NULL").count()
        return made.filter("features IS NOT NULL").drop("error"), failed

    def _resolved(self, folder: str, recursive: bool = True) -> tuple[DataFrame, DataFrame, int, int]:
        """Hits, misses and their numbers."""
        entries, cached = self._entries(folder, recursive), self.cache(folder).rows()
        both = stored(caches.split(entries, cached, self.dim, **self._keys()), "resolved")
        hits, misses = both.filter("features IS NOT NULL"), both.filter("features IS NULL")
        return hits, misses, hits.count(), misses.count()

    def extract(self, folder: str, recursive: bool = True) -> Extracted:
        """A vector for each image, from the cache or freshly made and then cached, in order of file_name."""
        began = time.time()
        hits, misses, n_hits, n_misses = self._resolved(folder, recursive)
        total = n_hits + n_misses
        self.progress(messages.LOADED % (n_hits, total, n_misses), total, n_hits, n_hits, n_misses)
        rows, failed = hits, 0
        if n_misses:
            fresh, failed = self._embedded(misses)
            self.cache(folder).store(fresh.select("path", "file_name", "file_size", "last_modified", "features"), self.settings.model_id, self.settings.tier)
            rows = caches.merged(hits, fresh.select(*hits.columns))
        seconds = time.time() - began
        self.progress(messages.EXTRACTED % (total, n_hits, n_misses, total / max(seconds, 1e-9)), total, total, n_hits, n_misses)
        return Extracted(rows.orderBy("file_name", "path"), n_hits, n_misses, failed, seconds)

    def _query_vector(self, source: str, folder_rows: DataFrame, folder: str) -> list[float] | None:
        """The query's vector: from the folder, from the cache if the file is unchanged, else None."""
        size, modified = catalog.file_identity(source)
        in_folder = folder_rows.filter(normal_path(F.col("path")) == normal_path(F.lit(source)))
        cached = self.cache(folder).load(self.dim).filter((normal_path(F.col("path")) == normal_path(F.lit(source))) & (F.col("file_size") == size) & (F.col("last_modified") == modified))
        for name, value in self._keys().items():
            cached = cached.filter(F.col(name) == value)
        return similarity.first_vector([in_folder, cached])

    def _embed_one(self, source: str, folder: str) -> list[float]:
        """Embeds a query image and stores it in the folder's cache."""
        size, modified = catalog.file_identity(source)
        row = self.spark.createDataFrame([(source, os.path.basename(source), size, modified)], "path string, file_name string, file_size long, last_modified long")
        fresh, failed = self._embedded(row)
        if failed:
            raise ValueError(f"cannot decode {source}")
        self.cache(folder).store(fresh, self.settings.model_id, self.settings.tier)
        return list(fresh.first()["features"])

    def similar(self, source: str, folder: str, threshold: float = 0.9, limit: int = 0, cache_only: bool = False) -> DataFrame | NeedsModel:
        """Images of a folder that are like one image; always with all folders below."""
        if not os.path.isfile(source):
            raise FileNotFoundError(source)
        hits, misses, _, n_misses = self._resolved(folder)
        query = self._query_vector(source, hits, folder)
        inside = misses.filter(normal_path(F.col("path")) == normal_path(F.lit(source))).limit(1).count()
        needed = n_misses + (1 if query is None and not inside else 0)
        if cache_only and needed:
            return NeedsModel(needed)
        rows = self.extract(folder).rows if n_misses else hits
        query = query or self._query_vector(source, rows, folder) or self._embed_one(source, folder)
        self.snapshots.put(folder, Snapshot(rows, self.cache(folder).identity(), self.dim, time.time()))
        return similarity.similar(rows, query, source, threshold, limit)

    def similar_in_snapshot(self, source: str, folder: str, threshold: float = 0.9, limit: int = 0) -> DataFrame | None:
        """The same from memory; None if the folder is not held at the cache's version or the image is not in it as
        it is now."""
        held = self.snapshots.get(folder, self.cache(folder).identity(), self.dim)
        if held is None or not os.path.isfile(source):
            return None
        size, modified = catalog.file_identity(source)
        row = held.rows.filter((normal_path(F.col("path")) == normal_path(F.lit(source))) & (F.col("file_size") == size) & (F.col("last_modified") == modified)).select("features").limit(1).collect()
        return similarity.similar(held.rows, list(row[0]["features"]), source, threshold, limit) if row else None

    def compare(self, sources: str, targets: str, threshold: float = 0.9, cache_only: bool = False) -> DataFrame | NeedsModel:
        """The best match of each target image over all source images; always with all folders below."""
        if cache_only:
            left, right = self._resolved(sources), self._resolved(targets)
            if needed := left[3] + right[3]:
                return NeedsModel(needed)
            return similarity.compare(left[0], right[0], threshold)
        return similarity.compare(self.extract(sources).rows, self.extract(targets).rows, threshold)

    def cached_folder(self, folder: str) -> DataFrame | NeedsModel:
        """A folder's vectors if the cache has all of them."""
        hits, _, _, n_misses = self._resolved(folder)
        return NeedsModel(n_misses) if n_misses else hits.orderBy("file_name", "path")

    def cache_stats(self, folder: str) -> DataFrame:
        """cached_count, cache_size_bytes, is_valid, and valid_count: rows that an image of the folder has now."""
        found = self._resolved(folder)[2]
        return self.cache(folder).stats().withColumn("valid_count", F.lit(found).cast("long"))

    def clear_cache(self, folder: str) -> bool:
        self.snapshots.drop(folder)
        return self.cache(folder).clear()

    def thumbnails(self, folder: str, size: int = 150) -> DataFrame:
        return media.thumbnails(catalog.contents(self.scan(folder).select("path")), size)

    def load_model(self, backend: str | None = None, path: str | None = None, tier: str = "fast", full: bool = False) -> str:
        """Takes a backend and its model file; without a backend the first of onnx and numpy that finds a file, else
        the tiles, which need none. Says what was loaded."""
        if backend not in (None, TILES, *BACKENDS):
            raise ValueError(f"unknown backend: {backend}")
        if backend is None and path:
            backend = "numpy" if path.endswith(".safetensors") else "onnx"
        kinds = [backend] if backend else [*BACKENDS]
        kind, file = next(((k, f) for k in kinds if k in BACKENDS and (f := model_for(k, path))), (TILES, None))
        if backend in BACKENDS and not file:
            raise FileNotFoundError(f"no model file for {backend}")
        self.make, self.model_path = BACKENDS.get(kind, embed.HistogramBackend), file
        self.settings = settings_for(kind, file, tier, full)
        self.snapshots = SnapshotRegistry()
        return f"{kind} model loaded: {file or 'none needed'}"

    def backend_info(self) -> dict:
        if self.make is None:
            return {"loaded": False}
        info = self.make(self.settings.model).info()
        return {"loaded": True, "name": info.name, "backend": info.backend, "quantization": info.quantization, "feature_dim": self.dim}
