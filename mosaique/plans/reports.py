"""Answers as JSON documents, text reports and dumps. The documents' field names are fixed values."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from .engine import Extracted


def _rows(df: DataFrame, *names: str) -> list[dict]:
    """The rows of an answer that a user asked to see; they come a partition at a time."""
    return [{n: r[n] for n in names} for r in df.select(*names).toLocalIterator()]


def scan_document(folder: str, rows: DataFrame, seconds: float) -> dict:
    images = _rows(rows, "path", "file_name", "file_size", "modified")
    return {"folder": folder, "count": len(images), "elapsed_secs": seconds, "images": images}


def extract_document(folder: str, found: Extracted, dim: int) -> dict:
    return {
        "folder": folder,
        "count": found.hits + found.misses - found.failed,
        "cache_hits": found.hits,
        "cache_misses": found.misses,
        "images_per_second": found.images_per_second,
        "elapsed_secs": found.seconds,
        "feature_dim": dim,
    }


def similar_document(source: str, folder: str, threshold: float, rows: DataFrame, seconds: float, cache_only: bool) -> dict:
    results = _rows(rows, "path", "file_name", "similarity")
    return {"source": source, "folder": folder, "threshold": threshold, "count": len(results), "elapsed_secs": seconds, "cache_only": cache_only, "results": results}


def compare_document(sources: str, targets: str, threshold: float, rows: DataFrame, seconds: float, cache_only: bool) -> dict:
    matches = _rows(rows, "target_path", "target_file_name", "best_similarity")
    return {"source_folder": sources, "target_folder": targets, "threshold": threshold, "count": len(matches), "elapsed_secs": seconds, "cache_only": cache_only, "matches": matches}


def stats_document(folder: str, stats: DataFrame) -> dict:
    row = stats.first()
    return {"folder": folder, "cached_count": row["cached_count"], "cache_size_bytes": row["cache_size_bytes"], "is_valid": row["is_valid"]}


def clear_document(folder: str, cleared: bool) -> dict:
    return {"folder": folder, "cleared": cleared}


#: Fixed value: a line of a text report.
LINE = "{:>3}. {:.4f}  {}"


def listing(results: list[dict], path: str, similarity: str) -> list[str]:
    return [LINE.format(i, r[similarity], r[path]) for i, r in enumerate(results, 1)]


def dump(rows: DataFrame, dim: int, path: str) -> None:
    """One JSON file: feature_dim and a list of [path, vector]. Rows are written as they come."""
    with open(path, "w", encoding="utf-8") as out:
        out.write('{"feature_dim": %d, "images": [' % dim)
        for i, r in enumerate(rows.select("path", "features").toLocalIterator()):
            out.write((", " if i else "") + json.dumps([r["path"], list(r["features"])]))
        out.write("]}")
