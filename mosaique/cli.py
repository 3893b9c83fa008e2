"""Command line: scan, extract, similar, compare, cache. Exit codes: 0 done, 1 failed, 2 wrong usage."""

from __future__ import annotations

import argparse
import json
import sys
import time

from .config import Settings
from .plans import reports
from .plans.engine import Engine, NeedsModel


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mosaique")
    p.add_argument("--json", action="store_true", help="answer with a JSON document")
    p.add_argument("--quiet", action="store_true", help="no progress on stderr")
    p.add_argument("--cache-root", help="where caches are kept; in each folder if left out")
    p.add_argument("--backend", choices=["tiles", "onnx", "numpy"], help="what makes the vectors; that of the first model file found if left out, else tiles")
    p.add_argument("--model", help="a model file (.onnx or .safetensors)")
    p.add_argument("--tier", choices=["fast", "ultra", "high"], help="the side of the images that the numpy backend takes")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "extract"):
        c = sub.add_parser(name)
        c.add_argument("folder")
        c.add_argument("--recursive", action=argparse.BooleanOptionalAction, default=True)
        if name == "extract":
            c.add_argument("--dump", help="write all vectors to a JSON file")
    c = sub.add_parser("similar")
    c.add_argument("source")
    c.add_argument("folder")
    c.add_argument("--threshold", type=float, default=0.9)
    c.add_argument("--limit", type=int, default=0, help="0 for all")
    c = sub.add_parser("compare")
    c.add_argument("source_folder")
    c.add_argument("target_folder")
    c.add_argument("--threshold", type=float, default=0.9)
    c = sub.add_parser("cache")
    c.add_argument("action", choices=["stats", "clear"])
    c.add_argument("folder")
    return p


class Throttle:
    """Prints progress at most every two seconds."""

    def __init__(self, quiet: bool):
        self.quiet, self.last = quiet, 0.0

    def __call__(self, message: str, total: int, processed: int, hits: int, misses: int) -> None:
        if not self.quiet and (time.time() - self.last >= 2 or processed == total):
            self.last = time.time()
            print(message, file=sys.stderr)

    def scanned(self, found: int, seconds: float) -> None:
        if not self.quiet and time.time() - self.last >= 2:
            self.last = time.time()
            print(f"{found} images, {seconds:.2f} s", file=sys.stderr)


def answer(engine: Engine, args: argparse.Namespace) -> tuple[dict, list[str]]:
    """The JSON document and the lines of the text report."""
    began = time.time()
    if args.command == "scan":
        doc = reports.scan_document(args.folder, engine.scan(args.folder, args.recursive, getattr(engine.progress, "scanned", None)), time.time() - began)
        return doc, [f"{doc['count']} images", *(i["path"] for i in doc["images"])]
    if args.command == "extract":
        found = engine.extract(args.folder, args.recursive)
        if args.dump:
            reports.dump(found.rows, engine.dim, args.dump)
        doc = reports.extract_document(args.folder, found, engine.dim)
        return doc, [f"{doc['count']} images, {doc['cache_hits']} cached, {doc['images_per_second']:.1f} images a second"]
    if args.command == "cache":
        if args.action == "clear":
            doc = reports.clear_document(args.folder, engine.clear_cache(args.folder))
            return doc, ["cleared" if doc["cleared"] else "no cache"]
        doc = reports.stats_document(args.folder, engine.cache_stats(args.folder))
        return doc, [f"{doc['cached_count']} vectors, {doc['cache_size_bytes'] / 1048576:.1f} MB"]
    cached = True
    if args.command == "similar":
        rows = engine.similar(args.source, args.folder, args.threshold, args.limit, cache_only=True)
        if isinstance(rows, NeedsModel):
            cached, rows = False, engine.similar(args.source, args.folder, args.threshold, args.limit)
        doc = reports.similar_document(args.source, args.folder, args.threshold, rows, time.time() - began, cached)
        return doc, [f"{doc['count']} similar images", *reports.listing(doc["results"], "path", "similarity")]
    rows = engine.compare(args.source_folder, args.target_folder, args.threshold, cache_only=True)
    if isinstance(rows, NeedsModel):
        cached, rows = False, engine.compare(args.source_folder, args.target_folder, args.threshold)
    doc = reports.compare_document(args.source_folder, args.target_folder, args.threshold, rows, time.time() - began, cached)
    return doc, [f"{doc['count']} matches", *reports.listing(doc["matches"], "target_path", "best_similarity")]


def main(argv: list[str] | None = None, engine: Engine | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if engine is None:
            from .session import local

            spark = local()
            spark.sparkContext.setLogLevel("ERROR")
            engine = Engine(spark, cache_root=args.cache_root)
            chosen = Settings.from_environment()
            said = engine.load_model(args.backend, args.model, args.tier or chosen.tier, chosen.full)
            if not args.quiet:
                print(said if engine.model_path else "no model file found: images are compared by the averages of tiles", file=sys.stderr)
        elif args.backend or args.model or args.tier:
            engine.load_model(args.backend, args.model, args.tier or engine.settings.tier, engine.settings.full)
        engine.progress = Throttle(args.quiet)
        doc, lines = answer(engine, args)
    except (OSError, ValueError, RuntimeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    print(json.dumps(doc, ensure_ascii=False) if args.json else "\n".join(lines))
    return 0


if __name__ == "__main__":
    sys.exit(main())
