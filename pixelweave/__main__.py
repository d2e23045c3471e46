"""Command line: optimise a file, or a folder of files on a cluster."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pixelweave.operators import compress
from pixelweave.sources import png, sink


def bounded(low: int, high: int):
    def number(text: str) -> int:
        value = int(text) if text.isascii() and text.isdigit() else -1
        if not low <= value <= high:
            raise argparse.ArgumentTypeError(f"not a number from {low} to {high}: {text}")
        return value

    return number


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: bad arguments; 2: unreadable input; 3: the output can't be written."""
    p = argparse.ArgumentParser(prog="pixelweave", description=__doc__)
    p.add_argument("-o", dest="level", type=bounded(0, 9), default=9, help="effort")
    p.add_argument("-j", dest="threads", type=bounded(0, 1024), default=0, help="local Spark threads for folders, 0: all")
    p.add_argument("-s", dest="single", action="store_true", help="one strategy only")
    p.add_argument("-v", dest="verbose", action="store_true")
    p.add_argument("--strip", action="store_true", help="drop metadata")
    p.add_argument("input")
    p.add_argument("output")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    if Path(a.input).is_dir():
        return _folder(a)
    original = sink.read_file(a.input)
    try:
        image = png.read(original)
    except png.Rejected as e:
        print(f"{a.input}: {e}", file=sys.stderr)
        return 2
    result = compress.compress(image, compress.CompressOptions(a.level, a.strip, multi=not a.single))
    kept = compress.keep_original(original, result.data)
    if a.verbose:
        print("\n".join([*image.warnings, f"{result.pixel_bytes} pixel bytes, {result.strategy}"]))
    try:
        if kept is not original or Path(a.input).resolve() != Path(a.output).resolve():
            sink.replace_file(a.output, kept)
    except OSError as e:
        print(f"{a.output}: {e}", file=sys.stderr)
        return 3
    print(f"{'Kept' if kept is original else 'Wrote'} {a.output}: {len(original)} to {len(kept)} bytes ({100 - 100 * len(kept) / len(original):.1f} % saved)")
    return 0


def _folder(a: argparse.Namespace) -> int:
    """All files of a folder and its subfolders; files that can't be read are named, the others are done."""
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from pixelweave.plans import optimise
    from pixelweave.sources.staging import staged

    spark = SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{a.threads or '*'}]").appName("pixelweave").getOrCreate()
    found = staged(optimise.optimise(png.files(spark, a.input), a.level, a.strip, multi=not a.single), "results")
    try:
        sink.write_files(found, a.output, root=a.input)
    except (OSError, ValueError, PySparkException) as e:
        print(f"{a.output}: {e}", file=sys.stderr)
        return 3
    if a.verbose:
        for r in found.select("path", "status", "strategy", "original_bytes", "encoded_bytes").orderBy("path").toLocalIterator():
            print(f"{r['path']}: {r['status']}, {r['original_bytes']} to {r['encoded_bytes']} bytes, {r['strategy']}")
    for r in optimise.totals(found).orderBy("status").collect():
        print(f"{r['status']}: {r['files']} files, {r['before']} to {r['after']} bytes")
    failed = 0
    for r in found.where(F.col("status") == "failed").select("path", "error").toLocalIterator():
        failed += 1
        print(f"{r['path']}: {r['error']}", file=sys.stderr)
    return 2 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
