"""Load timings of a module folder: ``python -m codestrata.report [--cache] DIR``."""

from __future__ import annotations

import argparse
import sys
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from .plans.workspace import Workspace, load_workspace


def load_report(spark: SparkSession, folder: str, out: Callable[[str], None] = print) -> Workspace:
    """Load a folder and tell the time of each step and of the whole."""
    began = last = time.perf_counter()

    def step(message: str) -> None:
        nonlocal last
        now = time.perf_counter()
        out(f"{message} (+{now - last:.3f} s, {now - began:.3f} s)")
        last = now

    ws = load_workspace(spark, folder, reporter=step)
    counts = {name: frame.count() for name, frame in ws.frames().items()}
    step(", ".join(f"{n} {c}" for n, c in counts.items()))
    return ws


def cache_report(spark: SparkSession, folder: str, where: str | None = None, out: Callable[[str], None] = print) -> dict[str, float]:
    """A cold and a warm load with one cache folder; their counts must agree."""
    where = where or tempfile.mkdtemp(prefix="codestrata-cache-")
    took, counts = {}, []
    for name in ("cold", "warm"):
        began = time.perf_counter()
        ws = load_workspace(spark, folder, disk_cache_dir=where)
        counts.append({n: f.count() for n, f in ws.frames().items()})
        took[name] = time.perf_counter() - began
        out(f"{name}: {took[name]:.3f} s")
    if counts[0] != counts[1]:
        raise AssertionError(f"the loads differ: {counts[0]} and {counts[1]}")
    return took


def main(args: list[str]) -> None:
    options = argparse.ArgumentParser(prog="codestrata.report")
    options.add_argument("--cache", action="store_true", help="compare a cold and a warm load")
    options.add_argument("folder", nargs="?", default=".")
    chosen = options.parse_args(args)
    spark = SparkSession.builder.appName("codestrata.report").getOrCreate()
    (cache_report if chosen.cache else load_report)(spark, chosen.folder)


if __name__ == "__main__":
    main(sys.argv[1:])
