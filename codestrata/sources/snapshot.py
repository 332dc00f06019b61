"""Snapshots of a scanned workspace on disk, valid while no source file changes.

A snapshot is a folder named by the fingerprint: one Parquet dataset for each relation and a meta file that is
written last. It is made under a temporary name and renamed, so readers see all of it or nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codestrata.operators.schema import SCHEMAS

VERSION = 1


def default_folder() -> str:
    base = os.environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), ".cache")
    if not os.access(os.path.dirname(base) or "/", os.W_OK):
        base = tempfile.gettempdir()
    return os.path.join(base, "codestrata")


def fingerprint(folder: str, include_tests: bool = False, with_module_file: bool = False) -> str:
    """SHA-256 over the folder and, of each source file and go.sum, path, time and size; vendored and hidden folders
    below the root don't count. with_module_file adds go.mod."""
    root = os.path.abspath(folder)
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    lines = []
    for at, folders, names in os.walk(root):
        folders[:] = [d for d in folders if d != "vendor" and not d.startswith(".")]
        for name in names:
            if name.endswith(".go") or name == "go.sum" or with_module_file and name == "go.mod":
                path = os.path.join(at, name)
                found = os.stat(path)
                lines.append(f"{os.path.relpath(path, root).replace(os.sep, '/')}\t{found.st_mtime_ns}\t{found.st_size}\n")
    head = f"dir:{root}\n" + ("tests\n" if include_tests else "")
    return hashlib.sha256((head + "".join(sorted(lines))).encode()).hexdigest()


def write(frames: dict[str, DataFrame], path: str) -> None:
    work = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        os.makedirs(work, mode=0o700)
        counts = {}
        for name, frame in frames.items():
            frame.write.parquet(f"file://{work}/{name}")
            counts[name] = frame.sparkSession.read.parquet(f"file://{work}/{name}").count()
        with open(f"{work}/meta.json", "w") as f:
            json.dump({"version": VERSION, "counts": counts}, f)
        shutil.rmtree(path, ignore_errors=True)
        os.rename(work, path)
    finally:
        shutil.rmtree(work, ignore_errors=True)


def read(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The relations of a snapshot; None if it is absent, broken or of another version."""
    try:
        with open(f"{path}/meta.json") as f:
            meta = json.load(f)
        if meta["version"] != VERSION:
            return None
        frames = {}
        for name, schema in SCHEMAS.items():
            frame = spark.read.schema(schema).parquet(f"file://{path}/{name}")
            if frame.count() != meta["counts"][name]:
                return None
            frames[name] = frame
        return frames
    except Exception:
        return None


def cached(
    spark: SparkSession, folder: str, where: str, parse: Callable[[], dict[str, DataFrame]], report: Callable[[str], None] = lambda message: None, include_tests: bool = False
) -> dict[str, DataFrame]:
    """The relations from the snapshot in where, or parsed and kept there. Trouble with the cache is reported, never fatal."""
    try:
        path = os.path.join(where, fingerprint(folder, include_tests))
    except OSError as e:
        report(f"no fingerprint, so no cache: {e}")
        return parse()
    found = read(spark, path)
    if found is not None:
        report("loaded from the disk cache")
        return found
    frames = parse()
    try:
        os.makedirs(where, mode=0o700, exist_ok=True)
        write(frames, path)
    except Exception as e:
        report(f"the snapshot could not be written: {e}")
    return frames
