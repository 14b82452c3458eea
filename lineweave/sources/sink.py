"""Results as one line-feed-terminated file, staged beside its place and published at once."""

from __future__ import annotations

import contextlib
import os
import secrets
import shutil
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import BinaryIO

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lineweave.sources.shared import Scratch


class PublishError(OSError):
    """The finished file could not take its place."""


@contextlib.contextmanager
def staging(destination: str) -> Iterator[str]:
    """A fresh ``<destination>.<8 hex>.partial``; gone afterwards unless it was moved."""
    for _ in range(8):
        path = f"{destination}.{secrets.token_hex(4)}.partial"
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o666))
            break
        except FileExistsError:
            continue
    else:
        raise FileExistsError(f"no free staging name beside {destination}")
    try:
        yield path
    finally:
        with contextlib.suppress(OSError):
            os.unlink(path)


@contextlib.contextmanager
def work_folder(parent: str) -> Iterator[str]:
    """A private folder for part files, removed on every exit."""
    path = os.path.join(parent, f"sorter-{os.getpid()}-{secrets.token_hex(4)}")
    os.makedirs(path)
    try:
        yield path
    finally:
        shutil.rmtree(path, ignore_errors=True)


def write_parts(df: DataFrame, folder: str, line: str = "line") -> tuple[int, int]:
    """Part files in partition order; returns the lines and bytes that the tasks wrote, as they
    counted them. Bytes pass unchanged; any store that Spark writes will do."""
    seen = Observation()
    size = F.coalesce(F.sum(F.octet_length(line).cast("long") + 1), F.lit(0)).alias("bytes")
    counted = df.select(line).observe(seen, F.count("*").alias("lines"), size)
    counted.select(F.col(line).cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(folder)
    try:
        found = seen.get
    except Py4JJavaError:  # a plan that turned out empty has no metrics
        found = {}
    return found.get("lines", 0), found.get("bytes", 0)


def _append(spark: SparkSession, folder: str, work: str, out: BinaryIO) -> list[int]:
    """Appends the part files of a folder, in their order; a store that is not local is fetched file
    by file. Returns the bytes that the store says each has."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((f for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    sizes = []
    for part in parts:
        sizes.append(part.getLen())
        local = part.getPath().toUri().getPath() if fs.getScheme() == "file" else os.path.join(work, "part")
        if fs.getScheme() != "file":
            fs.copyToLocalFile(False, part.getPath(), jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(local)}"), True)
        with open(local, "rb") as f:
            shutil.copyfileobj(f, out, 1 << 20)
        fs.delete(part.getPath(), False)
    return sizes


def publish(df: DataFrame, destination: str, temp: str, line: str = "line", accept: Callable[[], None] | None = None, told: Callable[[list[int]], None] | None = None) -> int:
    """Writes an ordered DataFrame's lines to one file on the driver's disk; returns its bytes.

    Tasks write ordered part files: below ``temp`` if they run on this machine, else in the folder
    that the cluster shares. The driver appends them in order to a staging file. Only if that has
    exactly the bytes that the tasks counted is it renamed to ``destination``; whatever else is there, parts
    that went missing among it, raises. ``accept`` runs once the parts are written and may still
    raise; ``told`` gets the bytes of each part. An existing result stays untouched until then, and a
    link is replaced, not followed.
    Where one file is not wanted, ``write_parts`` is the distributed end of the sort.
    """
    spark = df.sparkSession
    os.makedirs(temp, exist_ok=True)
    near = spark.sparkContext.master.split("[")[0] == "local"
    with work_folder(temp) as work, staging(destination) as partial, contextlib.ExitStack() as stack:
        if near:
            parts = (Path(work).absolute() / "parts").as_uri()
        else:
            shared = Scratch(spark, "parts")
            stack.callback(shared.release)
            parts = shared.path("parts")
        lines, size = write_parts(df, parts, line)
        if accept is not None:
            accept()
        with open(partial, "wb") as out:
            sizes = _append(spark, parts, work, out)
        listed, there = sum(sizes), os.path.getsize(partial)
        if not there == listed == size:
            raise OSError(f"the tasks wrote {lines} lines of {size} bytes, their files have {listed}, and {there} arrived in {partial}; {destination} stays as it was")
        try:
            os.replace(partial, destination)
        except OSError as e:
            raise PublishError(str(e)) from e
        if told is not None:
            told(sizes)
        return size
