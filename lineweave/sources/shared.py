"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """A cluster without spark.checkpoint.dir: nothing written would be seen by all."""


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder if all tasks run in this process'
    machine, as in tests; on a cluster that is refused."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.split("[")[0] == "local":
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = tempfile.mkdtemp(prefix="lineweave-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


class Scratch:
    """Tables that cut lineage. Each is written once to the shared folder and read back.

    ``release()`` deletes them; a caller does so when the results that read them are written.
    What is never released goes when the interpreter ends.
    """

    _live: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/lineweave-{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._tables: dict[str, str] = {}
        Scratch._live.append(self)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self._tables[name] = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str) -> None:
        """Deletes a path below the scratch that nothing reads any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def forget(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            self.drop(self._tables.pop(name))

    def release(self) -> None:
        self.drop(self.root)
        if self in Scratch._live:
            Scratch._live.remove(self)

    @classmethod
    def live(cls) -> list[Scratch]:
        return list(cls._live)

    @classmethod
    def release_all(cls) -> None:
        for scratch in list(cls._live):
            try:
                scratch.release()
            except Exception:  # the session may be gone already; its folder is then left to its owner
                cls._live.remove(scratch)


atexit.register(Scratch.release_all)
