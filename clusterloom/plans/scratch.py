"""Cutting lineage through files that the driver and all executors share.

Iterative plans and results that are read twice are written to a folder below
``spark.checkpoint.dir``.  A lost executor then costs a re-read, not a re-run, and the plan that
follows starts at a scan.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where that is unset and all runs in one process.

    On a cluster a folder of the driver's machine is none of the executors', so there the setting is needed.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="clusterloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: whether Spark deletes the shuffle files of a statement at its end
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """What is written inside runs with these settings of the session; __ stands for a dot."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    was = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shuffles_freed(spark: SparkSession) -> AbstractContextManager:
    """What is written inside leaves no shuffle files; else they lie on the disk until the driver collects its garbage."""
    return settings(spark, **{FREE_SHUFFLES: "true"})


class Scratch:
    """Named Parquet tables of one run, in a folder of its own under the shared folder.

    ``save`` writes a frame and returns it as a scan; ``drop`` deletes a table that no later plan
    reads.  Tables that a returned DataFrame still reads are left to the owner of the folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._step = 0
        self._paths: dict[str, str] = {}
        self._inner: list[Scratch] = []

    def inner(self, label: str) -> Scratch:
        """A scratch of one step of the run, in a folder below; it goes with this one's `keep_only` and `drop_all`."""
        found = Scratch(self.spark, label)
        found.root = f"{self.root}/{found.root.rsplit('/', 1)[1]}"
        self._inner.append(found)
        return found

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write `df` as table `name` (replacing an older version) and return it read back."""
        self._step += 1
        path = f"{self.root}/{name}-{self._step}"
        with shuffles_freed(self.spark):
            df.write.option("compression", compression).parquet(path)
        old, self._paths[name] = self._paths.get(name), path
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        if path := self._paths.pop(name, None):
            self._delete(path)

    def keep_only(self, *names: str) -> None:
        """Drop all tables but these, those of inner scratches too, once nothing else is read any more."""
        for step in self._inner:
            step.drop_all()
        self._inner = []
        for name in [n for n in self._paths if n not in names]:
            self.drop(name)

    def drop_all(self) -> None:
        """Delete the folder, once no result that reads it is used any more."""
        self._delete(self.root)
        self._paths, self._inner = {}, []

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
