"""clusterloom: density clustering of point data, expressed as Spark DataFrame plans."""

import os
from pathlib import Path


def let_workers_import() -> None:
    """Put this package's folder on the path of Python workers that see the same file system.

    A session started later inherits the environment; a running one is told.  Where executors have no
    such path, ship the package with --py-files.
    """
    root = str(Path(__file__).resolve().parents[1])
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    from pyspark import SparkContext

    running = SparkContext._active_spark_context
    if running is not None:
        running.environment["PYTHONPATH"] = os.environ["PYTHONPATH"]


let_workers_import()
