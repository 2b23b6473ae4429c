"""What runs need: the shared folder, and the package itself on Python workers."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local master may do without it; on a cluster a folder of one machine
    would hold what others must read, so an unset name is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "/tmp/checkpoints/weftline"
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors where they would not find it themselves."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {os.getcwd()}
    if root in known or getattr(spark.sparkContext, "_weftline_shipped", False):
        return
    import tempfile
    import zipfile

    path = os.path.join(tempfile.mkdtemp(), "weftline_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "weftline")):
            for x in names:
                if x.endswith(".py"):
                    z.write(os.path.join(folder, x), os.path.relpath(os.path.join(folder, x), root))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._weftline_shipped = True
    if path in sys.path:
        sys.path.remove(path)
