"""Makes this package importable in Python workers that would not find it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Sends the package to the executors once a session, unless PYTHONPATH or (on one machine) the folder has it."""
    sc = spark.sparkContext
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.applicationId in _shipped or os.path.realpath(_ROOT) in known or sc.master.startswith("local[") and os.path.realpath(os.getcwd()) == os.path.realpath(_ROOT):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="quillrake-"), "quillrake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "quillrake")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), _ROOT))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
