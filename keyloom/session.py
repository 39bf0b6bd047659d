"""What a session needs before the library's Python functions can run on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application.

    Spark's own file server hands the archive on, so executors need neither the
    repository's folder nor a path of the driver.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="keyloom"), "keyloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith((".py", ".json")):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark


def shipped(query):
    """A query or stage whose first argument is the session, which gets the package first."""

    @wraps(query)
    def run(spark: SparkSession, *rest):
        return query(ship(spark), *rest)

    return run
