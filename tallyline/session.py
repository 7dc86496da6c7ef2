"""Session options used by the tests, the benchmark and local runs."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import tallyline

# Options that matter for results (time zone) or for scale (adaptive execution).
OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoints go when the driver no longer refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    app: str = "tallyline",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the library's options.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster leave both
    unset so that the submit command and the cluster defaults decide.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**OPTIONS, **(extra or {})}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship(session)
    return session


def ship(session: SparkSession) -> None:
    """Send the package to the Python workers, which need not have it installed.

    A session that the package did not build calls this once, or is submitted with the package as
    ``--py-files``.
    """
    root = os.path.dirname(os.path.abspath(tallyline.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tallyline-"), "tallyline.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("tallyline", os.path.relpath(full, root)))
    session.sparkContext.addPyFile(path)
