"""Makes the package importable in Python workers that the session was not started with a path for."""

from __future__ import annotations

import io
import os
import zipfile
from pathlib import Path

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

from seriesloom.session import work_dir

ROOT = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> SparkSession:
    """Add the package to the session's Python files once, unless PYTHONPATH already names it."""
    context = spark.sparkContext
    named = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if os.path.realpath(ROOT.parent) in named or getattr(context, "_seriesloom_shipped", False):
        return spark
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(ROOT.rglob("*.py")):
            archive.write(file, file.relative_to(ROOT.parent))
    folder = work_dir(spark, "code")
    filesystem, path = pafs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
    filesystem.create_dir(path, recursive=True)
    with filesystem.open_output_stream(f"{path}/seriesloom-code.zip") as out:
        out.write(packed.getvalue())
    context.addPyFile(f"{folder}/seriesloom-code.zip")
    context._seriesloom_shipped = True
    return spark
