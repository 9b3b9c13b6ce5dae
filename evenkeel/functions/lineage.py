"""What jobs share: a folder, plans cut where they would be worked out again for every use, this package on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where it is unset, local mode takes one of its own and a cluster raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="evenkeel-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared folder; their lineage ends there."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def stored(rows: DataFrame, most: int = 0) -> DataFrame:
    """The rows as ``cut`` gives them, but by columns: for many wide rows of which each use reads a few columns.

    ``most`` is how many rows a file may have, where not 0, so that a long partition is read by several tasks.
    """
    path = f"{shared_folder(rows.sparkSession)}/evenkeel-rows-{uuid.uuid4().hex}"
    rows.write.option("maxRecordsPerFile", most).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def ship(spark) -> None:
    """Send this package to the executors, once for each context, as Python workers that hold its classes need it."""
    context = spark.sparkContext
    if getattr(context, "_evenkeel_sent", False):
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="evenkeel-")) / "evenkeel.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(Path(top.name) / p.relative_to(top)))
    context.addPyFile(str(target))
    context._evenkeel_sent = True
