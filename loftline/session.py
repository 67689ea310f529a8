"""Session helpers: checkpoints in the shared folder, size-checked broadcasts, shipping the package."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where all of Spark is one machine's."""
    context, folder = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; executors need a folder that all of them share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return folder or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. A checkpoint keeps what the optimizer inferred about df, which doubles with each round of a loop; a table does not."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it was counted to have no more than so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent).as_posix())
    folder = tempfile.mkdtemp(prefix="package-")
    name = os.path.join(folder, "loftline-package.zip")
    Path(name).write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
