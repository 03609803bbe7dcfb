"""What a session's executors need."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets the executors' Python import this package, also where it isn't installed; once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        top = Path(__file__).resolve().parents[1]
        at = tempfile.mkdtemp(prefix="trajspark-zip-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{at}/{top.name}", "zip", top.parent, top.name))


def _folder(df: DataFrame) -> None:
    """Sees that the session has a checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        known = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not known:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            known = tempfile.mkdtemp(prefix="trajspark-checkpoint-")
            atexit.register(shutil.rmtree, known, ignore_errors=True)
        context.setCheckpointDir(known)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df computed and kept in the session's checkpoint folder; a local master without one gets a temporary folder."""
    _folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in that folder: computed once, columns that a reader doesn't need aren't read."""
    _folder(df)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, most_rows: int, limit: int = 200_000) -> DataFrame:
    """df with a broadcast hint where it has at most most_rows rows and these are few; else the optimiser decides."""
    return F.broadcast(df) if most_rows <= limit else df
